"""The ledger of events: for each key the last event and how many there were, kept as state of a stream over a log's files.

Each micro-batch hands on the keys that it touched, as files of its own that a batch which is run again replaces, so a
stream that stopped anywhere and starts from its checkpoint leaves each event counted once. The ledger is the
newest of what was handed on for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import stream_events

SCHEMA = "key string, seq long, ts double, name string, note string"
LEDGER = "key string, n long, seq long, ts double, name string, note string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Last(StatefulProcessor):
    """State of a key: the number of its events and the last by (ts, seq), a missing ts being the earliest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long, seq long, ts double, name string, note string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, best = 0, None
        if self.last.exists():
            n, *kept = self.last.get()
            best = tuple(kept)
        rank = lambda r: (r[1] is not None, r[1] or 0.0, r[0] is not None, r[0] or 0)
        for part in rows:
            n += len(part)
            none = part.astype(object).where(part.notna(), None)
            for row in none[["seq", "ts", "name", "note"]].itertuples(index=False, name=None):
                if best is None or rank(row) >= rank(best):
                    best = row
        seq, ts, name, note = best
        seq = None if seq is None else int(seq)
        self.last.update((n, seq, ts, name, note))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "seq": pd.array([seq], "Int64"), "ts": [ts], "name": [name], "note": [note]})

    def close(self) -> None:
        pass


def follow(spark: SparkSession, log: str, out: str, checkpoint: str, *, files: int = 100, partitions: int | None = None) -> None:
    """Take in what the log's JSON files (key, seq, ts, name, note) hold by now and the checkpoint has not seen; bad lines and events without key are skipped.

    partitions: those of the state, fixed by the first run; the session's number of shuffle partitions if not given.
    """
    kept = {c: spark.conf.get(c, None) for c in (_PROVIDER, "spark.sql.shuffle.partitions")}
    spark.conf.set(_PROVIDER, _ROCKS)
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        events = stream_events(spark, log, SCHEMA, files).where("key is not null")
        last = events.groupBy("key").transformWithStateInPandas(Last(), outputStructType=LEDGER, outputMode="Update", timeMode="None")

        def hand_on(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        last.writeStream.foreachBatch(hand_on).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for c, value in kept.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """(key, n, seq, ts, name, note): each key's last event and the number of its events; none where nothing was handed on."""
    try:
        told = spark.read.schema(f"{LEDGER}, batch long").parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
    names = [c.split()[0] for c in LEDGER.split(", ")]
    newest = told.groupBy("key").agg(F.max_by(F.struct(*names[1:]), F.col("batch")).alias("l"))
    return newest.select("key", "l.*")
