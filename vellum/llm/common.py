"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import threading
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word is a maximal run without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


_own = threading.local()


def _written() -> list[str]:
    """The tables that this thread has written: two queries in threads do not delete each other's."""
    if not hasattr(_own, "places"):
        _own.places = []
    return _own.places


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read again.

    Its lineage is cut, an executor's loss costs nothing of it, and what reads it knows its size: a checkpoint
    would carry estimates on, which grow without bound where joins are repeated.
    """
    spark = df.sparkSession
    at = fresh(spark, "table")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fresh(spark: SparkSession, kind: str) -> str:
    """A place in the shared folder that nothing else uses."""
    at = f"{folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written().append(at)
    return at


def written() -> int:
    """How many tables ``cut`` has written so far in this thread, for ``forget``."""
    return len(_written())


def forget(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``cut`` has written since; for when all that reads them has been written itself."""
    for at in _written()[since:]:
        delete(spark, at)
    del _written()[since:]


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate results: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, is one set under the warehouse folder; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))) % modulus


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty, without decoding to str."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """What a worker has freed goes back to the machine, where the C library can do that: idle workers then hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def steps(texts: Sequence[bytes | str | None], size: int) -> Iterator[slice]:
    """Successive texts of about ``size`` bytes or characters together; a longer text is a step of its own."""
    a = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and held + n > size:
            yield slice(a, i)
            a, held = i, 0
        held += n + 1
    if a < len(texts):
        yield slice(a, len(texts))


def join_hot(big: DataFrame, small: DataFrame, key: str | list[str], weight: str, most: int = 2_000) -> DataFrame:
    """Inner join on ``key`` with one row a key in ``small``, whose ``weight`` is the number of ``big``'s rows of the key.

    Keys with over 1/most of all rows, hence fewer than ``most``, are broadcast, so that no task gets all rows of such a key.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    least = max(10_000, total // most)
    heavy = small.where(F.col(weight) > least).drop(weight)
    if heavy.isEmpty():
        return big.join(small.drop(weight), key)
    rest = big.join(F.broadcast(heavy.select(key)), key, "left_anti").join(small.where(F.col(weight) <= least).drop(weight), key)
    return big.join(F.broadcast(heavy), key).unionByName(rest)
