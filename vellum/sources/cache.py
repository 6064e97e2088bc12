"""The stored cache of translations: a table in directories by the first signs of its keys.

Keys are digests (``validate.cache_key``), so their first signs deal them evenly and say in which directory a key lies.
A merge reads and rewrites the directories that its rows fall into and leaves the files of all others alone; a lookup
reads those that its items ask for. The names of directories go through the driver, 16 ** ``SIGNS`` at most.

A merge replaces a directory when all its new files are written; one at a time may run. Rows without a key are neither
stored nor found. Of equal keys the row of the latest ``ts`` counts, then that of most attempts, then the least target.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate

#: First signs of a key that name its directory: 256 for hexadecimal keys.
SIGNS = 2
COLUMNS = "k string, model string, src string, tgt string, attempts int, ts double"
#: Rows of one file, about.
FILE_ROWS = 2_000_000
#: A merge writes whole directories anew, so what texts take up counts at each: a third less than by Spark's own choice.
CODEC = "zstd"
#: Stored bytes of a directory, about, that one task reads in a merge.
PART_BYTES = 256 << 20


def _filed(df: DataFrame) -> DataFrame:
    return df.where(F.col("k").isNotNull()).withColumn("bucket", F.lower(F.left("k", F.lit(SIGNS))))


def _buckets(filed: DataFrame) -> list[str]:
    return sorted(r[0] for r in filed.select("bucket").distinct().collect())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows with their ``bucket``; a table that was never written has none."""
    schema = f"{COLUMNS}, bucket string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge(spark: SparkSession, path: str, new: DataFrame, longest: int = validate.LONGEST) -> int:
    """Put the rows (k, model, src, tgt, attempts, ts) in place of older ones of their keys; the number of directories rewritten.

    Stored rows are dealt once, by directory: for the choice among a key's rows and for writing alike.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    touched = _buckets(_filed(new.select("k")))
    if not touched:
        return 0
    fresh = _filed(validate.upsert(new.select(*names), longest))
    old = read(spark, path).where(F.col("bucket").isin(touched))
    if old.inputFiles():
        each = F.lit(1 + int(old._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // (len(touched) * PART_BYTES))
        both = old.select(*names, "bucket").unionByName(fresh.select(*names, "bucket"))
        dealt = validate.upsert(both.withColumn("part", F.pmod(F.xxhash64("k"), each)).repartition("bucket", "part"), longest, ("bucket", "part"))
    else:
        # by directory; a large one is dealt over tasks by Spark itself, where it is out of proportion
        dealt = fresh.hint("rebalance", F.col("bucket"))
    typed = dealt.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in COLUMNS.split(", ")), "bucket")
    typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).option("compression", CODEC).partitionBy("bucket").parquet(path)
    return len(touched)


def lookup(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """Items (k, ...) with the stored ``tgt``, null where there is none."""
    asked = _filed(items.select("k"))
    found = read(spark, path).where(F.col("bucket").isin(_buckets(asked)))
    return validate.lookup(items, found)
