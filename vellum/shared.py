"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local master without one gets a folder under its warehouse."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir().rstrip("/")


def place(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table", packed: bool = False) -> DataFrame:
    """``df`` as a table, so that it is computed once and a lost executor costs nothing of it; packed: by zstd, for tables of texts."""
    at = place(df.sparkSession, kind)
    (df.write.option("compression", "zstd") if packed else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
