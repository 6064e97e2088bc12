"""Readers and writers of logs, glossaries and ligature tables, all through Spark's own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "name string, id string, why string, src string, ts double"


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """One JSON object a line; bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def glossary_rows(terms: DataFrame, language: str = "ko") -> DataFrame:
    """(source, target, tgt_lng): a row for each surface form of terms (term, surfaces, target); terms without target are left out."""
    forms = F.when(F.size("surfaces") > 0, F.array_sort("surfaces")).otherwise(F.array("term"))
    return terms.where(F.col("target").isNotNull()).select(F.explode(forms).alias("source"), "target", F.lit(language).alias("tgt_lng"))


def write_glossary(rows: DataFrame, path: str) -> None:
    rows.select("source", "target", "tgt_lng").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, target string, tgt_lng string").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def glossary_problem(spark: SparkSession, path: str) -> str:
    """Why a glossary file cannot be used, or the empty string: its header must be source,target, and a row must follow."""
    try:
        lines = [r[0] for r in spark.read.text(path).limit(2).collect()]
    except Exception as e:  # noqa: BLE001  any reader's error is the reason
        return f"unreadable: {type(e).__name__}"
    head = [c.strip().strip('"').lower() for c in (lines[0].lstrip("﻿") if lines else "").split(",")]
    if head[:2] != ["source", "target"]:
        return "header is not source,target"
    return "" if len(lines) > 1 else "no rows"


def glossary_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem) of every file of a folder, in one scan: why it cannot be used as a glossary, or the empty string.

    A file that cannot be read has no lines among those that can be, and is told from an empty one by its length. The first line is
    the one of the first place in the first part that Spark cuts the file into. Names and lengths are listed by the driver,
    as Spark lists them for any scan, since its readers leave empty files out.
    """
    name = F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("file")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = spark.createDataFrame([(f.getPath().getName(), f.getLen()) for f in listed if f.isFile() and f.getPath().getName()[0] not in "._"], "file string, length long")
    lines = spark.read.option("ignoreCorruptFiles", True).text(folder)
    lines = lines.select(name, F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"), "value")
    each = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.count(F.lit(1)).alias("n"))
    cells = F.transform(F.split(F.regexp_replace("head", "^\ufeff", ""), ","), lambda c: F.lower(F.btrim(F.btrim(c), F.lit('"'))))
    right = (F.get(cells, F.lit(0)) == "source") & (F.get(cells, F.lit(1)) == "target")
    problem = F.when(F.col("head").isNull() & (F.col("length") > 0), "unreadable").when(~F.coalesce(right, F.lit(False)), "header is not source,target").when(F.col("n") < 2, "no rows").otherwise("")
    return files.join(each, "file", "left").select("file", problem.alias("problem"))


def bad_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """(file, line) of the lines that ``read_events`` skips."""
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("file"), F.col("value").alias("line"))
    told = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.btrim("line") != "").where(told["_bad"].isNotNull())


def write_ligatures(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").parquet(path)


def read_ligatures(spark: SparkSession, path: str) -> DataFrame:
    """Pairs (l, r); files that are no table are left out, and a table that is not there is an empty one."""
    schema = "l string, r string"
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def fonts_without_unicode(lines: DataFrame) -> DataFrame:
    """(doc, fonts): rows of a font listing (doc, line) whose second-last column is no."""
    cells = F.split(F.btrim("line"), r"\s+")
    return lines.groupBy("doc").agg(F.count_if((F.size(cells) >= 2) & (F.element_at(cells, F.greatest(-F.size(cells), F.lit(-2))) == "no")).alias("fonts"))


def user_signature(files: DataFrame) -> DataFrame:
    """(doc, signature) over files (doc, pos, content binary or null, path): contents in order, the path where there is none, nothing for a file that is not given; each after a zero byte."""
    one = F.coalesce(F.col("content"), F.encode("path", "UTF-8"), F.lit(b""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("00"), F.hex(one)).alias("h")))), lambda x: x["h"]), "")
    return files.groupBy("doc").agg(F.left(F.sha2(F.unhex(joined), 256), F.lit(12)).alias("signature"))


def input_stamp(files: DataFrame) -> DataFrame:
    """(doc, stamp) of input files (doc, content binary): tells one input from another under the same name."""
    return files.select("doc", F.left(F.sha2(F.coalesce("content", F.lit(b"")), 256), F.lit(16)).alias("stamp"))


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def replace_table(df: DataFrame, path: str) -> None:
    """Put ``df`` in place of the Parquet table at ``path``, which it may itself be made from.

    The new table is written whole beside the old one before the old one moves away, so a write that fails leaves that as it
    is. A stop between the two moves leaves it under ``<path>.before``, where ``restored`` finds it.
    """
    spark = df.sparkSession
    fs, old = _path(spark, path)
    (_, new), (_, before) = _path(spark, f"{path}.new"), _path(spark, f"{path}.before")
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(old):
        fs.delete(before, True)
        if not fs.rename(old, before):
            raise OSError(f"{path} cannot be moved")
    if not fs.rename(new, old):
        raise OSError(f"{path}.new cannot be moved")
    fs.delete(before, True)


def restored(spark: SparkSession, path: str) -> bool:
    """Whether a table that an interrupted ``replace_table`` had moved away was brought back."""
    fs, old = _path(spark, path)
    _, before = _path(spark, f"{path}.before")
    return bool(not fs.exists(old) and fs.exists(before) and fs.rename(before, old))
