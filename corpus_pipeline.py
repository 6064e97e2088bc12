"""Corpus pipeline: quality rules, toxicity, near-duplicates, long repeats, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import queries as _queries
from vellum.llm import quality_rules, simhash, suffix_dedup, toxicity
from vellum.llm.common import cut, delete, folder, forget, table, written
from vellum.llm.graph import components
from vellum.session import ship


OWN = ["doc_id", "text", "lang", "source"]


def _wrapped(docs: DataFrame, *, without: tuple[str, ...] = ()) -> DataFrame:
    """The columns that stages read, and all others in one, so that none of these can clash with a made one."""
    return docs.select(*(c for c in docs.columns if c in OWN), F.struct(F.lit(0).alias("-"), *(F.col(f"`{c}`") for c in docs.columns if c not in (*OWN, *without))).alias("_rest"))


def _unwrapped(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    return df.select(*(made[c].alias(c) if c in made else F.col(c) if c in OWN else F.col("_rest").getField(c).alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go.

    Null and empty texts have no words and go; repeated rows are judged each; texts are read whole, one in one task.
    """
    ship(spark)
    return _unwrapped(quality_rules.judge(_wrapped(docs)).where("kept"), docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.7 or more go.

    A score of just 0.7 goes; a very long text is scored whole, some megabytes at a time. Null and empty texts score as a text without evidence; repeated rows are scored each; without labels the score is 0 and all stay.
    """
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(_wrapped(docs), model, carry=["text", "lang", "source", "_rest"])
    return _unwrapped(scored.where("score < 0.7"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays, among equal ids that of the least hash, null ids last.

    Linked are op6's fingerprints and texts whose 5-word shingles have a similarity of 0.8 or more. All null and empty
    texts are one group; a text is shingled in one task, its distinct shingles held as 64-bit numbers. A row is known by
    its id and two hashes of what it holds, which any scan of the input finds again, however its files are dealt;
    of rows that are equal in all of that one stays.
    """
    ship(spark)
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    hashed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.xxhash64(*own).alias("_h"), F.xxhash64(F.lit(1), *reversed(own)).alias("_g"))
    keyed = hashed.select(F.struct(F.col("_doc.doc_id").isNull().alias("none"), "_doc.doc_id", "_h", "_g").alias("_key"), F.col("_doc.text").alias("text"))
    groups = cut(simhash.cluster(keyed, key="_key"))
    of = lambda c: groups.select(F.col("_key").alias(c), F.col("component_id").alias(f"_{c}")).distinct()
    links = simhash.similar(keyed, key="_key", width=5, at_least=0.8)
    labels = components(links.join(of("a"), "a").join(of("b"), "b"), "_a", "_b")
    gone = labels.where(F.col("node") != F.col("label")).select("node._h", "node._g")
    least = groups.where(F.col("_key") == F.col("component_id")).groupBy("_key._h", "_key._g").agg(F.count(F.lit(1)).alias("_n"))
    stay = cut(least.join(gone, ["_h", "_g"], "left_anti"))
    kept = lambda some: hashed.join(stay.where(some).select("_h", "_g"), ["_h", "_g"], "left_semi")
    return kept("_n = 1").unionByName(kept("_n > 1").dropDuplicates(["_h", "_g"])).select("_doc.*")


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that repeat go, with what is left of characters cut in two; documents that had text and have none left go.

    Null texts become empty ones and stay, as empty ones do; all of repeated rows lose what they share, since no copy is the first. A very long text is cut
    in one task, its regions meet those of others in many.
    """
    ship(spark)
    left = suffix_dedup.dedup(_wrapped(docs, without=("n_chars",)), carry=["lang", "source", "_rest"], decoded="text")
    left = left.where((F.col("n_bytes") == 0) | (F.col("text") != ""))
    return _unwrapped(left, docs.columns, n_chars=F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence, with their ids; a null or empty text is its end alone, repeated rows are packed each.

    A very long text is encoded in one task and gives as many pieces as it fills.
    """
    ship(spark)
    return _queries.packed(docs, ids=True)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("SimHash near-duplicates", near_duplicates),
    ("suffix-array dedup", long_repeats),
    ("packing", packing),
]

#: The stages' models are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; of the tables written on the way only the last remains."""
    docs = table(spark, sf_dir, "documents")
    at = f"{folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        before = written()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        forget(spark, before)
        if i:
            delete(spark, f"{at}/{i - 1}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
