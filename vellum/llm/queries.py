"""Queries over the driver's tables: each operator on its whole table, and its digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, embedding_caps, lm_mixing, packing, pair_grammar, quality_bayes, quality_rules, simhash, spelling_variants, suffix_dedup, toxicity, url_rules
from .common import fresh, remainder, table

#: The curated URL rules (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def op5_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    found = quality_bayes.score(docs, labels.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), *(F.round(c, 9).alias(c) for c in ("evidence", "site", "score")), (F.col("score") >= 0.5).alias("kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return lm_mixing.score(docs, docs.where("not held_out"), "held_out")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(~toxicity.held_out())))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_toxic_spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame, ids: bool = False) -> DataFrame:
    """The pieces' places and checksums, and their ids if wanted."""
    pieces = packing.with_sequences(packing.pack(docs, public_tokenizers.path(WORD_BPE), end_id=1))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", *(["ids"] if ids else []))


def op10_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_caps.cluster(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.counted(table(spark, sf_dir, "documents"), spoil=97)
    return spelling_variants.variants(words.where("length(word) >= 5 and n >= 3"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32(conv_id:turn) % 20; nulls count as one space. 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    how = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("_how") == 0, 0).when(F.col("_how") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", "role", "text", how.alias("_how")).withColumn("_copy", copies)
    return rows.select("conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(damaged(rows), rows)


def op13_pair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "grammar")
    pair_grammar.write(table(spark, sf_dir, "documents"), at, public_tokenizers.path(WORD_BPE), end_id=2)
    return pair_grammar.read(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_url_rules, op4_packing, op5_quality_bayes, op6_simhash, op7_suffix_dedup, op8_lm_mixing, op9_byte_bpe, op10_embedding_caps, op11_spelling_variants, op12_conversation_repair, op13_pair_grammar)}


def oracle_sql() -> dict[str, str]:
    return {}
