"""Re-Pair shards: exact round trips, places, random access and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import pair_grammar as G
from vellum.llm import queries, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    """(doc_id, start, ids) by the tokenizer itself; rows in the order of their keys, nulls first."""
    core = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in rows:
        ids = core.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("vocabulary", [300, 49_408, 100_000])
@pytest.mark.parametrize("kind", ["random", "repeats", "one", "few"])
def test_shard_round_trip(vocabulary, kind):
    rng = np.random.default_rng(1)
    ids = {
        "random": rng.integers(0, vocabulary, 5000),
        "repeats": np.tile(rng.integers(0, vocabulary, 37), 200),
        "one": np.full(4001, 7),
        "few": rng.integers(0, 3, 6000),
    }[kind].astype(np.uint32)
    sizes = [1000, len(ids) - 1000]
    body = G.pack_shard(ids, sizes, 2, vocabulary, least=3, stride=16)
    shard = G.Shard(body)
    assert shard.sizes.tolist() == sizes and shard.n_ids == len(ids)
    assert (shard.ids() == ids).all()
    for a, b in [(0, 1), (17, 18), (999, 1003), (5, len(ids)), (len(ids) - 1, len(ids) + 9), (30, 30)]:
        assert (shard.ids(a, b) == ids[a:b]).all()
    if kind in ("repeats", "one"):
        assert len(shard.symbols) < len(ids) / 20


def test_rules_of_a_shard():
    ids = np.array([5, 6, 7] * 50 + [2], np.uint32)
    symbols, rules, lengths = G.compress(ids, 2, 100, least=2)
    assert symbols[-1] == 2 and 2 not in rules
    for i, (a, b) in enumerate(rules.tolist()):
        assert a < 100 + i and b < 100 + i
        assert lengths[i] == sum(1 if x < 100 else lengths[x - 100] for x in (a, b))


def test_places_do_not_overlap():
    s = np.array([1, 1, 1, 1, 1, 3, 1, 3, 3], np.uint16)
    keys = np.array([(1 << 16) | 1, (1 << 16) | 3, (3 << 16) | 3], np.uint32)
    at, rank = G._places(s, keys)
    assert (np.diff(at) > 1).all()
    assert all(keys[r] == (int(s[a]) << 16 | int(s[a + 1])) for a, r in zip(at, rank))


def test_a_shard_of_another_format():
    with pytest.raises(ValueError, match="not a shard"):
        G.Shard(b"XXXX" + bytes(60))


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    wanted = [(k, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, s, i in plain(rows)]
    found = [tuple(r) for r in queries.op13_pair_grammar(spark, SF).orderBy("doc_id").collect()]
    assert found == wanted


def test_many_shards_and_ranges(spark, tmp_path):
    rows = [(i, f"the cat number {i} sat on the mat and the cat sat again " * (1 + i % 5)) for i in range(300)]
    at = str(tmp_path / "shards")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    G.write(df, at, PATH, end_id=2, shard=500, least=3)
    wanted = plain(rows)
    found = {r["doc_id"]: (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in G.read(spark, at).collect()}
    assert found == {k: (s, i) for k, s, i in wanted}
    assert spark.read.parquet(at).count() > 10
    flat = [x for _, _, i in wanted for x in i]
    asked = [(0, 1), (490, 1700), (len(flat) - 3, len(flat) + 50), (77, 77), (-4, 3), (len(flat), len(flat) + 1)]
    ranges = spark.createDataFrame(asked, "begin long, end long")
    got: dict = {}
    for r in G.cut_out(spark, at, ranges).orderBy("begin", "first").collect():
        got.setdefault((r["begin"], r["end"]), []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {(a, b): flat[a:b] for a, b in asked[:3]}


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, key string, part int, start long, ids int, _h int, _m int"
    rows = [(None, "same"), (None, None), (4, "same text"), (4, "same text"), (4, ""), (9, "word " * 30_000), (-1, "\x1c two　three <|endoftext|>")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], schema)
    at = str(tmp_path / "odd")
    G.write(df, at, PATH, end_id=2)
    found = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in G.read(spark, at).orderBy("start").collect()]
    # the order of rows of one key is that of their texts' hashes
    hashed = [tuple(r) for r in df.orderBy("doc_id", F.xxhash64("text")).select("doc_id", "text").collect()]
    assert found == plain(hashed)


def test_empty_table(spark, tmp_path):
    at = str(tmp_path / "none")
    G.write(spark.createDataFrame([], "doc_id string, text string"), at, PATH, end_id=2)
    assert G.read(spark, at).collect() == []
    assert G.read(spark, at).columns == ["doc_id", "start", "n_tokens", "ids"]


WORDS = [None, "", " a ", "Hello, World!! it's ok.", "don't", "ÀÉß ÿ÷×", "İstanbul", "x.,y", "a\u0301b", "\xa0nbsp\u3000x", "<|endoftext|>.", "e.g.", "...", "ABC...?!", "ŒUVRE", "word" * 5000, "a\x85b\u2028c", "\x00x y\x01"]


@pytest.mark.parametrize("texts", [WORDS, [*WORDS, "a\x1cb"], [], [None, "!"]])
def test_words_of_a_batch(texts):
    core = Tokenizer.from_file(PATH)
    ids, sizes = word_ids.encoder(PATH).encode(pa.array(texts, pa.string()))
    wanted = [core.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == [x for w in wanted for x in w]
