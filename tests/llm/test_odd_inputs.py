"""Defined results on nulls, repeated rows, empty tables, clashing columns and very long texts, and exact sums by hand."""

import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import byte_bpe, embedding_caps, lm_mixing, packing, quality_bayes, quality_rules, queries, simhash, url_rules

BPE, WORDS = public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.path(queries.WORD_BPE)
CLASH = {"_row": 1, "n": 2, "ids": "x", "chunk": "y", "start": 3, "c": 4, "f": 5, "host": "h", "rule": "r", "_text": "t", "bucket": 6, "score": 7.0, "fp": 8}
ROWS = [(None, "null key"), (None, None), (3, "twice the same"), (3, "twice the same"), (4, ""), (5, "long " * 40_000), (6, "ties ties ties")]


def with_clashes(df):
    return df.select("*", *(F.lit(v).alias(c) for c, v in CLASH.items() if c not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(ROWS, "doc_id long, text string"))


def listed(rows):
    return sorted(rows, key=repr)


def test_byte_bpe(spark, docs):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.encode(docs, BPE, public_tokenizers.PATTERN, chunk_chars=1000, overlap=50, spread_chars=1000)
    assert listed((r["doc_id"], list(r["ids"])) for r in found.collect()) == listed((k, core.encode_ordinary(t or "")) for k, t in ROWS)
    none = byte_bpe.encode(docs.where("false"), BPE, public_tokenizers.PATTERN)
    assert byte_bpe.decode(none, BPE).collect() == []


def test_packing(docs):
    core = Tokenizer.from_file(WORDS)
    found = packing.with_sequences(packing.pack(docs, WORDS, end_id=1)).collect()
    assert len({r["sequence_id"] for r in found}) == len(found)
    whole: dict = {}
    for r in found:
        n = len(r["ids"]) // 4
        assert n & (n - 1) == 0 and n <= 2048 and r["bucket"] == n
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for key, text in ROWS:
        ids = core.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = whole[key, len(ids)]
        assert all(ids[a : a + len(p)] == p for a, p in pieces) and sum(len(p) for _, p in pieces) % len(ids) == 0


def test_packing_stage(spark, docs):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["packing"]
    few = docs.where("doc_id is null or doc_id <> 5")
    pieces = stage(spark, few, "").collect()
    sums: dict = {}
    for r in pieces:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + len(r["ids"]) // 4
    core = Tokenizer.from_file(WORDS)
    want: dict = {}
    for key, text in ROWS:
        if key != 5:
            want[key] = want.get(key, 0) + len(core.encode(text or "", add_special_tokens=False).ids) + 1
    assert sums == want
    assert stage(spark, docs.where("false"), "").collect() == []


def test_urls(spark):
    rows = [(None, "http://a.com/x"), (1, None), (2, "no scheme"), (3, "http://www.EXAMPLE.com/en/?q"), (3, "http://www.EXAMPLE.com/en/?q"), (4, "http://x.net/fr/"), (5, "http://" + "a." * 20_000 + "com/")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("z")).withColumn("path", F.lit("p")))
    got = listed((r["page_id"], r["host"][:15], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, queries.URL_RULES).collect())
    assert got == listed([(None, "a.com", "/x", "com/", "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), *[(3, "www.example.com", "/en/", "www.example.com/en/", "allow")] * 2, (4, "x.net", "/fr/", "net/fr/", "block"), (5, ("a." * 9)[:15], "/", "com/", "allow")])


def test_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2, v[0].tolist()), (None, v[0].tolist()), (None, None), (9, (2 * v[1]).tolist())]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)))
    got = embedding_caps.cluster(df).collect()
    assert len(got) == len(rows)
    links = {(r["vec_id"], r["component_id"]): r["n_links"] for r in got if r["vec_id"] is not None}
    assert links[0, 0] == 2 and links[1, 1] == 1 and links[9, 1] == 1 and links[3, 3] == 0
    assert embedding_caps.cluster(df.where("false")).collect() == []


def test_very_long_texts(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 150_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "short text of few words")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "held_out": F.col("doc_id") == 2})
    assert {r["doc_id"]: r["component_id"] for r in simhash.cluster(df).collect()} == {1: 1, 2: 1, 3: 3}
    judged = {r["doc_id"]: r for r in quality_rules.judge(df, keep_text=False).collect()}
    assert judged[1]["n_words"] == 150_000 and judged[1]["kept"] == judged[2]["kept"]
    scores = {r["doc_id"]: r["score"] for r in quality_bayes.score(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).collect()}
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores.values())
    told = {r["doc_id"]: r for r in lm_mixing.score(df, df.where("not held_out"), "held_out").collect()}
    assert told[2]["n_tokens"] == 150_001 and math.isfinite(told[2]["score"]) and told[2]["score"] < 0


def test_quality_bayes_sums_by_hand(spark, monkeypatch):
    """The site levels by exact sums: evidence is taken from the operator, its weights from the formula of moments."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(90):
        host, path = f"h{i % 4}", ("en", "fr")[i % 3 == 0]
        good = (i % 4) / 4 + rng.random() < 0.8
        rows.append((i, " ".join(rng.choice(["alpha", "beta", "gamma", "#", "##"], 60 + i).tolist() if not good else [f"word{k}" for k in rng.integers(0, 900, 80 + i)]), path, host))
        if i % 2:
            labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_bayes.score(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    known = dict(labels)
    base = sum(known.values()) / len(known)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    p = {i: float(known[i]) if i in known else 1 / (1 + math.exp(-got[i]["evidence"] - logit(base))) for i, *_ in rows}
    groups: dict = {}
    for i, _, path, host in rows:
        groups.setdefault((host, path), []).append(p[i])
    hosts: dict = {}
    for (host, _), x in groups.items():
        hosts.setdefault(host, []).extend(x)
    mean = sum(p.values()) / len(p)

    def weight(sets):
        sets = [(x, c) for x, c in sets if len(x) > 1]
        n = sum(len(x) for x, _ in sets)
        spread = max((sum(len(x) * (sum(x) / len(x) - c) ** 2 for x, c in sets) - sum(c * (1 - c) for _, c in sets)) / n, 0)
        within = sum(len(x) * c * (1 - c) for x, c in sets) / n
        return min(max(within / spread - 1 if spread else 1e4, 1.0), 1e4)

    w = weight([(x, mean) for x in hosts.values()])
    centre = {h: (sum(x) + w * mean) / (len(x) + w) for h, x in hosts.items()}
    w = weight([(x, centre[h]) for (h, _), x in groups.items()])
    for i, _, path, host in rows:
        x = groups[host, path]
        site = (sum(x) - p[i] + w * centre[host]) / (len(x) - 1 + w)
        assert got[i]["site"] == pytest.approx(site, abs=1e-9)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-got[i]["evidence"] - logit(site))), abs=1e-9)
    assert len(got) == 90


def test_words_of_slices():
    """Slices of an array are other texts than those at its beginning."""
    import pyarrow as pa

    from vellum.llm import word_ids

    texts = [None, "", " a ", "A\x0bb \x0c", "é  É x y", "  ", "Last One, here."] * 3
    whole = pa.array(texts, pa.string())
    core = Tokenizer.from_file(WORDS)
    for a, b in [(0, 21), (3, 9), (5, 5), (20, 21)]:
        ids, sizes = word_ids.encoder(WORDS).encode(whole.slice(a, b - a))
        wanted = [core.encode(t or "", add_special_tokens=False).ids for t in texts[a:b]]
        assert ids.tolist() == [x for w in wanted for x in w] and sizes.tolist() == [len(w) for w in wanted]
