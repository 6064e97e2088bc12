"""Each operator against a brute-force version, on odd inputs, and on the smallest tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import byte_bpe, embedding_caps, graph, lm_mixing, packing, quality_bayes, quality_rules, queries, simhash, suffix_dedup, toxicity, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component_id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 1.0, "x", 1),
    (3, "word " * 3000, "en", "a", 15000, 1.0, "x", 1),
    (4, "the same text", "en", None, 13, 1.0, "x", 1),
    (4, "the same text", "en", None, 13, 1.0, "x", 1),
    (None, "the same text", None, "a", 13, 1.0, "x", 1),
    (None, "é" * 300, "fr", "b", 300, None, None, None),
    (7, "x" * 70_000 + " end", "en", "a", 70_004, 1.0, "x", 1),
    (8, "one\ntwo\none\n\x0b \n", "en", "a", 16, 1.0, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def labels(spark):
    return spark.createDataFrame([(2, 1, 1), (3, 0, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")


# --- components


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(501, 560)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(label[n] == m for n, m in got.items())
    assert {n for e in edges for n in e if e[0] != e[1]} <= set(got)


# --- 1


def test_chain_equals_enumeration():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(rng.normal(size=(2, 2)), 0.3)
    texts = [rng.normal(size=n) * 3 for n in (1, 2, 5, 7, 1)]
    ends = np.cumsum([len(x) for x in texts])
    starts = ends - [len(x) for x in texts]
    m, forward, _ = chain.run(np.concatenate(texts), starts)
    clean = chain.log_all_clean(forward, starts, ends)
    for k, x in enumerate(texts):
        total, marginal, none = 0.0, np.zeros(len(x)), 0.0
        for y in itertools.product((0, 1), repeat=len(x)):
            p = np.exp((x * y).sum() + 0.3 * y[0] + sum(np.log(chain.t)[a, b] for a, b in itertools.pairwise(y)))
            total, marginal, none = total + p, marginal + p * np.array(y), none + p * (not any(y))
        assert np.allclose(marginal / total, m[starts[k] : ends[k]])
        assert np.isclose(np.log(none / total), clean[k])


def test_slopes_equal_differences_of_the_enumerated_likelihood():
    rng = np.random.default_rng(11)
    lengths, y = np.array([3, 1, 4]), np.array([1, 0, 1])
    ends = np.cumsum(lengths)
    starts, owner = ends - lengths, np.repeat(np.arange(3), lengths)
    e, moves = rng.standard_normal(8), rng.standard_normal(4)

    def likelihood(e, moves):
        total = 0.0
        for k, n in enumerate(lengths):
            weight = {}
            for labels in itertools.product((0, 1), repeat=int(n)):
                v = moves[3] * labels[0] + sum(e[starts[k] + i] * x for i, x in enumerate(labels))
                v += sum({(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}[p] for p in itertools.pairwise(labels))
                weight[labels] = math.exp(v)
            clean = weight[(0,) * int(n)] / sum(weight.values())
            total += math.log(1 - clean if y[k] else clean)
        return total

    chain = toxicity.Chain(np.array([[0.0, moves[0]], [moves[1], moves[2]]]), moves[3])
    by_token, by_move = toxicity.slopes(chain, e, owner, starts, ends, y)
    step = 1e-5
    for got, x, other in ((by_token, e, 0), (by_move, moves, 1)):
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i] += step
            down[i] -= step
            pair = [(likelihood(v, moves) if other == 0 else likelihood(e, v)) for v in (up, down)]
            assert np.isclose(got[i], (pair[0] - pair[1]) / (2 * step), atol=1e-5)


def test_toxicity_learns_a_planted_word(spark):
    rng = np.random.default_rng(1)
    words = ["".join(x) for x in itertools.product("abcd", "efg", "hij")]
    rows = [(i, " ".join([*rng.choice(words, 30), *(["Vile!"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 120"))
    got = toxicity.score(df, model).join(df, "doc_id").where("doc_id >= 120").collect()
    assert all((r["score"] >= 0.7) == (r["toxic"] == 1) for r in got)
    assert all([r["text"][s["start"] : s["end"]] for s in r["spans"]] == ["Vile!"] * r["toxic"] for r in got)


def test_toxicity_odd_inputs(spark, odd, empty):
    model = toxicity.fit(odd, labels(spark))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, model).count() == len(ODD)
    none = toxicity.fit(empty, labels(spark).where("false"))
    assert [r["score"] for r in toxicity.score(odd.where("doc_id = 2"), none).collect()][0] < 0.01
    assert toxicity.score(empty, none).count() == 0


# --- 2


def statistics(text):
    words = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeated = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_statistics(spark, odd, documents):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = spark.createDataFrame(documents[:80], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in quality_rules.statistics(df).collect():
        assert tuple(r[n] for n in names) == statistics(r["text"])


def test_repeats_with_colliding_hashes(spark, odd):
    texts = ["a b c d a b c e a b d a b c", "x y z " * 40, "p q r s t u v w", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for mask in (-1, 1 << 63 >> 1, 0):
        got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.statistics(df, mask=mask).collect()}
        assert got == {i: statistics(t)[-1] for i, t in enumerate(texts)}


def test_estimates_are_a_fixed_point_of_the_steps(spark):
    rng = np.random.default_rng(5)
    p, share, prior = quality_rules.P, 0.75, 30.0
    x = np.concatenate([rng.standard_normal((500, p)) @ rng.standard_normal((p, p)), 40 + rng.standard_normal((60, p))])
    df = spark.createDataFrame([("g", "l", *map(float, v)) for v in x], ", ".join(["_g string", "_lang string", *(f"_x{i} double" for i in range(p))]))
    r = quality_rules.fit(df, share=share, prior=prior).first()
    m = np.array([r[f"m{i}"] for i in range(p)])
    low = np.array([[r[f"l{i}_{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    d2 = (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)
    near = x[np.argsort(d2)[: int(share * len(x))]]
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    scale = np.maximum((q[2] - q[0]) / 1.349, list(quality_rules.FEATURES.values()))
    mean = (near.sum(axis=0) + prior * q[1]) / (len(near) + prior)
    assert np.allclose(m, mean, atol=0.3) and (d2[500:] > 100).all() and np.median(d2[:500]) < 15
    off = (near - mean).T @ (near - mean) + prior * np.outer(q[1] - mean, q[1] - mean) + prior * np.diag(scale**2)
    widen = share / quality_rules._chi(quality_rules._quantile(share, p // 2), p // 2 + 1)
    assert np.allclose(np.log(np.linalg.det(low @ low.T)), np.log(np.linalg.det(off / (len(near) + prior) * widen)), atol=0.5)


def test_outliers_go_and_plain_rows_stay(spark, odd, empty):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(w + ("%%%***" if i % 20 == 0 else "") for w in rng.choice(vocabulary, 120)), "en", "a") for i in range(200)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept == (i % 20 != 0) for i, kept in got.items())
    judged = quality_rules.judge(odd).collect()
    assert len(judged) == len(ODD)
    assert not any(r["kept"] for r in judged if r["n_words"] < 50)
    assert quality_rules.judge(empty).count() == 0


# --- 3


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "http://a.example.com/en/1?x#y", "http://www.example.com/en/", "http://x.net/es/a", "http://xnet/es/", "http://q.net?/es/", "http://a://b/c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.judge(df, queries.URL_RULES).collect():
        u = urls[r["page_id"]] or ""
        after = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert r["verdict"] == max(fits)[2]


def test_mined_rules_equal_enumeration(spark):
    rng = np.random.default_rng(3)
    rows = [(sorted({f"t{i}" for i in rng.integers(0, 5, 3)}), "block" if rng.random() < 0.5 else "allow") for _ in range(60)]
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support=0.05, confidence=0.6, least=1).collect()}
    every = {}
    for n in range(1, 5):
        for a in itertools.combinations([f"t{i}" for i in range(5)], n):
            held = [v for t, v in rows if set(a) <= set(t)]
            for v in ("allow", "block"):
                if held.count(v) >= 0.05 * len(rows) and held.count(v) / len(held) >= 0.6:
                    every[a, v] = held.count(v) / len(held)
    want = {k: c for k, c in every.items() if not any(set(b) < set(k[0]) and v == k[1] and d >= c for (b, v), d in every.items())}
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k], want[k]) for k in got)


def test_tokens_that_stand_together_are_one_item(spark):
    rows = [(["a", "b", "c"], "block")] * 12 + [(["c", "d"], "allow")] * 12 + [(["c"], "allow")]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    assert {r["token"]: r["item"] for r in url_rules.merged(labelled).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert {(*r["antecedent"], r["verdict"]) for r in url_rules.mine(labelled, support=0.01, confidence=0.8).collect()} == {("a", "block"), ("d", "allow")}
    assert url_rules.mine(labelled.limit(5), support=0.01, confidence=0.8).count() == 0


def test_open_urls_take_the_best_mined_rule(spark):
    rng = np.random.default_rng(4)
    part = lambda *x: str(rng.choice(list(x)))
    urls = [f"http://{part('www', 'm')}.{part('a', 'b', 'c')}.{part('com', 'net', 'org')}/{part('es', 'en', 'fr')}/{part('p', 'q')}" for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge(df, queries.URL_RULES, confidence=0.6).collect()}
    host, path, rest = url_rules.parts(F.col("url"))
    tokens = {r["page_id"]: set(r["t"]) for r in df.select("page_id", url_rules.tokens(host, path, rest).alias("t")).collect()}
    fixed = df.select("page_id", url_rules.tokens(host, path, rest).alias("tokens"), url_rules.curated(host, path, queries.URL_RULES)[1].alias("verdict")).where("verdict is not null and size(tokens) > 0")
    rules = url_rules.mine(fixed.select("tokens", "verdict"), support=0.002, confidence=0.6).collect()
    assert rules
    for i, r in got.items():
        if r["rule"] is None:
            best = max(((x["confidence"], x["support"], -len(x["antecedent"]), x["verdict"] != "allow", " ".join(x["antecedent"]), x["verdict"]) for x in rules if set(x["antecedent"]) <= tokens[i]), default=None)
            assert (r["verdict"], r["mined"]) == ((best[5], best[4]) if best else ("allow", None))


def test_urls_of_an_empty_table(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


# --- 4


def test_packing(spark, odd, documents, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate([*documents[:60], *((0, r[1] or "") for r in ODD)])], "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in queries.packed(df, ids=True).collect():
        found[r["doc_id"]].append(r)
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(found[r["doc_id"]], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in pieces) == ids.tobytes()
        assert all(p["start"] + p["length"] == q["start"] for p, q in itertools.pairwise(pieces))
        assert all(p["length"] & (p["length"] - 1) == 0 and p["length"] <= 2048 and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in pieces)
    every = [p["sequence_id"] for ps in found.values() for p in ps]
    assert len(every) == len(set(every))
    assert packing.pack(empty, public_tokenizers.path(queries.WORD_BPE), end_id=1).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(odd, "", end_id=1, longest=3)


# --- 5


def test_quality_bayes(spark, odd, empty):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality_bayes.score(df, known.where("doc_id % 2 = 0")).collect()}
    held = [(r["quality"], got[r["doc_id"]]) for r in known.where("doc_id % 2 = 1").collect()]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert quality_bayes.score(odd, labels(spark)).count() == len(ODD)
    assert all(abs(r["score"] - 0.5) < 1e-6 for r in quality_bayes.score(odd, labels(spark).where("false")).collect())
    assert quality_bayes.score(empty, labels(spark)).count() == 0


# --- 6


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []


def test_fingerprints(documents):
    for text in [t for _, t in documents[:40]] + [r[1] or "" for r in ODD]:
        own = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
        want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in own) > len(own))
        assert simhash.fingerprint(text.encode()) == want


def test_every_pair_within_the_radius_meets():
    kept = [m & (1 << 64) - 1 for m in simhash.masks(2)]
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in kept)


@pytest.mark.parametrize("bucket", [3, 64])
def test_links_connect_all_within_the_radius(spark, bucket):
    rng = np.random.default_rng(4)
    own = set()
    for base in rng.integers(-(2**63), 2**63 - 1, 4):
        for _ in range(50):
            x = int(base)
            for i in rng.choice(63, rng.integers(0, 4), replace=False):
                x ^= 1 << int(i)
            own.add(x)
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in own], "fp long"), bucket=bucket).collect()]
    assert all(far(a, b) <= 2 for a, b in found)

    def groups(edges):
        label = {x: x for x in own}
        while True:
            before = dict(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    assert groups(found) == groups([(a, b) for a, b in itertools.combinations(own, 2) if far(a, b) <= 2])


def test_simhash_odd_inputs(odd, empty):
    got = simhash.cluster(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash.cluster(empty).count() == 0


# --- 7


def without_repeats(texts, span):
    seen = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("block_regions", [4096, 3])
def test_repeats_equal_brute_force(spark, block_regions):
    rng = np.random.default_rng(5)
    made = lambda n: bytes(rng.integers(97, 101, n).astype(np.uint8))
    passages = [made(n) for n in (30, 60, 25, 90)]
    texts = [b"", b"a" * 200, b"ab" * 90, b"short", made(19), made(20)]
    for _ in range(120):
        texts.append(b"".join([made(int(rng.integers(0, 50))), *(passages[rng.integers(0, 4)] + made(int(rng.integers(0, 20))) for _ in range(rng.integers(0, 3)))]))
    texts += [texts[20]] * 3 + ["é".encode() * 60]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)] + [(None, None), (3, "short"), (3, "short")], "doc_id long, text string")
    got = suffix_dedup.dedup(df, span=20, gram=6, block_regions=block_regions).collect()
    want = without_repeats([*texts, b"", b"short", b"short"], 20)
    assert collections.Counter(bytes(r["kept"]) for r in got) == collections.Counter(want)
    assert all(r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)


def test_suffixes_are_sorted_again_only_where_they_tie(monkeypatch):
    rng = np.random.default_rng(2)
    for n, kinds in ((3, 2), (40, 2), (300, 3), (3000, 40)):
        s = rng.integers(0, kinds, n).astype(np.uint16)
        s[-2:] = 1, 0
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())  # noqa: B023
    s = rng.integers(1, 200, 20_000).astype(np.uint16)
    s[12_000:14_000], s[-1] = s[1000:3000], 0
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **kind: sizes.append(len(x)) or argsort(x, **kind))
    suffix_dedup.suffix_array(s)
    assert len(sizes) > 5 and sum(sizes) < 3 * len(s)


def test_scan_of_a_text_beyond_24_bits_of_places(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    whole = suffix_dedup.Scan(data, np.array([3000]), 40, 12)
    monkeypatch.setattr(suffix_dedup, "_PLACE", np.uint64((1 << 11) - 1))
    again = suffix_dedup.Scan(data, np.array([3000]), 40, 12)
    assert len(whole.low) == len(again.low) > 20


def test_suffix_odd_inputs(odd, empty):
    assert suffix_dedup.dedup(odd).count() == len(ODD)
    assert suffix_dedup.dedup(empty).count() == 0
    assert suffix_dedup.dedup(odd.where("false"), decoded="text", carry=["lang"]).columns == ["doc_id", "n_bytes", "spans", "text", "lang"]


# --- 8


def mixing_model(texts):
    """The model of some texts, fitted without Spark."""
    L = lm_mixing  # noqa: N806
    c = collections.Counter(w for t in texts for w in L.words(t))
    ranked = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    totals, once = np.zeros(L.BUCKETS, np.int64), np.zeros(L.BUCKETS, np.int64)
    for w, k in ranked[L.CODED :]:
        totals[L.bucket(w)] += k
        once[L.bucket(w)] += k == 1
    code = L.Code(ranked[: L.LOCAL], totals, len(texts))
    tables = [np.zeros(n, np.int32) for n in ((L.COMMON + 1) * code.symbols, 2 << 12, 2 << 12)]
    L.count_bits(code, tables, texts, 12)
    spell = [np.zeros(2 << L.SPELL_BITS, np.int32) for _ in range(4)]
    L.count_spelling(spell, [w for w, k in c.items() if k == 1])
    pack = lambda t: L.packed(t.reshape(-1, 2).astype(np.int64))
    return L.Model(code, tables[0].astype(np.int64), [pack(t) for t in tables[1:]], [pack(t) for t in spell], totals, once)


def scored_by_hand(model, ids):
    """Log10 probability of one text's symbols, bit by bit."""
    L, code = lm_mixing, model.code  # noqa: N806
    w, last, total = L._starts(), [-8 + k / 2 for k in range(33)], 0.0
    one = lambda x: L.scrambled(np.array([x]))
    for begin in range(0, len(ids), L.BLOCK):
        seen = []
        for i in range(begin, min(begin + L.BLOCK, len(ids))):
            before, two = (int(ids[i - 1]) + 1 if i else 0), (int(ids[i - 2]) + 1 if i > 1 else 0)
            skip = next((int(ids[j]) + 1 for j in range(i - 1, -1, -1) if ids[j] < min(L.COMMON, code.coded)), 0)
            symbol = code.symbol[ids[i]]
            for k in range(code.at[symbol], code.at[symbol] + code.length[symbol]):
                node, y = int(code.node[k]), 2 * int(code.bit[k]) - 1
                slot = [int(((h ^ code.hash[k : k + 1]) * L._K >> np.uint64(64 - model.table_bits))[0]) for h in (one(before * 2 + 1), one((two << 20) + before + (1 << 50)))]
                c = [int(t[x]) for t, x in zip(model.tables, slot, strict=True)]
                x = np.array([model.skip[skip * code.nodes + node], *(L.STRETCHED[v] for v in c)], float)
                gate = (c[0] >> 6) * L.LEVELS + (c[1] >> 6)
                dot = float(np.clip(w[gate] @ x, -12, 12))
                cell = round((min(max(dot, -8), 8) + 8) * 2)
                total += math.log1p(math.exp(-y * (dot + last[cell]) / 2))
                seen.append((gate, x, y, dot, cell, (dot + last[cell]) / 2))
        for gate in {g for g, *_ in seen}:
            own = [z for z in seen if z[0] == gate]
            w[gate] += L.RATE / math.sqrt(1 + len(own)) * sum(y / (1 + math.exp(y * dot)) * x for _, x, y, dot, _, _ in own)
        for cell in {z[4] for z in seen}:
            own = [z for z in seen if z[4] == cell]
            last[cell] += L.REFINE / math.sqrt(1 + len(own)) * sum(y / (1 + math.exp(y * r)) for _, _, y, _, _, r in own)
    return -total / math.log(10)


def test_mixing_equals_brute_force(documents):
    texts = [t.encode() for _, t in documents[:40]]
    model = mixing_model(texts[:30])
    code = model.code
    assert np.isclose(sum(2.0**-n for n in code.length), 1)
    ids = [code.ids(lm_mixing.words(t)) for t in texts[28:36]]
    together = model.score(lm_mixing.Tokens(code, ids), len(ids))
    assert np.allclose(together, [scored_by_hand(model, i) for i in ids], rtol=2e-3)
    first = [10 ** model.score(lm_mixing.Tokens(code, [np.array([k])]), 1)[0] for k in np.unique(code.symbol, return_index=True)[1]]
    assert np.isclose(sum(first), 1, atol=1e-4)
    words = [[(b"novelword", 2), (b"other", 1)], [], [(b"x" * 3000, 1)]]
    alone = [model.novel([w])[0] for w in words]
    assert np.allclose(model.novel(words), alone, rtol=1e-4) and alone[1] == 0 and max(alone[0], alone[2]) < 0


def test_pieces_of_counts_add_up():
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, hi, lm_mixing.PIECE) * (rng.random(lm_mixing.PIECE) < p) for hi, p in ((2, 0.01), (300, 0.9), (1 << 40, 0.3), (70_000, 0.001))]
    total = np.zeros(lm_mixing.PIECE, np.int64)
    for t in tables:
        lm_mixing._added(lm_mixing._small(t), total)
    assert (total == sum(tables)).all()


def test_base_scores_and_gain(spark, documents, odd, empty):
    got = {r["doc_id"]: r for r in queries.op8_lm_mixing(spark, SF).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = {d: [*t.encode().lower().split(), None] for d, t in documents}
    c = collections.Counter(w for d, ws in words.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (got[d]["held_out"], got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (held(d), len(ws), sum(c[w] > 0 for w in ws), n)
        assert np.isclose(got[d]["base_score"], want)
        assert got[d]["score"] < 0
    flagged = odd.select("doc_id", "text", (F.col("doc_id") == 7).alias("held_out")).na.fill(False)
    assert lm_mixing.score(flagged, flagged.where("not held_out"), "held_out").count() == len(ODD)
    assert lm_mixing.score(flagged, flagged.where("false"), "held_out").count() == len(ODD)
    nothing = empty.select("doc_id", "text", F.lit(True).alias("held_out"))
    assert lm_mixing.score(nothing, nothing, "held_out").count() == 0


# --- 9


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 3), (1 << 16, 1 << 10)])
def test_byte_bpe_round_trip(spark, documents, chunk, overlap):
    path = public_tokenizers.path(queries.BYTE_BPE)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    texts = [t for _, t in documents[:25]] + [r[1] or "" for r in ODD] + [" " * 500 + "x", "it's  \n\n\t we'll " * 40, "日本語テキスト" * 60, "\x1c\x1d a\x85b " * 40, " " * 900]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    for r in byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap), path).collect():
        text = texts[r["doc_id"]] if r["doc_id"] != 999 else ""
        assert list(r["ids"]) == plain.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_byte_bpe_digests(spark, documents):
    path = public_tokenizers.path(queries.BYTE_BPE)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, SF).collect()}
    for d, t in documents:
        ids = plain.encode_ordinary(t)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


# --- 10


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, block):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((300, 32))
    near = a[:150] / np.linalg.norm(a[:150], axis=1)[:, None] + 0.045 * rng.standard_normal((150, 32))
    crowd = a[0] + 0.02 * rng.standard_normal((80, 32))
    x = np.concatenate([a, near, crowd, np.repeat(a[5:6], 4, axis=0), a[7:8] * 3]).astype(np.float32)
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] * 32), (9005, []), (9006, [float("inf")] * 32), (9007, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_caps.cluster(df, block=block).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert len(got) == len(x) + len(odd)
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.9 * linked.sum()
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(len(x)))
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in odd)
    assert embedding_caps.cluster(df.where("false")).count() == 0


def test_recall_at_twenty_thousand(spark):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((10_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((10_000, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.905 * a + math.sqrt(1 - 0.905**2) * b / np.linalg.norm(b, axis=1)[:, None]
    x = np.concatenate([a, b]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {r["vec_id"]: r["n_links"] for r in embedding_caps.cluster(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = np.concatenate([(u[i : i + 2000] @ u.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(u), 2000)])
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.9 * true.sum() >= 9_000


# --- pipeline


CLASHING = ["n_words", "m0", "_lines", "kept", "n_bytes", "spans", "_row", "score", "_g", "th", "fp", "component_id"]


def test_pipeline_carries_clashing_columns_nulls_and_empty_tables(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    base = odd.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        for frame in (docs, base, base.where("false")):
            got = stage(spark, frame, SF)
            assert got.columns == frame.columns, name
            assert all(tuple(r[c] for c in CLASHING) == tuple(range(len(CLASHING))) for r in got.collect())
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[3][1](spark, base.where("doc_id in (1, 2, 8)"), SF).collect()} == {1, 2, 8}


def test_pipeline_by_brute_force(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in queries.op2_quality_rules(spark, SF).collect()}
    frame, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF).cache()
        seen.append(frame.collect())
    good, mild, single, left, packed = seen
    assert {r["doc_id"] for r in good} == {d for d, k in verdicts.items() if k}
    assert {r["doc_id"] for r in mild} <= {r["doc_id"] for r in good}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode()) for r in mild}
    shingles = {r["doc_id"]: {*zip(*(r["text"].encode().lower().split()[i:] for i in range(5)), strict=False)} for r in mild}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) > 0
    label = {d: d for d in prints}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2 or alike(shingles[a], shingles[b])]
    for _ in range(4):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"] for r in single} == {d for d, m in label.items() if d == m}
    want = without_repeats([r["text"].encode() for r in single], 200)
    assert {r["doc_id"]: r["text"] for r in left} == {r["doc_id"]: w.decode("utf-8", "ignore") for r, w in zip(single, want, strict=True) if w}
    assert all(frame.columns for frame in (docs,)) and all(set(r.asDict()) == set(docs.columns) for r in left)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


@pytest.mark.parametrize("bucket", [64, 2])
def test_similar_equals_brute_force(spark, documents, bucket):
    sets = {d: set(simhash.shingle_set(t.encode()).tolist()) for d, t in documents}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    label, got = ({d: d for d in sets} for _ in range(2))
    links = simhash.similar(spark.createDataFrame(documents, "doc_id long, text string"), bucket=bucket).collect()
    for of, pairs in ((label, want), (got, [tuple(r) for r in links])):
        for _ in range(len(sets)):
            before = dict(of)
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
            if of == before:
                break
    assert {d: m for d, m in got.items() if sets[d]} == {d: m for d, m in label.items() if sets[d]}
    assert any(sets[a] != sets[b] for a, b in want)


@pytest.mark.parametrize("tile", [2048, 300])
def test_crowded_buckets_lose_no_link(spark, tile):
    core = " ".join(f"w{i}" for i in range(64))
    texts = [" ".join([core, *(f"{k}-{i}" for i in range(10))]) for k in range(1200)]  # 60 of 80 shingles of two of them are common: no link
    texts += [" ".join([*t.split()[:67], *(f"x{k}-{i}" for i in range(7))]) for k, t in enumerate(texts[:40])]  # 63 of 77
    links = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile=tile).collect()
    assert sorted({tuple(sorted(r)) for r in links}) == [(k, 1200 + k) for k in range(40)]


def test_common_shingles_of_two_parts():
    rng = np.random.default_rng(1)
    parts = [[np.unique(rng.integers(0, 400, n) ** 2) for n in rng.integers(1, 90, rows)] for rows in (30, 50)]
    listed = [(np.concatenate(p), np.repeat(np.arange(len(p)), [len(x) for x in p])) for p in parts]
    listed = [tuple(x[np.argsort(t, kind="stable")] for x in (t, own)) for t, own in listed]
    assert simhash._common(*listed, 30, 50).tolist() == [[len(np.intersect1d(x, y)) for y in parts[1]] for x in parts[0]]


def test_near_duplicate_stage_links_five_word_similarity(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    near, far = [*words[:30], "other", *words[31:]], [w if i % 10 else "x" for i, w in enumerate(words)]
    rows = [(None, " ".join(near)), (1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, ""), (5, None)]
    assert (simhash.fingerprint(rows[1][1].encode()) ^ simhash.fingerprint(rows[2][1].encode())).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3, 4]


def test_near_duplicate_stage_outlives_another_dealing_of_its_files(spark, monkeypatch, tmp_path):
    """The cores that are alive decide how files are packed into partitions; rows must be known again all the same."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_ones = docs.limit(3).unionByName(docs.limit(3)).withColumn("doc_id", F.lit(None).cast("long"))
    at = str(tmp_path / "docs")
    docs.unionByName(docs.where("doc_id < 20")).unionByName(odd_ones).repartition(13).write.parquet(at)
    packing = "spark.sql.files.minPartitionNum"
    listed = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect())
    wanted = listed(corpus_pipeline.near_duplicates(spark, spark.read.parquet(at), SF))
    whole = simhash.cluster

    def then_fewer(*a, **k):
        found = whole(*a, **k).collect()
        spark.conf.set(packing, "2")
        return spark.createDataFrame(found, whole(*a, **k).schema)

    monkeypatch.setattr(simhash, "cluster", then_fewer)
    try:
        spark.conf.set(packing, "13")
        left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(at), SF)
        spark.conf.set(packing, "5")
        assert listed(left) == wanted
    finally:
        spark.conf.unset(packing)
    assert len({r[1] for r in wanted if not r[0]}) == len([r for r in wanted if not r[0]])
