"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
from conftest import SF

from vellum.llm import queries
from vellum.llm import spelling_variants as S


def neighbours(word, signs):
    """All words one edit from a word, of the given signs."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in signs:
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1)}
    return out - {word}


def plain(counts):
    signs = {c for w in counts for c in w}
    near = {w: [v for v in neighbours(w, signs) if v in counts] for w in counts}
    best = {w: min((-counts[v], v) for v in vs) if vs else None for w, vs in near.items()}
    form = {w: b[1] if b and -b[0] >= 2 * counts[w] else None for w, b in best.items()}
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {w: (form[w], root[w], counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def run_counts(rows):
    counts = Counter()
    for key, text in rows:
        for w in S.RUN.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{key}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = plain(run_counts(rows))
    assert got(queries.op11_spelling_variants(spark, SF)) == wanted
    assert sum(w[3] > 0 for w in wanted.values()) > 50 and any(w[0] for w in wanted.values())


@pytest.mark.parametrize("halves, most, few", [(40_000, 20_000, 8), (60, 7, 2)])
def test_random_words(spark, monkeypatch, halves, most, few):
    for name, value in (("HALVES", halves), ("MOST", most), ("FEW", few)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(5)
    counts = {"".join(rng.choices("abé", k=rng.randint(2, 9))): rng.choice([1, 2, 3, 4, 4, 8, 50]) for _ in range(1500)}
    counts |= {"x" * n: 3 for n in (90, 91, 92, 200)} | {"x" * 45 + c + "x" * 45: 9 for c in "abcdefghijkl"}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(S.variants(df)) == plain(counts)


def test_one_apart():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        assert S.one_apart(a, b) == (b in neighbours(a, "ab"))


def test_odd_rows(spark):
    texts = [None, "", "Straße STRASSE straßes", "éé ÉÉéée Ééééé", "x" * 70_000, "x" * 70_001, "don't 3cats naïve NAÏVE naïve", "word" * 2]
    rows = [(k, t) for k in (None, 5, 5, 6) for t in texts]
    schema = "doc_id long, text string, word string, n int, side string, half string, shard int, root string"
    df = spark.createDataFrame([(*r, "w", 1, "s", "h", 2, "r") for r in rows], schema)
    words = S.counted(df, spoil=97).where("length(word) >= 5 and n >= 3")
    assert got(S.variants(words)) == plain_long(run_counts([("" if k is None else k, t) for k, t in rows]))


def plain_long(counts):
    """As ``plain``, pair by pair."""
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and apart(v, w)] for w in counts}
    best = {w: min((-counts[v], v) for v in vs) if vs else None for w, vs in near.items()}
    form = {w: b[1] if b and -b[0] >= 2 * counts[w] else None for w, b in best.items()}
    roots = {w: w for w in counts}
    for w in counts:
        while form[roots[w]]:
            roots[w] = form[roots[w]]
    return {w: (form[w], roots[w], counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def apart(a, b):
    a, b = sorted((a, b), key=len)
    head = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[head + (len(a) == len(b)) :] == b[head + 1 :]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(S.counted(df, spoil=97)).collect() == []
