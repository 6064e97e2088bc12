"""Numbering by parts, the stored cache, the event ledger, the sweep, the affix index, the ladder and the report file, against plain Python."""

import collections
import glob
import json
import os
import random

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellum.operators import audit, hidden, ladder, layout, ligature, order, terms, validate
from vellum.shared import written
from vellum.sources import cache, tables
from vellum.streaming import ledger


# --- numbers in an order


@pytest.mark.parametrize("hot", [False, True])
def test_numbered(spark, hot):
    rng = random.Random(1)
    rows = [("h" if hot and i % 3 else rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    got = order.numbered(spark.createDataFrame(rows, "k string, v int, i long").repartition(5), ["k"], [F.desc("v"), F.col("i")]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert {r["i"]: r["n"] for r in got} == want and len(got) == len(rows)


def test_numbered_empty_and_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 7, "k string, _v int")
    assert sorted(r["n"] for r in order.numbered(df, ["k"], ["_v"]).collect()) == list(range(1, 8))
    assert order.numbered(df.where("false"), ["k"], ["_v"]).collect() == []


@pytest.mark.parametrize("block", [4096, 3])
def test_tokens_and_pairs_across_pages(spark, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK", block)
    rng = random.Random(2)
    words = ["states", "state", "value", "function", "the", "temporal-difference", "policy", "policies", "x1", "--"]
    rows = [(rng.choice(["d", "e", None]), page, " ".join(rng.choices(words, k=rng.choice([0, 0, 1, 2, 9])))) for page in rng.sample(range(-20, 60), 60)]
    pages = terms.paged(spark.createDataFrame(rows, "doc string, page int, text string").repartition(4))
    want, pairs = [], collections.Counter()
    for doc in ("d", "e"):
        flat = [w for r in sorted((r for r in rows if r[0] == doc), key=lambda r: r[1]) for w in r[2].split() if w]
        clean = [(w, "".join(c for c in w.lower() if c.isalpha() or c == "-")) for w in flat]
        clean = [(r, w) for r, w in clean if w]
        want += [(doc, i, r, w) for i, (r, w) in enumerate(clean, 1)]
        known = {w for _, w in clean}
        norm = lambda w: {"states": "state", "policies": "policy"}.get(w, w) if {"states": "state", "policies": "policy"}.get(w, w) in known else w  # noqa: B023, E731
        for (_, a), (_, b) in zip(clean, clean[1:]):
            if a.isalpha() and b.isalpha() and not {a, b} & {"the", "x"}:
                pairs[doc, f"{norm(a)} {norm(b)}"] += 1
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in terms.tokens(pages).collect()), key=key) == sorted(want, key=key)
    found = terms.counted(pages).where("tier = 1").collect()
    assert {(r["doc"], r["term"]): r["cnt"] for r in found} == dict(pairs)
    place = {(d, i): w for d, i, _, w in want}
    assert all(place[r["doc"], r["first_pos"]][:4] == r["term"][:4] for r in found)


def test_paged_composed(spark):
    df = spark.createDataFrame([("d", 1, "Café b↵le"), ("d", 2, ""), ("d", 3, None)], "doc string, page int, text string")
    for composed in (False, True):
        got = {r["page"]: [x["w"] for x in r["words"] or []] for r in terms.paged(df, composed=composed).collect()}
        assert got == {1: ["cafe" if not composed else "caf", "bffle"], 2: [], 3: []}


def test_batch_map_keeps_order(spark):
    df = spark.createDataFrame([("d", b, i) for b in range(40) for i in range(b % 4 + 1)], "doc string, batch long, v long").repartition(6)
    calls = spark.sparkContext.accumulator(0)

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        calls.add(1)
        return pd.DataFrame({"total": sorted(rows["v"], reverse=True)})

    got = [tuple(r) for r in order.batch_map(df, fn, "total long").orderBy("doc", "batch", "i").collect()]
    assert got == [("d", b, i, b % 4 - i) for b in range(40) for i in range(b % 4 + 1)]
    assert calls.value == 40


# --- stored cache

ROW = "k string, model string, src string, tgt string, attempts int, ts double"


def key(i):
    return f"{i * 37 % 256:02x}{i:06x}"


def test_three_merges(spark, tmp_path):
    at = str(tmp_path / "cache")
    rng = random.Random(3)
    want: dict = {}
    for turn in range(3):
        rows = [(key(rng.randrange(60)), "m", f"s{i}" * 3000, f"t{turn}-{i}", rng.choice([1, 2, None]), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(80)]
        rows += [rows[0], (None, "m", "s", "t", 1, 9.0)]
        cache.merge(spark, at, spark.createDataFrame(rows, ROW))
        for k, m, s, t, a, ts in rows:
            if k is not None:
                rank = (ts is None, -(ts or 0), a is None, -(a or 0), t)
                if k not in want or rank < want[k][0]:
                    want[k] = (rank, (k, m, s[:8000], t, a, ts))
    got = sorted((tuple(r)[:6] for r in cache.read(spark, at).collect()), key=repr)
    assert got == sorted((w[1] for w in want.values()), key=repr)


def test_untouched_files_keep_their_names(spark, tmp_path):
    at = str(tmp_path / "cache")
    files = lambda: {b: sorted(f for f in os.listdir(f"{at}/{b}") if f.endswith(".parquet")) for b in os.listdir(at) if b.startswith("bucket=")}
    row = lambda i, ts: (key(i), "m", "s", f"t{ts}", 1, ts)
    assert cache.merge(spark, at, spark.createDataFrame([row(i, 1.0) for i in range(40)], ROW)) == 40
    before = files()
    assert cache.merge(spark, at, spark.createDataFrame([row(3, 2.0), row(4, 0.5), (None, "m", "s", "t", 1, 1.0)], ROW)) == 2
    after = files()
    assert {b for b in before if before[b] != after[b]} == {f"bucket={key(i)[:2]}" for i in (3, 4)} and set(before) == set(after)
    assert cache.merge(spark, at, spark.createDataFrame([], ROW)) == 0
    asked = spark.createDataFrame([(0, key(3)), (1, key(4)), (2, key(3)), (3, "ff999999"), (4, None)], "i int, k string")
    assert {r["i"]: r["tgt"] for r in cache.lookup(spark, at, asked).collect()} == {0: "t2.0", 1: "t1.0", 2: "t2.0", 3: None, 4: None}
    read = cache.lookup(spark, at, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read and key(3)[:2] in read
    assert cache.lookup(spark, str(tmp_path / "none"), asked).where("tgt is not null").count() == 0


def dealings(spark):
    """Times that the last query's plan deals rows."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plan = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    plan = plan.split("== Initial Plan ==")[-1].split("\n\n")[0]
    return plan.count("Exchange (")


@pytest.mark.parametrize("least", [1 << 28, 100])
def test_merge_deals_stored_rows_once(spark, tmp_path, monkeypatch, least):
    """New rows by key and all by directory; of a large directory, by parts of it."""
    monkeypatch.setattr(cache, "PART_BYTES", least)
    at = str(tmp_path / "cache")
    rows = lambda turn, step: [(f"{i % 3:02x}{i:06x}", "m", f"s{i}", f"t{turn}", 1, float(turn)) for i in range(0, 300, step)]
    cache.merge(spark, at, spark.createDataFrame(rows(1, 1), ROW))
    assert dealings(spark) == 2
    assert cache.merge(spark, at, spark.createDataFrame(rows(0, 1) + rows(2, 2), ROW)) == 3
    assert dealings(spark) == 2
    got = {r["k"]: r["tgt"] for r in cache.read(spark, at).collect()}
    assert cache.read(spark, at).count() == 300 and all(t == ("t1" if int(k[2:], 16) % 2 else "t2") for k, t in got.items())


def test_stored_texts_are_packed(spark, tmp_path):
    """A merge writes its directories anew, so what texts take up counts at each; tables of another codec are read and replaced as well."""
    at = str(tmp_path / "cache")
    spark.createDataFrame([("00a", "m", "s", "old", 1, 1.0), ("00b", "m", "s", "kept", 1, 1.0)], ROW).withColumn("bucket", F.left("k", F.lit(2))).write.partitionBy("bucket").option("compression", "snappy").parquet(at)
    assert cache.merge(spark, at, spark.createDataFrame([("00a", "m", "s", "new", 1, 2.0), ("01a", "m", "s", "t", 1, 1.0)], ROW)) == 2
    assert {r["k"]: r["tgt"] for r in cache.read(spark, at).collect()} == {"00a": "new", "00b": "kept", "01a": "t"}
    files = glob.glob(f"{at}/bucket=*/*.parquet")
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(2).compression for f in files} == {"ZSTD"}


def test_lookup_shuffles_no_keys_to_find_directories(spark, tmp_path):
    at = str(tmp_path / "cache")
    cache.merge(spark, at, spark.createDataFrame([(key(i), "m", "s", "t", 1, 1.0) for i in range(40)], ROW))
    asked = spark.createDataFrame([(i, key(i)) for i in range(20)], "i int, k string")
    assert cache._buckets(cache._filed(asked)) == sorted(key(i)[:2] for i in range(20))
    seen, buckets = [], cache._buckets
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cache, "_buckets", lambda filed: seen.append(filed) or buckets(filed))
        assert cache.lookup(spark, at, asked).where("tgt = 't'").count() == 20
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


# --- event ledger


def logged(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        f.write("\n".join([*(json.dumps(r) for r in rows), "not json", ""]))


def test_ledger_outlives_stops(spark, tmp_path, monkeypatch):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    rng = random.Random(4)
    rows = [{"key": rng.choice(["a", "b", "c", None]), "seq": i, "ts": rng.choice([None, 1.0, 2.0, 3.0]), "name": f"n{i}", "note": None} for i in range(90)]
    go = lambda files: ledger.follow(spark, log, out, check, files=files, partitions=2)

    def want(upto):
        mine: dict = {}
        for r in rows[:upto]:
            if r["key"] is not None:
                n, best = mine.get(r["key"], (0, None))
                rank = (r["ts"] is not None, r["ts"] or 0, r["seq"])
                mine[r["key"]] = (n + 1, max(best or (rank, r["name"]), (rank, r["name"])))
        return {k: (n, b[1]) for k, (n, b) in mine.items()}

    got = lambda: {r["key"]: (r["n"], r["name"]) for r in ledger.ledger(spark, out).collect()}
    assert got() == {}
    logged(log, "a", rows[:30])
    go(1)
    assert got() == want(30)
    logged(log, "b", rows[30:60])
    logged(log, "c", rows[60:90])
    # the stream dies when its second batch has been handed on and not yet been noted as done
    whole = ledger.LEDGER
    written = []
    from pyspark.sql import DataFrameWriter

    real = DataFrameWriter.parquet

    def dies(self, path, *a, **k):
        real(self, path, *a, **k)
        written.append(path)
        if len(written) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="lost"):
        go(1)
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    go(1)
    assert got() == want(90) and whole == ledger.LEDGER
    go(1)
    assert got() == want(90)


# --- sweep


@pytest.mark.parametrize("batch", ["10000", "40"])
def test_sweep_equals_all_pairs(spark, batch):
    rng = random.Random(5)
    boxes = []
    for page in range(6):
        for pos in range([1, 700, 130, 90, 60, 300][page]):
            x, y = rng.choice([0, 5, 10, 40, 90]) + rng.random() * 3, rng.randrange(30) * 3.0
            boxes.append(("d", page, pos, x, y, x + rng.choice([4, 20, 60]), y + rng.choice([2, 10, 30])))
    want = collections.Counter()
    for page in range(6):
        words = sorted((b for b in boxes if b[1] == page), key=lambda b: (b[4], b[3], b[2]))
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 60]:
                ox, oy = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
                if b[4] <= a[6] and ox > 0.5 and oy > 0.5 and ox * oy > 0.30 * (a[5] - a[3]) * (a[6] - a[4]):
                    want[page] += 1
                    break
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(boxes, "doc string, page int, pos int, x0 double, y0 double, x1 double, y1 double").repartition(3)
        got = {r["page"]: r["hits"] for r in layout.overlap(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == {p: want[p] for p in range(6)} and want[1] > 100


# --- affix index


def test_affixes_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 5)))
    pairs = sorted({(word(), rng.choice(["", "-"]) + word()) for _ in range(40)})
    texts = [f"x {word()}{{v{i}}}{rng.choice(['', '-'])}{word()} y{{v9}} {word()}<style id='1'>{{v7}}</style>{word()}" for i in range(200)]
    bare = lambda r: r.removeprefix("-")

    def known(g1, g5):
        return (g1, g5) in pairs or (len(g1) > 1 and len(bare(g5)) > 1 and any(left.endswith(g1) and right.startswith(g5) for left, right in pairs))

    import re

    wedge = re.compile(r"([A-Za-z]+)((?:</?style[^>]*>\s*)*)(\{v\d+\})((?:</?style[^>]*>\s*)*)(-?[A-Za-z]+)")
    want = [wedge.sub(lambda m: m[1] + m[2] + ("ff" if known(m[1], m[5]) else m[3]) + m[4] + m[5], t) for t in texts]
    done = ligature.dissolve(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(pairs, "l string, r string"))
    assert [r["text"] for r in done.orderBy("id").collect()] == want and any("ff" in w for w in want)
    none = ligature.dissolve(spark.createDataFrame([(0, "plain")], "id long, text string"), spark.createDataFrame([], "l string, r string"))
    assert none.first()["text"] == "plain"


# --- hints of batches


def test_gravest_fault_of_a_batch_decides(spark):
    ko = "가나다라마바사아자차카타파하 거너더러"
    half = "이것은 한국어 문장이다 그리고 더 있다 참으로 길고 긴 문장이다 the agent then takes another action here 끝이다 정말로 그렇다"
    rows = [
        ("wide", 1, "some plain english words here", ko * 9), ("wide", 2, "with {v1} in it all", ko[:9]),
        ("half", 1, "x " * 60, half), ("half", 2, "with {v1} and {v1} in it", "{v2} 가나"),
        ("marks", 1, "with {v1} and {v3} in it", "{v2} 가나"), ("marks", 2, "fine", "좋다"), ("marks", 3, "{v4} some", None),
        ("none", 1, "a {v1}", None), ("none", 2, "b", None), ("fine", 1, "fine", "좋다"),
    ]
    got = {r["batch"]: (r["kind"], r["items"], r["details"]) for r in validate.batch_hint(spark.createDataFrame(rows, "batch string, id int, src string, tgt string")).collect()}
    assert got["wide"][:2] == ("length", 1) and got["wide"][2].startswith("id 1: ")
    assert got["half"] == ("english", 1, "id 1: the agent then takes another action here")
    assert got["marks"] == ("placeholders", 2, "id 1: missing {v1}, {v3}; invented {v2}\nid 3: missing {v4}")
    assert got["none"] == ("reply", 0, "") and got["fine"] == ("again", 0, "")


def test_fingerprint_is_of_the_set(spark):
    mark = lambda rows, *a: validate.rules_fingerprint(spark.createDataFrame(rows, "l string, r string").repartition(3), *a).first()[0]
    pairs = [(f"l{i}", f"r{i}") for i in range(30)]
    assert mark(pairs) == mark(pairs[::-1] + pairs[:4]) != mark(pairs[1:])
    assert len({mark(pairs), mark(pairs, "mine"), mark([]), mark([("", "")])}) == 4


# --- ladder


def test_ladder_asks_only_for_what_failed(spark):
    ko = "가나다라마바사아자차카타파하"
    src = "some plain english words stand here"
    replies = {1: {1: ko, 2: src, 3: None, 5: src}, 2: {2: ko, 3: src, 5: src}, 3: {3: src, 5: src}}
    asked: dict = {}

    def ask(pending, turn):
        asked[turn] = {r["id"]: r["why"] for r in pending.collect()}
        return spark.createDataFrame([*replies[turn].items(), (1, "late and wrong")], "id int, output string").withColumn("pos", F.when(F.col("output") == "late and wrong", 0).otherwise(1))

    def rescue(pending):
        return pending.where("id in (3, 4)").select("id", F.lit(ko).alias("output"), F.when(F.col("id") == 4, 2).otherwise(1).alias("replaced"))

    dense = " ".join(f"word{{v{i}}}" for i in range(16))
    items = spark.createDataFrame([(1, src), (2, src), (3, src), (4, dense), (5, src)], "id int, input string")
    got = {r["id"]: (r["provenance"], r["turn"], r["cacheable"]) for r in ladder.climb(items, ask, rescue).collect()}
    assert got == {1: ("whole", 1, True), 2: ("whole", 2, True), 3: ("rescue", 4, False), 4: ("fragment", 0, True), 5: ("source", 5, False)}
    assert asked == {1: dict.fromkeys((1, 2, 3, 5), ""), 2: {2: "echo", 3: "empty output", 5: "echo"}, 3: {3: "echo", 5: "echo"}}
    asked.clear()
    assert ladder.climb(items.where("id = 1"), ask).count() == 1 and list(asked) == [1]


def test_ladder_judges_replies_in_their_rows(spark):
    ko = "가나다라마바사아자차카타파하"
    src = "some plain english words stand here"
    items = spark.createDataFrame([(i, None if i == 6 else " ".join(f"word{{v{k}}}" for k in range(16)) if i == 7 else src) for i in range(8)] + [(None, src)], "id int, input string")
    said = lambda turn: F.when(F.col("id") < turn, ko).when(F.col("id") == turn, F.col("input"))

    def ask(pending, turn):
        return pending.select("id", "input", said(turn).alias("output"))

    def rescue(pending):
        return pending.select("id", "input", F.lit(ko).alias("output"), (F.col("id") % 2).alias("replaced"))

    got = ladder.climb(items, ask, rescue)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # the same replies without their inputs meet their items by id
    apart = ladder.climb(items, lambda p, t: ask(p, t).drop("input"), lambda p: rescue(p).drop("input"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.collect()))
    told = {r["id"]: (r["provenance"], r["turn"], r["cacheable"]) for r in got.collect()}
    assert told == {0: ("whole", 1, True), 1: ("whole", 2, True), 2: ("whole", 3, True), 3: ("rescue", 4, False), 4: ("source", 5, False), 5: ("rescue", 4, False), 6: ("source", 5, False), 7: ("fragment", 0, True)}


# --- report


def test_report_file_keeps_its_order(spark, tmp_path):
    verdicts = spark.createDataFrame([(d, p, ["overlap"] if p % 3 else []) for d in ("a", "b") for p in range(300)], "doc string, page long, reasons array<string>")
    recoveries = spark.createDataFrame([("a", 1, 1, "reverted", ""), ("a", 2, 1, "kept", "first"), ("a", 2, 2, "kept", "torn\npage")], "doc string, page long, seq int, action string, note string")
    left = spark.createDataFrame([("a", p, f"run {p} | end") for p in range(20)], "doc string, page long, run string")
    frags = spark.createDataFrame([("b", p, "heavy", f"src {p}") for p in range(3)], "doc string, pos int, why string, src string")
    lines = audit.report_lines(audit.header(verdicts, recoveries, left), audit.report_table(verdicts, recoveries), left, audit.failed(recoveries), frags)
    audit.write_report(lines.repartition(7), str(tmp_path / "r"))
    text = {}
    for d in ("a", "b"):
        files = [f for f in os.listdir(tmp_path / "r" / f"doc={d}") if f.startswith("part")]
        assert len(files) == 1
        text[d] = (tmp_path / "r" / f"doc={d}" / files[0]).read_text().splitlines()
    assert text["a"][:4] == ["# Report", "300 pages, 200 broken, 1 restored, 20 with leftovers", "## Broken pages", "| 1 | overlap | original restored |"]
    assert text["a"][4] == "| 2 | overlap | torn page |" and text["a"][203:207] == ["## Failed repairs", "- 2: torn page", "## English left", "- 0: run 0 / end"]
    assert text["a"][-1] == "- and 8 more" and len(text["a"]) == 2 + 201 + 2 + 14
    assert text["b"][-4:] == ["## Rescued in fragments: 3", "- src 0", "- src 1", "- src 2"]
    assert [x for x in text["b"] if x.startswith("|")] == [f"| {p} | overlap | none |" for p in range(300) if p % 3]


# --- sources that survive


def test_glossaries_of_a_folder(spark, tmp_path):
    want = {"good.csv": "", "bom.csv": "", "header.csv": "no rows", "other.csv": "header is not source,target", "empty.csv": "header is not source,target", "torn.csv.gz": "unreadable"}
    (tmp_path / "good.csv").write_text('Source,"target",tgt_lng\na,b,ko\n')
    (tmp_path / "bom.csv").write_text("﻿source, TARGET\na,b\n")
    (tmp_path / "header.csv").write_text("source,target,tgt_lng\n")
    (tmp_path / "other.csv").write_text("term,target\na,b\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "torn.csv.gz").write_bytes(b"\x1f\x8b\x08\x00broken")
    assert {r["file"]: r["problem"] for r in tables.glossary_problems(spark, str(tmp_path)).collect()} == want


def test_torn_tables_and_lines(spark, tmp_path):
    at = str(tmp_path / "pairs")
    tables.write_ligatures(spark.createDataFrame([("di", "erent")], "l string, r string"), at)
    (tmp_path / "pairs" / "part-torn.parquet").write_bytes(b"PAR1 no table PAR1")
    assert [tuple(r) for r in tables.read_ligatures(spark, at).collect()] == [("di", "erent")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"nothing")
    assert tables.read_ligatures(spark, str(tmp_path / "bad")).collect() == [] == tables.read_ligatures(spark, str(tmp_path / "none")).collect()
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"name":"retries","id":"1","ts":1.0}\n{"name": torn\n\n')
    assert [(r["file"], r["line"]) for r in tables.bad_events(spark, str(tmp_path / "log")).collect()] == [("a.json", '{"name": torn')]
    tables.append_events(tables.read_events(spark, str(tmp_path / "log")), str(tmp_path / "log"))
    assert tables.read_events(spark, str(tmp_path / "log")).count() == 2


def test_replacing_a_table_by_itself(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.replace_table(spark.range(3), at)
    tables.replace_table(spark.read.parquet(at).selectExpr("id + 10 as id"), at)
    assert sorted(r["id"] for r in spark.read.parquet(at).collect()) == [10, 11, 12] and os.listdir(tmp_path) == ["t"]
    with pytest.raises(Exception, match="torn"):
        tables.replace_table(spark.read.parquet(at).select(F.raise_error(F.lit("torn")).cast("long").alias("id")), at)
    assert spark.read.parquet(at).count() == 3 and not tables.restored(spark, at)
    os.rename(at, f"{at}.before")
    assert tables.restored(spark, at) and spark.read.parquet(at).count() == 3


# --- replies


def test_brackets_equal_a_stack(spark):
    from vellum.operators import protocol

    rng = random.Random(7)
    parts = ["[", "]", "[", "]", "a", ", ", '[{"id":1,"output":"b"}]', '[{"id":2}', "{}", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(300)] + ["[" * 2000 + "]" * 2000, None]

    def plain(text):
        open_, found = [], set()
        for at in range(len(text) - 1, -1, -1):
            if text[at] == "]":
                open_.append(at)
            elif text[at] == "[" and open_:
                found.add((at, open_.pop() + 1))
        return found

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got: dict = {}
    for r in protocol.slices(df).collect():
        got.setdefault(r["id"], set()).add((r["begin"], r["stop"]))
    assert {i: got.get(i, set()) for i in range(len(texts))} == {i: plain(t or "") for i, t in enumerate(texts)}

    def last(text):
        for a, b in sorted(plain(text), key=lambda x: -x[1]):
            try:
                value = json.loads(text[a:b])
            except ValueError:
                continue
            if value and isinstance(value[0], dict):
                return a, b
        return -1, -1

    places = {r["id"]: (r["begin"], r["stop"]) for r in protocol.array_places(df, text="text").collect()}
    assert places == {i: last(t or "") for i, t in enumerate(texts)} and len(set(places.values())) > 5


def test_parsed_items(spark):
    from vellum.operators import protocol

    raws = ['[{"id": 1, "output": "a"}, 5, {"id": "x", "output": 7}, {"output": "b"}]', '```json\n[{"id":1,"output":"a"}]\n```', "```[] ```", "[1, 2]", 'so [1] and [{"id":2,"output":"c"}] end ]', '[{"id":3,"output":"d', "none", None]
    rows = protocol.parsed(spark.createDataFrame(list(enumerate(raws)), "id int, raw string")).collect()
    got = {r["id"]: (None if r["items"] is None else [tuple(x) for x in r["items"]], r["repaired"]) for r in rows}
    assert got == {0: ([("1", "a"), ("x", None), (None, "b")], False), 1: ([("1", "a")], False), 2: ([], False), 3: ([], False), 4: ([("2", "c")], False), 5: ([("3", "d")], True), 6: (None, False), 7: (None, False)}


def test_operands_wait_for_their_operator():
    from vellum.operators import hidden

    shown = lambda data: [(x.characters, x.inside) for x in hidden.shown(data)]
    assert shown(b"BT (abc) 0 0 Td Tj ET") == [(3, True)]
    assert shown(b"BT (abc) Tj Tj ET") == [(3, True), (1, True)]
    assert shown(b"q 0 0 10 10 re W n BT 50 50 Td (ab) Tj ET Q") == [(2, False)]
    assert shown(b"0 0 10 10 re 1 1 W n BT 2 2 Td (ab) Tj ET") == [(2, True)]
    assert shown(b"q 2 0 0 2 0 0 cm 0 0 50 50 re W n BT (xy) 250 250 Td Tj ET Q") == [(2, False)]


def test_folded_streams_equal_the_byte_reader(spark):
    from vellum.operators import hidden

    rng = random.Random(8)
    numbers = ["0", "10", "-3.5", ".5", "2", "400", "1e2", "+7."]
    strings = [b"(abc)", b"(a\\)b\\101)", b"(n(e)s)", b"(n(e(s)t)ed)", b"<48656c>", b"<4>", b"<>", b"[(AB) -20 (C[D)]", b"[[(x)] <4142>]", b"()", b"(caf\xe9)"]
    ops = [b"q", b"Q", b"cm", b"re", b"W", b"W*", b"n", b"BT", b"ET", b"Tm", b"Td", b"TD", b"T*", b"Tj", b"TJ", b"'", b'"', b"/F1", b"Tf", b"<<", b">>"]
    deep = [b"(a(b(c(d))))", b"(never closed", b"[ open", b"nan", b"1_0"]

    def stream(more):
        out = [b"BT"] if rng.random() < 0.7 else []
        for _ in range(rng.randint(0, 60)):
            kind = rng.random()
            if kind < 0.35:
                out += [x.encode() for x in rng.choices(numbers, k=rng.choice([1, 2, 4, 6, 7]))]
            elif kind < 0.55:
                out.append(rng.choice(strings + more))
            out.append(rng.choice(ops))
        return rng.choice([b" ", b"\n"]).join(out)

    rows = [("d", i, stream([])) for i in range(250)] + [("d", 1000 + i, stream(deep)) for i in range(60)] + [("d", 2000, b""), ("d", 2001, None)]
    df = spark.createDataFrame(rows, "doc string, page int, data binary")
    got = {r["page"]: (r["hidden"], r["shown"], r["error"]) for r in hidden.scan(df).collect()}
    want = {r["page"]: (r["hidden"], r["shown"], r["error"]) for r in hidden._scanned(df).collect()}
    assert got == want and len(got) == len(rows)
    assert sum(h > 0 for h, _, _ in want.values()) > 10 and sum(s > 0 for _, s, _ in want.values()) > 60


# --- pages that are judged in their rows


def test_inspect_pages_equals_inspect_and_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setattr(layout, "AT_ONCE", 40)
    rng = random.Random(5)

    def words(n):
        found = []
        for pos in range(n):
            x, y = rng.choice([0.0, 3.0, 45.0, 90.5, -9.0]) + 20 * (pos % 6), 14.0 * (pos // 6) + rng.choice([0.0, 0.0, -11.0, 2.5])
            found.append((pos, x, y, x + rng.choice([0.0, 12.0, 40.0]), y + rng.choice([12.0, 12.0, 30.0, 0.0])))
        rng.shuffle(found)
        return found

    rows = [("d", page, words(rng.choice([0, 3, 14, 15, 40, 90])) if page % 7 else None, words(rng.choice([0, 16, 40, 70]))) for page in range(60)]
    box = "array<struct<pos:bigint,x0:double,y0:double,x1:double,y1:double>>"
    pages = spark.createDataFrame(rows, f"doc string, page bigint, translated {box}, original {box}").repartition(3)
    got = layout.inspect_pages(pages)
    side = lambda c: layout.proper(pages.select("doc", "page", F.inline(c)).withColumn("txt", F.lit("x")))
    want = layout.inspect(side("translated"), side("original"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect())) and got.where(F.size("reasons") > 0).count() > 5
    assert "Exchange" not in layout.inspect_pages(spark.createDataFrame(rows, pages.schema))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("offset", [0, 2])
def test_facing_gives_every_page_once(spark, monkeypatch, offset):
    """Texts too long for a row, and ids that come twice, are judged word by word; the verdicts are those of all words dealt."""
    from vellum.plans import inputs, reference

    monkeypatch.setattr(inputs, "ROW_CHARS", 300)
    rng = random.Random(6)
    rows = [(i, None if i == 9 else " ".join(rng.choices(["a", "bcd", "temporal", "", "x\ny"], k=rng.choice([4, 30, 60, 90])))) for i in [*range(30), 4, 11, None]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = reference.inspected(d, offset)
    want = layout.inspect(layout.proper(inputs.boxes(d, True)), layout.proper(inputs.boxes(d, False)), offset=offset)
    key = ["page", "words", *layout.LIMITS]
    lone = F.col("page").isin([p for p in range(30) if not {p, p + offset} & {4, 11}])  # of equal words of equal places any comes first
    assert sorted(map(tuple, got.where(lone).select(key).collect())) == sorted(map(tuple, want.where(lone).select(key).collect()))
    assert sorted(map(tuple, got.select("page", "words").collect())) == sorted(map(tuple, want.select("page", "words").collect()))


# --- content streams are read once


def test_cleaning_reads_a_stream_once(monkeypatch):
    """The reader's words, both ways of cleaning and the check after them share what was read."""
    read = []
    inner = hidden._shown
    monkeypatch.setattr(hidden, "_shown", lambda data: (read.append(data), inner(data))[1])
    hidden.shown.cache_clear()
    data = b"q 0 0 100 100 re W n\nBT 10 10 Td (seen) Tj ET\nBT 500 500 Td (hidden here now) Tj ET\nQ"
    assert hidden.all_words(data) == ["seen", "hidden", "here", "now"] and hidden.visible_words(data) == ["seen"]
    made = hidden.strip_blocks(data, set())
    assert hidden.strip_operators(data, set()) != data and hidden.all_words(made) == ["seen"] == hidden.visible_words(made)
    assert read == [data, made]


@pytest.mark.parametrize("body", [b"", b"plain", b"a\\nb\\(c\\)", b"\\101\\7x\\0053", b"\\8\\q", b"end\\", b"\\\n\\\\", b"\\777"])
def test_literal_equals_reading_by_bytes(body):
    out, at = bytearray(), 0
    while at < len(body):
        byte = body[at]
        at += 1
        if byte == 0x5C and at < len(body):
            octal = 0
            while octal < 3 and body[at + octal : at + octal + 1] in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7"):
                octal += 1
            byte = int(body[at : at + octal], 8) & 255 if octal else dict(zip(b"nrtbf", b"\n\r\t\b\f")).get(body[at], body[at])
            at += octal or 1
        out.append(byte)
    assert hidden._literal(body) == bytes(out)


# --- terms


def test_clean_without_repair_equals_repair(spark):
    from vellum.functions import text as X

    raws = ["plain", "Mixed-Case's", "a{v1}b", "</style>x", "<style id='1'>y", "tab\x01ctl", "é-à", "o↵-policy", "<s x↵>", "↵", "--", "İx", "a\u0301b"]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    old = F.replace(F.lower(F.regexp_replace(X.repair(F.col("r"), False), r"[^A-Za-z\- ]+", " ")), F.lit(" "), F.lit(""))
    assert [r[0] for r in df.select(terms.clean(F.col("r"))).collect()] == [r[0] for r in df.select(old).collect()]
    spans = df.select(F.lit("d").alias("doc"), F.concat(F.lit("x  y\t{v1} "), "r").alias("text"), F.lit("TI").alias("font"))
    want = {w for r in spans.select(F.lower(F.regexp_replace(X.repair(F.col("text"), False), r"[^A-Za-z\- ]+", " "))).collect() for w in r[0].split(" ") if w}
    assert {r["w"] for r in terms.italic_words(spans).collect()} == want


def test_terms_are_counted_in_hash_tables(spark):
    """A spelling's count and place need no sort of all occurrences."""
    pages = terms.paged(spark.createDataFrame([("d", 1, "some words stand here some words")], "doc string, page int, text string"))
    plan = terms.counted(pages)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "min(struct" not in plan


#: Words of which some share a norm, some only where a third stands.
FOLDED = """movie movies movy movys dish dishs dishes glass glasses glasss policy policies policie policys series serie sery ties tie gases gas gass
bus buses house houses states state queries query cats cat boss bosses wishes wish fishs fishes skies xies flies-over flies-overs self-dish self-dishes re-entry
re-entries re-entrie""".split()


def test_tiered_terms_of_words_that_fold(spark, tmp_path):
    import duckdb

    from vellum.plans import reference

    rng = random.Random(5)
    rows = []
    for source in range(12):
        some = rng.sample(FOLDED, rng.randint(4, 24))
        rows += [(source * 100 + k, " ".join(rng.choices(some + ["the"], k=rng.randint(0, 40))), "en", f"s{source}") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("t14_tiered_terms", "t16_keep_terms"):
        found = reference.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"select {', '.join(found.columns)} from ({reference.SQL[name]})").fetchall())


def test_tiered_writes_no_rare_terms(spark, monkeypatch):
    """What occurs once is neither joined nor written, and no table of the whole vocabulary is made."""
    sizes: dict = {}

    def kept(df, kind="table", **more):
        at = written(df, kind, **more)
        sizes.setdefault(kind, []).append(at.count())
        return at

    monkeypatch.setattr(terms, "written", kept)
    letters = "abcdefghijklmnop"
    once = ["qu" + letters[i % 16] + letters[i // 16 % 16] + letters[i // 256] + "ing" for i in range(2000)]
    rows = [("d", k, " ".join(once[k * 20 : k * 20 + 20]) + " hidden states" * 2) for k in range(100)]
    pages = terms.paged(spark.createDataFrame(rows, "doc string, page int, text string"), surfaces=False)
    assert pages.schema["words"].dataType.elementType.names == ["w"]
    found = terms.tiered(pages, terms.vocabulary(pages)).collect()
    assert [(r["rank"], r["term"], r["cnt"]) for r in sorted(found)] == [(1, "hidden states", 200), (2, "states hidden", 100)]
    assert all(max(n) < 100 for kind, n in sizes.items() if kind not in ("words", "starts")), sizes
