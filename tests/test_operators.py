"""Examples of the reference's behaviour, and laws."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import audit, control, hidden, layout, ligature, order, protocol, slides, terms, validate
from vellum.plans import extra, inputs, reference
from vellum.sources import tables


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "out"),
    [("di↵erent", "different"), ("o↵-policy", "off-policy"), ("Ho↵", "Hoff"), ("↵w", "αw"), ("↵n", "αn"), ("a  {v1}  b", "a {v1} b"), ("<style id='2'>o↵</style>", "<style id='2'>off</style>"), ("specific efficient define final", "specific efficient define final"), ("", ""), (None, None), ("é", "é")],
)
def test_repair(spark, text, out):
    assert one(spark, text, X.repair) == out


def test_ratio_edges(spark):
    assert [one(spark, t, X.hangul_ratio) for t in (None, "", "12 .", "가a", "abc")] == [0.0, 0.0, 1.0, 0.5, 0.0]


def test_dissolve(spark):
    words = spark.createDataFrame([("di", "erent"), ("o", "-policy"), ("di", "erence")], "l string, r string")
    cases = {"two di{v1}erent MDPs": ("two different MDPs", 1), "BE{v2}BE": ("BE{v2}BE", 0), "MDP{v4}MDP": ("MDP{v4}MDP", 0), "w{v2}x": ("w{v2}x", 0), "<style id='4'>temporal-di</style>{v6}<style id='5'>erence</style>": ("<style id='4'>temporal-di</style>ff<style id='5'>erence</style>", 1)}
    got = ligature.dissolve(spark.createDataFrame(list(enumerate(cases)), "id long, text string"), words).orderBy("id").collect()
    assert [(r["text"], r["removed"]) for r in got] == list(cases.values())


def test_dissolve_shuffles_no_text_for_a_wedge(spark, monkeypatch):
    """What is written for all wedges of a long text does not grow with the text; equal texts and keys stay rows of their own."""
    long = "x " * 5000 + "two di{v1}erent and di{v1}erent, a w{v2}x"
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (2, "")], "id long, text string")
    words = spark.createDataFrame([("di", "erent")], "l string, r string")
    done = ligature.dissolve(df, words)
    assert sorted((r["id"], len(r["text"] or ""), r["removed"]) for r in done.collect()) == [(1, len(long) - 4, 2), (1, len(long) - 4, 2), (2, 0, 0), (2, 0, 0)]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "_text" in line]


@given(st.lists(st.sampled_from(["a", " ", "{v1}", "{v22}", "</style>", "<style id='1'>", "\n"]), max_size=12))
@settings(max_examples=15, deadline=None)
def test_split_runs_round_trip(spark, parts):
    text = "".join(parts)
    assert one(spark, text, lambda c: X.woven(X.runs(c), X.kept(c))) == text


LEFT = "이것은 한국어 문장이다 그리고 더 있다 참으로 길고 긴 문장이다 the agent then takes another action here 끝이다 정말로 그렇다"


@pytest.mark.parametrize(
    ("text", "found"),
    [(LEFT, True), (LEFT.replace("끝이다", "1998년 끝"), True), (LEFT.replace("here 끝", "here (1998) 끝"), False), (LEFT.replace("the agent then takes another action here", "MATCHBOX EDUCABLE NOUGHTS AND CROSSES ENGINE"), False), (LEFT.replace("the agent then takes another action here", "A A A x v v x b"), False), ("all english words stand here without any other", False)],
)
def test_leftover_english(spark, text, found):
    got = one(spark, text, X.leftover_english)
    assert (got is not None) == found


def test_checks_measure_a_width_once(spark):
    """Retries judge whole texts at every turn: the source's width and the target's are spelt out once each."""
    src, tgt = F.col("src"), F.col("tgt")
    assert str(validate.reason(src, tgt)).count("0.33") == 2
    assert str(validate.rebuilt(src, tgt, F.lit(1))).count("0.33") == 2


@pytest.mark.parametrize("end", ["", " " * 70, "." + "\n" * 90, "." * 90, " )" + " " * 63, "x"])
def test_polite_ending_far_from_the_end(spark, end):
    import re

    text = "그렇게 합니다" + end
    assert one(spark, text, X.polite) == bool(re.search(X.POLITE_END, text))


def test_check_reasons(spark):
    ko = "가나다라마바사아자차카타파하 거너더러"
    cases = [("some plain english words here", "", "empty output"), ("with {v1} in it", ko, "placeholder"), ("some plain english words here", f"<style '5'>{ko}", "malformed style tag"), ("some plain english words here", "그렇게 합니다.", "polite ending"), ("some plain english words here", "some plain english words here", "echo"), ("some plain english words here", ko * 9, "width"), ("some plain english words here", ko[:12], "")]
    df = spark.createDataFrame(cases, "src string, tgt string, want string").select("want", validate.reason(F.col("src"), F.col("tgt")).alias("got"))
    assert [(r["got"], r["want"]) for r in df.collect() if r["got"] != r["want"]] == []


def test_page_ranges(spark):
    want = {"": (1, 502), "7": (7, 7), "13-502": (13, 502), "2-999999": (2, 502), "0-3": (1, 3), "abc": None, "-5": None, "5-2": None, "0-0": None, "999-1000": None}
    df = spark.createDataFrame([(s,) for s in want], "s string").select("s", control.page_range(F.col("s"), F.lit(502)).alias("r")).select("s", "r.*")
    got = {r["s"]: None if r["error"] else (r["first"], r["last"]) for r in df.collect()}
    assert got == want


def test_norms_and_terms(spark):
    words = "states state policies policy channels channel bias analysis physics species lens virus axis".split()
    df = spark.createDataFrame([("d", i, w) for i, w in enumerate(words)], "doc string, pos long, w string")
    got = {r["w"]: r["norm"] for r in terms.norms(df).collect()}
    assert got == {w: {"states": "state", "policies": "policy", "channels": "channel"}.get(w, w) for w in words}


def test_decide(spark):
    bad = ["19", "—", "| 표 |", "{v1} 노름", "그것은 그렇다.", "상태이다"]
    df = spark.createDataFrame([("norm", t) for t in [*bad, "막 전위"]], "en string, t string")
    assert [r["t"] for r in df.where(terms.decided(F.col("en"), F.col("t"))).collect()] == ["막 전위"]


def test_keep_terms_falls_back_to_whole_batches(spark):
    c = spark.createDataFrame([("d", b, t) for b in (0, 1) for t in ("x", "y")], "doc string, batch long, term string")
    v = spark.createDataFrame([("d", 0, " X ", "No"), ("d", 1, "x", "false"), ("d", 1, "y", "0")], "doc string, batch long, term string, keep string")
    assert sorted((r["batch"], r["term"]) for r in terms.keep_terms(c, v).collect()) == [(0, "y"), (1, "x"), (1, "y")]


@pytest.mark.parametrize(
    ("raw", "out"),
    [('[{"id":1,"output":"a"}]', 1), ('```json\n[{"id":1,"output":"a"}]\n```', 1), ("prose", None), ('see [[x]] then [{"id":0,"output":"b"}]', 1), ('[{"id":0,"output":"b"}', 1), ('[{"id":0,"output":"b"', 1), ('[{"id":0,"output":"b', 1), ('[{"id":0,"outp', None), ("[]", 0)],
)
def test_parse(spark, raw, out):
    got = protocol.parsed(spark.createDataFrame([(1, raw)], "id int, raw string")).first()["items"]
    assert (None if got is None else len(got)) == out


def test_client_reply(spark):
    raw = json.dumps([{"id": "1", "output": "a"}, {"id": "x", "output": "b"}, {"id": 2}, {"id": 1, "output": "c"}])
    assert one(spark, raw, protocol.client_reply) == {1: "c"}
    assert one(spark, "no", protocol.client_reply) == {}


@pytest.mark.parametrize(("operand", "n"), [(b"(" + b"x" * 200 + b")", 200), (b"[(AB) -20 (CDE)]", 5), (b"<48656c6c6f>", 5), (b"(a\\(b)", 3)])
def test_operand_characters(operand, n):
    assert hidden.characters(operand) == n


def test_hidden_scan_and_strip():
    data = b"q 0 0 100 100 re W n BT 10 10 Td (seen) Tj ET BT 500 500 Td (unseen words) Tj ET Q BT 500 500 Td (free) Tj ET"
    assert [(t, inside) for t, _, inside, *_ in hidden.shown(data)] == [("seen", True), ("unseen words", False), ("free", True)]
    assert b"unseen" not in hidden.strip_blocks(data, {"view"})
    assert b"unseen" in hidden.strip_blocks(data, {"words"})
    assert b"unseen" not in hidden.strip_operators(data, {"view"})


def test_loss_is_a_multiset(spark):
    rows = [("d", 1, s, w) for s, ws in (("before", ["head"] * 6 + ["x"] * 20), ("after", ["head"] * 3 + ["x"] * 20)) for w in ws]
    got = hidden.accepted(spark.createDataFrame(rows, "doc string, page int, side string, w string")).first()
    assert (got["lost"], got["ok"]) == (3, True)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=25))
@settings(max_examples=8, deadline=None)
def test_overlap_equals_brute_force(spark, raw):
    w = [("d", 1, i, float(x), float(y), float(x + a), float(y + b), "t") for i, (x, y, a, b) in enumerate(raw)]
    order = sorted(w, key=lambda r: (r[4], r[3], r[2]))
    want = 0
    for i, a in enumerate(order):
        for b in order[i + 1 : i + 60]:
            ox, oy = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
            if b[4] <= a[6] and ox > 0.5 and oy > 0.5 and ox * oy > 0.3 * (a[5] - a[3]) * (a[6] - a[4]):
                want += 1
                break
    df = spark.createDataFrame(w, "doc string, page int, pos int, x0 double, y0 double, x1 double, y1 double, txt string")
    assert layout.overlap(df).first()["hits"] == want


def test_own_mark_does_not_count(spark):
    w = [("d", 1, 0, 0.0, 0.0, 5.0, 5.0, "text"), ("d", 1, 1, 0.0, 790.0, 5.0, 795.0, layout.SELF_MARK), ("d", 1, 2, 9.0, 790.0, 20.0, 795.0, "note")]
    df = spark.createDataFrame(w, "doc string, page int, pos int, x0 double, y0 double, x1 double, y1 double, txt string")
    assert [r["txt"] for r in layout.proper(df, spark.createDataFrame([("d", 1, 800.0)], "doc string, page int, bottom double")).collect()] == ["text"]


def test_merge_refuses(spark):
    plan = spark.createDataFrame([("d", f, f + 1) for f in (1, 3, 5, 7)], "doc string, first int, last int")
    found = spark.createDataFrame([("d", 1, "a", 1.0, 2, [50, 50]), ("d", 3, "b", 1.0, 1, [50]), ("d", 5, "c", 1.0, 2, [3, 4]), ("d", 5, "old", 0.0, 2, [50, 50])], "doc string, first int, path string, mtime double, page_count int, text_len array<int>")
    assert {r["first"]: r["error"] for r in control.merge_errors(plan, found).collect()} == {3: "short", 5: "no text", 7: "missing"}
    with pytest.raises(ValueError, match="at least one"):
        control.chunks(plan, 0)


def test_recovery(spark):
    ko = " ".join(["가나다"] * 20)
    bad = spark.createDataFrame([("d", p) for p in range(4)], "doc string, page int")
    c = spark.createDataFrame([("d", 0, ko, True, 0.0, 0.0, 0.0), ("d", 1, "english " * 20, True, 0.0, 0.0, 0.0), ("d", 2, ko, True, 0.5, 0.0, 0.0)], "doc string, page int, text string, fits boolean, overlap double, outside double, collision double")
    assert {r["page"]: r["action"] for r in audit.repaired(bad, c).collect()} == {0: "retranslated", 1: "reverted", 2: "reverted", 3: "reverted"}
    assert {r["page"]: r["action"] for r in audit.untranslated(bad, c).collect()} == {0: "retranslated", 1: "kept", 2: "kept", 3: "kept"}


def test_slides(spark):
    runs = spark.createDataFrame([(1, ["0"], 0, i, t) for i, t in enumerate(["Note:", "the long body", "x"])], "slide int, path array<string>, para int, i int, text string")
    new = spark.createDataFrame([(1, ["0"], 0, "본문")], "slide int, path array<string>, para int, text string")
    assert [r["text"] for r in slides.applied(runs, new).orderBy("i").collect()] == ["", "본문", ""]
    assert one(spark, "-", lambda c: slides.shrunk(F.lit(9.0))) == 8.0


def test_glossary_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", '값, "둘"', "ko")], "source string, target string, tgt_lng string")
    tables.write_glossary(rows.coalesce(1), f"{tmp_path}/g")
    assert [tuple(r) for r in tables.read_glossary(spark, f"{tmp_path}/g").collect()] == [("a", '값, "둘"', "ko")]
    for name, body, problem in (("ok", "﻿Source , TARGET\na,b\n", ""), ("head", "x,y\na,b\n", "header is not source,target"), ("none", "source,target\n", "no rows")):
        (tmp_path / name).write_text(body)
        assert tables.glossary_problem(spark, str(tmp_path / name)) == problem
    assert tables.glossary_problem(spark, str(tmp_path / "missing")).startswith("unreadable")


def test_events(spark, tmp_path):
    from vellum.streaming import events

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"name":"retries","id":"1","ts":10.0}\nbroken\n{"name":"retries","id":"2","ts":20.0}\n')
    assert tables.read_events(spark, str(tmp_path / "log")).count() == 2
    q = events.counts(events.stream_events(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("seen").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select n from seen where name = 'retries'").first()["n"] == 2


def test_swap_array_takes_every_reply(spark):
    from conftest import SF

    from vellum.plans import extra

    before = {r["id"]: r["raw"] for r in extra._replies(spark, SF).collect()}
    after = {r["id"]: r["raw"] for r in extra.j02_swap_array(spark, SF).collect()}
    around = {0: ("", ""), 1: ("```json\n", "\n```"), 3: ("as [asked]: ", " done")}
    want = {i: raw if i % 4 == 2 else around[i % 4][0] + f'[{{"id":{i},"output":"x"}}]' + around[i % 4][1] for i, raw in before.items()}
    assert after == want


def test_dissolve_mines_all_documents(spark):
    from conftest import SF

    from vellum.plans import inputs, reference

    done = reference.x11_dissolve(spark, SF).agg(F.sum("removed")).first()[0]
    marked = inputs.damaged(inputs.table(spark, SF, "documents")).select(F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z]++↵-?[A-Za-z]++"), F.lit(0))).alias("n"))
    assert done == marked.agg(F.sum("n")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\n## Glossary\nx\n# N\nr", "a\n\n# N\nr"), ("a\n# glossary of terms\nx", "a\n"), ("a\n# Other\nx", "a\n# Other\nx"), ("", ""), (None, None)],
)
def test_glossary_section_leaves_a_line_break(spark, text, want):
    assert one(spark, text, X.without_glossary) == want


@pytest.mark.parametrize(("spec", "want"), [("1 3", None), (" 4 - 6 ", (4, 6)), ("7", (7, 7)), (None, (1, 9)), ("5-2", None), ("12", None), ("0-3", (1, 3))])
def test_page_range_keeps_inner_blanks(spark, spec, want):
    got = spark.createDataFrame([(spec,)], "s string").select(control.page_range(F.col("s"), F.lit(9)).alias("r")).first()["r"]
    assert (None if got["error"] else (got["first"], got["last"])) == want


def test_cache_key_tells_null_parts_apart(spark):
    rows = [("m", None, "2", "r", "s"), ("m", "2", None, "r", "s"), ("m", "", "2", "r", "s")]
    keys = [r[0] for r in spark.createDataFrame(rows, "a string, b string, c string, d string, e string").select(validate.cache_key(*(F.col(c) for c in "abcde"))).collect()]
    assert keys[0] != keys[1] and keys[0] == keys[2]


def test_signature_has_a_zero_byte_before_each_file(spark):
    import hashlib

    rows = [("d", 1, None, "p"), ("d", 0, b"text", "t"), ("d", 2, None, None)]
    got = tables.user_signature(spark.createDataFrame(rows, "doc string, pos int, content binary, path string")).first()["signature"]
    assert got == hashlib.sha256(b"\0text\0p\0").hexdigest()[:12]


def test_dissolve_with_blanks_after_tags_and_shared_keys(spark):
    words = spark.createDataFrame([("di", "erence"), ("di", "erent")], "l string, r string")
    rows = [(2, "<style id='4'>di</style> {v6}<style id='5'>erence</style>"), (2, "a di{v1}erent b"), (None, "a di{v1}erent b"), (3, None)]
    got = sorted((str(r["id"]), r["text"] or "", r["removed"]) for r in ligature.dissolve(spark.createDataFrame(rows, "id int, text string"), words).collect())
    assert got == [("2", "<style id='4'>di</style> ff<style id='5'>erence</style>", 1), ("2", "a different b", 1), ("3", "", 0), ("None", "a different b", 1)]


def test_english_run_joins_no_break_spaces(spark):
    text = "한국어 문장이 여기에 있고 아주 길게 이어집니다 that there remains some english prose within 번역되지 않은 부분이 남았다"
    assert one(spark, text, X.leftover_english) is not None


def test_cleaning_tries_blocks_then_operators_and_rolls_back(spark):
    page = lambda body: f"q 0 0 100 100 re W n {body} Q".encode()
    seen, gone = "BT 10 10 Td (seen) Tj ET", "BT 500 500 Td (unseen) Tj ET"
    rows = [
        (1, page(f"{seen} {gone}"), [], []),
        (2, page("BT 10 10 Td (seen) Tj 500 500 Td (unseen) Tj ET"), [], []),
        (3, page("BT 10 10 Td (seen) Tj 500 500 Td (unseen) Tj ET"), [[1009.0, 1009.0, 1011.0, 1011.0], [509.0, 509.0, 511.0, 511.0]], []),
        (4, page(f"{seen} {gone}"), [[500.0, 500.0, 510.0, 510.0]], ["unseen words"]),
        (5, None, None, None),
    ]
    df = spark.createDataFrame(rows, "page int, data binary, boxes array<array<double>>, visible array<string>").withColumn("doc", F.lit("b"))
    ways = {r["page"]: (r["way"], b"unseen" in bytes(r["data"])) for r in hidden.cleaned(df, hidden.visible_words).collect()}
    assert ways == {1: ("blocks", False), 2: ("operators", False), 3: ("kept", True), 4: ("kept", True), 5: ("kept", False)}
    worse = hidden.cleaned(df.where("page = 1"), lambda d: ["w"] * (9 if b"unseen" in d else 1)).first()
    assert worse["way"] == "rolled back" and b"unseen" in bytes(worse["data"])


@pytest.mark.parametrize(("operand", "text"), [(rb"(a\(b)", "a(b"), (rb"(\101\n)", "A\n"), (b"<00480065006c>", "Hel"), (b"[(AB) -20 <43>]", "ABC"), (b"<4>", "@"), (b"()", "")])
def test_strings_are_decoded(operand, text):
    assert hidden.text_of(operand) == text


def test_hints_by_precedence(spark):
    rows = [("a", "x {v1} y", None), ("b", "x" * 30, "가" * 40), ("c", "one {v1}", "하나"), ("d", "one {v1}", "하나 {v1}"), ("e", "one", "하나 {v2}")]
    got = {r["id"]: (r["kind"], r["detail"]) for r in validate.hint(spark.createDataFrame(rows, "id string, src string, tgt string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "reply", "b": "length", "c": "placeholders", "d": "again", "e": "placeholders"}
    assert got["c"][1] == "missing {v1}" and got["e"][1] == "invented {v2}"


def test_rules_fingerprint_follows_rules_and_dictionary(spark):
    d = spark.createDataFrame([("di", "erent"), ("o", "-policy")], "l string, r string")
    mark = lambda *a: validate.rules_fingerprint(*a).first()["fingerprint"]
    assert mark(d) == mark(d.orderBy(F.desc("l"))) and len({mark(d), mark(d.limit(0)), mark(d, "more")}) == 3


def test_reasons_with_percentages(spark):
    got = spark.createDataFrame([(["overlap", "outside"], 0.126, 0.05, 0.0), ([], 0.0, 0.0, 0.0)], "reasons array<string>, overlap double, outside double, collision double").select(layout.told_reasons().alias("r")).collect()
    assert [r["r"] for r in got] == [["overlap +13%", "outside +5%"], []]


def test_verdicts_reject_as_spelled(spark):
    c = spark.createDataFrame([("d", 0, t) for t in ("a", "b", "c", "e")], "doc string, batch int, term string")
    v = spark.createDataFrame([("d", 0, "A", "No"), ("d", 0, "b", "NO"), ("d", 0, "c", "false")], "doc string, batch int, term string, keep string")
    assert sorted(r["term"] for r in terms.keep_terms(c, v).collect()) == ["b", "e"]


def test_mark_differences_join_no_marks(spark):
    rows = [(1, "{v1} {v1} {v2}", "{v1} {v3}"), (1, "{v2}", None), (2, None, None), (3, "", "{v9}{v9}")]
    df = spark.createDataFrame(rows, "id long, src string, tgt string")
    got = validate.mark_differences(df)
    assert sorted(map(tuple, got.distinct().collect())) == [(1, "{v1}, {v2}", "{v3}"), (2, "", ""), (3, "", "{v9}")] and got.count() == 4
    assert "FullOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_loss_of_pages_in_their_rows(spark):
    """The same verdicts as word by word, with null words and pages without any; no word is shuffled."""
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "A", "", "a\0", "é", "\0a", None])
    pages = [("d", i, [word() for _ in range(rng.randrange(9))], [word() for _ in range(rng.randrange(9))]) for i in range(60)] + [("d", 60, None, ["x"]), ("d", None, ["x"] * 30, None), ("d", 61, None, None), (None, 62, [], [])]
    df = spark.createDataFrame(pages, "doc string, page int, before array<string>, after array<string>")
    words = [(d, p, side, w) for d, p, *both in pages for side, ws in zip(("before", "after"), both) for w in ws or []]
    want = hidden.accepted(spark.createDataFrame(words, "doc string, page int, side string, w string"))
    got = hidden.accepted_pages(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_loss_rule_of_repeated_ids_and_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "ROW_CHARS", 50)
    rows = [(1, "a B"), (1, "B c"), (2, "x y z"), (3, "Q w " * 30), (None, "K k"), (None, "K"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in extra.h10_loss_rule(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, False), (2, 0, True), (3, 30, False), (None, 2, False), (5, 0, True)}


@pytest.mark.parametrize(("far", "hashed"), [(7, True), (1 << 40, False)])
def test_unreachable_is_not_sorted_before_it_is_counted(spark, monkeypatch, far, hashed):
    """First places as one number, which a hash table holds; positions too far apart for it give the same order as pairs. A null position comes first."""
    t = lambda *ws: "".join(f"<a:t>{w}</a:t>" for w in ws)
    parts = [("d", 3, t("c", "1", "b", "c")), ("d", -2, t("b", "a")), ("d", far, t("z", "a", "y")), ("d", 3, t("e", "f", "g", "h")), ("e", None, t("q")), ("e", 0, t("p", "q")), ("f", None, t("r"))]
    seen, numbered = [], order.numbered
    monkeypatch.setattr(order, "numbered", lambda df, *more: seen.append(df) or numbered(df, *more))
    got = sorted((r["deck"], r["n"], r["text"]) for r in slides.unreachable(spark.createDataFrame(parts, "deck string, pos long, xml string")).collect())
    tied = {n: t for d, n, t in got if d == "d"}
    assert [tied[n] for n in (1, 2, 8, 9)] == ["b", "a", "z", "y"] and {tied[n] for n in (3, 4)} == {"c", "e"} and [tied[n] for n in (5, 6, 7)] == ["f", "g", "h"]
    assert [g for g in got if g[0] != "d"] == [("e", 1, "q"), ("e", 2, "p"), ("f", 1, "r")]
    assert ("SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()) == hashed


def test_unreachable_searches_a_text_for_a_letter_once(spark, monkeypatch):
    """Among distinct texts, not at each occurrence; places count what has no letter, too."""
    parts = [("d", 1, "<a:t>1</a:t><a:t>b</a:t><a:t></a:t><a:t>b</a:t>"), ("d", 1, "<c:v>é</c:v><a:t>2</a:t><a:t>a</a:t>"), ("d", 2, None)]
    seen, numbered = [], order.numbered
    monkeypatch.setattr(order, "numbered", lambda df, *more: seen.append(df) or numbered(df, *more))
    got = sorted((r["n"], r["text"]) for r in slides.unreachable(spark.createDataFrame(parts, "deck string, pos long, xml string")).collect())
    assert got == [(1, "é"), (2, "b"), (3, "a")]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.index("RLIKE") < plan.index("Aggregate")


def test_numbered_rows_are_not_shuffled_to_meet_their_parts(spark):
    """The table of parts is far smaller than the rows that it numbers, and its size is known."""
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        got = order.numbered(rows, ["k"], ["v"])
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        made = {(r["k"], r["v"]): r["n"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(k, v): n for k in range(3) for n, v in enumerate(sorted(v for j, v in made if j == k), 1)}
    assert made == want and len(made) == 30_000


def test_texts_once_are_dealt_by_key_once(spark):
    """A cache's rows of distinct texts come dealt by their key, so that an upsert does not move the texts again; null languages do not count."""
    d = spark.createDataFrame([("a", "en", 1), ("a", None, 2), ("a", "de", 3), ("b", None, 4), (None, "ko", 5)], "text string, lang string, doc_id long").repartition(3)
    once = reference._once(d, "lang")
    rows = once.select("k", F.lit("m").alias("model"), F.col("text").alias("src"), F.concat("lang", F.lit("1")).alias("tgt"), F.lit(1).alias("attempts"), F.lit(1.0).alias("ts"))
    got = validate.upsert(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["src"], r["tgt"]) for r in got.collect()} == {("a", "de1"), ("b", None), (None, "ko1")}


def test_texts_once_are_cut_before_they_are_dealt(spark):
    """Keys are those of whole texts; only what a cache keeps of a text is moved."""
    long = "x" * 9000
    d = spark.createDataFrame([(long + "a", "en"), (long + "b", "de"), (long + "a", "de"), ("short", None)], "text string, lang string").repartition(3)
    once = reference._once(d, "lang")
    got = {r["k"]: (r["text"], r["lang"]) for r in once.collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): (t[:8000], lang) for t, lang in ((long + "a", "de"), (long + "b", "de"), ("short", None))}
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "8000)" in plan[plan.index("Exchange hashpartitioning(k") :]
