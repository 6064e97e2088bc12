"""Conversation repair against all edits tried out, a search for long ones, and plain Python for the whole query."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from conftest import SF

from vellum.llm import conversation_repair as C
from vellum.llm import queries

BLANK = " \t\n\x0b\x0c\r"


def tried(signs):
    """(cost, audit) of the best of all edits of a few rows."""
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    rows = []
    for s in signs:
        more = 3 if s.isupper() else 0
        rows.append([("D", "", 4)] + ([] if s == "x" else [("K", s.lower(), more), ("R", "u", 3 + more), ("R", "a", 3 + more)]))
    best = None
    for picks in itertools.product(*rows):
        for gaps in itertools.product(inserts, repeat=len(signs) + 1):
            roles = audit = ""
            cost = 0
            for gap, pick in itertools.zip_longest(gaps, picks, fillvalue=("", "", 0)):
                roles += "".join(gap) + pick[1]
                audit += "I" * len(gap) + pick[0]
                cost += 3 * len(gap) + pick[2]
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def searched(signs):
    """(cost, audit, roles): cheapest-first search over prefixes of edits, for longer signatures."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        state = (at, roles[-1:], roles == "" or None)
        if at == len(signs) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        if state in seen:
            continue
        seen.add(state)
        ok = lambda r: re.fullmatch("(s?(ua)*u?)?", r)
        heap_add = lambda *x: heapq.heappush(heap, x)
        for r in "ua":
            if ok(roles + r):
                heap_add(cost + 3, audit + "I", at, roles + r)
        if at < len(signs):
            s = signs[at]
            heap_add(cost + 4, audit + "D", at + 1, roles)
            if s != "x":
                more = 3 if s.isupper() else 0
                if ok(roles + s.lower()):
                    heap_add(cost + more, audit + "K", at + 1, roles + s.lower())
                for r in "ua":
                    if ok(roles + r):
                        heap_add(cost + 3 + more, audit + "R", at + 1, roles + r)
    raise AssertionError


def answer(signs, sizes):
    """(cost, audit) by tries over the signature in segments."""
    parts, at = [], 0
    for n in sizes:
        parts.append(signs[at : at + n])
        at += n
    parts = [*parts, signs[at:]] if at < len(signs) else parts
    moves = [[(b, *m) for b in range(4) for m in C.Trie(b).answers(p)] for p in parts]
    cost, steps, inserts = C.compose([[m[:4] for m in seg] for seg in moves])
    edits = "".join(next(e for b, a, _, _, e in seg if (b, a) == step) for seg, step in zip(moves, steps))
    return cost, edits + inserts


@pytest.mark.parametrize("n", [1, 2])
def test_every_short_signature(n):
    for signs in itertools.product("suaoSUAOx", repeat=n):
        assert answer("".join(signs), [1] * n) == answer("".join(signs), [n]) == tried(signs), signs


def test_random_signatures():
    rng = random.Random(3)
    for _ in range(12):
        signs = "".join(rng.choices("suaoSUAx", k=3))
        assert answer(signs, [3]) == tried(signs) == searched(signs)[:2]
    for _ in range(400):
        n = rng.randint(1, 24)
        signs = "".join(rng.choices("suaoSUAOx", [1, 6, 6, 1, 1, 2, 2, 1, 3], k=n))
        assert answer(signs, [n]) == answer(signs, [rng.randint(1, 4)] * (n // 4)) == searched(signs)[:2], signs


def test_layers_are_shared():
    trie = C.Trie(C.START)
    signatures = sorted("uaua" * 5 + x + y for x in "uax" for y in "uax")
    for s in signatures:
        assert trie.answers(s) == C.Trie(C.START).answers(s)
    assert trie.layers == 20 + 3 + 9


def plain(rows):
    """The contract in plain Python: rows (conv_id, turn, role, text) before damage."""
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        how = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", said[3]) if how == 2 else said[3]
        convs[conv] += [(turn, "user" if how == 4 else said[2], text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return {conv: judged(found) for conv, found in convs.items()}


def judged(found):
    found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, seen, signs = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), ""
    for _, role, text in found:
        fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANK)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signs += "x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
    turns = [t for t, _, _ in found if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    cost, audit, roles = searched(signs)
    out, at, left = [], 0, iter(roles)
    for e in audit:
        if e == "D":
            at += 1
            continue
        name = {"s": "system", "u": "user", "a": "assistant"}[next(left)]
        out.append(f"{name if e != 'K' else found[at][1]}:{'' if e == 'I' else found[at][2]}")
        at += e != "I"
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = got(queries.op12_conversation_repair(spark, SF))
    assert found == plain(rows)
    assert {c: max(v[i] for v in found.values()) > 0 for i, c in enumerate(COLUMNS[:6])} == dict.fromkeys(COLUMNS[:6], True)


ODD = [
    (None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Yes!"),
    (1, 0, "tool", "x."), (1, 0, "user", "b."), (1, 0, "user", "a."), (1, None, "system", "Be good. \n"), (1, 9, "assistant", "é?"),
    (2, 5, "user", "one"), (2, 5, "user", "one"), (2, 5, "user", "one"), (2, 7, "user", "one"), (2, 8, "assistant", "\x0b \t"),
    *((3, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(700)),
    *((3, 5, "user", "again.") for _ in range(300)),
    (4, 0, "user", "word " * 60_000), (5, 0, "", ""), (6, None, "assistant", "no turn."),
]


@pytest.mark.parametrize("segment, chars", [(4096, 4 << 20), (7, 40)])
def test_odd_rows(spark, monkeypatch, segment, chars):
    monkeypatch.setattr(C, "SEGMENT", segment)
    monkeypatch.setattr(C, "SEGMENT_CHARS", chars)
    schema = "conv_id long, turn long, role string, text string, state int, part string, edits string, first int, signature string"
    df = spark.createDataFrame([(*r, 1, "p", "e", 2, "s") for r in ODD], schema).repartition(5)
    assert got(C.report(queries.damaged(df), df)) == plain(ODD)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Well"), (1, 2, "assistant", " ")], "conv_id long, turn int, role string, text string")
    rows = C.repaired(C.plan(df)).orderBy("part", "number", "i").collect()
    cost, audit, _ = searched("aAx")
    assert "".join(r["edit"] for r in rows) == audit.replace("D", "")
    assert [r["role"] for r in rows] == ["user", "assistant"] * (len(rows) // 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.report(queries.damaged(df), df).collect() == []
    one = spark.createDataFrame([(1, 2, "user", "x.")], df.schema)
    assert got(C.report(df, one)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
