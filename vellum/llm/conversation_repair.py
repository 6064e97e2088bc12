"""Conversation structure repair: the cheapest edits to ``(s?(ua)+)?``, by a dynamic program shared over a prefix trie.

A conversation is its rows by turn (nulls first; rows of one turn by role, then text). A row's first fault counts: blank
(no character but space, tab, LF, VT, FF, CR), duplicate (its role and text stood before) or truncated (its last such
character is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate
rows), Insert of an empty user or assistant row anywhere 3; a truncated row that is not deleted adds 3. What is left must
be an optional system row and pairs of user and assistant, or nothing. Of equally cheap edits the ASCII-least string of
their initials wins.

How it runs: equal rows are counted before they are shuffled, rows are sorted over the whole cluster by conversation and
turn, and each task writes segments of at most ``SEGMENT`` rows with a signature, one sign a row for role and fault. The
distinct signatures are sorted, so that those with a common prefix stand together; a task inserts them into a trie, of
which it holds the rightmost path, computes a layer of the dynamic program once for each node and emits the answer at
each terminal: the least cost, order and edits from each start state to each end state. The answers of a conversation's
segments are then composed, four numbers a segment, so neither a conversation nor a set of equal ones needs a task that
holds all its rows. Only a digest passes all rows of a conversation through one task, as a stream.

Null roles and texts count as one space; roles of other initials than s, u, a can only be reroled or deleted. Null
conversation ids are one conversation. Very long texts make segments of few rows. Repeated rows are duplicates. Empty tables
give no rows. Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Rows and characters of a segment at most; a longer row is a segment of its own.
SEGMENT, SEGMENT_CHARS = 4096, 4 << 20
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row, which takes the role that the pattern wants next.
_NEXT = (USER, USER, ASSISTANT, USER)
_NONE = 1 << 30


def _moves(sign: str, state: int) -> list[tuple[str, int, int]]:
    """(edits, cost, state after) of a row from a state; an insert stands before the row that it makes possible.

    An insert before a Delete never wins, since the Delete first costs as much and is less.
    """
    out = [("D", 4, state)]
    if sign == "x":
        return out
    more = 3 if sign.isupper() else 0
    wanted = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(sign.lower())
    after, later = _NEXT[state], _NEXT[_NEXT[state]]
    out += [("R", 3 + more, after), ("IR", 6 + more, later)]
    if wanted == SYSTEM:
        out += [("K", more, SYSTEM)] if state == START else []
    elif wanted == after:
        out.append(("K", more, after))
    elif wanted == later:
        out.append(("IK", 3 + more, later))
    return out


@functools.lru_cache(1 << 16)
def _layer(costs: tuple[int, ...], ranks: tuple[int, ...], sign: str) -> tuple:
    """(more, costs, ranks, came, edits): the layer below, its costs less ``more``; which state each state came from, by what.

    ranks order the edits so far of the states. Edits of two states never begin one with the other, as both end with the
    same row, so ranks and the new edits alone order what follows.
    """
    best: list[tuple | None] = [None] * 4
    for state in range(4):
        if costs[state] >= _NONE:
            continue
        for edits, cost, after in _moves(sign, state):
            one = (costs[state] + cost, ranks[state], edits, state)
            if best[after] is None or one < best[after]:
                best[after] = one
    order = sorted((s for s in range(4) if best[s]), key=lambda s: best[s][1:3])
    least = min(b[0] for b in best if b)
    rank = tuple(order.index(s) if best[s] else 4 for s in range(4))
    return least, tuple(b[0] - least if b else _NONE for b in best), rank, tuple(b[3] if b else -1 for b in best), tuple(b[2] if b else "" for b in best)


class Trie:
    """Answers to sorted signatures: the layers along the path of the last one, from one start state."""

    def __init__(self, start: int):
        self.path: list[tuple] = []  # (cost, costs, ranks, came, edits) of each node from the root on
        self.root = (0, tuple(0 if s == start else _NONE for s in range(4)), tuple(0 if s == start else 4 for s in range(4)), None, None)
        self.last = ""
        self.layers = 0

    def answers(self, signature: str) -> list[tuple[int, int, int, str]]:
        """(state, cost, order, edits) of each state that the signature's rows can end in."""
        shared = 0
        for a, b in zip(signature, self.last):
            if a != b:
                break
            shared += 1
        del self.path[shared:]
        for sign in signature[shared:]:
            total, costs, ranks = (self.path[-1] if self.path else self.root)[:3]
            more, costs, ranks, came, edits = _layer(costs, ranks, sign)
            self.path.append((total + more, costs, ranks, came, edits))
            self.layers += 1
        self.last = signature
        total, costs, ranks = (self.path[-1] if self.path else self.root)[:3]
        return [(s, total + costs[s], ranks[s], self._edits(s)) for s in range(4) if costs[s] < _NONE]

    def _edits(self, state: int) -> str:
        out = []
        for _, _, _, came, edits in reversed(self.path):
            out.append(edits[state])
            state = came[state]
        return "".join(reversed(out))


#: What ends a conversation in each state: cost and inserts.
_CLOSE = ((0, ""), (6, "II"), (3, "I"), (0, ""))


def compose(segments: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, [(state before, state after) of each segment], inserts at the end) from each segment's (before, after, cost, order)."""
    now = {START: (0, 0)}
    back: list[dict[int, int]] = []
    for moves in segments:
        best: dict[int, tuple] = {}
        for before, after, cost, order in moves:
            if before in now:
                one = (now[before][0] + cost, now[before][1], order, before)
                if after not in best or one < best[after]:
                    best[after] = one
        ranked = sorted(best, key=lambda s: best[s][1:3])
        now = {s: (best[s][0], ranked.index(s)) for s in best}
        back.append({s: best[s][3] for s in best})
    cost, _, inserts, state = min((now[s][0] + _CLOSE[s][0], now[s][1], _CLOSE[s][1], s) for s in now)
    steps = []
    for came in reversed(back):
        steps.append((came[state], state))
        state = came[state]
    return cost, steps[::-1], inserts


def edited(roles: list[str], texts: list[str], edits: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the rows that are left or inserted."""
    at = 0
    for e in edits:
        if e == "D":
            at += 1
            continue
        if e == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[at][:1]]
            yield roles[at], texts[at], e
        else:
            state = _NEXT[state]
            yield "user" if state == USER else "assistant", "" if e == "I" else texts[at], e
        at += e != "I"


def faults(text: Column, first: Column) -> Column:
    """A row's first fault, or null; first: no earlier row has its role and text."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return F.when(bare == "", "blank").when(~first, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


_SEGMENTS = (
    "part int, number int, conv_id {kind}, signature string, roles array<string>, texts array<string>, turns long, low long, high long, "
    "blank long, duplicate long, truncated long, illegal long, head string, tail string"
)


def segments(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written segments of the conversations' rows in order; (part, number) names a segment and orders those of a conversation."""
    kind = df.schema[key].dataType.simpleString()
    blank = F.lit(" ")
    rows = df.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("conv_id", "role", "text").agg(F.min(place)["turn"].alias("turn")).withColumn("_first", F.lit(True))
    # a first row is met by its turn too, so a row that stands in very many turns is no hot key
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.alias("r").join(firsts.alias("f"), functools.reduce(lambda a, b: a & b, same), "left").select("r.*", F.coalesce("_first", F.lit(False)).alias("first"))
    rows = rows.withColumn("fault", faults(F.col("text"), F.col("first")))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "copies", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema, held, found = None, [], None
        number = chars = 0
        begun = False  # whether the partition's first conversation, which may have begun before, is over
        for batch in batches:
            if schema is None:
                conv_type = batch.schema.field(0).type
                schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("conv_id", conv_type), ("signature", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
                                   + [(c, pa.int64()) for c in ("turns", "low", "high", "blank", "duplicate", "truncated", "illegal")] + [("head", pa.string()), ("tail", pa.string())])
            for conv, turn_, role_, text_, copies, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if found is not None and found["conv_id"] != conv:
                    held.append(_closed(found, part, number))
                    chars += found["chars"]
                    number, found, begun = number + 1, None, True
                sign = role_[:1] if role_[:1] in ("s", "u", "a") else "o"
                for i in range(copies):
                    if found is not None and (len(found["roles"]) >= SEGMENT or found["chars"] + len(text_) > SEGMENT_CHARS):
                        held.append(_closed(found, part, number))
                        chars += found["chars"]
                        number, found = number + 1, _opened(conv, False)
                    if found is None:
                        found = _opened(conv, begun)
                    _add(found, turn_, role_, text_, sign, fault if i == 0 or fault == "blank" else "duplicate")
                    if len(held) >= 256 or chars >= SEGMENT_CHARS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, chars = [], 0
        if found is not None:
            held.append(_closed(found, part, number))
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return cut(rows.mapInArrow(run, _SEGMENTS.format(kind=kind)))


def _opened(conv: object, first: bool) -> dict:
    return {"conv_id": conv, "first": first, "signs": [], "roles": [], "texts": [], "chars": 0, "turns": 0, "low": None, "high": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": "", "tail": ""}


def _add(seg: dict, turn: int | None, role: str, text: str, sign: str, fault: str | None) -> None:
    if turn is not None:
        seg["turns"] += turn != seg["high"]
        seg["low"] = turn if seg["low"] is None else seg["low"]
        seg["high"] = turn
    if seg["roles"]:
        seg["illegal"] += seg["tail"] + sign not in ("su", "ua", "au")
    seg["head"], seg["tail"] = seg["head"] or sign, sign
    seg["signs"].append("x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign)
    if fault:
        seg[fault] += 1
    seg["roles"].append(role)
    seg["texts"].append(text)
    seg["chars"] += len(text)


def _closed(seg: dict, part: int, number: int) -> dict:
    """A signature that surely begins its conversation says so by its first sign: it has one start state."""
    signature = ("^" if seg["first"] else "") + "".join(seg["signs"])
    return {k: v for k, v in seg.items() if k not in ("first", "signs", "chars")} | {"part": part, "number": number, "signature": signature}


_ANSWERS = "array<struct<before: int, after: int, cost: long, rank: int, edits: string>>"


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, weight, moves): moves from each start state to each end state, for distinct signatures."""
    ordered = signatures.repartitionByRange("signature").sortWithinPartitions("signature").select("signature", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {mark: [Trie(s) for s in starts] for mark, starts in (("^", (START,)), ("", (START, SYSTEM, USER, ASSISTANT)))}
        kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())]))
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                moves = []
                for signature in part.column(0).to_pylist():
                    of = tries["^" if signature.startswith("^") else ""]
                    starts = (START,) if len(of) == 1 else range(4)
                    moves.append([{"before": b, "after": a, "cost": c, "rank": r, "edits": e} for b, t in zip(starts, of) for a, c, r, e in t.answers(signature.lstrip("^"))])
                yield pa.record_batch([part.column(0), part.column(1), pa.array(moves, kind)], names=["signature", "weight", "moves"])

    return ordered.mapInArrow(run, f"signature string, weight long, moves {_ANSWERS}")


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plan(df: DataFrame, **columns: str) -> DataFrame:
    """Written segments with their edits: (part, number, conv_id, roles, texts, state, edits, and at a conversation's last segment its totals)."""
    segs = segments(df, **columns)
    answers = cut(solved(segs.groupBy("signature").agg(F.count(F.lit(1)).alias("weight"))))
    met = cut(join_hot(segs, answers, "signature", "weight"))
    slim = F.transform("moves", lambda m: F.struct(m["before"].alias("before"), m["after"].alias("after"), m["cost"].alias("cost"), m["rank"].alias("rank")))
    light = met.select("part", "number", "conv_id", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "head", "tail", slim.alias("moves"))
    light = light.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[dict] = []
        names = [("part", pa.int32()), ("number", pa.int32()), ("state", pa.int32()), ("end", pa.int32()), ("inserts", pa.string()), *((c, pa.int64()) for c in _TOTALS)]
        schema = pa.schema(names)
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[-1]["conv_id"] != row["conv_id"]:
                    out += _conversation(group)
                    group = []
                row["moves"] = [(m["before"], m["after"], m["cost"], m["rank"]) for m in row["moves"]]
                group.append(row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if group:
            out += _conversation(group)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    chosen = light.mapInArrow(run, "part int, number int, state int, end int, inserts string, " + ", ".join(f"{c} long" for c in _TOTALS))
    both = met.select("part", "number", "conv_id", "roles", "texts", "moves").join(chosen, ["part", "number"])
    mine = F.filter("moves", lambda m: (m["before"] == F.col("state")) & (m["after"] == F.col("end")))[0]["edits"]
    return cut(both.select("part", "number", "conv_id", "roles", "texts", "state", F.concat(mine, F.coalesce("inserts", F.lit(""))).alias("edits"), *_TOTALS))


def _conversation(group: list[dict]) -> list[dict]:
    cost, steps, inserts = compose([g["moves"] for g in group])
    out = [{"part": g["part"], "number": g["number"], "state": a, "end": b} for g, (a, b) in zip(group, steps)]
    known = [g for g in group if g["high"] is not None]
    turns = sum(g["turns"] for g in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    totals = {c: sum(g[c] for g in group) for c in ("blank", "duplicate", "truncated", "illegal")}
    totals["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
    out[-1] |= totals | {"gaps": gaps, "cost": cost, "inserts": inserts}
    return out


def repaired(planned: DataFrame) -> DataFrame:
    """(conv_id, part, number, i, role, text, edit): the rows of the repaired conversations, ordered by part, number and i."""
    kind = planned.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.to_pylist()[0]
                rows = list(edited(row["roles"], row["texts"], row["edits"], row["state"]))
                if rows:
                    same = [one.column(c).take(pa.array([0] * len(rows))) for c in range(3)]
                    yield pa.record_batch([*same, pa.array(range(len(rows)), pa.int32()), *(pa.array(x, pa.string()) for x in zip(*rows))], names=["conv_id", "part", "number", "i", "role", "text", "edit"])

    return planned.select("conv_id", "part", "number", "roles", "texts", "state", "edits").mapInArrow(run, f"conv_id {kind}, part int, number int, i int, role string, text string, edit string")


def summary(planned: DataFrame) -> DataFrame:
    """(conv_id, totals, audit, repaired_sha256) of each conversation; its rows pass as a stream, only the edits are held."""
    kind = planned.schema["conv_id"].dataType.simpleString()
    ordered = planned.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").select("conv_id", "roles", "texts", "state", "edits", *_TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, any_row = hashlib.sha256(), [], False
        for batch in batches:
            ends, found = [], []
            for at, row in enumerate(batch.to_pylist()):
                for role, text, _ in edited(row["roles"], row["texts"], row["edits"], row["state"]):
                    digest.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
                    any_row = True
                audit.append(row["edits"])
                if row["cost"] is not None:
                    ends.append(at)
                    found.append(("".join(audit), digest.hexdigest()))
                    digest, audit, any_row = hashlib.sha256(), [], False
            kept = batch.take(pa.array(ends, pa.int64()))
            yield pa.record_batch([kept.column(0), *(kept.column(5 + i) for i in range(len(_TOTALS))), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], names=["conv_id", *_TOTALS, "audit", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _TOTALS) + ", audit string, repaired_sha256 string")


def report(df: DataFrame, ids: DataFrame, **columns: str) -> DataFrame:
    """``summary`` of the rows of ``df`` for each distinct conv_id of ``ids``; one without rows has zeros and empty edits."""
    found = summary(plan(df, **columns))
    every = ids.select("conv_id").distinct()
    both = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    numbers = (F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in _TOTALS)
    return both.select("e.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
