"""Toxic spans by a linear-chain conditional random field.

Tokens get one of two labels. A token's features are its normalised form and that form's beginnings and
endings; neighbours act through the transition weights. Training has document labels only, so tokens are
labelled by them in expectation: a clean document's tokens are all clean, and a toxic one has at least one toxic token,
which one being weighed by the model's own marginals. The weights of features, transitions and starts climb the likelihood of
that: their slopes are the expected counts that forward-backward gives, of tokens and of pairs of neighbours.

Scoring: a token's emission depends on its form only, so it is computed once a form. The forward and
backward ratios of all texts of a batch run in one blocked scan: within blocks in step, between blocks by
the blocks' 2x2 products, so a text of any length costs the same per token. Marginals over the least give
the offending offsets; their noisy-or, calibrated on training documents, is the document's score.

The fit uses a bounded sample of labelled rows, those of the least hash in each class, and runs in a task, whose memory
the bounds hold down; only the weights come to the driver. Everything else covers all rows, whole texts; a very long text
is a step of its own, with some hundred bytes a token. Null and empty texts have no tokens and get the score of a document without
evidence; rows that repeat are scored each; a key whose labels contradict each other counts as toxic, equal hashes are ordered by key; other columns, and labels of rows that are held out, are not touched. Without any
labelled row of both classes every score is the share of toxic ones, or 0.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, rows_of, steps

#: Labelled rows of each class that the fit may use, and bytes of their texts; a text of over a quarter of these is not used.
SAMPLE = 1500
SAMPLE_BYTES = 8_000_000
#: Bytes of the texts of one step of scoring.
STEP = 2_000_000
AFFIXES = range(3, 9)
#: Tokens whose emissions are held in memory for reuse; beyond that the table is emptied, which no result depends on.
KEPT = 400_000
_TRIM = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def form(token: str) -> str:
    """A token in lower case without signs at its ends."""
    m = _TRIM.search(token.lower())
    return m[0] if m else ""


def features(word: str) -> list[str]:
    if not word:
        return ["-"]
    return [f"w:{word}", *(f"p:{word[:n]}" for n in AFFIXES if n < len(word)), *(f"s:{word[-n:]}" for n in AFFIXES if n < len(word))]


class Chain:
    """Forward-backward over concatenated texts. T: 2x2 potentials of the transitions, start: of a first token's toxicity."""

    def __init__(self, transitions: np.ndarray, start: float):
        self.t, self.s = np.exp(transitions), np.exp(start)

    def _scan(self, m: list[np.ndarray]) -> np.ndarray:
        """x1/x0 after each position, where (x0, x1) becomes m (x0, x1) at each; the first must not depend on what was before."""
        n = len(m[0])
        steps = max(1, int(n**0.5))
        blocks = -(-n // steps)
        pad = blocks * steps - n
        a, b, c, d = (np.concatenate([x, np.full(pad, fill)]).reshape(blocks, steps).T.copy() for x, fill in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True))
        p, q, r, s = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
        for k in range(1, steps):
            p, q, r, s = a[k] * p + b[k] * r, a[k] * q + b[k] * s, c[k] * p + d[k] * r, c[k] * q + d[k] * s
            scale = 1.0 / (p + q + r + s)
            p, q, r, s = p * scale, q * scale, r * scale, s * scale
        x = np.empty(blocks)
        now = 1.0
        for k, (p1, q1, r1, s1) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
            x[k] = now
            now = (r1 + s1 * now) / (p1 + q1 * now)
        out = np.empty((steps, blocks))
        for k in range(steps):
            x = (c[k] + d[k] * x) / (a[k] + b[k] * x)
            out[k] = x
        return out.T.reshape(-1)[:n]

    def run(self, emission: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(toxic marginal of each token, ratio forward, ratio backward); starts: places of the texts' first tokens."""
        n = len(emission)
        e = np.exp(np.clip(emission, -25, 25))
        (t00, t01), (t10, t11) = self.t
        first = np.zeros(n, bool)
        first[starts] = True
        one = np.ones(n)
        forward = self._scan([np.where(first, one, t00), np.where(first, 1.0, t10), np.where(first, e * self.s, t01 * e), np.where(first, e * self.s, t11 * e)])
        # backward, from the last token: the ratio before a text's last token starts at 1
        last = np.concatenate([first[1:], [True]])[::-1]
        ahead = np.concatenate([[1.0], e[::-1][:-1]])
        backward = self._scan([np.where(last, one, t00), np.where(last, 1.0, t01 * ahead), np.where(last, one, t10), np.where(last, 1.0, t11 * ahead)])[::-1]
        both = forward * backward
        return both / (1 + both), forward, backward

    def log_all_clean(self, forward: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability that a text has no toxic token."""
        (t00, _), (t10, _) = self.t
        grown = np.log(t00 + forward * t10)
        total = np.concatenate([[0.0], np.cumsum(grown)])
        clean = np.log(t00) * (ends - starts - 1)
        return clean - (total[ends - 1] - total[starts]) - np.log1p(forward[ends - 1])


    def pairs(self, emission: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Marginals of (clean, toxic), (toxic, clean), (toxic, toxic) for each token and the next, as rows; where a text ends they mean nothing."""
        e = np.exp(np.clip(emission[1:], -25, 25)) * backward[1:]
        f = forward[:-1]
        (t00, t01), (t10, t11) = self.t
        made = np.stack([t01 * e, f * t10, f * t11 * e])
        return made / (t00 + made.sum(axis=0))


def slopes(chain: Chain, emission: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the documents' log-likelihood by each token's emission, and by the transitions' and the start's weights: 01, 10, 11, start."""
    m, forward, backward = chain.run(emission, starts)
    q = np.clip(chain.log_all_clean(forward, starts, ends), -50, -1e-9)
    push = np.where(y == 1, np.exp(q) / -np.expm1(q), -1.0)  # a toxic document that is explained pushes no more
    inside = owner[1:] == owner[:-1]
    pair = (chain.pairs(emission, forward, backward) * (push[owner[1:]] * inside)).sum(axis=1)
    return push[owner] * m, np.append(pair, (push * m[starts]).sum())


class Model:
    """Weights by feature, transitions, and the calibration of document scores."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, start: float, calibration: tuple[float, float, float], least: float):
        self.weights, self.bias, self.transitions, self.start, self.calibration, self.least = weights, bias, transitions, start, calibration, least

    def emission(self, token: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(form(token.decode("utf-8", "replace"))))

    def scores(self, evidence: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Calibrated scores from the noisy-or of the marginals and the texts' lengths."""
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * evidence + c * np.log1p(tokens), -30, 30)))


def evidence(marginals: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float) -> np.ndarray:
    """Log-odds of the noisy-or of the marginals from ``least`` on, for each text."""
    m = np.where(marginals >= least, np.minimum(marginals, 1 - 1e-6), 0.0)
    total = np.concatenate([[0.0], np.cumsum(-np.log1p(-m))])
    some = -np.expm1(-np.minimum(total[ends] - total[starts], 12.0))
    return np.log((some + 0.02) / (1 - some + 0.02))


def train(texts: list[str | None], toxic: np.ndarray, share: float, *, rounds: int = 40, least: float = 0.3) -> Model:
    """Fits all weights to documents and their labels; share: of toxic ones among all labelled documents."""
    if not len(texts) or toxic.all() or not toxic.any():
        base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model({}, -12.0, np.zeros((2, 2)), 0.0, (base, 0.0, 0.0), least)
    known: dict[str, int] = {}
    ids = [np.fromiter((known.setdefault(form(m[0]), len(known)) for m in _TOKEN.finditer(x or "")), np.int32) for x in texts]
    forms = list(known)
    # features of at least two toxic documents; most stand in one, so their names are not held: small counts
    # under a hash come first, and only what may have two is counted by name
    mask = (1 << 22) - 1
    rough = bytearray(mask + 1)
    for one, t in zip(ids, toxic, strict=True):
        if t:
            for h in {hash(f) & mask for i in np.unique(one) for f in features(forms[i])}:
                rough[h] = min(rough[h] + 1, 2)
    seen: Counter[str] = Counter()
    for one, t in zip(ids, toxic, strict=True):
        if t:
            seen.update({f for i in np.unique(one) for f in features(forms[i]) if rough[hash(f) & mask] > 1})
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    del seen, rough
    row, col = array("i"), array("i")  # a few million numbers; lists would hold objects
    for i, w in enumerate(forms):
        for f in features(w):
            if (k := index.get(f)) is not None:
                row.append(i)
                col.append(k)
    row, col = np.array(row, np.int32), np.array(col, np.int32)
    del known
    lengths = np.array([len(x) for x in ids])
    used = np.flatnonzero(lengths)
    flat, lengths, y = np.concatenate([ids[i] for i in used]) if len(used) else np.zeros(0, np.int32), lengths[used], toxic[used]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(used), dtype=np.int32), lengths)
    # start from the features' log-odds of document frequency
    pairs = np.unique(owner.astype(np.int64) * len(forms) + flat)
    doc_of, form_of = pairs // len(forms), pairs % len(forms)
    del pairs
    df = [np.bincount(form_of[y[doc_of] == k], minlength=len(forms)) for k in (0, 1)]
    freq = [np.minimum(np.bincount(col, d[row].astype(float), minlength=len(index)), (y == k).sum()) for k, d in enumerate(df)]
    odds = np.log((freq[1] + 0.5) / (y.sum() + 1)) - np.log((freq[0] + 0.5) / ((1 - y).sum() + 1))
    theta = np.clip(odds - 1.0, 0, 3) * (freq[1] >= 2) * 0.5
    # the transition from clean to clean is the one that the others are measured by
    bias, moves = -7.0, np.array([0.0, 0.0, 0.5, 0.0])
    squares = np.full(len(index), 1e-3)
    b_square, m_square = 1e-3, np.full(4, 1.0)
    for _ in range(rounds):
        e_form = bias + np.bincount(row, theta[col], minlength=len(forms))
        chain = Chain(np.array([[0.0, moves[0]], [moves[1], moves[2]]]), moves[3])
        g, turn = slopes(chain, e_form[flat], owner, starts, ends, y)
        slope = np.bincount(col, np.bincount(flat, g, minlength=len(forms))[row], minlength=len(index)) - 0.02 * theta
        squares += slope * slope
        theta += 0.5 * slope / np.sqrt(squares)
        g_bias = float(np.clip(g.sum(), -50, 50))
        b_square += g_bias * g_bias
        bias += 0.2 * g_bias / b_square**0.5
        turn = np.clip(turn - 0.5 * moves, -50, 50)
        m_square += turn * turn
        moves = np.clip(moves + 0.05 * turn / np.sqrt(m_square), -3.0, 3.0)
    transitions, start = np.array([[0.0, moves[0]], [moves[1], moves[2]]]), float(moves[3])
    m = Chain(transitions, start).run((bias + np.bincount(row, theta[col], minlength=len(forms)))[flat], starts)[0]
    x = evidence(m, starts, ends, least)
    design = np.stack([np.ones(len(x)), x, np.log1p(lengths)], axis=1)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    w = np.zeros(3)
    for _ in range(30):  # Newton's steps of a logistic regression with a weak prior
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        prior = np.array([0.01, 0.01, 1.0])
        grad = design.T @ (weight * (y - p)) - prior * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(prior)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    kept = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}
    return Model(kept, float(bias), transitions, start, (float(w[0]), float(w[1]), float(w[2])), least)


def fit(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on at most ``sample`` labelled rows of each class, those whose keys have the least hashes, and at most ``sample_bytes`` of their texts.

    Of several texts of one key the least is taken, of labels that contradict each other the toxic one.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    share = float(known.agg(F.avg("_y")).first()[0] or 0.0)
    least = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(sample)
    chosen = F.broadcast(least(1).unionByName(least(0)))  # 2 * sample rows at most
    rows = df.select(key, F.col(text).alias("_text")).join(chosen, key).groupBy(key).agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    order = F.struct(F.xxhash64(key), F.col(key))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    fitting = rows.where(size <= sample_bytes // 4).withColumn("_upto", F.sum(size).over(Window.partitionBy("_y").orderBy(order)))  # over 2 * sample rows
    fitting = fitting.where(F.col("_upto") <= sample_bytes // 2).select(F.lit(0).alias("_g"), F.col(key).cast("string").alias("_key"), "_text", F.col("_y").cast("int").alias("_y"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_key", "ascending")])
        model = train(group["_text"].to_pylist(), group["_y"].to_numpy().astype(np.int64), share)
        give_back()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = fitting.groupBy("_g").applyInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else train([], np.zeros(0, np.int64), share)


def score(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", at_least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """(key, score, spans) of each row and the columns to ``carry``; spans: (start, end) characters of the tokens marked toxic, neighbours joined."""
    carried = carry or []
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the features of 2 * sample documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Emissions(model)
        chain = Chain(model.transitions, model.start)
        for batch in batches:
            bodies = rows_of(batch, "_text").to_pylist()
            for at in steps(bodies, STEP):
                texts, part = bodies[at], batch.slice(at.start, at.stop - at.start)
                tokens = [(x or "").encode().split() for x in texts]
                lengths = np.array([len(t) for t in tokens])
                used = np.flatnonzero(lengths)
                ends = np.cumsum(lengths[used])
                starts = ends - lengths[used]
                e = np.fromiter((known[t] for i in used for t in tokens[i]), np.float64, int(lengths.sum()))
                found = np.full(len(texts), evidence(np.zeros(0), np.zeros(1, np.int64), np.zeros(1, np.int64), 0)[0])
                spans: list[list[dict]] = [[] for _ in texts]
                if len(used):
                    m = chain.run(e, starts)[0]
                    found[used] = evidence(m, starts, ends, model.least)
                    hot = np.flatnonzero(m >= at_least)
                    of = np.searchsorted(ends, hot, side="right")
                    for k in np.unique(of).tolist():
                        places = [x.span() for x in _TOKEN.finditer(texts[used[k]])]
                        marked = spans[used[k]]
                        before = -2
                        for t in (hot[of == k] - starts[k]).tolist():
                            a, b = places[t]
                            if t == before + 1:
                                marked[-1]["end"] = b
                            else:
                                marked.append({"start": a, "end": b})
                            before = t
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                own = [rows_of(part, "_text" if c == text else c) for c in carried]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(found, lengths)), pa.array(spans, kind), *own], [key, "score", "spans", *carried])
            give_back()

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([df.schema[key], T.StructField("score", T.DoubleType()), T.StructField("spans", spans), *(df.schema[c] for c in carried)])
    return df.select(key, F.col(text).alias("_text"), *(c for c in carried if c != text)).mapInArrow(run, schema)


class _Emissions(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: bytes) -> float:
        value = self.model.emission(token)
        if len(token) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[token] = value
        return value


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1
