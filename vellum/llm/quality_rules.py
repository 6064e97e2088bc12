"""Robust multivariate outliers among document statistics, by language and source.

Every document gets a vector of transformed statistics. For each language and source the minimum
covariance determinant estimate is sought by concentration steps: distances from the present centre and
scatter, the closest share of the group, its mean and covariance, again, until the determinants rest. There are
three starts: the language's medians and quartile ranges, the group's own, the group's mean and covariance; the
one that ends at the least determinant is taken, and its scatter widened by the factor that makes it consistent for normal
vectors. The language's medians and ranges also stand in as some documents' worth of evidence, so that small or
constant groups have a proper scatter. A document whose squared Mahalanobis distance exceeds the cut is
rejected, and so is one that fails the base rules.

Everything is DataFrame expressions. Distances are ranked through a histogram of their logarithm, so a
group of any size is reduced before it is shuffled. Null texts count as empty; a null language or source
is a group of its own; rows that repeat are judged each; distances that tie share a bin, which is taken or left whole; a
very long text is one row in one task, with some tens of bytes a word, and its repeated windows are exact; starts that tie are taken in
the order above; columns of the input are kept, and one named
like a made column gives way to it in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Features and the least scale each may have (all are logarithms).
FEATURES = {"words": 0.5, "word_length": 0.08, "symbols": 0.35, "repeats": 0.45, "dup_lines": 0.45, "upper": 0.35}
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Bins of the distances' histogram to a factor of two.
BINS = 16
#: Groups up to which their estimates (about 300 bytes each) are broadcast; beyond it they are joined by key.
BROADCAST_GROUPS = 50_000


def statistics(df: DataFrame, text: str = "text", mask: int = -1) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines, n_upper.

    Repeated three-word windows are found by sorting, within the row, one 64-bit number for each window:
    leading bits of a hash of its words (``mask`` keeps some of them) and its place. Neighbours of equal bits are compared word by
    word; where any differ, the text's windows are sorted by their words.
    """
    window = lambda i: f"xxhash64(_w[{i}], _w[{i} + 1], _w[{i} + 2])"
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_w", F.array_remove(F.split(t, SPACE), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long"),
        "_lines": lines,
        "_b": F.length(F.bin(F.size("_w").cast("long"))),
    })
    out = out.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_p": F.expr(f"if(size(_w) < 3, array(), sort_array(transform(sequence(0L, size(_w) - 3L), i -> shiftleft(shiftright({window('int(i)')} & {mask}L, _b), _b) | i)))"),
        "_mask": F.expr("shiftleft(1L, _b) - 1L"),
    })
    alike = "(_p[k] | _mask) = (_p[k - 1] | _mask)"
    same = " and ".join(f"_w[int(_p[k] & _mask) + {d}] = _w[int(_p[k - 1] & _mask) + {d}]" for d in range(3))
    out = out.withColumn("_k", F.expr(f"if(size(_p) < 2, array(), filter(sequence(1, size(_p) - 1), k -> {alike}))"))
    # other words under the same bits: such a text sorts its windows by their words instead
    out = out.withColumn("_mixed", F.expr(f"exists(_k, k -> not ({same}))"))
    whole = "transform(sequence(0, size(_w) - 3), i -> struct(_w[i] as a, _w[i + 1] as b, _w[i + 2] as c, i as i))"
    pairs = f"transform(array(sort_array({whole})), p -> flatten(transform(filter(sequence(1, size(p) - 1), k -> p[k].a = p[k - 1].a and p[k].b = p[k - 1].b and p[k].c = p[k - 1].c), k -> array(p[k].i, p[k - 1].i))))[0]"
    starts = f"if(_mixed, transform({pairs}, x -> bigint(x)), flatten(transform(_k, k -> array(_p[k] & _mask, _p[k - 1] & _mask))))"
    out = out.withColumn("_s", F.expr(starts))
    out = out.withColumn("n_repeat_words", F.expr("size(array_distinct(flatten(transform(_s, s -> array(s, s + 1, s + 2)))))").cast("long"))
    return out.drop("_w", "_lines", "_b", "_p", "_mask", "_k", "_mixed", "_s")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(df: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds the group and the transformed vector to a DataFrame with the statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    made = [
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log(0.02 + F.col("n_symbols") / n),
        F.log(0.05 + F.col("n_repeat_words") / n),
        F.log(0.05 + F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log(0.02 + F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
    ]
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return df.withColumns({"_lang": key(lang), "_g": F.concat_ws("\n", key(lang), key(source)), **{f"_x{i}": x for i, x in enumerate(made)}})


def _with_distance(x: DataFrame, params: DataFrame, broadcast: bool) -> DataFrame:
    """The vectors with their squared distance; Cholesky solves are staged in columns, so that none is evaluated twice."""
    out = x.join(F.broadcast(params) if broadcast else params, "_g")
    for i in range(P):
        y = F.col(f"_x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}_{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", y / F.col(f"l{i}_{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)), F.lit(0.0))
    return out.withColumn("_d2", total).drop(*(f"_y{i}" for i in range(P)), *(c for c in params.columns if c not in ("_g", "_s")))


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds l{i}_{j} from the covariances c{i}_{j}, and drops these; a column of the factor at a time."""
    leasts = list(FEATURES.values())
    for j in range(P):
        rest = lambda i: F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))  # noqa: E731, B023
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest(j), F.lit(leasts[j] ** 2 * 1e-3))))
        if j + 1 < P:
            df = df.withColumns({f"l{i}_{j}": rest(i) / F.col(f"l{j}_{j}") for i in range(j + 1, P)})
    return df.drop(*(f"c{i}_{j}" for i, j in PAIRS))


def _chi(x: float, k: int) -> float:
    """Share of a chi-square variable of 2k degrees of freedom up to x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k))


def _quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi(mid, k) < p else (low, mid)
    return high


def _scale(q: Column, least: float) -> Column:
    return F.greatest((q[2] - q[0]) / 1.349, F.lit(least))


def _diagonal(rows: DataFrame, start: int, centre: str, scale: str) -> DataFrame:
    ls = [(F.col(f"{scale}{i}") if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i, j in PAIRS]
    return rows.select("_g", F.lit(start).alias("_s"), *(F.col(f"{centre}{i}").alias(f"m{i}") for i in range(P)), *ls)


def _estimates(groups: DataFrame, sums: DataFrame, prior: float) -> DataFrame:
    """(_g, _s, m*, l*, _det) from sums of rows (n, a*, b*); det: the logarithm of the determinant."""
    joined = sums.join(groups, "_g")
    n = F.col("n") + prior
    out = joined.withColumns({f"m{i}": (F.col(f"a{i}") + prior * F.col(f"s{i}")) / n for i in range(P)})
    cov = {}
    for i, j in PAIRS:
        # scatter about the new centre; the prior adds its own spread and that of its centre
        own = F.col(f"b{i}_{j}") - F.col(f"m{j}") * F.col(f"a{i}") - F.col(f"m{i}") * F.col(f"a{j}") + F.col("n") * F.col(f"m{i}") * F.col(f"m{j}")
        off = prior * (F.col(f"s{i}") - F.col(f"m{i}")) * (F.col(f"s{j}") - F.col(f"m{j}"))
        value = (own + off) / n
        if i == j:
            value = F.greatest(value + prior * F.col(f"v{i}") * F.col(f"v{i}") / n, F.lit(list(FEATURES.values())[i] ** 2))
        cov[f"c{i}_{j}"] = value
    out = _cholesky(out.withColumns(cov))
    det = 2 * sum((F.log(F.col(f"l{i}_{i}")) for i in range(P)), F.lit(0.0))
    return out.select("_g", "_s", *(f"m{i}" for i in range(P)), *(f"l{i}_{j}" for i, j in PAIRS), det.alias("_det"))


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(f"_x{i}").alias(f"a{i}") for i in range(P)), *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"b{i}_{j}") for i, j in PAIRS)]


def fit(x: DataFrame, *, share: float = 0.75, steps: int = 12, prior: float = 30.0, still: float = 0.1) -> DataFrame:
    """(_g, m*, l*) of each group, from its rows' vectors. share: of a group that a step keeps. prior: weight, in documents, of the language's start.

    Steps go on until no group's log determinant moves by ``still`` (bins of distances are taken whole, so it never quite rests), at most
    ``steps``; a group that moves even then keeps its last estimate.
    """
    x = x.select("_g", "_lang", *(f"_x{i}" for i in range(P)))
    quartiles = [F.percentile_approx(f"_x{i}", [0.25, 0.5, 0.75], 2000).alias(f"_q{i}") for i in range(P)]
    lang = x.groupBy("_lang").agg(*quartiles).select("_lang", *(F.col(f"_q{i}")[1].alias(f"s{i}") for i in range(P)), *(_scale(F.col(f"_q{i}"), w).alias(f"v{i}") for i, w in enumerate(FEATURES.values())))
    own = x.groupBy("_g").agg(F.first("_lang").alias("_lang"), *quartiles, *_sums())
    own = own.select("_g", "_lang", "n", *(f"a{i}" for i in range(P)), *(f"b{i}_{j}" for i, j in PAIRS), *(F.col(f"_q{i}")[1].alias(f"t{i}") for i in range(P)), *(_scale(F.col(f"_q{i}"), w).alias(f"u{i}") for i, w in enumerate(FEATURES.values())))
    all_ = cut(own.join(lang, "_lang"))
    groups = all_.select("_g", *(f"{c}{i}" for c in "sv" for i in range(P)))
    broadcast = all_.count() <= BROADCAST_GROUPS // 4
    whole = all_.select("_g", F.lit(2).alias("_s"), "n", *(f"a{i}" for i in range(P)), *(f"b{i}_{j}" for i, j in PAIRS))
    params = cut(_diagonal(all_, 0, "s", "v").unionByName(_diagonal(all_, 1, "t", "u")).unionByName(_estimates(groups, whole, prior).drop("_det")).withColumn("_det", F.lit(1e9)))
    order = Window.partitionBy("_g", "_s").orderBy("_bin")  # over a group's bins, some hundreds
    for _ in range(steps):
        near = _with_distance(x, params.drop("_det"), broadcast).withColumn("_bin", F.floor(BINS * F.log2(F.col("_d2") + 1e-9)))
        bins = near.groupBy("_g", "_s", "_bin").agg(*_sums())
        placed = bins.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        inner = placed.where(F.col("_upto") - F.col("n") < share * F.col("_all"))
        sums = inner.groupBy("_g", "_s").agg(*(F.sum(c).alias(c) for c in ("n", *(f"a{i}" for i in range(P)), *(f"b{i}_{j}" for i, j in PAIRS))))
        made = cut(_estimates(groups, sums, prior).join(params.select("_g", "_s", F.col("_det").alias("_was")), ["_g", "_s"]))
        moved = made.agg(F.max(F.abs(F.col("_det") - F.col("_was")))).first()[0] or 0.0
        params = made.drop("_was")
        if moved < still:
            break
    names = [c for c in params.columns if c not in ("_g", "_s", "_det")]
    best = params.groupBy("_g").agg(F.min_by(F.struct(*names), F.struct("_det", "_s")).alias("_b")).select("_g", "_b.*")
    # the closest share of normal vectors has less scatter than all; single precision of the share is enough
    widen = math.sqrt(share / _chi(_quantile(share, P // 2), P // 2 + 1))
    return cut(best.withColumns({f"l{i}_{j}": F.col(f"l{i}_{j}") * widen for i, j in PAIRS}))


def judge(df: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", reject: float = 1e-5, share: float = 0.75, steps: int = 12, keep_text: bool = True) -> DataFrame:
    """``df`` with its statistics, distance, base_failed and kept; without its texts if these aren't wanted. reject: share of normal vectors beyond the cut, a chi-square quantile of the squared distance."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distance", "base_failed", "kept"]
    own = [c for c in df.columns if c not in names]
    x = features(statistics(df.select(*own), text), lang=lang, source=source)
    if not keep_text:
        x, own = x.drop(text), [c for c in own if c != text]
    x = cut(x)
    params = fit(x, share=share, steps=steps)
    near = _with_distance(x, params, params.count() <= BROADCAST_GROUPS)
    judged = near.withColumns({"distance": F.sqrt("_d2"), "base_failed": base_failed()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("_d2") <= _quantile(1 - reject, P // 2))).select(*own, *names)
