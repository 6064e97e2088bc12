"""Near-duplicate vectors through spherical-cap filters.

The dimensions are cut into two blocks, after a random rotation that spreads what a block holds. Each
block has a fixed random code of unit vectors; a filter direction is one codeword from each block, so
codes of n words give n * n directions. A vector passes the filters whose direction has a product with
it above a threshold. List decoding finds them all without trying every one: a codeword of the first
block that even the best of the second cannot lift over the threshold is dropped with all its
directions. Vectors that pass one filter are compared.

Threshold and code size follow from the number of vectors: in each of ``codes`` independent codes a
vector passes about ``passes`` filters, more as the codes grow, and a filter is passed by about
``occupancy`` of evenly spread vectors. Filters passed by more than
``block`` are dealt out in pairs of blocks, so that no task gets an unbounded group. Equal vectors are one class
before anything is compared. A filter's vectors are compared by products in single precision; what comes near the
least cosine is computed in double precision on the vectors as given. The misses are pairs without a common
filter: at the default settings under 5 of 100 random pairs at cosine 0.901, fewer above.

No pairs leave a task: of each vector it returns the number of its links and the root of its component there. A vector
carries the filters that it passes, and a link is counted in the least filter that its two vectors share, so none is
counted twice. Output is thus linear in the passed filters, however dense a group is; its comparisons are not.

Vectors that are null, zero, empty, or hold null or non-finite components link with nothing and are
components of their own; vectors of different lengths do not link; rows that repeat are linked; a very long vector
is one row in one task; other columns are not touched.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot
from .graph import components

#: Far above the rounding of a product of unit vectors in single precision.
MARGIN = 1e-4


@functools.lru_cache(8)
def code(size: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, and the codes of the two blocks."""
    rng = np.random.default_rng([seed, size, words])
    rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
    cutoff = (size + 1) // 2
    blocks = [rng.standard_normal((words, n)) for n in (cutoff, size - cutoff)]
    return rotation, *(b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12) for b in blocks)


def decode(unit: np.ndarray, words: int, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that each unit vector passes."""
    rotation, first, second = code(unit.shape[1], words, seed)
    turned = unit @ rotation
    cutoff = first.shape[1]
    a, b = turned[:, :cutoff] @ first.T, turned[:, cutoff:] @ second.T
    least = threshold * math.sqrt(2)
    rows, i = np.nonzero(a + b.max(axis=1, keepdims=True) >= least)
    found = []
    for at in range(0, len(rows), 1 << 14):
        r, k = rows[at : at + (1 << 14)], i[at : at + (1 << 14)]
        x, j = np.nonzero(a[r, k][:, None] + b[r] >= least)
        found.append((r[x], k[x] * words + j))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def _earlier(lists: list[np.ndarray], f: int) -> np.ndarray:
    """A bit for each filter below f that several of the vectors pass, packed by vector."""
    low = [x[: np.searchsorted(x, f)] for x in lists]
    row = np.repeat(np.arange(len(low)), [len(x) for x in low])
    found, at, n = np.unique(np.concatenate([*low, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    use = np.cumsum(n > 1) - 1
    bits = np.zeros((len(lists), (int((n > 1).sum()) + 63) // 64 or 1), np.uint64)
    shared = n[at] > 1
    place = use[at[shared]]
    np.bitwise_or.at(bits, (row[shared], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return bits


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def compared(x: np.ndarray, weight: np.ndarray, lists: list[np.ndarray], side: np.ndarray, f: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links first met here, root of the component) of each vector; side: bit 1 stands on the left, bit 2 on the right."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    unit = (x / norm[:, None]).astype(np.float32)
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    within = np.array_equal(left, right)
    bits, counts, near_a, near_b = None, np.zeros(len(x), np.int64), [], []
    for at in range(0, len(left), 256):
        own = left[at : at + 256]
        product = unit[own] @ unit[right].T
        i, j = np.nonzero(product >= cosine - MARGIN)
        close = product[i, j] < cosine + MARGIN
        i, j = own[i], right[j]
        keep = i < j if within else i != j
        i, j, close = i[keep], j[keep], close[keep]
        if close.any():
            p, q = i[close], j[close]
            sure = np.ones(len(i), bool)
            sure[close] = np.einsum("ij,ij->i", x[p], x[q]) >= cosine * norm[p] * norm[q]
            i, j = i[sure], j[sure]
        if not len(i):
            continue
        bits = _earlier(lists, f) if bits is None else bits
        for a in range(0, len(i), 1 << 18):
            p, q = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
            new = np.ones(len(p), bool)
            for k in range(bits.shape[1]):
                new &= (bits[p, k] & bits[q, k]) == 0
            counts += np.bincount(p[new], weight[q[new]], minlength=len(x)).astype(np.int64) + np.bincount(q[new], weight[p[new]], minlength=len(x)).astype(np.int64)
        # of a piece's links only a forest goes on
        root = _roots(len(x), i, j)
        moved = np.flatnonzero(root != np.arange(len(x)))
        near_a.append(moved)
        near_b.append(root[moved])
    return counts, _roots(len(x), np.concatenate(near_a), np.concatenate(near_b)) if near_a else np.arange(len(x))


def links(classes: DataFrame, *, cosine: float = 0.9, codes: int = 2, passes: float = 16.0, occupancy: int = 1024, block: int = 2048, seed: int = 17) -> DataFrame:
    """(c, others, root) from the classes (c, n, embedding), a row for each class and filter where it has links: rows in linked classes first met there, and a class linked there."""
    n = classes.count()
    words = max(8, math.ceil(math.sqrt(n * passes / occupancy)))
    passes *= max(1.0, math.sqrt(words / 28))
    quantile = NormalDist().inv_cdf(1 - min(0.5, passes / words**2))
    kind = "<f4" if classes.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):  # bounds the filters held at once
                lengths = part.column(2).value_lengths().to_numpy()
                for size in np.unique(lengths):
                    own = np.flatnonzero(lengths == size)
                    given = part.column(2).take(pa.array(own)).flatten().to_numpy().reshape(len(own), size)
                    x = given / np.abs(given).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = []
                    for k in range(codes):
                        rows, f = decode(x, words, quantile / math.sqrt(size), seed + k)
                        found.append(np.stack([rows, (f * codes + k) + (int(size) << 40)]))
                    rows, f = np.concatenate(found, axis=1)
                    order = np.lexsort((f, rows))
                    rows, f = rows[order], f[order]
                    edges = np.searchsorted(rows, np.arange(len(own) + 1))
                    lists = pa.array([f[a:b].astype("<i8").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                    vectors = pa.array([r.tobytes() for r in given.astype(kind)], pa.binary())
                    at = pa.array(own)
                    yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), vectors, lists, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(f))], names=["c", "n", "v", "l", "f"])

    def compare(group: pa.Table) -> pa.Table:
        ids = group["c"].to_numpy()
        x = np.frombuffer(b"".join(group["v"].to_pylist()), kind).astype(np.float64).reshape(len(ids), -1)
        counts, root = compared(x, group["n"].to_numpy(), [np.frombuffer(v, "<i8") for v in group["l"].to_pylist()], group["side"].to_numpy(), group["f"][0].as_py(), cosine)
        use = np.flatnonzero((counts > 0) | (root != np.arange(len(ids))))
        return pa.table({"c": ids[use], "others": counts[use], "root": ids[root[use]]})

    passed = classes.select("c", "n", "embedding").mapInArrow(filters, "c long, n long, v binary, l binary, f array<long>").withColumn("f", F.explode("f"))
    sizes = passed.groupBy("f").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    dealt = passed.join(sizes, "f").withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # bit 1: stands on the left of the pair of blocks, bit 2: on the right; a block meets itself as both
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("f", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "c", "n", "v", "l", side.alias("side"))
    return dealt.groupBy("f", "p", "q").applyInArrow(compare, "c long, others long, root long")


def valid(column: str) -> Column:
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def cluster(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, **options: float) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    rows = df.select(F.col(key), F.col(vector).alias("embedding"))
    good = rows.where(valid("embedding"))
    classes = cut(good.groupBy("embedding").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")).withColumn("c", F.monotonically_increasing_id()))
    met = cut(links(classes, cosine=cosine, **options))
    others = met.groupBy("c").agg(F.sum("others").alias("others"))
    labels = components(met.where("c <> root"), "c", "root")
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    named = named.join(others, "c", "left")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = cut(named.join(least, "label").select("embedding", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    found = join_hot(good, known, "embedding", "n").select(key, "n_links", "component_id")
    rest = rows.where(~valid("embedding")).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
