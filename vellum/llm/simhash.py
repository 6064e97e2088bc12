"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 bits over all shingles of a text, repeats included; a bit is set where it is set in over
half of the shingles' hashes. Two fingerprints link at ``radius`` or fewer differing bits.

Covering: each bit gets a non-zero label of radius + 1 bits, dealt evenly. For every non-zero vector v a
table keys the fingerprints by the bits whose label has an odd product with v. The labels of radius
differing bits cannot span the space, so some v is orthogonal to all of them, and in v's table the pair
collides: every pair within the radius meets in one of the 2^(radius+1) - 1 tables.

Copies are reduced to distinct fingerprints before anything meets. In a table, buckets up to ``bucket``
fingerprints compare their members; the members of larger buckets are linked exactly another way: each is
filed under all fingerprints within half the radius of it. Two that share a key are within the radius of
each other, and two within the radius share a key, so the least of a key links to the others, and a bucket
of any size costs a constant per member.

Null and empty texts have the fingerprint zero and link like any other; rows that repeat belong to one
component; a bit that is set in exactly half of the hashes is 0; a very long text is fingerprinted by one task, 65,536 hashes
at a time; other columns are not touched. A null key never is a component's least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, join_hot, text_bytes
from .graph import components

BITS = 64
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    rows = zip(*(words[i : i + n] for i in range(min(width, len(words)))), strict=False)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    hashes = np.fromiter((digest(x, SEED) for x in map(b" ".join, rows)), np.uint64, n)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """``df`` without its texts, with the fingerprint as a signed long."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*kept, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                made = np.array([fingerprint(x, width) for x in text_bytes(part.column(len(kept)))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made)], schema.names)
            give_back()

    return df.select(*kept, text).mapInArrow(run, schema)


def masks(radius: int) -> list[int]:
    """Signed 64-bit masks of the covering tables."""
    labels = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    made = [sum(1 << i for i, w in enumerate(labels) if (v & w).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in made]


def _balls(radius: int) -> list[int]:
    """Signed masks of up to ``radius`` set bits."""
    found = {0}
    for _ in range(radius):
        found |= {m | 1 << i for m in found for i in range(BITS)}
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in sorted(found)]


def links(distinct: DataFrame, *, radius: int = 2, bucket: int = 64, fp: str = "fp") -> DataFrame:
    """(a, b) links between distinct fingerprints that connect all within the radius, which must be even."""
    if radius % 2:
        raise ValueError("the radius must be even")
    keyed = distinct.select(fp, F.posexplode(F.array(*(F.col(fp).bitwiseAND(F.lit(m)) for m in masks(radius)))).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min(fp).alias("lo"), F.max(fp).alias("hi")).where("n > 1")
    sizes = cut(sizes)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(near)
    small = keyed.join(sizes.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("t", "k"), ["t", "k"])
    listed = small.groupBy("t", "k").agg(F.sort_array(F.collect_list(fp)).alias("all"))
    within = listed.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.expr(f"filter(slice(all, i + 2, size(all)), x -> bit_count(x ^ a) <= {radius})")).alias("b"))
    crowded = keyed.join(sizes.where(F.col("n") > bucket).select("t", "k"), ["t", "k"]).select(fp).distinct()
    # radius 2: two fingerprints that share a neighbour at one bit differ by at most two bits, and any two that differ so share one
    half = radius // 2
    filed = crowded.select(fp, F.explode(F.array(*(F.lit(m) for m in _balls(half)))).alias("m")).select(fp, F.col(fp).bitwiseXOR(F.col("m")).alias("k"))
    stars = filed.groupBy("k").agg(F.min(fp).alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = filed.join(stars, "k").where(F.col(fp) != F.col("lo")).select(F.col("lo").alias("a"), F.col(fp).alias("b"))
    return pairs.unionByName(within).unionByName(starred).distinct()


def cluster(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, bucket: int = 64) -> DataFrame:
    """(key, fp, component_id) of each row; component_id is the least key that links lead to."""
    rows = cut(fingerprints(df.select(key, text), text=text, width=width))
    distinct = cut(rows.groupBy("fp").agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_n")))
    labels = components(links(distinct, radius=radius, bucket=bucket))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("_least").alias("component_id"))
    named = cut(named.select("fp", "_n", "label").join(least, "label").select("fp", "_n", "component_id"))
    return join_hot(rows, named, "fp", "_n").select(key, "fp", "component_id")


#: Bands of least hashes, and hashes of one: texts at similarity 0.8 fail to meet with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, an empty one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(len(words) - width + 1, 1)
    rows = zip(*(words[i : i + n] for i in range(min(width, len(words)))), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in map(b" ".join, rows)), np.uint64, n))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed key for each band of the least hashes under BANDS * ROWS orders; none without shingles."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1 << 9):
        np.minimum(least, (high[at : at + (1 << 9), None] * _FACTORS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _with_sets(df: DataFrame, text: str, width: int, whole: bool) -> DataFrame:
    """``df`` without its texts, with the shingles if whole, else their hash, number and band keys."""
    kept = [c for c in df.columns if c != text]
    more = [F.array(F.lit(0).cast("long")).alias("shingles")] if whole else [F.lit(0).cast("long").alias("set"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("bands")]
    schema = df.select(*kept, *more).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                sets = [shingle_set(x, width) for x in text_bytes(part.column(len(kept)))]
                if whole:
                    made = [pa.array([x.view(np.int64) for x in sets], longs)]
                else:
                    names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                    made = [pa.array(names), pa.array([len(x) for x in sets], pa.int64()), pa.array([band_keys(x) for x in sets], longs)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], schema.names)
            give_back()

    return df.select(*kept, text).mapInArrow(run, schema)


#: Shingles of one part of a family, about.
TILE_SHINGLES = 1 << 20
#: Sets whose common shingles with a part are counted at once.
TILE_ROWS = 512


def _common(a: np.ndarray, b: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """How many shingles each of some sets shares with each of others; a and b: (shingle, set) in order of the shingles, each the same shingles."""
    out = np.zeros((rows, columns), np.float32)
    tokens, first_a, n_a = np.unique(a[0], return_index=True, return_counts=True)
    at = np.searchsorted(b[0], tokens)
    n_b = np.searchsorted(b[0], tokens, side="right") - at
    # a shingle of many sets is a column of a matrix product, any other counts its pairs
    often = n_a * n_b > rows * columns // 64
    wide = np.flatnonzero(often)
    for step in (wide[i : i + 1024] for i in range(0, len(wide), 1024)):
        x, y = np.zeros((rows, len(step)), np.float32), np.zeros((columns, len(step)), np.float32)
        for m, of, first, n in ((x, a, first_a, n_a), (y, b, at, n_b)):
            column = np.repeat(np.arange(len(step)), n[step])
            m[of[1][np.arange(len(column)) + np.repeat(first[step] - np.cumsum(n[step]) + n[step], n[step])], column] = 1
        out += x @ y.T
    few = np.flatnonzero(~often & (n_b > 0))
    products = np.cumsum(n_a[few] * n_b[few])
    edges = np.searchsorted(products, np.arange(0, (products[-1] if len(few) else 0) + (1 << 20), 1 << 20))
    for step in (few[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if i < j):
        n = n_a[step] * n_b[step]
        own = np.repeat(np.arange(len(step)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        x, y = a[1][first_a[step][own] + place // n_b[step][own]], b[1][at[step][own] + place % n_b[step][own]]
        out += np.bincount(x * columns + y, minlength=rows * columns).reshape(rows, columns).astype(np.float32)
    return out


def _tile(at_least: float):
    """(a, b) links between the sets of two parts, or of one, that connect their components as all their links would."""

    def listed(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, own = np.concatenate(shingles), np.repeat(np.arange(len(shingles)), [len(x) for x in shingles])
        order = np.argsort(flat, kind="stable")
        return flat[order], own[order]

    def run(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        part, name = group["part"].to_numpy(), group["set"].to_numpy()
        label = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
        column = group["shingles"].combine_chunks()
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        of = lambda x: values[offsets[x] : offsets[x + 1]]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        root = list(range(int(label.max()) + 1))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        made: list[tuple[int, int]] = []
        if len(left) and len(right):
            size = offsets[1:] - offsets[:-1]
            across = listed([of(x) for x in right.tolist()])
            for rows in (left[k : k + TILE_ROWS] for k in range(0, len(left), TILE_ROWS)):
                common = _common(listed([of(x) for x in rows.tolist()]), across, len(rows), len(right))
                union = size[rows][:, None] + size[right][None, :] - common
                x, y = np.nonzero((common >= at_least * union - 1e-9) & (label[rows][:, None] != label[right][None, :]))
                x, y = rows[x], right[y]
                low, high = np.minimum(label[x], label[y]).astype(np.int64), np.maximum(label[x], label[y])
                for k in np.unique(low * len(root) + high, return_index=True)[1].tolist():
                    if (p := top(int(low[k]))) != (q := top(int(high[k]))):
                        root[p] = q
                        made.append((int(name[x[k]]), int(name[y[k]])))
        return pa.table([pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64())], names=["a", "b"])

    return run


def similar(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, at_least: float = 0.8, bucket: int = 64, tile: int = 2048) -> DataFrame:
    """(a, b) links between keys, without nulls, that connect texts whose distinct shingles have this Jaccard similarity or more.

    Equal sets are one. Sets meet in the bands' buckets, and every link is verified on the shingles themselves. First
    each bucket is a chain in an order of its own, which settles large groups of near copies; then buckets whose members
    are not yet of one component compare all pairs of two components. Members of those of over ``bucket`` do so inside
    tasks, ``tile`` with ``tile`` of them, which return a forest of the links and no pairs.
    """
    df = df.select(key, text)
    rows = cut(_with_sets(df, text, width, whole=False))
    sets = cut(rows.groupBy("set").agg(F.min(key).alias("_least"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        wanted = ids.join(sets.select("set", F.col("_least").alias(key)), "set")
        # rows that repeat have one key, but one set is wanted once
        whole = cut(_with_sets(wanted.join(df, key).select("set", text).dropDuplicates(["set"]), text, width, whole=True))
        both = pairs.join(whole.select(F.col("set").alias("a"), F.col("shingles").alias("_a")), "a").join(whole.select(F.col("set").alias("b"), F.col("shingles").alias("_b")), "b")
        common = F.size(F.array_intersect("_a", "_b"))
        return cut(both.select("a", "b", common.alias("c"), (F.size("_a") + F.size("_b") - common).alias("all")).where(F.col("c") >= at_least * F.col("all") - 1e-9).select("a", "b"))

    def chained(members: DataFrame, *by: str) -> DataFrame:
        before = F.lag(F.struct("set", "n")).over(Window.partitionBy(*by).orderBy(F.xxhash64("set", *by), "set"))
        return alike(members.withColumn("_p", before).where("_p is not null").select("_p.set", "_p.n", F.col("set").alias("set2"), F.col("n").alias("n2")).toDF("a", "na", "b", "nb"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes allow the similarity."""
        sized = pairs.where(F.least("na", "nb") >= at_least * F.greatest("na", "nb") - 1e-9)
        return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def crossed(members: DataFrame, *by: str) -> DataFrame:
        listed = members.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("set", "n", "label"))).alias("all"))
        first = listed.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.expr("filter(slice(all, i + 2, size(all)), y -> y.label <> x.label)")).alias("y"))
        return alike(first.select("x.set", "x.n", "y.set", "y.n").toDF("a", "na", "b", "nb"))

    def tiled(crowded: DataFrame) -> DataFrame:
        """Links that connect what the buckets' members link to; sets that buckets lead to form a family, whose parts meet each other in tasks."""
        heads = crowded.groupBy("k").agg(F.min("set").alias("head"))
        family = cut(components(crowded.join(heads, "k"), "head", "set").withColumnRenamed("label", "family"))
        members = crowded.select("set", "n", "label").distinct().join(family.withColumnRenamed("node", "set"), "set")
        sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("parts"))
        members = cut(members.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")))
        wanted = members.select("set").join(sets.select("set", F.col("_least").alias(key)), "set")
        whole = cut(_with_sets(wanted.join(df, key).select("set", text).dropDuplicates(["set"]), text, width, whole=True))
        dealt = members.select("family", "set", "label", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        dealt = dealt.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "set", "label")
        return cut(dealt.join(whole, "set").groupBy("family", "i", "j").applyInArrow(_tile(at_least), "a long, b long"))

    tried = cut(chained(sets.select("set", "n", F.explode("bands").alias("k")), "k"))
    found = verified(tried)
    named = sets.join(components(found).withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set")).select("set", "n", "label", "bands")
    named = cut(named)
    keyed = named.select("set", "n", "label", F.explode("bands").alias("k"))
    mixed = lambda x, *by: cut(x.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*by, "m"))
    open_ = mixed(keyed, "k")
    pairs = crossed(keyed.join(open_.where(F.col("m") <= bucket), "k"), "k")
    found = found.unionByName(verified(cut(pairs.join(tried, ["a", "b"], "left_anti"))))
    crowded = cut(keyed.join(open_.where(F.col("m") > bucket).select("k"), "k").select("set", "n", "label", "k"))
    found = found.unionByName(tiled(crowded))
    of = lambda c: sets.select(F.col("set").alias(c), F.col("_least").alias(f"_{c}"))
    links = found.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    equal = rows.join(sets.select("set", "_least"), "set").where(F.col(key) != F.col("_least")).select(F.col("_least").alias("a"), F.col(key).alias("b"))
    return links.unionByName(equal)
