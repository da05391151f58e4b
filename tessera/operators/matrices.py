"""Pairwise values as tables (i, j, value), i < j, and what is computed from them.

Pairs are made by pairs of blocks (see blocks), so a row is not copied for each row or block that it meets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocks as B


def unit_rows(df: DataFrame, vector: str) -> DataFrame:
    """The vectors as doubles of unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    return df.withColumn("_n", norm).withColumn(vector, F.when(F.col("_n") > 0, F.transform(vector, lambda x: x / F.col("_n"))).otherwise(F.col(vector))).drop("_n")


def z_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Each column of the vectors with mean 0 and population deviation 1; a constant column becomes 0."""
    long = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    s = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0)
    return long.join(F.broadcast(s), "pos").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", z.alias("z")))), lambda e: e["z"]).alias(vector))


def pair_values(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Of the rows of x and those of y: cosine distance of unit rows, euclidean distance, or 1 - correlation."""
    if kind == "correlation":
        x, y = (v - v.mean(axis=1, keepdims=True) for v in (x, y))
        x, y = (np.divide(v, s, out=np.zeros_like(v), where=s > 0) for v, s in ((v, np.linalg.norm(v, axis=1, keepdims=True)) for v in (x, y)))
    dots = x @ y.T
    if kind == "euclidean":
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * dots, 0))
    return 1 - dots


def keyed_vectors(rows: pa.Table, vector: str = "v") -> np.ndarray:
    return np.asarray(B.column(rows, vector).flatten(), float).reshape(rows.num_rows, -1)


def pairs(df: DataFrame, key: str, vector: str, kind: str = "cosine", block: int = 1024) -> DataFrame:
    """(i, j, value) for i < j: cosine distance of unit rows, euclidean distance, or 1 - correlation."""
    blocks = B.in_blocks(df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")), block)

    def work(a: pa.Table, b: pa.Table, own: bool) -> pa.Table:
        values = pair_values(keyed_vectors(a), keyed_vectors(b), kind)
        p, q, i, j = B.ordered(a, b, own)
        return pa.table({"i": i, "j": j, "value": values[p, q]})

    return B.meet(blocks, work, "i long, j long, value double")


def _order_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles, 4096 of them for a power of two."""
    bits = x.view(np.int64)
    return np.where(bits >= 0, bits, -(bits & np.int64(0x7FFFFFFFFFFFFFFF))) >> 40


def _split(at: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The distinct values of `at`, and for each of the columns its entries at each of them, as bytes."""
    order = np.argsort(at, kind="stable")
    names, first = np.unique(at[order], return_index=True)
    return names, [[part.tobytes() for part in np.split(c[order], first[1:])] for c in columns]


def _dealt_correlations(blocks: DataFrame, kinds: tuple[str, str], places: int, share: int) -> DataFrame:
    """pair_correlations by sorting the pairs, to the last place.

    One reading of the pairs counts them by ranges of values. Then they are dealt to runs of ranges with about `share` pairs, first by the one value, which
    gives its ranks, and with these by the other, as packed numbers: 16 bytes for a pair and value. Equal values lie in one run.
    """

    def values(a: pa.Table, b: pa.Table, own: bool) -> list[np.ndarray]:
        p, q, _, _ = B.ordered(a, b, own)
        return [v[p, q] for v in _block_values(a, b, kinds)]

    def count(a: pa.Table, b: pa.Table, own: bool) -> pa.Table:
        v = values(a, b, own)
        bins = [np.unique(_order_bits(np.round(x, places) + 0.0), return_counts=True) for x in v]
        sums = [v[0].sum(), v[1].sum(), (v[0] * v[0]).sum(), (v[1] * v[1]).sum(), (v[0] * v[1]).sum()]
        which = np.repeat([0, 1, *range(2, 7)], [len(bins[0][0]), len(bins[1][0]), *[1] * 5])
        return pa.table({"w": which, "bin": np.concatenate([bins[0][0], bins[1][0], np.zeros(5, np.int64)]), "n": np.concatenate([bins[0][1], bins[1][1], np.zeros(5, np.int64)]), "s": np.concatenate([np.zeros(len(which) - 5), sums])})

    seen = B.meet(blocks, count, "w long, bin long, n long, s double").groupBy("w", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()  # a row for each range
    runs = []
    for w in (0, 1):
        own = seen[seen["w"] == w].sort_values("bin")
        upto = own["n"].to_numpy().cumsum()
        before = upto - own["n"].to_numpy()
        run = before // share
        first = np.flatnonzero(np.diff(run, prepend=-1))
        runs.append((own["bin"].to_numpy()[first], before[first]))  # the first range of each run, and the pairs below it
    n = int(seen.loc[seen["w"] == 0, "n"].sum())
    middle = (n + 1) / 2
    place = lambda x, ends: np.searchsorted(ends, _order_bits(x), "right") - 1
    read = lambda t, c: np.concatenate([np.frombuffer(x.as_buffer(), float) for x in t.column(c)])

    def ranks(x: np.ndarray, below: int) -> np.ndarray:
        """Average ranks less their mean."""
        _, at, size = np.unique(x, return_inverse=True, return_counts=True)
        return (below + np.cumsum(size) - (size - 1) / 2 - middle)[at]

    def deal(a: pa.Table, b: pa.Table, own: bool) -> pa.Table:
        x, y = (np.round(v, places) + 0.0 for v in values(a, b, own))
        names, (xs, ys) = _split(place(x, runs[0][0]), x, y)
        return pa.table({"g": names, "x": pa.array(xs, pa.binary()), "y": pa.array(ys, pa.binary())})

    def first(t: pa.Table) -> pa.Table:
        y, r = read(t, "y"), ranks(read(t, "x"), int(runs[0][1][t.column("g")[0].as_py()]))
        names, (ys, rs) = _split(place(y, runs[1][0]), y, r)
        return pa.table({"g": names, "x": pa.array(rs, pa.binary()), "y": pa.array(ys, pa.binary())})

    def second(t: pa.Table) -> pa.Table:
        r, q = read(t, "x"), ranks(read(t, "y"), int(runs[1][1][t.column("g")[0].as_py()]))
        return pa.table({"xx": [float(r @ r)], "yy": [float(q @ q)], "xy": [float(r @ q)]})

    packed = "g long, x binary, y binary"
    sums = B.meet(blocks, deal, packed).groupBy("g").applyInArrow(first, packed).groupBy("g").applyInArrow(second, "xx double, yy double, xy double")
    sx, sy, sxx, syy, sxy = (float(seen.loc[seen["w"] == w, "s"].sum()) for w in range(2, 7))
    top, low = (sxy - sx * sy / n, (sxx - sx * sx / n) * (syy - sy * sy / n)) if n else (0.0, 0.0)
    pearson = F.lit(top / low**0.5 if low > 0 else None).cast("double")
    return sums.agg(pearson.alias("pearson"), F.try_divide(F.sum("xy"), F.sqrt(F.sum("xx") * F.sum("yy"))).alias("spearman"))


def _block_values(a: pa.Table, b: pa.Table, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """A matrix of values of the rows of two blocks for each kind (see pair_values; cosine: of the vectors as unit rows)."""
    x, y = keyed_vectors(a), keyed_vectors(b)
    unit = lambda v, s: np.divide(v, s, out=v.copy(), where=s > 0)
    u, w = (unit(v, np.linalg.norm(v, axis=1, keepdims=True)) for v in (x, y))
    return [pair_values(*((u, w) if kind == "cosine" else (x, y)), kind) for kind in kinds]


def _pair_vectors(a: pa.Table, b: pa.Table, own: bool, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The values of the pairs of different keys of two blocks, each pair once, in any order."""
    x, y = (B.column(t, "k").to_numpy(zero_copy_only=False) for t in (a, b))
    values = _block_values(a, b, kinds)
    if own:
        keep = np.triu(np.ones((len(x), len(x)), bool), 1)
    elif not np.isin(x, y).any():
        return [v.ravel() for v in values]
    else:
        keep = np.ones((len(x), len(y)), bool)
    keep &= x[:, None] != y[None, :]
    return [v[keep] for v in values]


#: Ranges that pair_correlations counts a value by, and of them in a row of counts.
RANGES, RANGES_ROW = 1 << 20, 1 << 16


def _bounds(s: float, a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    """Least and largest correlation of ranks, from the sums over mean ranks of ranges: of products s, and of squares with the largest sum of squares within ranges.

    Ranks less the mean of their range add up to 0 in it, so they correlate with what the range does not tell of the others only (Cauchy and Schwarz).
    """
    (aa, da), (bb, db) = a, b
    rest = max(0.0, 1 - s * s / (aa * bb)) + 1e-12  # doubles add up with some error
    x = (da * bb * rest) ** 0.5 + (db * aa * rest) ** 0.5 + (da * db) ** 0.5 + 1e-12 * (aa * bb) ** 0.5
    ends = [(s + e) / f for e in (-x, x) for f in ((aa * bb) ** 0.5, ((aa + da) * (bb + db)) ** 0.5)]
    return max(-1.0, min(ends)), min(1.0, max(ends))


def _counted_correlations(blocks: DataFrame, kinds: tuple[str, str], places: int, digits: int, ranges: int) -> tuple[float | None, float] | None:
    """pearson, spearman by counts of ranges of values, without a row for a pair; None if the ranges leave the digits open."""
    spark, scale = blocks.sparkSession, 10.0**places

    def norms(batches):
        for batch in batches:
            for data in batch.column(0):
                with pa.ipc.open_stream(data.as_buffer()) as rows:
                    yield pa.RecordBatch.from_pydict({"m": [float(np.linalg.norm(keyed_vectors(rows.read_all().combine_chunks()), axis=1).max(initial=0))]})

    longest = blocks.select("data").mapInArrow(norms, "m double").agg(F.max("m")).first()[0]
    if longest is None or not np.isfinite(longest):
        return None
    steps = [max(1.0, scale * (2 * longest if kind == "euclidean" else 2.0) / (ranges - 2)) for kind in kinds]

    def places_of(x: np.ndarray, step: float) -> np.ndarray:
        """The range of each value, rounded to places; equal ones have the same, larger ones no lower, and range 0 has zeros only (or what is below)."""
        t = np.rint(x * scale)
        np.ceil(np.divide(t, step, out=t), out=t)
        return np.clip(t, 0, ranges - 1, out=t).astype(np.int64)

    def count(pairs):
        n, sums, least = np.zeros((2, ranges), np.int64), np.zeros(5), [0.0, 0.0]
        for a, b, own in pairs:
            v = _pair_vectors(a, b, own, kinds)
            for w in (0, 1):
                n[w] += np.bincount(places_of(v[w], steps[w]), minlength=ranges)
                least[w] = min(least[w], v[w].min(initial=0))
            sums += v[0].sum(), v[1].sum(), v[0] @ v[0], v[1] @ v[1], v[0] @ v[1]
        for w in (0, 1):
            for low in range(0, ranges, RANGES_ROW):
                yield pa.table({"w": [w], "low": [low], "n": [n[w, low : low + RANGES_ROW].tobytes()], "s": pa.array([sums.tolist() if w == low == 0 else [0.0] * 5], pa.list_(pa.float64())), "least": [least[w]]})

    def add(t: pa.Table) -> pa.Table:
        n, s = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("n")), np.sum(t.column("s").to_pylist(), axis=0)
        return pa.table({"w": [t["w"][0].as_py()], "low": [t["low"][0].as_py()], "n": [n.tobytes()], "s": [s.tolist()], "least": [min(t["least"].to_pylist())]})

    schema = "w long, low long, n binary, s array<double>, least double"
    seen = B.meet_in_few(blocks, count, schema).groupBy("w", "low").applyInArrow(add, schema).orderBy("w", "low").toArrow()  # a row for RANGES_ROW ranges
    if not seen.num_rows:
        return None
    counts = np.frombuffer(b"".join(seen.column("n").to_pylist()), np.int64).reshape(2, ranges)
    sx, sy, sxx, syy, sxy = np.sum(seen.column("s").to_pylist(), axis=0)
    n = int(counts[0].sum())
    if n < 2 or not np.isfinite([sx, sy, sxx, syy, sxy]).all():
        return None
    means = [np.cumsum(c) - c / 2 - n / 2 for c in counts]  # the mean rank of each range, less that of all
    shared = spark.sparkContext.broadcast(means)

    def products(pairs):
        total = 0.0
        for a, b, own in pairs:
            v = _pair_vectors(a, b, own, kinds)
            total += float(np.dot(*(np.take(m, places_of(x, step)) for m, x, step in zip(shared.value, v, steps, strict=True))))
        yield pa.table({"s": [total]})

    s = B.meet_in_few(blocks, products, "s double").agg(F.sum("s")).first()[0]
    squares = []
    for w, (c, m) in enumerate(zip(counts.astype(float), means, strict=True)):
        within = c * (c * c - 1) / 12  # if no two are equal
        if round(min(x for k, x in zip(seen.column("w").to_pylist(), seen.column("least").to_pylist(), strict=True) if k == w), places) == 0:
            within[0] = 0  # all are zeros
        if steps[w] == 1:
            within[:-1] = 0  # a range for each value
        squares.append((float((c * m * m).sum()), float(within.sum())))
    if min(q[0] for q in squares) <= 0:
        return None
    low, high = _bounds(s, *squares)
    if np.floor(low * 10**digits + 0.5) != np.floor(high * 10**digits + 0.5):
        return None
    spread = (sxx - sx * sx / n) * (syy - sy * sy / n)
    return float((sxy - sx * sy / n) / spread**0.5) if spread > 0 else None, float((low + high) / 2)


def pair_correlations(df: DataFrame, key: str, vector: str, kinds: tuple[str, str], places: int = 10, share: int = 1 << 19, digits: int = 6, ranges: int = RANGES) -> DataFrame:
    """pearson, spearman of two values of all pairs (see pair_values; cosine: of the vectors as unit rows), their ranks over values of so many places.

    The pairs are read twice and counted by ranges of values, which gives bounds of the correlation of ranks. If both, rounded to `digits`, are the same, it is that number;
    then no pair is kept or dealt. Else the pairs are sorted, 16 bytes for a pair and value.
    """
    blocks = B.in_blocks(df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null"))
    found = _counted_correlations(blocks, kinds, places, digits, ranges)
    if found is None:
        return _dealt_correlations(blocks, kinds, places, share)
    return df.sparkSession.createDataFrame([found], "pearson double, spearman double")


def _item_blocks(cases: DataFrame | None, sets: DataFrame, key: str, item: str) -> tuple[DataFrame, str]:
    """Blocks of (k, n, items) of keyed item sets, and the type of the key; `cases` adds those without an item."""
    have = sets.select(F.col(key).alias("k"), F.col(item).alias("x")).distinct()
    rows = have.groupBy("k").agg(F.count("*").alias("n"), F.collect_list("x").alias("items"))
    if cases is not None:
        rows = cases.select(F.col(key).alias("k")).join(rows, "k", "left").select("k", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("items", F.array().cast(rows.schema["items"].dataType)).alias("items"))
    return B.in_blocks(rows), rows.schema["k"].dataType.simpleString()


def _jaccard_distances(a: pa.Table, b: pa.Table, own: bool, empty: float | None) -> pa.Table:
    """i, j, value of the pairs that share an item, or of all with the value `empty` for two without one."""
    both = B.common(a, b, "items")
    p, q, i, j = B.ordered(a, b, own, both > 0 if empty is None else None)
    c, n = both[p, q], B.column(a, "n").to_numpy()[p] + B.column(b, "n").to_numpy()[q]
    value = 1 - np.divide(c, n - c, out=np.zeros_like(c), where=n > c)
    # two sets without a union are both empty
    return pa.table({"i": i, "j": j, "value": value if empty is None else np.where(n == 0, empty, value)})


def set_distance(sets: DataFrame, key: str, item: str) -> DataFrame:
    """Jaccard distances (i, j, value) of keyed item sets that share an item; all other pairs of them have 1."""
    blocks, kind = _item_blocks(None, sets, key, item)
    return B.meet(blocks, lambda a, b, own: _jaccard_distances(a, b, own, None), f"i {kind}, j {kind}, value double")


def full_set_distance(cases: DataFrame, sets: DataFrame, key: str, item: str, empty: float) -> DataFrame:
    """Jaccard distances (i, j, value) of all pairs i < j of the cases; two without an item have `empty`. As many rows as pairs."""
    blocks, kind = _item_blocks(cases, sets, key, item)
    return B.meet(blocks, lambda a, b, own: _jaccard_distances(a, b, own, empty), f"i {kind}, j {kind}, value double")


def both_ways(p: DataFrame) -> DataFrame:
    return p.select("i", "j", "value").unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def neighbours_of(p: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, i, j, value, r): the k nearest of each i within the keys, ties by j."""
    both = p.select(*keys, "i", "j", "value").unionByName(p.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "i").orderBy("value", "j"))).filter(F.col("r") <= k)


def neighbours(p: DataFrame, k: int) -> DataFrame:
    """(i, j, value, r): the k nearest of each i, ties by j."""
    return neighbours_of(p, [], k)


def counts_below(n: DataFrame, keys: list[str], value: str, count: str, buckets: int = 64) -> DataFrame:
    """The rows (keys, value, count), distinct in keys and value, with `upto`: the sum of the counts up to the value within the keys.

    The values are dealt to `buckets` ranges between quantiles, so a window holds a share of a key's values; what lies in the
    ranges below is added.
    """
    ends = n.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(100 * buckets)).alias("_ends"))
    dealt = n.join(F.broadcast(ends), keys) if keys else n.crossJoin(F.broadcast(ends))
    dealt = dealt.withColumn("_b", F.size(F.filter("_ends", lambda e: e < F.col(value)))).drop("_ends")
    below = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    before = dealt.groupBy(*keys, "_b").agg(F.sum(count).alias("_s")).select(*keys, "_b", F.coalesce(below, F.lit(0)).alias("_before"))
    own = F.sum(count).over(Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_own", own).join(F.broadcast(before), [*keys, "_b"]).withColumn("upto", F.col("_own") + F.col("_before")).drop("_own", "_before", "_b")


def average_ranks(p: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows with rank: the average rank of the value within the keys, over its distinct values and their counts."""
    n = counts_below(p.groupBy(*keys, value).agg(F.count("*").alias("_t")), keys, value, "_t")
    return p.join(n.select(*keys, value, (F.col("upto") - F.col("_t") / 2 + 0.5).alias("rank")), [*keys, value])


def diverse_medoids(rows: DataFrame, key: str, group: str, vector: str, top: int) -> DataFrame:
    """group, place, key: of each group of unit vectors the one of the highest mean similarity to it, then those of the highest mean less the
    highest similarity to the ones before; ties: the smallest key. From sums of vectors, without pairs."""
    width = F.size(vector)
    sums = rows.select(group, F.posexplode(vector).alias("_pos", "_x")).groupBy(group, "_pos").agg(F.sum("_x").alias("_x"), F.count("*").alias("_n"))
    sums = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", (F.col("_x") / F.col("_n")).alias("m")))), lambda e: e["m"]).alias("_mean"))  # width entries
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    now = rows.filter(width > 0).join(F.broadcast(sums), group).withColumn("_m", dot(vector, "_mean")).withColumn("_near", F.lit(0.0))  # a row for each group
    out = None
    for place in range(1, top + 1):
        score = F.struct(F.round(F.col("_m") - F.col("_near"), 9).alias("s"), (-F.col(key)).alias("k"))
        best = now.groupBy(group).agg(F.max_by(F.struct(F.col(key).alias("key"), F.col(vector).alias("v")), score).alias("_b"))
        chosen = best.select(group, F.lit(place).alias("place"), F.col("_b.key").alias(key))
        out = chosen if out is None else out.unionByName(chosen)
        met = dot(F.col(vector), F.col("_b.v"))
        now = now.join(F.broadcast(best), group).filter(F.col(key) != F.col("_b.key")).withColumn("_near", met if place == 1 else F.greatest("_near", met)).drop("_b")
    return out


def affinity(p: DataFrame, k: int = 20, mu: float = 0.5) -> DataFrame:
    """Scaled-exponential kernel: sigma = (mean distance of i to its k nearest + that of j + d) / 3, and the density of Normal(0, mu sigma) at d."""
    m = neighbours(p, k).groupBy("i").agg(F.avg("value").alias("m"))
    x = p.join(m, "i").join(m.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j")
    sigma = F.lit(mu) * (F.col("m") + F.col("mj") + F.col("value")) / 3
    return x.select("i", "j", F.when(sigma > 0, F.exp(-F.col("value") * F.col("value") / (2 * sigma * sigma)) / (sigma * F.sqrt(F.lit(2 * np.pi)))).otherwise(1.0).alias("value"))


def centred_kernel(p: DataFrame, n: int) -> DataFrame:
    """(i, j, value) of -J D^2 J / 2 with the diagonal, i <= j."""
    d2 = both_ways(p).select("i", "j", (F.col("value") * F.col("value")).alias("s"))
    row = d2.groupBy("i").agg((F.sum("s") / n).alias("m"))
    grand = row.agg((F.sum("m") / n).alias("g"))
    full = p.select("i", "j", (F.col("value") * F.col("value")).alias("s")).unionByName(row.select("i", F.col("i").alias("j"), F.lit(0.0).alias("s")))
    out = full.join(row, "i").join(row.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j").crossJoin(F.broadcast(grand))
    return out.select("i", "j", (-(F.col("s") - F.col("m") - F.col("mj") + F.col("g")) / 2).alias("value"))


def generalised_rv(a: DataFrame, b: DataFrame) -> DataFrame:
    """grv of two kernels given as (i, j, value) with i <= j: entries off the diagonal count twice."""
    w = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    x = a.join(b.withColumnRenamed("value", "other"), ["i", "j"])
    v, o = F.col("value"), F.col("other")
    return x.agg((F.sum(w * v * o) / F.sqrt(F.sum(w * v * v) * F.sum(w * o * o))).alias("grv"))


def group_means(p: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """(i, g, own, mean, n): mean value of each i to the members of each group, itself left out."""
    g = groups.select(F.col(key).alias("j"), F.col(group).alias("g"))
    own = groups.select(F.col(key).alias("i"), F.col(group).alias("own"))
    return both_ways(p).join(g, "j").groupBy("i", "g").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).join(own, "i")


def silhouette(p: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """(i, own, nearest, s): (b - a) / max(a, b); 0 for one alone in its group."""
    return silhouette_of(group_means(p, groups, key, group))


def block_means(p: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """(g, h, mean, n), g <= h: mean value between groups; within a group over its pairs."""
    a = groups.select(F.col(key).alias("i"), F.col(group).alias("gi"))
    b = groups.select(F.col(key).alias("j"), F.col(group).alias("gj"))
    return p.join(a, "i").join(b, "j").groupBy(F.least("gi", "gj").alias("g"), F.greatest("gi", "gj").alias("h")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def _unit_matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows of unit length; a zero vector stays."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def group_sums(df: DataFrame, vector: str, group: str) -> DataFrame:
    """g, s (sum of the group's unit vectors), q (of their squares), n: one matrix product a batch, and a row for each task and group."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = batch.column(0).dictionary_encode()
                at = codes.indices.to_numpy()
                u = _unit_matrix(batch.column(1))
                hot = np.zeros((len(codes.dictionary), len(at)))
                hot[at, np.arange(len(at))] = 1
                sums = hot @ u
                yield pa.RecordBatch.from_arrays(
                    [codes.dictionary, pa.array(list(sums), pa.list_(pa.float64())), pa.array(hot @ (u * u).sum(axis=1)), pa.array(hot.sum(axis=1).astype(np.int64))], names=["g", "s", "q", "n"])

    kind = df.schema[group].dataType.simpleString()
    parts = df.select(group, vector).filter(F.col(group).isNotNull()).mapInArrow(run, f"g {kind}, s array<double>, q double, n long")
    add = F.aggregate(F.slice("l", 2, F.lit(1 << 30)), F.get("l", F.lit(0)), lambda t, x: F.zip_with(t, x, lambda a, b: a + b))
    return parts.groupBy("g").agg(F.collect_list("s").alias("l"), F.sum("q").alias("q"), F.sum("n").alias("n")).select("g", add.alias("s"), "q", "n")  # a row for each batch


def cosine_group_means(df: DataFrame, key: str, vector: str, group: str, shard: int = 10_000) -> DataFrame:
    """As group_means of the cosine distances, without the pairs: the mean of 1 - u v over a group's v is 1 - u S / n, S the
    group's sum of unit vectors, itself left out. Work and rows grow with rows times groups, not with the square of rows.
    The sums go to all tasks, `shard` groups at a time; a batch is one matrix product with them."""
    sums = group_sums(df, vector, group)
    shards = -(-sums.count() // shard) or 1
    kind = df.schema[group].dataType.simpleString()
    own = df.select(F.col(key).alias("i"), F.col(group).alias("own"), F.col(vector).alias("_v"))
    schema = f"i {df.schema[key].dataType.simpleString()}, g {kind}, mean double, n long, own {kind}"

    def means(part: DataFrame) -> DataFrame:
        held = part.toArrow()  # `shard` rows at most
        names = held.column("g").combine_chunks()
        total, size = np.array(held.column("s").to_pylist() or [[]], float)[: len(names)], held.column("n").to_numpy()
        shared = df.sparkSession.sparkContext.broadcast((names, total, size))

        def run(batches):
            names, total, size = shared.value
            place = {g: k for k, g in enumerate(names.to_pylist())}
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                u = _unit_matrix(batch.column(2))
                at = np.array([place.get(g, -1) for g in batch.column(1).to_pylist()])
                dots, n = u @ total.T, np.repeat(size[None, :], len(u), axis=0)
                here = np.flatnonzero(at >= 0)
                dots[here, at[here]] -= (u[here] * u[here]).sum(axis=1)
                n[here, at[here]] -= 1
                keep = n > 0
                row, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), names.take(pa.array(col)), pa.array(1 - dots[keep] / n[keep]), pa.array(n[keep]), batch.column(1).take(pa.array(row))], names=["i", "g", "mean", "n", "own"])

        return own.mapInArrow(run, schema)

    if shards == 1:
        return means(sums)
    out = [means(sums.filter(F.pmod(F.xxhash64("g"), F.lit(2 * shards)) == s)) for s in range(2 * shards)]
    return reduce(DataFrame.unionByName, out)


def silhouette_of(means: DataFrame) -> DataFrame:
    """(i, own, nearest, s) of group means; 0 for one alone in its group."""
    a = F.max(F.when(F.col("g") == F.col("own"), F.col("mean")))
    b = F.min(F.when(F.col("g") != F.col("own"), F.struct("mean", "g")))
    x = means.groupBy("i", "own").agg(a.alias("a"), b.alias("b"))
    return x.select("i", "own", F.col("b.g").alias("nearest"), F.coalesce(F.try_divide(F.col("b.mean") - F.col("a"), F.greatest("a", F.col("b.mean"))), F.lit(0.0)).alias("s"))


def cosine_block_means(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """As block_means of the cosine distances, from the groups' sums alone: (g, h, mean, n), g <= h. The rows are read once."""
    sums = group_sums(df, vector, group)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    other = sums.select(F.col("g").alias("h"), F.col("s").alias("t"), F.col("n").alias("m"))
    pairs = sums.join(other, F.col("g") < F.col("h")).select("g", "h", (1 - dot("s", "t") / (F.col("n") * F.col("m"))).alias("mean"), (F.col("n") * F.col("m")).alias("n"))
    pair_count = F.col("n") * (F.col("n") - 1)
    inside = sums.filter("n > 1").select("g", F.col("g").alias("h"), (1 - (dot("s", "s") - F.col("q")) / pair_count).alias("mean"), (pair_count / 2).cast("long").alias("n"))
    return pairs.unionByName(inside)


def drawn_members(members: DataFrame, group: str, key: str, repeats: int) -> DataFrame:
    """rep, group, key: the members that a draw with replacement of the size of each group has, each once; draws are hashes of (repeat, group, place)."""
    spark = members.sparkSession
    place = F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1
    rows = members.select(group, key, place.cast("long").alias("_pos"), F.count("*").over(Window.partitionBy(group)).alias("_size"))
    reps = F.broadcast(spark.range(repeats).select(F.col("id").alias("rep")))
    number = F.conv(F.left(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col(group).cast("string"), F.col("_pos").cast("string"))), F.lit(8)), 16, 10).cast("long")
    drawn = rows.crossJoin(reps).select("rep", group, (number % F.col("_size")).alias("_pos")).distinct()
    return drawn.join(rows.select(group, key, "_pos"), [group, "_pos"]).select("rep", group, key)


def margins(rows: DataFrame, keys: list[str], group: str, vector: str, width: int) -> DataFrame:
    """keys, group, margin of each unit vector: its mean similarity to the others of its group less that to the rows of other groups, from sums of vectors."""
    sums = rows.groupBy(*keys, group).agg(F.count("*").alias("_n"), F.array(*[F.sum(F.get(vector, F.lit(i))) for i in range(width)]).alias("_s"))
    all_ = sums.groupBy(*keys).agg(F.sum("_n").alias("_whole"), F.array(*[F.sum(F.get("_s", F.lit(i))) for i in range(width)]).alias("_total"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    x = rows.join(sums, [*keys, group]).join(all_, keys).filter("_n > 1 and _whole > _n")
    own = (dot(vector, "_s") - dot(vector, vector)) / (F.col("_n") - 1)
    other = (dot(vector, "_total") - dot(vector, "_s")) / (F.col("_whole") - F.col("_n"))
    return x.select(*keys, group, (own - other).alias("margin"))
