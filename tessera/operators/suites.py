"""Families of tests over a long table (feature, key, group, value): omnibus tests, gates, and comparisons after them.

A gate is a semi-join on the adjusted p of the omnibus test. Each comparison names its family of adjustment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import statistics as S


def numeric_omnibus(long: DataFrame, family: list[str] | None = None) -> DataFrame:
    """feature, n, k, h, epsilon2, p, q: Kruskal and Wallis over the groups of each feature; q over all features (or within `family`)."""
    keys = ["feature", *(family or [])]
    out = S.kruskal(long, keys, "group", "value").withColumn("p", special.chi2_p("h", F.col("k") - 1))
    return S.benjamini_hochberg(out, family or [], tie=["feature"])


def two_samples(rows: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """keys, n1, n2, median1, median2, smd, delta (Cliff), p (Mann-Whitney, normal with ties) of the values that `first` tells apart; both have some."""
    rows = rows.filter("value is not null").withColumn("_first", first)
    ranks = S.rank_sums(rows, keys, "group", "value", F.col("_first")).filter("n1 > 0 and n2 > 0")
    of = lambda f, own: f(F.when(F.col("_first") == own, F.col("value")))
    plain = rows.groupBy(*keys).agg(*[of(F.median, own).alias(f"median{i}") for i, own in ((1, True), (2, False))])
    smd = S.standardised_difference(rows, keys, "value", F.col("_first")).select(*keys, "smd")
    out = ranks.withColumn("p", special.normal_p("z")).join(plain, keys).join(smd, keys)
    return out.select(*keys, "n1", "n2", "median1", "median2", "smd", "delta", "p")


def against_rest(long: DataFrame) -> DataFrame:
    """target and the other columns: every row once for each group, to be compared with that one. Rows: groups times rows."""
    groups = long.select(F.col("group").alias("target")).distinct()
    return long.crossJoin(F.broadcast(groups))  # a row for each group


def group_pairs(long: DataFrame) -> DataFrame:
    """group_a < group_b and the other columns: every row once for each pair that its group is in."""
    groups = long.select("group").distinct()
    pairs = groups.select(F.col("group").alias("group_a")).join(groups.select(F.col("group").alias("group_b")), F.expr("group_a < group_b"))
    return long.join(F.broadcast(pairs), F.expr("group = group_a or group = group_b"))  # a row for each pair of groups


def compared_with_rest(long: DataFrame) -> DataFrame:
    """feature, target, and two_samples of the target and all others."""
    return two_samples(against_rest(long), ["feature", "target"], F.col("group") == F.col("target"))


def compared_pairs(long: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """feature, group_a, group_b, and two_samples; of the features of `gate` only, if there is one."""
    rows = long.join(gate.select("feature"), "feature", "left_semi") if gate is not None else long
    return two_samples(group_pairs(rows), ["feature", "group_a", "group_b"], F.col("group") == F.col("group_a"))


def binary_cells(rows: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """keys, a, b, c, d: values above 0 and not, of the first sample and of the other; missing values are in no cell."""
    rows = rows.filter("value is not null").withColumn("_f", first).withColumn("_y", F.col("value") > 0)
    f, y = F.col("_f"), F.col("_y")
    cells = {"a": f & y, "b": f & ~y, "c": ~f & y, "d": ~f & ~y}
    return rows.groupBy(*keys).agg(*[F.count_if(rule).alias(name) for name, rule in cells.items()]).filter("a + b > 0 and c + d > 0")


def binary_tests(cells: DataFrame) -> DataFrame:
    """The cells with difference of frequencies, odds ratio and its limits (half added if a cell is 0), and Fisher's p."""
    ratio, low, high = S.odds_ratio(*[F.col(c).cast("double") for c in "abcd"], "if_zero")
    gap = F.col("a") / (F.col("a") + F.col("b")) - F.col("c") / (F.col("c") + F.col("d"))
    return cells.withColumns({"difference": gap, "odds": ratio, "low": low, "high": high, "p": special.fisher_p("a", "b", "c", "d")})


def dispersed(chi: str = "least_expected", few: str = "few_expected") -> Column:
    """The stricter rule for sparse tables: an expected count under 1, or more than a fifth of them under 5."""
    return (F.col(chi) < 1) | (F.col(few) > 0.2)


def pseudo_f(vectors: DataFrame, keys: list[str], group: str, vector: str, width: int) -> DataFrame:
    """keys, n, k, f, r2: Anderson's pseudo-F of euclidean distances, from sums of vectors by group and without pairs:
    the squares within a group are sum |x|^2 - |sum x|^2 / n."""
    parts = [F.sum(F.get(vector, F.lit(i))).alias(f"_s{i}") for i in range(width)]
    square = F.sum(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)).alias("_q")
    by = vectors.groupBy(*keys, group).agg(F.count("*").alias("_n"), square, *parts)
    own = [F.col(f"_s{i}") for i in range(width)]
    length = sum((c * c for c in own[1:]), own[0] * own[0])
    inside = F.sum(F.col("_q") - length / F.col("_n"))
    totals = [F.sum(c).alias(f"_t{i}") for i, c in enumerate(own)]
    all_ = by.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("k"), inside.alias("_w"), F.sum("_q").alias("_q"), *totals)
    whole = [F.col(f"_t{i}") for i in range(width)]
    total = F.col("_q") - sum((c * c for c in whole[1:]), whole[0] * whole[0]) / F.col("n")
    f = F.try_divide((total - F.col("_w")) / (F.col("k") - 1), F.col("_w") / (F.col("n") - F.col("k")))
    return all_.select(*keys, "n", "k", f.alias("f"), (1 - F.col("_w") / total).alias("r2"))


def permanova(vectors: DataFrame, by: list[str], key: str, group: str, vector: str, width: int, repeats: int) -> DataFrame:
    """by, n, k, f, r2, p = (x + 1) / (repeats + 1); groups are dealt anew by hash. Rows: repeats times vectors, summed at once."""
    seen = pseudo_f(vectors, by, group, vector, width)
    dealt = S.permuted_groups(vectors.select(*by, key, group), repeats, key, group, by).join(vectors.select(*by, key, vector), [*by, key])
    drawn = pseudo_f(dealt, [*by, "rep"], group, vector, width)
    over = drawn.select(*by, "rep", F.col("f").alias("_f"))
    over = over.join(seen.select(*by, "f"), by) if by else over.crossJoin(F.broadcast(seen.select("f")))
    p = over.groupBy(*by).agg(((F.count_if(F.col("_f") >= F.col("f") - 1e-9) + 1) / (repeats + 1)).alias("p"))
    return seen.join(p, by) if by else seen.crossJoin(p)
