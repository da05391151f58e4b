"""Tests, effect sizes and corrections over long tables. A family of tests is always named: it is part of the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.digests import PrefixedMd5
from tessera.operators.matrices import counts_below


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p", out: str = "q", tie: list[str] | None = None) -> DataFrame:
    """Step-up q-values within a family. A null p isn't in the family and has a null q."""
    known = Window.partitionBy(*family, F.col(p).isNull())
    order = known.orderBy(F.asc(p), *(tie or []))
    raw = F.col(p) * F.count(p).over(known) / F.row_number().over(order)
    step = df.withColumn("_i", F.row_number().over(order)).withColumn("_r", raw)
    least = F.min("_r").over(known.orderBy("_i").rowsBetween(0, Window.unboundedFollowing))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_i", "_r")


def holm(df: DataFrame, family: list[str], p: str = "p", out: str = "p_holm", tie: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p-values within a family; a null p stays null and out of it."""
    known = Window.partitionBy(*family, F.col(p).isNull())
    order = known.orderBy(F.asc(p), *(tie or []))
    step = df.withColumn("_i", F.row_number().over(order)).withColumn("_r", F.col(p) * (F.count(p).over(known) - F.row_number().over(order) + 1))
    most = F.max("_r").over(known.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), most))).drop("_i", "_r")


def value_ranks(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, group, value, n (rows of the group with the value), t (rows with the value), rank (average rank of the value).

    Ranks are taken over the distinct values with their counts, so a window holds distinct values, not rows.
    """
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count("*").alias("n"))
    ties = n.groupBy(*keys, value).agg(F.sum("n").alias("t"))
    if keys:
        upto = F.sum("t").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        ties = ties.withColumn("upto", upto)
    else:  # one family of values: its window is dealt to ranges
        ties = counts_below(ties, [], value, "t")
    return n.join(ties.withColumn("rank", F.col("upto") - F.col("t") / 2 + 0.5).drop("upto"), [*keys, value])


def kruskal(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, n, k, h (with the correction for ties), epsilon2 = (h - k + 1) / (n - k) within [0, 1]; null h if all values tie or a group is alone."""
    r = value_ranks(df, keys, group, value)
    by = r.groupBy(*keys, group).agg(F.sum(F.col("rank") * F.col("n")).alias("s"), F.sum("n").alias("m"))
    h0 = by.groupBy(*keys).agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("ss"))
    one = r.select(*keys, value, "t").distinct()
    ties = one.groupBy(*keys).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("tie") / (n * n * n - n))
    out = (h0.join(ties, keys) if keys else h0.crossJoin(ties)).withColumn("h", F.when(F.col("k") > 1, h))
    e2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("h") - F.col("k") + 1, F.col("n") - F.col("k"))))
    return out.select(*keys, "n", "k", "h", e2.alias("epsilon2"))


def rank_sums(df: DataFrame, keys: list[str], group: str, value: str, first: Column) -> DataFrame:
    """keys, n1, n2, u1 (Mann-Whitney), delta (Cliff: 2 u1 / (n1 n2) - 1), z (normal approximation with ties and continuity)."""
    rows = df.select(*keys, value, first.alias("_first"))
    r = value_ranks(rows, keys, "_first", value)
    f = F.col("_first")
    n1 = F.sum(F.when(f, F.col("n")).otherwise(0))
    out = r.groupBy(*keys).agg(n1.alias("n1"), (F.sum("n") - n1).alias("n2"), F.sum(F.when(f, F.col("rank") * F.col("n")).otherwise(0.0)).alias("r1"))
    ties = r.select(*keys, value, "t").distinct().groupBy(*keys).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    out = out.join(ties, keys) if keys else out.crossJoin(ties)
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - a * (a + 1) / 2
    n = a + b
    sd = F.sqrt(a * b / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1))))
    gap = F.abs(F.col("u1") - a * b / 2) - 0.5
    return out.withColumn("u1", u).select(*keys, "n1", "n2", "u1", F.try_divide(2 * F.col("u1"), a * b).alias("d0"), F.try_divide(F.greatest(gap, F.lit(0.0)), sd).alias("z")).withColumn("delta", F.col("d0") - 1).drop("d0")


def odds_ratio(a: Column, b: Column, c: Column, d: Column, correction: str = "if_zero") -> tuple[Column, Column, Column]:
    """Odds ratio of [[a, b], [c, d]] with its 95 % limits. Half is added to each cell if one is zero, or always.
    With if_zero_and_events, a table without events in both groups has none."""
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    half = F.lit(0.5) if correction == "always" else F.when(zero, 0.5).otherwise(0.0)
    w, x, y, z = (v + half for v in (a, b, c, d))
    ratio = w * z / (x * y)
    error = 1.96 * F.sqrt(1 / w + 1 / x + 1 / y + 1 / z)
    out = (ratio, F.exp(F.ln(ratio) - error), F.exp(F.ln(ratio) + error))
    if correction == "if_zero_and_events":
        out = tuple(F.when((a + c) > 0, v) for v in out)
    return out


def chi_square(df: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """keys, n, rows, cols, chi2, df, least_expected, few_expected (share of expected counts under 5), v (Cramer), v_corrected (bias-corrected), over the complete grid of rows and columns that have entries."""
    return chi_square_of(df.groupBy(*keys, row, col).agg(F.count("*").alias("o")), keys, row, col)


def chi_square_of(n: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """As chi_square, of the counts `o` of (keys, row, col)."""
    r, c = n.groupBy(*keys, row).agg(F.sum("o").alias("r")), n.groupBy(*keys, col).agg(F.sum("o").alias("c"))
    t = n.groupBy(*keys).agg(F.sum("o").alias("n"))
    on = (lambda x, y: x.join(y, keys)) if keys else (lambda x, y: x.crossJoin(y))
    grid = on(on(r, c), t).join(n, [*keys, row, col], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    e = F.col("r") * F.col("c") / F.col("n")
    out = grid.groupBy(*keys).agg(F.max("n").alias("n"), F.count_distinct(row).alias("rows"), F.count_distinct(col).alias("cols"), F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("chi2"), F.min(e).alias("least_expected"), F.avg((e < 5).cast("double")).alias("few_expected"))
    size, k, m = F.col("n").cast("double"), F.col("rows").cast("double"), F.col("cols").cast("double")
    v = F.sqrt(F.try_divide(F.col("chi2") / size, F.least(k, m) - 1))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / size - (k - 1) * (m - 1) / (size - 1))
    kk, mm = k - (k - 1) * (k - 1) / (size - 1), m - (m - 1) * (m - 1) / (size - 1)
    corrected = F.sqrt(F.try_divide(phi, F.least(kk, mm) - 1))
    return out.withColumn("v", v).withColumn("v_corrected", corrected).withColumn("df", (F.col("rows") - 1) * (F.col("cols") - 1))


def kaplan_meier(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """group, time, at_risk, events, survival, at each distinct time; survival is 0 from the time at which all at risk have the event."""
    n = df.groupBy(group, time).agg(F.count("*").alias("k"), F.sum(F.col(event).cast("long")).alias("events"))
    w = Window.partitionBy(group).orderBy(time)
    at = F.sum("k").over(w.rowsBetween(0, Window.unboundedFollowing))
    n = n.withColumn("at_risk", at)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.max(F.when(F.col("events") == F.col("at_risk"), 1).otherwise(0)).over(upto)
    product = F.exp(F.sum(F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(upto))
    return n.select(group, time, "at_risk", "events", F.when(whole == 1, 0.0).otherwise(product).alias("survival"))


def log_rank(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """For two groups: statistic (O - E)^2 / V of the first in order, with observed and expected events."""
    n = df.groupBy(time, group).agg(F.count("*").alias("k"), F.sum(F.col(event).cast("long")).alias("d"))
    first = df.agg(F.min(group).alias("g")).first()["g"]
    own = F.col(group) == first
    wide = n.groupBy(time).agg(F.sum("k").alias("k"), F.sum("d").alias("d"), F.sum(F.when(own, F.col("k")).otherwise(0)).alias("k1"), F.sum(F.when(own, F.col("d")).otherwise(0)).alias("d1"))
    w = Window.orderBy(time).rowsBetween(0, Window.unboundedFollowing)  # distinct times, not rows
    wide = wide.withColumn("r", F.sum("k").over(w)).withColumn("r1", F.sum("k1").over(w))
    share = F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    sums = wide.agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(v).alias("variance"))
    return sums.withColumn("statistic", F.try_divide((F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")), F.col("variance")))


def standardised_difference(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """keys, n1, n2, smd: difference of means over the pooled standard deviation; null if that is 0."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    out = df.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), (F.avg(a) - F.avg(b)).alias("gap"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return out.select(*keys, "n1", "n2", F.try_divide(F.col("gap"), pooled).alias("smd"))


def hashed_order(rep: Column, key: Column) -> Column:
    """A pseudo-random order for each repeat that any engine with md5 gives."""
    return F.md5(F.concat(rep.cast("string"), F.lit("|"), key.cast("string")))


def permuted_groups(members: DataFrame, repeats: int, key: str = "key", group: str = "group", by: list[str] | None = None) -> DataFrame:
    """The rows with rep and, for each repeat, the groups dealt anew by hash within `by`; sizes stay. Rows: repeats times members."""
    by = by or []
    spark = members.sparkSession
    place = members.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    reps = spark.range(repeats).select(F.col("id").alias("rep"))
    order = Window.partitionBy(*by, "rep").orderBy(hashed_order(F.col("rep"), F.col(key)), key)
    drawn = place.drop(group, "_pos").crossJoin(F.broadcast(reps)).withColumn("_pos", F.row_number().over(order))
    return drawn.join(place.select(*by, group, "_pos"), [*by, "_pos"]).select("rep", *members.columns)


def _deals(members: DataFrame, repeats: int, key: str, group: str, value: str, by: list[str], figures, schema: str) -> DataFrame:
    """by and the columns of `schema`: what figures(group codes, groups, values, orders) gives for each group of `by`, orders being (repeat, places)
    of the hashed orders of `permuted_groups`: its row at place p has the group of the p-th key.

    A group's members are one row, in the order of their keys; tasks take it with a share of the repeats. So no row is made for a repeat of a member.
    """
    from tessera.session import cut

    spark = members.sparkSession
    rows = F.struct(F.col(key).alias("k"), F.col(key).cast("string").alias("t"), F.col(group).alias("g"), F.col(value).alias("v"))
    whole = cut(members.groupBy(*by).agg(F.array_sort(F.collect_list(rows)).alias("_rows")))
    share = -(-repeats // 16) or 1
    shares = spark.range(0, -(-repeats // share), 1, 16).select(F.sequence(F.col("id") * share, F.least(F.col("id") * share + share, F.lit(repeats)) - 1).alias("_reps"))

    def orders(digests: PrefixedMd5, reps: list[int]):
        for rep in reps:
            high, low = digests(f"{rep}|".encode())
            order = np.argsort(high)
            first = high[order]
            if (first[1:] == first[:-1]).any():
                order = np.lexsort((low, high))  # stable: then by key
            yield rep, order

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                own = batch.column(len(by))[n].values
                if not len(own):
                    continue
                codes = own.field("g").dictionary_encode("encode")
                digests = PrefixedMd5([t.encode() for t in own.field("t").to_pylist()])
                out = figures(codes.indices.to_numpy(), codes.dictionary, own.field("v"), orders(digests, batch.column(len(by) + 1)[n].as_py()))
                size = len(out[0])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array([n] * size)) for c in range(len(by))), *out], names=names)

    kinds = [f"{c} {members.schema[c].dataType.simpleString()}" for c in by]
    names = [*by, *(c.split()[0] for c in schema.split(", "))]
    return whole.join(shares.hint("shuffle_replicate_nl")).select(*by, "_rows", "_reps").mapInArrow(run, ", ".join([*kinds, schema]))


def permuted_counts(members: DataFrame, repeats: int, key: str, group: str, value: str, by: list[str]) -> DataFrame:
    """by, rep, group, value, o: how many rows of `permuted_groups` have the group and the value; without those rows."""

    def figures(g, groups, v, orders):
        codes = v.dictionary_encode("encode")
        v, width = codes.indices.to_numpy(), len(codes.dictionary)
        reps, cells, counts = [], [], []
        for rep, order in orders:
            n = np.bincount(g * width + v[order], minlength=len(groups) * width)
            cells.append(np.flatnonzero(n))
            reps.append(np.full(len(cells[-1]), rep))
            counts.append(n[cells[-1]])
        cell = np.concatenate(cells)
        return [pa.array(np.concatenate(reps)), groups.take(pa.array(cell // width)), codes.dictionary.take(pa.array(cell % width)), pa.array(np.concatenate(counts))]

    kind = {c: members.schema[c].dataType.simpleString() for c in (group, value)}
    return _deals(members, repeats, key, group, value, by, figures, f"rep long, {group} {kind[group]}, {value} {kind[value]}, o long")


def permuted_sums(members: DataFrame, repeats: int, key: str, group: str, value: str, by: list[str]) -> DataFrame:
    """by, rep, group, n, s: number and sum of the values, not null, that the groups of `permuted_groups` have; without those rows."""

    def figures(g, groups, v, orders):
        known = v.is_valid().to_numpy(zero_copy_only=False)
        v = v.fill_null(0).to_numpy().astype(float)
        reps, counts, sums = [], [], []
        for rep, order in orders:
            reps.append(np.full(len(groups), rep))
            counts.append(np.bincount(g[known[order]], minlength=len(groups)))
            sums.append(np.bincount(g, v[order], len(groups)))
        return [pa.array(np.concatenate(reps)), groups.take(pa.array(np.tile(np.arange(len(groups)), len(reps)))), pa.array(np.concatenate(counts)), pa.array(np.concatenate(sums))]

    return _deals(members, repeats, key, group, value, by, figures, f"rep long, {group} {members.schema[group].dataType.simpleString()}, n long, s double")


def permuted_chi_square(members: DataFrame, by: list[str], key: str, group: str, value: str, repeats: int) -> DataFrame:
    """As chi_square of group and value within `by`, and p = (x + 1) / (repeats + 1) of the statistics of permuted groups."""
    from tessera.session import cut

    seen = chi_square(members, by, group, value)
    drawn = chi_square_of(cut(permuted_counts(members, repeats, key, group, value, by)), [*by, "rep"], group, value)  # read several times
    over = drawn.select(*by, "rep", F.col("chi2").alias("other")).join(seen.select(*by, "chi2"), by)
    over = over.groupBy(*by).agg(((F.count_if(F.col("other") >= F.col("chi2") - 1e-9) + 1) / (repeats + 1)).alias("p"))
    return seen.join(over, by)


def categorical_tests(members: DataFrame, by: list[str], key: str, group: str, value: str, sparse: Column, repeats: int) -> DataFrame:
    """As chi_square, with method and p: the permutation test for tables that are sparse, Pearson's otherwise. Only the sparse tables' rows are permuted."""
    from tessera.functions import special

    own = chi_square(members, by, group, value).withColumn("sparse", sparse)
    rare = members.join(own.filter("sparse").select(*by), by, "left_semi")
    p = permuted_chi_square(rare, by, key, group, value, repeats).select(*by, F.col("p").alias("_p"))
    out = own.withColumn("p", special.chi2_p("chi2", "df")).join(p, by, "left")
    return out.withColumn("method", F.when(F.col("sparse"), "permutation").otherwise("pearson")).withColumn("p", F.when(F.col("sparse"), F.col("_p")).otherwise(F.col("p"))).drop("_p", "sparse")
