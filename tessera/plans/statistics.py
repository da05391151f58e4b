"""Queries: tests, effect sizes, corrections and permutations (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import statistics as S
from tessera.plans import sqltext as Q
from tessera.plans.registry import query, table


def _round(df, **places):
    for c, n in places.items():
        df = df.withColumn(c, F.round(c, n))
    return df


_P = "p AS (SELECT l_suppkey AS id, l_suppkey % 4 AS family, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE round(avg(l_discount) * 10 - 0.2, 6) / 2 END AS p FROM lineitem GROUP BY 1)"


def _pvalues(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.round(F.avg("l_discount") * 10 - 0.2, 6) / 2).alias("p"))
    return rows.select("id", (F.col("id") % 4).alias("family"), F.when(F.col("id") % 7 != 0, F.col("p")).alias("p"))


@query("sta1_bh", f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS i, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL) SELECT id, family, p, round(least(1, min(p * m / i) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r UNION ALL SELECT id, family, p, NULL FROM p WHERE p IS NULL")
def sta1(spark, d):
    return _round(S.benjamini_hochberg(_pvalues(spark, d), ["family"], tie=["id"]), q=9)


@query("sta2_holm", f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS i, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL) SELECT id, family, p, round(least(1, max(p * (m - i + 1)) OVER (PARTITION BY family ORDER BY i ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM r UNION ALL SELECT id, family, p, NULL FROM p WHERE p IS NULL")
def sta2(spark, d):
    return _round(S.holm(_pvalues(spark, d), ["family"], tie=["id"]), p_holm=9)


@query(
    "sta4_cliffs_delta",
    """WITH a AS (SELECT c_nationkey, c_acctbal AS x FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_nationkey, c_acctbal AS y FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT c_nationkey, round(sum(CASE WHEN x > y THEN 1.0 WHEN x < y THEN -1.0 ELSE 0 END) / count(*), 9) AS delta FROM a JOIN b USING (c_nationkey) GROUP BY 1""",
)
def sta4(spark, d):
    out = S.rank_sums(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", F.col("c_mktsegment") == "BUILDING")
    return _round(out.filter("n1 > 0 and n2 > 0").select("c_nationkey", "delta"), delta=9)


_RANKED = """r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY k, x) AS t FROM v)"""


_KRUSKAL = f"""WITH v AS (SELECT p_type AS k, l_returnflag || l_linestatus AS g, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey), {_RANKED},
    s AS (SELECT k, g, sum(rk) AS s, count(*) AS m FROM r GROUP BY 1, 2), a AS (SELECT k, sum(m) AS n, count(*) AS c, sum(s * s / m) AS ss FROM s GROUP BY 1),
    t AS (SELECT k, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r GROUP BY 1), h AS (SELECT k, CAST(n AS BIGINT) AS n, c, (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - tie / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM a JOIN t USING (k))
    SELECT k AS p_type, n, c AS k, round(h, 6) AS h, round(greatest(0, least(1, (h - c + 1) / (n - c))), 6) AS epsilon2 FROM h"""


@query(
    "sta6_kruskal",
    _KRUSKAL,
)
def sta6(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("g")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _round(S.kruskal(rows, ["p_type"], "g", "l_quantity"), h=6, epsilon2=6)


@query(
    "sta6_kruskal_tests",
    f"""WITH h AS ({_KRUSKAL}), t AS (SELECT *, {Q.chi2_tail("h", "k - 1")} AS p FROM h), r AS (SELECT *, row_number() OVER (ORDER BY p, p_type) AS i, count(p) OVER () AS m FROM t)
    SELECT p_type, h, round(p, 6) AS p, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""",
)
def sta6p(spark, d):
    out = sta6(spark, d).withColumn("p", special.chi2_p("h", F.col("k") - 1)).withColumn("family", F.lit("features"))
    return _round(S.benjamini_hochberg(out, ["family"], tie=["p_type"]).select("p_type", "h", "p", "q"), p=6, q=6)


_MANN_WHITNEY = f"""WITH v AS (SELECT c_nationkey AS k, c_mktsegment = 'BUILDING' AS g, c_acctbal AS x FROM customer), {_RANKED},
    s AS (SELECT k, count(CASE WHEN g THEN 1 END) AS n1, count(CASE WHEN NOT g THEN 1 END) AS n2, sum(CASE WHEN g THEN rk ELSE 0 END) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r GROUP BY 1),
    u AS (SELECT *, CAST(n1 AS DOUBLE) AS a, CAST(n2 AS DOUBLE) AS b, r1 - n1 * (n1 + 1) / 2.0 AS u FROM s)
    SELECT k AS c_nationkey, n1, n2, round(u, 6) AS u1, round(greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(a * b / 12 * ((a + b + 1) - tie / ((a + b) * (a + b - 1)))), 6) AS z FROM u WHERE n1 > 0 AND n2 > 0"""


@query(
    "sta7_mann_whitney",
    _MANN_WHITNEY,
)
def sta7(spark, d):
    out = S.rank_sums(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", F.col("c_mktsegment") == "BUILDING")
    return _round(out.filter("n1 > 0 and n2 > 0").drop("delta"), u1=6, z=6)


@query(
    "sta7_mann_whitney_tests",
    f"""WITH z AS ({_MANN_WHITNEY}), t AS (SELECT *, {Q.normal_two_sided("z")} AS p FROM z), r AS (SELECT *, row_number() OVER (ORDER BY p, c_nationkey) AS i, count(p) OVER () AS m FROM t)
    SELECT c_nationkey, u1, round(p, 6) AS p, round(least(1, max(p * (m - i + 1)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_holm FROM r""",
)
def sta7p(spark, d):
    out = S.holm(sta7(spark, d).withColumn("p", special.normal_p("z")).withColumn("family", F.lit("pairs")), ["family"], tie=["c_nationkey"])
    return _round(out.select("c_nationkey", "u1", "p", "p_holm"), p=6, p_holm=6)


_CELLS = {"a": "= 'R' AND l_quantity > 40", "b": "= 'R' AND l_quantity <= 40", "c": "<> 'R' AND l_quantity > 40", "d": "<> 'R' AND l_quantity <= 40"}
_TWO = "t AS (SELECT p_brand, {} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)".format(
    ", ".join(f"CAST(count(CASE WHEN l_returnflag {rule} THEN 1 END) AS DOUBLE) AS {name}" for name, rule in _CELLS.items()))


def _two_by_two(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    r, q = F.col("l_returnflag") == "R", F.col("l_quantity") > 40
    return rows.groupBy("p_brand").agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("a", r & q), ("b", r & ~q), ("c", ~r & q), ("d", ~r & ~q))])


def _odds(cells, correction):
    ratio, low, high = S.odds_ratio(*[F.col(c) for c in "abcd"], correction)
    return cells.select("p_brand", F.round(ratio, 6).alias("odds"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _odds_sql(half, when="true"):
    cells = f"SELECT p_brand, a AS a0, c AS c0, a + {half} AS a, b + {half} AS b, c + {half} AS c, d + {half} AS d FROM t"
    pick = lambda x: f"CASE WHEN {when} THEN round({x}, 6) END"
    return f"WITH {_TWO}, x AS ({cells}) SELECT p_brand, {pick('a * d / (b * c)')} AS odds, {pick('exp(ln(a * d / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))')} AS low, {pick('exp(ln(a * d / (b * c)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))')} AS high FROM x"


_ZERO = "(CASE WHEN t.a = 0 OR t.b = 0 OR t.c = 0 OR t.d = 0 THEN 0.5 ELSE 0 END)"


@query("sta10_odds_ratio", _odds_sql(_ZERO, "a0 + c0 > 0"))
def sta10(spark, d):
    return _odds(_two_by_two(spark, d), "if_zero_and_events")


@query("sta11_odds_ratio_always", _odds_sql("0.5"))
def sta11(spark, d):
    return _odds(_two_by_two(spark, d), "always")


@query("sta12_odds_ratio_if_zero", _odds_sql(_ZERO))
def sta12(spark, d):
    return _odds(_two_by_two(spark, d), "if_zero")


@query(
    "sta13_fisher_enrichment",
    f"""WITH {_TWO}, f AS (SELECT *, {Q.fisher("a", "b", "c", "d")} AS p FROM t), r AS (SELECT *, row_number() OVER (ORDER BY p, p_brand) AS i, count(*) OVER () AS m FROM f)
    SELECT p_brand, a, b, c, d, round(p, 9) AS p, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""",
)
def sta13(spark, d):
    rows = _two_by_two(spark, d).withColumn("p", special.fisher_p("a", "b", "c", "d")).withColumn("family", F.lit("all genes"))
    return _round(S.benjamini_hochberg(rows, ["family"], tie=["p_brand"]).drop("family"), p=9, q=9)


@query(
    "sta14_chi_square",
    """WITH n AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS o FROM orders GROUP BY 1, 2), g AS (SELECT a.r, b.c, rs * cs * 1.0 / (SELECT sum(o) FROM n) AS e FROM (SELECT r, sum(o) AS rs FROM n GROUP BY 1) a CROSS JOIN (SELECT c, sum(o) AS cs FROM n GROUP BY 1) b)
    SELECT round(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e), 6) AS chi2, CAST((count(DISTINCT g.r) - 1) * (count(DISTINCT g.c) - 1) AS BIGINT) AS df, round(min(e), 6) AS least_expected FROM g LEFT JOIN n ON g.r = n.r AND g.c = n.c""",
)
def sta14(spark, d):
    out = S.chi_square(table(spark, d, "orders"), [], "o_orderpriority", "o_orderstatus")
    return _round(out.select("chi2", "df", "least_expected"), chi2=6, least_expected=6)


@query(
    "sta15_cramers_v",
    """WITH n AS (SELECT c_nationkey AS r, c_mktsegment AS c, count(*) AS o FROM customer GROUP BY 1, 2), t AS (SELECT CAST(sum(o) AS DOUBLE) AS n, CAST(count(DISTINCT r) AS DOUBLE) AS k, CAST(count(DISTINCT c) AS DOUBLE) AS m FROM n),
    g AS (SELECT a.r, b.c, rs * cs * 1.0 / (SELECT n FROM t) AS e FROM (SELECT r, sum(o) AS rs FROM n GROUP BY 1) a CROSS JOIN (SELECT c, sum(o) AS cs FROM n GROUP BY 1) b),
    x AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS x FROM g LEFT JOIN n ON g.r = n.r AND g.c = n.c)
    SELECT round(sqrt(x / n / (least(k, m) - 1)), 6) AS v, round(sqrt(greatest(0, x / n - (k - 1) * (m - 1) / (n - 1)) / (least(k - (k - 1) * (k - 1) / (n - 1), m - (m - 1) * (m - 1) / (n - 1)) - 1)), 6) AS v_corrected FROM x, t""",
)
def sta15(spark, d):
    out = S.chi_square(table(spark, d, "customer"), [], "c_nationkey", "c_mktsegment")
    return _round(out.select("v", "v_corrected"), v=6, v_corrected=6)


_SHUFFLED = """m AS (SELECT c_nationkey, c_custkey AS key, c_mktsegment AS g, c_acctbal AS x, c_acctbal > 5000 AS y, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
    d AS (SELECT c_nationkey, rep, key, x, y, row_number() OVER (PARTITION BY c_nationkey, rep ORDER BY md5(rep || '|' || key), key) AS pos FROM m CROSS JOIN (SELECT CAST(range AS BIGINT) AS rep FROM range({n}))),
    s AS (SELECT d.c_nationkey, rep, d.key, d.x, d.y, m.g FROM d JOIN m USING (c_nationkey, pos) UNION ALL SELECT c_nationkey, -1, key, x, y, g FROM m)"""
_CHI = """n AS (SELECT c_nationkey, rep, g, y, count(*) AS o FROM s GROUP BY ALL), r AS (SELECT c_nationkey, rep, g, sum(o) AS r FROM n GROUP BY ALL), c AS (SELECT c_nationkey, rep, y, sum(o) AS c FROM n GROUP BY ALL),
    t AS (SELECT c_nationkey, rep, sum(o) AS t FROM n GROUP BY ALL), e AS (SELECT r.*, y, r * c * 1.0 / t AS e FROM r JOIN c USING (c_nationkey, rep) JOIN t USING (c_nationkey, rep)),
    x AS (SELECT c_nationkey, rep, sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2, min(e) AS least, (count(DISTINCT g) - 1) * (count(DISTINCT y) - 1) AS df FROM e LEFT JOIN n USING (c_nationkey, rep, g, y) GROUP BY ALL),
    o AS (SELECT * FROM x WHERE rep = -1), p AS (SELECT c_nationkey, (count(CASE WHEN x.chi2 >= o.chi2 - 1e-9 THEN 1 END) + 1) / ({n} + 1.0) AS p FROM x JOIN o USING (c_nationkey) WHERE x.rep >= 0 GROUP BY 1)"""
REPEATS = 999


def _customers(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("group"), x.alias("x"), (x > 5000).alias("y"))


@query("sta18_permuted_chi_square", f"WITH {_SHUFFLED.format(n=REPEATS)}, {_CHI.format(n=REPEATS)} SELECT c_nationkey, round(chi2, 6) AS chi2, round(p, 6) AS p FROM o JOIN p USING (c_nationkey)")
def sta18(spark, d):
    out = S.permuted_chi_square(_customers(spark, d), ["c_nationkey"], "key", "group", "y", REPEATS)
    return _round(out.select("c_nationkey", "chi2", "p"), chi2=6, p=6)


@query(
    "sta16_categorical_tests",
    f"""WITH {_SHUFFLED.format(n=REPEATS)}, {_CHI.format(n=REPEATS)} SELECT c_nationkey, round(chi2, 6) AS chi2, CASE WHEN least < 5 THEN 'permutation' ELSE 'pearson' END AS method,
    round(CASE WHEN least < 5 THEN p ELSE {Q.chi2_tail("chi2", "df")} END, 6) AS p FROM o JOIN p USING (c_nationkey)""",
)
def sta16(spark, d):
    out = S.categorical_tests(_customers(spark, d), ["c_nationkey"], "key", "group", "y", F.col("least_expected") < 5, REPEATS)
    return _round(out.select("c_nationkey", "chi2", "method", "p"), chi2=6, p=6)


@query(
    "sta48_permutation",
    f"""WITH {_SHUFFLED.format(n=REPEATS)}, g AS (SELECT c_nationkey, rep, avg(CASE WHEN g = 'BUILDING' THEN x END) - avg(CASE WHEN g <> 'BUILDING' THEN x END) AS gap FROM s GROUP BY ALL)
    SELECT o.c_nationkey, round(any_value(o.gap), 6) AS gap, round((count(CASE WHEN abs(g.gap) >= abs(o.gap) - 1e-9 THEN 1 END) + 1) / {REPEATS + 1.0}, 6) AS p
    FROM g JOIN g o ON g.c_nationkey = o.c_nationkey AND o.rep = -1 WHERE g.rep >= 0 AND o.gap IS NOT NULL GROUP BY 1""",
)
def sta48(spark, d):
    rows = _customers(spark, d).withColumn("group", F.col("group") == "BUILDING")
    own = F.col("group")
    gap = F.avg(F.when(own, F.col("x"))) - F.avg(F.when(~own, F.col("x")))
    mean = F.try_divide("s", "n")
    dealt = F.max(F.when(own, mean)) - F.max(F.when(~own, mean))  # a row for each group
    drawn = S.permuted_sums(rows, REPEATS, "key", "group", "x", ["c_nationkey"]).groupBy("c_nationkey", "rep").agg(dealt.alias("gap"))
    seen = rows.groupBy("c_nationkey").agg(gap.alias("seen")).filter("seen is not null")
    out = drawn.join(seen, "c_nationkey").groupBy("c_nationkey", "seen").agg(F.count_if(F.abs("gap") >= F.abs("seen") - 1e-9).alias("k"))
    return out.select("c_nationkey", F.round("seen", 6).alias("gap"), F.round((F.col("k") + 1) / (REPEATS + 1.0), 6).alias("p"))


@query(
    "sta26_smd",
    """WITH s AS (SELECT c_nationkey, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS n1, count(CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 END) AS n2, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) - avg(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) AS g,
    var_samp(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS v1, var_samp(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) AS v2 FROM customer GROUP BY 1)
    SELECT c_nationkey, n1, n2, round(g / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS smd FROM s""",
)
def sta26(spark, d):
    return _round(S.standardised_difference(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", F.col("c_mktsegment") == "BUILDING"), smd=6)


_SURVIVAL = "v AS (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'a' ELSE 'b' END AS grp, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS event FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)"


def _survival(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("days"), F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("event"))
    grp = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "a").otherwise("b")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", grp.alias("grp"), "days", "event")


@query(
    "sta34_kaplan_meier",
    f"""WITH {_SURVIVAL}, n AS (SELECT grp, days, count(*) AS k, sum(event) AS d FROM v GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY grp ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM n)
    SELECT grp, days, CAST(r AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN max(CASE WHEN d = r THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < r THEN ln(1 - d / r) ELSE 0 END) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY grp ORDER BY days ROWS UNBOUNDED PRECEDING)""",
)
def sta34(spark, d):
    return _round(S.kaplan_meier(_survival(spark, d), "grp", "days", "event"), survival=6)


@query(
    "sta35_log_rank",
    f"""WITH {_SURVIVAL}, n AS (SELECT days, count(*) AS k, sum(event) AS d, count(CASE WHEN grp = 'a' THEN 1 END) AS k1, sum(CASE WHEN grp = 'a' THEN event ELSE 0 END) AS d1 FROM v GROUP BY 1),
    r AS (SELECT *, sum(k) OVER w AS r, sum(k1) OVER w * 1.0 / sum(k) OVER w AS s FROM n WINDOW w AS (ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    x AS (SELECT sum(d1) AS o, sum(d * s) AS e, sum(CASE WHEN r > 1 THEN d * s * (1 - s) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r)
    SELECT CAST(o AS BIGINT) AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round((o - e) * (o - e) / v, 6) AS statistic FROM x""",
)
def sta35(spark, d):
    return _round(S.log_rank(_survival(spark, d), "grp", "days", "event"), expected=6, variance=6, statistic=6)


@query("sta47_within_between", "SELECT source, round(sum(CASE WHEN lang = 'en' THEN n_chars END) * 1.0 / count(CASE WHEN lang = 'en' THEN 1 END) - sum(CASE WHEN lang <> 'en' THEN n_chars END) * 1.0 / count(CASE WHEN lang <> 'en' THEN 1 END), 6) AS gap FROM documents GROUP BY 1")
def sta47(spark, d):
    x, own = F.col("n_chars"), F.col("lang") == "en"
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg(F.when(own, x)) - F.avg(F.when(~own, x)), 6).alias("gap"))
