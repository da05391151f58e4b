"""Queries: gated families of tests, and the audits made of them (2.8 and 2.11b).

The cases are the embeddings, the features their 64 entries, the groups the labels of the first partition (see
plans.partitions), so that eight of the features differ between the groups. Binary features are entries above 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import statistics as S
from tessera.operators import suites as U
from tessera.plans import sqltext as Q
from tessera.plans.partitions import _RUNS, _runs
from tessera.plans.registry import query, table
from tessera.session import cut

_LONG = f"""{_RUNS}, g AS (SELECT node, label AS g FROM m WHERE run = 0),
    l AS (SELECT feature, v.node, g, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id AS node, unnest(range(64)) AS feature, unnest(embedding) AS x FROM embeddings) v JOIN g USING (node))"""
_PAIRS = "pr AS (SELECT l.*, a.g AS ga, b.g AS gb, l.g = a.g AS f FROM l, (SELECT DISTINCT g FROM g) a, (SELECT DISTINCT g FROM g) b WHERE a.g < b.g AND l.g IN (a.g, b.g))"
_REST = "rs AS (SELECT l.*, o.g AS target, l.g = o.g AS f FROM l, (SELECT DISTINCT g FROM g) o)"


def _groups(spark, d):
    return _runs(spark, d).filter("run = 0").select("node", F.col("label").alias("group"))


def _long(spark, d):
    long = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.posexplode("embedding").alias("feature", "value"))
    return long.withColumn("value", F.col("value").cast("double")).join(_groups(spark, d), "node")


def _round(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


_OMNIBUS = f"{_LONG}, {Q.kruskal('l', 'feature')}, {Q.adjusted('kw', '', 'feature')}"


@query("sta9_omnibus", f"WITH {_OMNIBUS} SELECT CAST(feature AS INTEGER) AS feature, n, k, round(h, 6) AS h, round(epsilon2, 6) AS epsilon2, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sta9_omnibus(spark, d):
    return _round(U.numeric_omnibus(_long(spark, d)), "h", "epsilon2", "p", "q")


@query(
    "sta9_gated_pairs",
    f"""WITH {_OMNIBUS}, gate AS (SELECT feature FROM adj WHERE q < 0.05), pg AS (SELECT * FROM ({_PAIRS.removeprefix("pr AS (").removesuffix(")")}) SEMI JOIN gate USING (feature)),
    r2 AS (SELECT 1), x AS (WITH {Q.two_samples("pg", "feature, ga, gb")}, {Q.adjusted("mw", "feature", "ga, gb", "holm", "ho", "p_holm")} SELECT * FROM ho)
    SELECT CAST(feature AS INTEGER) AS feature, ga AS group_a, gb AS group_b, n1, n2, round(m1, 6) AS median1, round(m2, 6) AS median2, round(delta, 6) AS delta, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM x""",
)
def sta9_pairs(spark, d):
    long = _long(spark, d)
    out = U.compared_pairs(long, U.numeric_omnibus(long).filter("q < 0.05"))
    out = S.holm(out, ["feature"], tie=["group_a", "group_b"]).drop("smd")
    return _round(out, "median1", "median2", "delta", "p", "p_holm")


_AGAINST = f"{_LONG}, {_REST}, {Q.two_samples('rs', 'feature, target')}"
_SHOWN = "CAST(feature AS INTEGER) AS feature, target, n1, n2, round(m1, 6) AS median1, round(m2, 6) AS median2"


@query("sta8_against_rest", f"WITH {_AGAINST} SELECT {_SHOWN}, round(delta, 6) AS delta, round(p, 6) AS p FROM mw")
def sta8(spark, d):
    return _round(U.compared_with_rest(_long(spark, d)).drop("smd"), "median1", "median2", "delta", "p")


@query("sta9_against_rest", f"WITH {_AGAINST}, {Q.adjusted('mw', 'target', 'feature')} SELECT {_SHOWN}, round(delta, 6) AS delta, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sta9_rest(spark, d):
    out = S.benjamini_hochberg(U.compared_with_rest(_long(spark, d)), ["target"], tie=["feature"])
    return _round(out.drop("smd"), "median1", "median2", "delta", "p", "q")


@query("sta50_core_against_rest", f"WITH {_AGAINST}, {Q.adjusted('mw', 'target', 'feature')} SELECT {_SHOWN}, round(smd, 6) AS smd, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sta50(spark, d):
    out = S.benjamini_hochberg(U.compared_with_rest(_long(spark, d)), ["target"], tie=["feature"])
    return _round(out.drop("delta"), "median1", "median2", "smd", "p", "q")


_NUMERIC_PAIRS = f"{_LONG}, {_PAIRS}, {Q.two_samples('pr', 'feature, ga, gb')}, {Q.adjusted('mw', 'ga, gb', 'feature')}"


@query("sec1_pairwise_numeric", f"WITH {_NUMERIC_PAIRS} SELECT CAST(feature AS INTEGER) AS feature, ga AS group_a, gb AS group_b, n1, n2, round(smd, 6) AS smd, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sec1(spark, d):
    out = S.benjamini_hochberg(U.compared_pairs(_long(spark, d)), ["group_a", "group_b"], tie=["feature"])
    return _round(out.drop("median1", "median2", "delta"), "smd", "p", "q")


_SPEND = """sp AS (SELECT c_mktsegment AS g, c_custkey, coalesce(sum(o_totalprice), 0) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def _spend(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.lit("spend").alias("feature"), F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("group"), F.coalesce("s", F.lit(0.0)).alias("value"))


@query(
    "sec2_removed_by_value",
    f"""WITH {_SPEND}, rs AS (SELECT o.g AS target, x, sp.g = o.g AS f FROM sp, (SELECT DISTINCT g FROM sp) o), {Q.two_samples("rs", "target")}, {Q.adjusted("mw", "", "target")}
    SELECT target, n1, n2, round(smd, 6) AS smd, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sec2(spark, d):
    """A group against all values less its own, each taken out once: by their group, not by value, since a sum of doubles made twice may differ in its last digit."""
    out = S.benjamini_hochberg(U.compared_with_rest(cut(_spend(spark, d).select("feature", "group", "value"))), [], tie=["target"])
    return _round(out.select("target", "n1", "n2", "smd", "p", "q"), "smd", "p", "q")


@query(
    "sec3_pairs_of_one_feature",
    f"""WITH {_SPEND}, pr AS (SELECT a.g AS ga, b.g AS gb, x, sp.g = a.g AS f FROM sp, (SELECT DISTINCT g FROM sp) a, (SELECT DISTINCT g FROM sp) b WHERE a.g < b.g AND sp.g IN (a.g, b.g)),
    {Q.two_samples("pr", "ga, gb")}, {Q.adjusted("mw", "", "ga, gb")}
    SELECT ga AS group_a, gb AS group_b, round(smd, 6) AS smd, round(m1, 4) AS median1, round(m2, 4) AS median2, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sec3(spark, d):
    out = S.benjamini_hochberg(U.compared_pairs(_spend(spark, d)), [], tie=["group_a", "group_b"])
    out = _round(_round(out, "smd", "p", "q"), "median1", "median2", places=4)
    return out.select("group_a", "group_b", "smd", "median1", "median2", "p", "q")


FAMILIES = ("shape", "firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm")  # fixed values: families of image features


@query(
    "sec4_annotated_features",
    f"""WITH {_AGAINST}, {Q.adjusted('mw', 'target', 'feature')} SELECT 'original_' || list_extract(['shape', 'firstorder', 'glcm', 'glrlm', 'glszm', 'gldm', 'ngtdm', 'other'], CAST(feature % 8 + 1 AS INTEGER))
    || '_' || feature AS feature, target, list_extract(['shape', 'firstorder', 'glcm', 'glrlm', 'glszm', 'gldm', 'ngtdm', 'other'], CAST(feature % 8 + 1 AS INTEGER)) AS family,
    CASE WHEN smd > 0 THEN 'higher' WHEN smd < 0 THEN 'lower' ELSE 'not estimable' END AS direction, q < 0.05 AS significant FROM adj""",
)
def sec4(spark, d):
    kinds = F.array(*[F.lit(x) for x in (*FAMILIES, "other")])
    long = _long(spark, d).withColumn("feature", F.concat(F.lit("original_"), F.get(kinds, F.col("feature") % 8), F.lit("_"), F.col("feature")))
    out = S.benjamini_hochberg(U.compared_with_rest(long), ["target"], tie=["feature"])
    family = F.coalesce(*[F.when(F.col("feature").contains(f"_{x}_"), x) for x in FAMILIES], F.lit("other"))
    direction = F.when(F.col("smd") > 0, "higher").when(F.col("smd") < 0, "lower").otherwise("not estimable")
    return out.select("feature", "target", family.alias("family"), direction.alias("direction"), (F.col("q") < 0.05).alias("significant"))


_CELLS = """ce AS (SELECT {keys}, count(CASE WHEN f AND x > 0 THEN 1 END) AS a, count(CASE WHEN f AND x <= 0 THEN 1 END) AS b, count(CASE WHEN NOT f AND x > 0 THEN 1 END) AS c,
    count(CASE WHEN NOT f AND x <= 0 THEN 1 END) AS d FROM {source} GROUP BY ALL HAVING count(CASE WHEN f THEN 1 END) > 0 AND count(CASE WHEN NOT f THEN 1 END) > 0),
    bt AS (SELECT *, a * 1.0 / (a + b) - c * 1.0 / (c + d) AS difference, """ + Q.fisher("a", "b", "c", "d") + " AS p FROM ce)"
_ODDS = """CASE WHEN least(a, b, c, d) = 0 THEN (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)) ELSE a * 1.0 * d / (b * 1.0 * c) END"""


@query(
    "sta49_binary_against_rest",
    f"""WITH {_LONG}, {_REST}, {_CELLS.format(keys="feature, target", source="rs")}, {Q.adjusted("bt", "target", "feature")}
    SELECT CAST(feature AS INTEGER) AS feature, target, a, b, c, d, round(difference, 6) AS difference, round({_ODDS}, 6) AS odds, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sta49(spark, d):
    cells = U.binary_cells(U.against_rest(_long(spark, d)), ["feature", "target"], F.col("group") == F.col("target"))
    out = S.benjamini_hochberg(U.binary_tests(cells), ["target"], tie=["feature"])
    return _round(out.drop("low", "high"), "difference", "odds", "p", "q")


@query(
    "sta49_binary_pairs",
    f"""WITH {_LONG}, {_PAIRS}, {_CELLS.format(keys="feature, ga, gb", source="pr")}, {Q.adjusted("bt", "ga, gb", "feature")}
    SELECT CAST(feature AS INTEGER) AS feature, ga AS group_a, gb AS group_b, round(difference, 6) AS difference, round({_ODDS}, 6) AS odds, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sta49_pairs(spark, d):
    cells = U.binary_cells(U.group_pairs(_long(spark, d)), ["feature", "group_a", "group_b"], F.col("group") == F.col("group_a"))
    out = S.benjamini_hochberg(U.binary_tests(cells), ["group_a", "group_b"], tie=["feature"])
    return _round(out.drop("low", "high", "a", "b", "c", "d"), "difference", "odds", "p", "q")


@query(
    "sec12_top_events",
    f"""WITH {_LONG}, {_REST}, {_CELLS.format(keys="feature, target", source="rs")}, {Q.adjusted("bt", "target", "feature")},
    s AS (SELECT feature, max(CASE WHEN q < 0.05 THEN 1 ELSE 0 END) AS flag, max(abs(difference)) AS gap FROM adj GROUP BY 1)
    SELECT CAST(feature AS INTEGER) AS feature, flag, round(gap, 6) AS gap FROM s ORDER BY flag DESC, round(gap, 9) DESC, feature LIMIT 20""",
)
def sec12(spark, d):
    cells = U.binary_cells(U.against_rest(_long(spark, d)), ["feature", "target"], F.col("group") == F.col("target"))
    out = S.benjamini_hochberg(U.binary_tests(cells), ["target"], tie=["feature"])
    best = out.groupBy("feature").agg(F.max(F.when(F.col("q") < 0.05, 1).otherwise(0)).alias("flag"), F.max(F.abs("difference")).alias("gap"))
    return _round(best.orderBy(F.desc("flag"), F.desc(F.round("gap", 9)), "feature").limit(20), "gap")


@query(
    "sta51_enriched_features",
    f"""WITH {_AGAINST}, {Q.adjusted('mw', 'target', 'feature')}, e AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY q, feature) AS i FROM adj WHERE q < 0.05 AND m1 > m2)
    SELECT target, i AS place, CAST(feature AS INTEGER) AS feature, round(m1 - m2, 6) AS effect FROM e WHERE i <= 3""",
)
def sta51(spark, d):
    return _enriched(spark, d).select("target", "place", "feature", F.round(F.col("median1") - F.col("median2"), 6).alias("effect"))


def _enriched(spark, d, limit=3):
    from pyspark.sql import Window

    out = S.benjamini_hochberg(U.compared_with_rest(_long(spark, d)), ["target"], tie=["feature"]).filter("q < 0.05 and median1 > median2")
    place = F.row_number().over(Window.partitionBy("target").orderBy("q", "feature"))
    return out.withColumn("place", place).filter(F.col("place") <= limit)


@query(
    "sec31_identity_card",
    f"""WITH {_AGAINST}, {Q.adjusted('mw', 'target', 'feature')}, e AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY q, feature) AS i FROM adj WHERE q < 0.05 AND m1 > m2),
    c AS (SELECT target, string_agg(feature, ';' ORDER BY i) AS names FROM e WHERE i <= 3 GROUP BY 1), n AS (SELECT g, count(*) AS n FROM g GROUP BY 1)
    SELECT n.g AS state, n, coalesce(names, 'none detected') AS names FROM n LEFT JOIN c ON target = n.g""",
)
def sec31(spark, d):
    card = _enriched(spark, d).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("place", "feature"))).alias("e"))  # three at most
    names = F.array_join(F.transform("e", lambda x: x["feature"].cast("string")), ";")
    sizes = _groups(spark, d).groupBy(F.col("group").alias("state")).agg(F.count("*").alias("n"))
    return sizes.join(card.select(F.col("target").alias("state"), names.alias("names")), "state", "left").na.fill("none detected", ["names"])


@query(
    "sec28_top_features",
    f"""WITH {_OMNIBUS}, s AS (SELECT feature, q FROM adj WHERE q < 0.05 ORDER BY round(q, 9), feature LIMIT 12)
    SELECT CAST(l.feature AS INTEGER) AS feature, g AS state, round(avg(x), 6) AS mean FROM l JOIN s USING (feature) GROUP BY 1, 2""",
)
def sec28(spark, d):
    long = _long(spark, d)
    top = U.numeric_omnibus(long).filter("q < 0.05").orderBy(F.round("q", 9), "feature").limit(12)  # the report's twelve
    return long.join(top.select("feature"), "feature", "left_semi").groupBy("feature", F.col("group").alias("state")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query("sta52_primary_numeric", f"WITH {_OMNIBUS} SELECT CAST(feature AS INTEGER) AS feature, CASE WHEN p IS NULL THEN 'not_testable' ELSE 'kruskal_wallis' END AS test, round(q, 6) AS q FROM adj")
def sta52(spark, d):
    out = U.numeric_omnibus(_long(spark, d))
    return out.select("feature", F.when(F.col("p").isNull(), "not_testable").otherwise("kruskal_wallis").alias("test"), F.round("q", 6).alias("q"))


_CORE = f"{_LONG}, co AS (SELECT feature, x, g < 4 AS f FROM l), {Q.two_samples('co', 'feature')}, {Q.adjusted('mw', '', 'feature')}"


def _core(spark, d):
    out = U.two_samples(_long(spark, d), ["feature"], F.col("group") < 4)
    return S.benjamini_hochberg(out, [], tie=["feature"])


@query("sta44_core_numeric", f"WITH {_CORE} SELECT CAST(feature AS INTEGER) AS feature, n1 AS core_n, n2 AS other_n, round(m1, 6) AS core_median, round(m2, 6) AS other_median, round(delta, 6) AS delta, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sta44(spark, d):
    out = _core(spark, d).select("feature", F.col("n1").alias("core_n"), F.col("n2").alias("other_n"), F.col("median1").alias("core_median"), F.col("median2").alias("other_median"), "delta", "p", "q")
    return _round(out, "core_median", "other_median", "delta", "p", "q")


@query(
    "sta53_proxies",
    f"""WITH {_SPEND}, co AS (SELECT 'spend' AS proxy, x, g IN ('BUILDING', 'MACHINERY') AS f FROM sp UNION ALL SELECT 'balance', c_acctbal, c_mktsegment IN ('BUILDING', 'MACHINERY') FROM customer),
    {Q.two_samples("co", "proxy")}, {Q.adjusted("mw", "", "proxy")} SELECT proxy, n1, n2, round(m1, 4) AS median1, round(m2, 4) AS median2, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sta53(spark, d):
    balance = table(spark, d, "customer").select(F.lit("balance").alias("feature"), F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("value"))
    rows = _spend(spark, d).unionByName(balance).withColumnRenamed("feature", "proxy")
    out = S.benjamini_hochberg(U.two_samples(rows, ["proxy"], F.col("group").isin("BUILDING", "MACHINERY")), [], tie=["proxy"])
    return _round(_round(out.drop("smd", "delta"), "p", "q"), "median1", "median2", places=4)


@query(
    "sta25_score_contrast",
    f"""WITH {_LONG}, s AS (SELECT 0 AS feature, a.node, a.g, a.x - b.x AS x FROM l a JOIN l b USING (node) WHERE a.feature = 0 AND b.feature = 1), {Q.kruskal("s", "feature")},
    pr AS (SELECT s.*, a.g AS ga, b.g AS gb, s.g = a.g AS f FROM s, (SELECT DISTINCT g FROM g) a, (SELECT DISTINCT g FROM g) b WHERE a.g < b.g AND s.g IN (a.g, b.g) AND (SELECT p FROM kw) < 0.05),
    x AS (WITH {Q.two_samples("pr", "ga, gb")}, {Q.adjusted("mw", "", "ga, gb", "holm", "ho", "p_holm")} SELECT * FROM ho)
    SELECT ga AS group_a, gb AS group_b, round(delta, 6) AS delta, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM x""",
)
def sta25(spark, d):
    scores = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), (F.get("embedding", F.lit(0)).cast("double") - F.get("embedding", F.lit(1)).cast("double")).alias("value"))
    long = scores.join(_groups(spark, d), "node").withColumn("feature", F.lit(0))
    out = S.holm(U.compared_pairs(long, U.numeric_omnibus(long).filter("p < 0.05")), [], tie=["group_a", "group_b"])
    return _round(out.select("group_a", "group_b", "delta", "p", "p_holm"), "delta", "p", "p_holm")


@query(
    "sta3_both_corrections",
    f"""WITH p AS (SELECT l_suppkey AS id, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE round(avg(l_discount) * 10 - 0.2, 6) / 2 END AS p FROM lineitem GROUP BY 1),
    {Q.adjusted("p", "", "id")}, {Q.adjusted("adj", "", "id", "holm", "ho", "p_holm")} SELECT id, p, round(q, 9) AS q, round(p_holm, 9) AS p_holm FROM ho""",
)
def sta3(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.round(F.avg("l_discount") * 10 - 0.2, 6) / 2).alias("p"))
    rows = rows.select("id", F.when(F.col("id") % 7 != 0, F.col("p")).alias("p"))
    return _round(S.holm(S.benjamini_hochberg(rows, [], tie=["id"]), [], tie=["id"]), "q", "p_holm", places=9)


REPEATS = 199
#: Cases with categorical variables: customers by segment; variable, value (null: missing).
_RECORDS = """cm AS (SELECT c_custkey AS key, c_mktsegment AS g, 'nation' AS variable, CAST(c_nationkey % 5 AS VARCHAR) AS v FROM customer UNION ALL
    SELECT c_custkey, c_mktsegment, 'standing', CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'even' ELSE 'rich' END FROM customer UNION ALL
    SELECT c_custkey, c_mktsegment, 'priority', max(o_orderpriority) FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1, 2)"""


def _records(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("group"), "c_nationkey", "c_acctbal")
    late = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("priority"))
    standing = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "even").otherwise("rich")
    wide = customer.join(late, "key", "left").select("key", "group", (F.col("c_nationkey") % 5).cast("string").alias("nation"), standing.alias("standing"), "priority")
    return wide.unpivot(["key", "group"], ["nation", "standing", "priority"], "variable", "value")


def _chi(keys, source, repeats=REPEATS):
    """CTEs that end in `ch`: keys, n, chi2, df, least, few, p_perm and p_pearson of rows (keys, key, g, v)."""
    on = f"USING ({keys}, rep)"
    return f"""mm AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY key) AS pos FROM {source} WHERE v IS NOT NULL),
    dd AS (SELECT {keys}, rep, key, v, row_number() OVER (PARTITION BY {keys}, rep ORDER BY md5(rep || '|' || key), key) AS pos FROM mm CROSS JOIN (SELECT CAST(range AS BIGINT) AS rep FROM range({repeats}))),
    ss AS (SELECT dd.* EXCLUDE (pos), mm.g FROM dd JOIN mm USING ({keys}, pos) UNION ALL BY NAME SELECT {keys}, CAST(-1 AS BIGINT) AS rep, key, v, g FROM mm),
    cn AS (SELECT {keys}, rep, g, v, count(*) AS o FROM ss GROUP BY ALL), cr AS (SELECT {keys}, rep, g, sum(o) AS r FROM cn GROUP BY ALL), cc AS (SELECT {keys}, rep, v, sum(o) AS c FROM cn GROUP BY ALL),
    ct AS (SELECT {keys}, rep, sum(o) AS t FROM cn GROUP BY ALL), ee AS (SELECT cr.*, v, r * c * 1.0 / t AS e, t FROM cr JOIN cc {on} JOIN ct {on}),
    xx AS (SELECT {keys}, rep, max(t) AS n, sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2, min(e) AS least, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0 END) AS few,
        (count(DISTINCT g) - 1) * (count(DISTINCT v) - 1) AS df FROM ee LEFT JOIN cn USING ({keys}, rep, g, v) GROUP BY ALL),
    oo AS (SELECT * FROM xx WHERE rep = -1), pp AS (SELECT {keys}, (count(CASE WHEN xx.chi2 >= oo.chi2 - 1e-9 THEN 1 END) + 1) / {repeats + 1.0} AS p_perm FROM xx JOIN oo USING ({keys}) WHERE xx.rep >= 0 GROUP BY ALL),
    ch AS (SELECT oo.* EXCLUDE (rep), p_perm, {Q.chi2_tail("chi2", "df")} AS p_pearson FROM oo JOIN pp USING ({keys}))"""


@query("sta21_categorical_omnibus", f"WITH {_RECORDS}, {_chi('variable', 'cm')}, z AS (SELECT variable, CAST(n AS BIGINT) AS n, chi2, p_perm AS p FROM ch WHERE df > 0), {Q.adjusted('z', '', 'variable')} SELECT variable, n, round(chi2, 6) AS chi2, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sta21(spark, d):
    rows = _records(spark, d).filter("value is not null")
    out = S.permuted_chi_square(rows, ["variable"], "key", "group", "value", REPEATS).filter("df > 0")
    return _round(S.benjamini_hochberg(out, [], tie=["variable"]).select("variable", "n", "chi2", "p", "q"), "chi2", "p", "q")


_CATEGORY_PAIRS = "cp AS (SELECT cm.*, a.g AS ga, b.g AS gb FROM cm, (SELECT DISTINCT g FROM cm) a, (SELECT DISTINCT g FROM cm) b WHERE a.g < b.g AND cm.g IN (a.g, b.g))"


@query(
    "sta22_categorical_pairs",
    f"""WITH {_RECORDS}, {_CATEGORY_PAIRS}, {_chi("variable, ga, gb", "cp")}, z AS (SELECT variable, ga, gb, CAST(n AS BIGINT) AS n, chi2, p_perm AS p FROM ch WHERE df > 0), {Q.adjusted("z", "variable", "ga, gb", "holm", "ho", "p_holm")}
    SELECT variable, ga AS group_a, gb AS group_b, n, round(chi2, 6) AS chi2, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM ho""",
)
def sta22(spark, d):
    rows = U.group_pairs(_records(spark, d).filter("value is not null"))
    out = S.permuted_chi_square(rows, ["variable", "group_a", "group_b"], "key", "group", "value", REPEATS).filter("df > 0")
    out = S.holm(out, ["variable"], tie=["group_a", "group_b"]).select("variable", "group_a", "group_b", "n", "chi2", "p", "p_holm")
    return _round(out, "chi2", "p", "p_holm")


@query(
    "sta24_missingness",
    f"""WITH {_RECORDS}, ms AS (SELECT key, g, variable, CASE WHEN v IS NULL THEN 'missing' ELSE 'known' END AS v FROM cm), {_chi("variable", "ms")}
    SELECT variable, round(chi2, 6) AS chi2, round(p_perm, 6) AS p FROM ch WHERE df > 0""",
)
def sta24(spark, d):
    rows = _records(spark, d).withColumn("value", F.when(F.col("value").isNull(), "missing").otherwise("known"))
    out = S.permuted_chi_square(rows, ["variable"], "key", "group", "value", REPEATS).filter("df > 0")
    return _round(out.select("variable", "chi2", "p"), "chi2", "p")


_SPARSE = f"""{_chi("variable", "cm")}, z AS (SELECT variable, chi2, CASE WHEN least < 1 OR few > 0.2 THEN 'monte_carlo_chi2' ELSE 'pearson_chi2' END AS test,
    CASE WHEN least < 1 OR few > 0.2 THEN p_perm ELSE p_pearson END AS p FROM ch WHERE df > 0)"""


@query("sta17_sparse_rule", f"WITH {_RECORDS}, {_SPARSE}, {Q.adjusted('z', '', 'variable')} SELECT variable, round(chi2, 6) AS chi2, test, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sta17(spark, d):
    out = _sparse_tests(spark, d)
    return _round(S.benjamini_hochberg(out, [], tie=["variable"]).select("variable", "chi2", "test", "p", "q"), "chi2", "p", "q")


def _sparse_tests(spark, d):
    rows = _records(spark, d).filter("value is not null")
    out = S.categorical_tests(rows, ["variable"], "key", "group", "value", U.dispersed(), REPEATS).filter("df > 0")
    return out.withColumn("test", F.when(F.col("method") == "permutation", "monte_carlo_chi2").otherwise("pearson_chi2"))


_NUMERIC = f"{_SPEND}, nu AS (SELECT 'spend' AS variable, g, x FROM sp UNION ALL SELECT 'balance', c_mktsegment, c_acctbal FROM customer), {Q.kruskal('nu', 'variable')}"


def _numeric(spark, d):
    balance = table(spark, d, "customer").select(F.lit("balance").alias("feature"), F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("value"))
    out = U.numeric_omnibus(_spend(spark, d).unionByName(balance))
    return out.select(F.col("feature").alias("variable"), F.lit("kruskal_wallis").alias("test"), "p")


_BOTH = f"WITH {_RECORDS}, {_NUMERIC}, {_SPARSE}, bo AS (SELECT variable, test, p FROM z UNION ALL SELECT variable, 'kruskal_wallis', p FROM kw), {Q.adjusted('bo', '', 'variable')} SELECT variable, test, round(p, 6) AS p, round(q, 6) AS q FROM adj"


@query("sec33_joint_family", _BOTH)
def sec33(spark, d):
    both = _sparse_tests(spark, d).select("variable", "test", "p").unionByName(_numeric(spark, d))
    return _round(S.benjamini_hochberg(both, [], tie=["variable"]), "p", "q")


@query(
    "sta27_confounders",
    f"""WITH {_RECORDS}, {_NUMERIC}, {_chi("variable", "cm")}, bo AS (SELECT variable, 'categorical' AS kind, CASE WHEN least < 5 THEN p_perm ELSE p_pearson END AS p FROM ch WHERE df > 0 UNION ALL
    SELECT variable, 'numeric', p FROM kw), {Q.adjusted("bo", "", "variable")} SELECT variable, kind, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sta27(spark, d):
    rows = _records(spark, d).filter("value is not null")
    own = S.categorical_tests(rows, ["variable"], "key", "group", "value", F.col("least_expected") < 5, REPEATS).filter("df > 0")
    both = own.select("variable", F.lit("categorical").alias("kind"), "p").unionByName(_numeric(spark, d).select("variable", F.lit("numeric").alias("kind"), "p"))
    return _round(S.benjamini_hochberg(both, [], tie=["variable"]), "p", "q")


@query(
    "sta33_clinical_suite",
    f"""WITH {_RECORDS}, {_NUMERIC}, {_chi("variable", "cm")}, bo AS (SELECT variable, p_perm AS p FROM ch WHERE df > 0 UNION ALL SELECT variable, p FROM kw WHERE variable = 'balance'),
    {Q.adjusted("bo", "", "variable")} SELECT variable, round(p, 6) AS p, round(q, 6) AS q, coalesce(q < 0.05, false) AS opens FROM adj""",
)
def sta33(spark, d):
    rows = _records(spark, d).filter("value is not null")
    own = S.permuted_chi_square(rows, ["variable"], "key", "group", "value", REPEATS).filter("df > 0").select("variable", "p")
    both = S.benjamini_hochberg(own.unionByName(_numeric(spark, d).filter("variable = 'balance'").select("variable", "p")), [], tie=["variable"])
    return _round(both.withColumn("opens", F.coalesce(F.col("q") < 0.05, F.lit(False))), "p", "q")


@query(
    "sta45_core_categorical",
    f"""WITH {_RECORDS}, cc2 AS (SELECT variable, v, count(CASE WHEN g IN ('BUILDING', 'MACHINERY') THEN 1 END) AS core_n, count(CASE WHEN g NOT IN ('BUILDING', 'MACHINERY') THEN 1 END) AS other_n FROM cm WHERE v IS NOT NULL GROUP BY 1, 2),
    co AS (SELECT key, variable, v, CASE WHEN g IN ('BUILDING', 'MACHINERY') THEN 'core' ELSE 'other' END AS g FROM cm), {_chi("variable", "co")},
    z AS (SELECT variable, CASE WHEN least < 1 OR few > 0.2 THEN p_perm ELSE p_pearson END AS p FROM ch WHERE df > 0), {Q.adjusted("z", "", "variable")},
    t AS (SELECT count(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 END) AS a, count(CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 1 END) AS b FROM customer)
    SELECT variable, v AS level, core_n, other_n, round(core_n * 1.0 / a, 6) AS core_share, round(other_n * 1.0 / b, 6) AS other_share, round(p, 6) AS p, round(q, 6) AS q FROM cc2 JOIN adj USING (variable), t""",
)
def sta45(spark, d):
    core = F.col("group").isin("BUILDING", "MACHINERY")
    records = _records(spark, d).withColumn("group", F.when(core, "core").otherwise("other"))
    rows = records.filter("value is not null")
    own = S.categorical_tests(rows, ["variable"], "key", "group", "value", U.dispersed(), REPEATS).filter("df > 0").select("variable", "p")
    own = S.benjamini_hochberg(own, [], tie=["variable"])
    n = lambda g: F.count_if(F.col("group") == g)
    whole = records.filter("variable = 'standing'").agg(n("core").alias("a"), n("other").alias("b"))
    levels = rows.groupBy("variable", F.col("value").alias("level")).agg(n("core").alias("core_n"), n("other").alias("other_n")).join(own, "variable").crossJoin(F.broadcast(whole))
    shares = {"core_share": F.round(F.col("core_n") / F.col("a"), 6), "other_share": F.round(F.col("other_n") / F.col("b"), 6)}
    return _round(levels.withColumns(shares).drop("a", "b"), "p", "q")


@query(
    "sta46_missing_as_level",
    f"""WITH {_RECORDS}, ms AS (SELECT key, variable, CASE WHEN g IN ('BUILDING', 'MACHINERY') THEN g ELSE 'other' END AS g, coalesce(v, 'missing') AS v FROM cm), {_chi("variable", "ms")}
    SELECT variable, round(chi2, 6) AS chi2, round(p_perm, 6) AS p FROM ch""",
)
def sta46(spark, d):
    group = F.when(F.col("group").isin("BUILDING", "MACHINERY"), F.col("group")).otherwise("other")
    rows = _records(spark, d).withColumn("group", group).na.fill("missing", ["value"])
    return _round(S.permuted_chi_square(rows, ["variable"], "key", "group", "value", REPEATS).select("variable", "chi2", "p"), "chi2", "p")


_LABELLED = """bl AS (SELECT doc_id AS key, lang AS g, 'quality' AS variable, quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, lang, 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    "sta19_binary_omnibus",
    f"""WITH {_LABELLED}, {_chi("variable", "bl")}, z AS (SELECT variable, CAST(n AS BIGINT) AS available, chi2, p_perm AS p FROM ch), {Q.adjusted("z", "", "variable")},
    w AS (SELECT variable, count(*) - count(v) AS missing, CAST(sum(v) AS BIGINT) AS altered FROM bl GROUP BY 1)
    SELECT variable AS feature, available, missing, altered, round(chi2, 6) AS chi2, round(p, 6) AS p, round(q, 6) AS q FROM adj JOIN w USING (variable)""",
)
def sta19(spark, d):
    """Missing isn't wild type: cases without a label are in no cell, and counted."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    long = rows.select(F.col("doc_id").alias("key"), F.col("lang").alias("group"), "quality", "toxic").unpivot(["key", "group"], ["quality", "toxic"], "feature", "value")
    own = S.permuted_chi_square(long.filter("value is not null"), ["feature"], "key", "group", "value", REPEATS)
    counts = long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.sum("value").alias("altered"))
    out = S.benjamini_hochberg(own, [], tie=["feature"]).join(counts, "feature")
    return _round(out.select("feature", F.col("n").alias("available"), "missing", "altered", "chi2", "p", "q"), "chi2", "p", "q")


_VECTORS = f"{_RUNS}, e AS (SELECT vec_id AS node, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _permanova_sql(keys, source, repeats=99):
    """CTEs that end in `pm`: keys, n, k, f, r2, p of rows (keys, node, g); the squares come from sums of vectors."""
    return f"""pl AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY node) AS pos FROM {source}),
    pd AS (SELECT {keys}, rep, node, row_number() OVER (PARTITION BY {keys}, rep ORDER BY md5(rep || '|' || node), node) AS pos FROM pl CROSS JOIN (SELECT CAST(range AS BIGINT) AS rep FROM range({repeats}))),
    ps AS (SELECT pd.* EXCLUDE (pos), pl.g FROM pd JOIN pl USING ({keys}, pos) UNION ALL BY NAME SELECT {keys}, CAST(-1 AS BIGINT) AS rep, node, g FROM pl),
    px AS (SELECT {keys}, rep, g, pos, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM ps JOIN (SELECT node, unnest(v) AS x, unnest(range(64)) AS pos FROM e) USING (node) GROUP BY ALL),
    pg AS (SELECT {keys}, rep, pos, sum(n) AS n, count(*) AS k, sum(q - s * s / n) AS w, sum(q) - sum(s) * sum(s) / sum(n) AS t FROM px GROUP BY ALL),
    pf AS (SELECT {keys}, rep, max(n) AS n, max(k) AS k, ((sum(t) - sum(w)) / (max(k) - 1)) / (sum(w) / (max(n) - max(k))) AS f, 1 - sum(w) / sum(t) AS r2 FROM pg GROUP BY ALL),
    pm AS (SELECT {keys}, CAST(any_value(o.n) AS BIGINT) AS n, any_value(o.k) AS k, any_value(o.f) AS f, any_value(o.r2) AS r2, (count(CASE WHEN pf.f >= o.f - 1e-9 THEN 1 END) + 1) / {repeats + 1.0} AS p
        FROM pf JOIN (SELECT * FROM pf WHERE rep = -1) o USING ({keys}) WHERE pf.rep >= 0 GROUP BY ALL)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _factors(spark, d):
    """Three factors of the cases: the labels of the table and of two partitions."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.lit("label").alias("factor"), F.col("label").alias("group"))
    runs = _runs(spark, d).filter("run < 2").select("node", F.concat(F.lit("run"), "run").alias("factor"), F.col("label").alias("group"))
    return labels.unionByName(runs.withColumn("group", F.col("group").cast("int")))


_FACTORS = "fa AS (SELECT node, 'label' AS factor, label AS g FROM (SELECT vec_id AS node, label FROM embeddings) UNION ALL SELECT node, 'run' || run, label FROM m WHERE run < 2)"


@query("sta28_permanova", f"WITH {_VECTORS}, {_FACTORS}, {_permanova_sql('factor', 'fa')}, {Q.adjusted('pm', '', 'factor')} SELECT factor, n, k, round(f, 6) AS f, round(r2, 6) AS r2, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def sta28(spark, d):
    rows = _factors(spark, d).join(_vectors(spark, d), "node")
    out = S.benjamini_hochberg(U.permanova(rows, ["factor"], "node", "group", "v", 64, 99), [], tie=["factor"])
    return _round(out, "f", "r2", "p", "q")


@query(
    "sta29_gated_permanova",
    f"""WITH {_VECTORS}, {_FACTORS}, gt AS (WITH {_permanova_sql("factor", "fa")}, {Q.adjusted("pm", "", "factor")} SELECT factor FROM adj WHERE q < 0.05),
    fp AS (SELECT fa.*, a.g AS ga, b.g AS gb FROM fa SEMI JOIN gt USING (factor) JOIN (SELECT DISTINCT factor, g FROM fa) a USING (factor) JOIN (SELECT DISTINCT factor, g FROM fa) b USING (factor)
        WHERE a.g < b.g AND fa.g IN (a.g, b.g)), x AS (WITH {_permanova_sql("factor, ga, gb", "fp")}, {Q.adjusted("pm", "factor", "ga, gb", "holm", "ho", "p_holm")} SELECT * FROM ho)
    SELECT factor, CAST(ga AS INTEGER) AS group_a, CAST(gb AS INTEGER) AS group_b, n, round(f, 6) AS f, round(r2, 6) AS r2, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM x""",
)
def sta29(spark, d):
    factors, vectors = _factors(spark, d), _vectors(spark, d)
    seen = S.benjamini_hochberg(U.permanova(factors.join(vectors, "node"), ["factor"], "node", "group", "v", 64, 99), [], tie=["factor"])
    seen = cut(seen.filter("q < 0.05").select("factor"))
    groups = factors.join(seen, "factor", "left_semi").select("factor", "group").distinct()
    pairs = groups.withColumnRenamed("group", "group_a").join(groups.withColumnRenamed("group", "group_b"), "factor").filter("group_a < group_b")
    rows = factors.join(F.broadcast(pairs), "factor").filter("group = group_a or group = group_b").join(vectors, "node")  # a row for each pair of groups
    out = U.permanova(rows, ["factor", "group_a", "group_b"], "node", "group", "v", 64, 99).drop("k")
    return _round(S.holm(out, ["factor"], tie=["group_a", "group_b"]), "f", "r2", "p", "p_holm")


@query(
    "sta32_taxonomy_enrichment",
    f"""WITH {_RUNS}, tx AS (SELECT a.node, a.label AS g, 'run' || b.run AS taxonomy, b.label AS level FROM m a JOIN m b USING (node) WHERE a.run = 0 AND b.run IN (1, 2)),
    ce AS (SELECT t.taxonomy, s.g AS grp, l.level AS level, count(CASE WHEN t.g = s.g AND t.level = l.level THEN 1 END) AS a, count(CASE WHEN t.g = s.g AND t.level <> l.level THEN 1 END) AS b,
        count(CASE WHEN t.g <> s.g AND t.level = l.level THEN 1 END) AS c, count(CASE WHEN t.g <> s.g AND t.level <> l.level THEN 1 END) AS d FROM tx t, (SELECT DISTINCT g FROM tx) s,
        (SELECT DISTINCT taxonomy, level FROM tx) l WHERE l.taxonomy = t.taxonomy GROUP BY ALL), z AS (SELECT *, {Q.fisher("a", "b", "c", "d")} AS p FROM ce), {Q.adjusted("z", "taxonomy", "grp, level")}
    SELECT taxonomy, grp, level, a, round(a * 1.0 / (a + b), 6) AS share, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sta32(spark, d):
    runs = _runs(spark, d)
    rows = _groups(spark, d).join(runs.filter("run in (1, 2)").select("node", F.concat(F.lit("run"), "run").alias("taxonomy"), F.col("label").alias("level")), "node")
    n = rows.groupBy("taxonomy", F.col("group").alias("grp"), "level").agg(F.count("*").alias("a"))
    by = n.groupBy("taxonomy", "grp").agg(F.sum("a").alias("r"))
    col = n.groupBy("taxonomy", "level").agg(F.sum("a").alias("s"))
    all_ = n.groupBy("taxonomy").agg(F.sum("a").alias("t"))
    grid = by.join(col, "taxonomy").join(all_, "taxonomy").join(n, ["taxonomy", "grp", "level"], "left").na.fill(0, ["a"])
    cells = grid.select("taxonomy", "grp", "level", "a", (F.col("r") - F.col("a")).alias("b"), (F.col("s") - F.col("a")).alias("c"), (F.col("t") - F.col("r") - F.col("s") + F.col("a")).alias("d"))
    out = S.benjamini_hochberg(cells.withColumn("p", special.fisher_p("a", "b", "c", "d")), ["taxonomy"], tie=["grp", "level"])
    share = F.round(F.col("a") / (F.col("a") + F.col("b")), 6)
    return _round(out.select("taxonomy", "grp", "level", "a", share.alias("share"), "p", "q"), "p", "q")
