"""Queries: variants of the audits with other references, boundaries and factors (2.4, 2.5, 2.8 and 2.11b)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import matrices as M
from tessera.operators import models as L
from tessera.operators import partitions as P
from tessera.operators import statistics as S
from tessera.operators import suites as U
from tessera.plans import sqltext as Q
from tessera.plans.images import _PIXELS, _pixels
from tessera.plans.partitions import _BASKET, _joint_means
from tessera.plans.registry import query, table
from tessera.plans.suites import _CELLS, _LONG, _NUMERIC, _PAIRS, _RECORDS, _REST, REPEATS, _chi, _long, _permanova_sql, _records, _round, _spend, _vectors


@query("agg22_intersections", f"WITH RECURSIVE {_BASKET}, b AS (SELECT list_sort(list(node)) AS m FROM s GROUP BY set), c(m) AS (SELECT DISTINCT m FROM b UNION SELECT list_sort(list_intersect(c.m, b.m)) FROM c, b) SELECT DISTINCT array_to_string(c.m, ',') AS members, len(c.m) AS size FROM c WHERE len(m) >= 1")
def agg22(spark, d):
    """All intersections of the observed sets, with their sizes."""
    mean = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("x"))
    levels = mean.withColumn("lv", F.explode(F.array(F.lit(4000), F.lit(4500), F.lit(5000)))).filter("x > lv")
    s = levels.select(F.concat("c_mktsegment", F.col("lv").cast("string")).alias("set"), F.col("c_nationkey").alias("node"))
    return P.closed_sets(s, 1).select(F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("size"))


_DRAWS = """e AS (SELECT vec_id AS node, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IN (0, 1)), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY node) - 1 AS pos, count(*) OVER (PARTITION BY label) AS size FROM e),
    dr AS (SELECT DISTINCT rep, label, CAST('0x' || left(md5(rep || '|' || label || '|' || pos), 8) AS BIGINT) % size AS pos FROM o CROSS JOIN (SELECT CAST(range AS BIGINT) AS rep FROM range(99)) UNION ALL SELECT -1, label, pos FROM o),
    dn AS (SELECT rep, o.label, o.node, o.v FROM dr JOIN o USING (label, pos)), w AS (SELECT * FROM (VALUES (0), (1)) t(view)),
    u AS (SELECT rep, view, label, node, list_slice(v, view * 32 + 1, view * 32 + 32) AS v FROM dn, w), n AS (SELECT rep, view, label, node, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u)"""


@query(
    "mat16_boundary_bootstrap",
    f"""WITH {_DRAWS}, p AS (SELECT a.rep, a.view, a.node, avg(CASE WHEN a.label = b.label THEN list_dot_product(a.v, b.v) END) - avg(CASE WHEN a.label <> b.label THEN list_dot_product(a.v, b.v) END) AS m
        FROM n a JOIN n b ON a.rep = b.rep AND a.view = b.view AND a.node <> b.node GROUP BY ALL), q AS (SELECT rep, median(CASE WHEN view = 0 THEN m END) - median(CASE WHEN view = 1 THEN m END) AS gap FROM p GROUP BY 1)
    SELECT round(max(CASE WHEN rep = -1 THEN gap END), 6) AS gap, round(quantile_cont(gap, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(gap, 0.975) FILTER (rep >= 0), 6) AS high FROM q""",
)
def mat16(spark, d):
    """The difference of the median margins of two groups in two views, with its interval over draws of the groups: margins come from sums of vectors."""
    e = table(spark, d, "embeddings").filter("label in (0, 1)").select(F.col("vec_id").alias("node"), F.col("label").alias("group"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    views = [e.select("node", "group", F.lit(k).alias("view"), F.slice("v", 32 * k + 1, 32).alias("v")) for k in (0, 1)]
    rows = M.unit_rows(views[0].unionByName(views[1]), "v")
    drawn = M.drawn_members(e.select("node", "group"), "group", "node", 99).unionByName(e.select(F.lit(-1).cast("long").alias("rep"), "group", "node"))
    gaps = M.margins(drawn.join(rows, ["group", "node"]), ["rep", "view"], "group", "v", 32).groupBy("rep")
    gap = gaps.agg((F.median(F.when(F.col("view") == 0, F.col("margin"))) - F.median(F.when(F.col("view") == 1, F.col("margin")))).alias("gap"))
    q = F.percentile(F.when(F.col("rep") >= 0, F.col("gap")), F.array(F.lit(0.025), F.lit(0.975)))
    out = gap.agg(F.max(F.when(F.col("rep") == -1, F.col("gap"))).alias("gap"), q.alias("q"))
    return out.select(F.round("gap", 6).alias("gap"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@query("img7_masked_patches", f"WITH {_PIXELS} SELECT slice, y // 4 AS row, x // 4 AS col, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END), 6) AS share FROM px GROUP BY ALL HAVING avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) >= 0.5")
def img7b(spark, d):
    """Patches of a grid of which half or more lies in the mask."""
    p = _pixels(spark, d).groupBy("slice", F.floor(F.col("y") / 4).cast("int").alias("row"), F.floor(F.col("x") / 4).cast("int").alias("col"))
    return p.agg(F.avg((F.col("v") > 0).cast("double")).alias("share")).filter("share >= 0.5").withColumn("share", F.round("share", 6))


@query("img5_mask_geometry", "SELECT l_orderkey, count(*) = any_value(n) AS same_geometry, bool_and(l_quantity > 0) AS positive, count(*) = any_value(n) AND bool_and(l_quantity > 0) AS pass FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 AS n FROM lineitem GROUP BY 1) USING (l_orderkey) GROUP BY 1")
def img5b(spark, d):
    """A mask has the volume's geometry (no line is missing) and positive voxels."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") == F.max("l_linenumber") - F.min("l_linenumber") + 1).alias("same_geometry"), F.bool_and(F.col("l_quantity") > 0).alias("positive"))
    return x.withColumn("pass", F.col("same_geometry") & F.col("positive"))


@query(
    "sta30_acquisition_factors",
    f"""WITH e AS (SELECT vec_id AS node, list_transform(list_slice(embedding, 1, 16), lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), fa AS (SELECT vec_id AS node, 'scanner' AS factor, CAST(vec_id % 3 AS INTEGER) AS g FROM embeddings UNION ALL SELECT vec_id, 'label', label FROM embeddings),
    {_permanova_sql("factor", "fa").replace("range(64)", "range(16)")}, {Q.adjusted("pm", "", "factor")} SELECT factor, n, k, round(f, 6) AS f, round(r2, 6) AS r2, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sta30(spark, d):
    """PERMANOVA of one view by factors of its acquisition."""
    e = table(spark, d, "embeddings")
    factors = e.select(F.col("vec_id").alias("node"), F.lit("scanner").alias("factor"), (F.col("vec_id") % 3).cast("int").alias("group")).unionByName(e.select(F.col("vec_id").alias("node"), F.lit("label").alias("factor"), F.col("label").alias("group")))
    rows = factors.join(_vectors(spark, d).select("node", F.slice("v", 1, 16).alias("v")), "node")
    return _round(S.benjamini_hochberg(U.permanova(rows, ["factor"], "node", "group", "v", 16, 99), [], tie=["factor"]), "f", "r2", "p", "q")


@query("sta37_hazards_test")
def sta37(spark, d):
    """Customers' time between first and last order: the effect of the building segment, and whether it is proportional."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("event"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("days", "event", (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"))
    return spark.createDataFrame([tuple(L.hazards_test(rows, "days", "event", "building", 0.01).values())], "beta double, se double, chi2 double, p double")


@query(
    "sta41_two_references",
    f"""WITH {_LONG}, rf AS (SELECT 'all' AS reference, * FROM l UNION ALL SELECT 'core', * FROM l WHERE g < 4), rs AS (SELECT rf.*, o.g AS target, rf.g = o.g AS f FROM rf, (SELECT DISTINCT reference, g FROM rf) o WHERE o.reference = rf.reference),
    {_CELLS.format(keys="reference, feature, target", source="rs")}, {Q.adjusted("bt", "reference, target", "feature")}
    SELECT reference, CAST(feature AS INTEGER) AS feature, target, round(difference, 6) AS difference, round(p, 6) AS p, round(q, 6) AS q FROM adj""",
)
def sta41(spark, d):
    """Binary features of each group against the rest of all cases and of the core cases; a family for each group and reference."""
    long = _long(spark, d)
    rows = long.withColumn("reference", F.lit("all")).unionByName(long.filter("group < 4").withColumn("reference", F.lit("core")))
    targets = rows.select("reference", F.col("group").alias("target")).distinct()
    cells = U.binary_cells(rows.join(F.broadcast(targets), "reference"), ["reference", "feature", "target"], F.col("group") == F.col("target"))  # a row for each group
    out = S.benjamini_hochberg(U.binary_tests(cells), ["reference", "target"], tie=["feature"])
    return _round(out.select("reference", "feature", "target", "difference", "p", "q"), "difference", "p", "q")


@query(
    "sec6_rest_and_pairs",
    f"""WITH {_LONG}, {_PAIRS}, {_REST}, a AS (WITH {Q.two_samples("rs", "feature, target")}, {Q.adjusted("mw", "target", "feature")} SELECT 'rest' AS kind, target AS a, CAST(NULL AS INTEGER) AS b, feature, smd, q FROM adj),
    b AS (WITH {Q.two_samples("pr", "feature, ga, gb")}, {Q.adjusted("mw", "ga, gb", "feature")} SELECT 'pair' AS kind, ga AS a, gb AS b, feature, smd, q FROM adj)
    SELECT kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(feature AS INTEGER) AS feature, round(smd, 6) AS smd, round(q, 6) AS q FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def sec6(spark, d):
    """The effects of each feature, of each group against the rest and of all pairs, in one table."""
    long = _long(spark, d)
    rest = S.benjamini_hochberg(U.compared_with_rest(long), ["target"], tie=["feature"])
    pair = S.benjamini_hochberg(U.compared_pairs(long), ["group_a", "group_b"], tie=["feature"])
    one = rest.select(F.lit("rest").alias("kind"), F.col("target").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "feature", "smd", "q")
    two = pair.select(F.lit("pair").alias("kind"), F.col("group_a").cast("long").alias("a"), F.col("group_b").cast("long").alias("b"), "feature", "smd", "q")
    return _round(one.unionByName(two), "smd", "q")


@query(
    "sec32_quality_proxies",
    f"""WITH {_RECORDS}, {_NUMERIC}, {_chi("variable", "cm")} SELECT variable, 'monte_carlo_chi2' AS test, round(sqrt(chi2 / n / 4), 6) AS effect, round(p_perm, 6) AS p FROM ch WHERE variable = 'nation'
    UNION ALL SELECT variable, 'kruskal_wallis', round(epsilon2, 6), round(p, 6) FROM kw""",
)
def sec32(spark, d):
    """Proxies of quality: a permuted table with Cramer's V, and rank tests with epsilon squared."""
    rows = _records(spark, d).filter("variable = 'nation'")
    own = S.permuted_chi_square(rows, ["variable"], "key", "group", "value", REPEATS).select("variable", F.lit("monte_carlo_chi2").alias("test"), F.col("v").alias("effect"), "p")
    balance = table(spark, d, "customer").select(F.lit("balance").alias("feature"), F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("value"))
    ranks = U.numeric_omnibus(_spend(spark, d).unionByName(balance)).select(F.col("feature").alias("variable"), F.lit("kruskal_wallis").alias("test"), F.col("epsilon2").alias("effect"), "p")
    return _round(own.unionByName(ranks), "effect", "p")


@query(
    "sec22_two_models",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
    md AS (SELECT 'cores' AS model, vec_id, label AS g, v, n FROM u UNION ALL SELECT 'states', vec_id, label // 5, v, n FROM u),
    p AS MATERIALIZED (SELECT a.model, a.vec_id AS i, a.g AS own, b.g AS g, avg(1 - list_dot_product(a.v, b.v) / (a.n * b.n)) AS m FROM md a JOIN md b ON a.model = b.model AND a.vec_id <> b.vec_id GROUP BY ALL),
    s AS (SELECT model, i, max(CASE WHEN own = g THEN m END) AS a, min(CASE WHEN own <> g THEN m END) AS b FROM p GROUP BY ALL) SELECT model, round(median((b - a) / greatest(a, b)), 6) AS silhouette FROM s GROUP BY 1""",
)
def sec22(spark, d):
    """The median silhouette of the cases by cores (labels) and by states (five labels each)."""
    e = table(spark, d, "embeddings")
    models = {"cores": F.col("label"), "states": F.floor(F.col("label") / 5).cast("int")}
    rows = [M.silhouette_of(M.cosine_group_means(e.withColumn("g", g), "vec_id", "embedding", "g")).agg(F.round(F.median("s"), 6).alias("silhouette")).withColumn("model", F.lit(name)) for name, g in models.items()]
    return rows[0].unionByName(rows[1])


@query("sec25_hierarchy_rows")
def sec25(spark, d):
    """The labels cut into two by both linkages of their mean coassignment."""
    means = _joint_means(spark, d).filter("g <> h").select(F.lit(0).alias("one"), F.col("g").alias("i"), F.col("h").alias("j"), F.col("mean").alias("value"))

    def one(frame):
        nodes = sorted(set(frame["i"]) | set(frame["j"]))
        near = P.square(frame, nodes, 0.0, 1.0)
        rows = [(m, int(n), int(c), int(n) // 5) for m in ("average", "complete") for n, c in zip(nodes, P.linkage_cut(1 - near, clusters=2, method=m), strict=True)]
        return pd.DataFrame(rows, columns=["linkage", "core", "cluster", "state"])

    return means.groupBy("one").applyInPandas(one, "linkage string, core int, cluster int, state int")


@query("sec42_consensus_with_zeros")
def sec42(spark, d):
    """Resampled consensus over few draws, where pairs that no draw has together are 0 instead of an error."""
    from tessera.plans.consensus import cohort_views

    cases, views = cohort_views(spark, d)
    out = P.resampled_consensus(spark, views, (2,), 3, unseen=0.0)
    names = spark.createDataFrame(pd.DataFrame({"pos": range(len(cases)), "node": cases}), "pos long, node long")
    return out.join(names.toDF("i", "ni"), "i").join(names.toDF("j", "nj"), "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "seen", F.round("value", 9).alias("value"))


@query("sec43_transformed_features")
def sec43(spark, d):
    """Features that pruning keeps, with mean 0 and deviation 1 over all cases; constant ones are dropped."""
    e = table(spark, d, "embeddings")
    r, sd = L.correlations(e, "embedding")
    kept = [i for i in range(len(sd)) if sd[i] > 0]
    names = {f"e{i:02d}": i for i in kept}
    chosen = [names[n] for n in L.prune_by(list(names), r[kept][:, kept], 0.08)]
    return M.z_rows(e.select("vec_id", F.array(*[F.get("embedding", F.lit(i)) for i in chosen]).alias("v")), "vec_id", "v")


@query("sec48_bootstrap_by_group")
def sec48(spark, d):
    """Cliff's delta of the building segment against the others with its bootstrap interval, for each nation; a nation's customers meet in a task."""
    import numpy as np

    def one(key, frame):
        own = frame["c_mktsegment"] == "BUILDING"
        a, b = np.sort(frame.loc[own, "c_acctbal"].to_numpy()), np.sort(frame.loc[~own, "c_acctbal"].to_numpy())
        if not len(a) or not len(b):
            return pd.DataFrame([(key[0], None, None, None)], columns=["c_nationkey", "delta", "low", "high"])
        delta = lambda x, y: float((np.searchsorted(y, x, "left").sum() - (len(y) - np.searchsorted(y, x, "right")).sum()) / len(x) / len(y))
        r = np.random.default_rng([7, int(key[0])])
        drawn = [delta(r.choice(a, len(a)), np.sort(r.choice(b, len(b)))) for _ in range(999)]
        return pd.DataFrame([(key[0], delta(a, b), *np.quantile(drawn, (0.025, 0.975)))], columns=["c_nationkey", "delta", "low", "high"])

    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal").groupBy("c_nationkey").applyInPandas(one, "c_nationkey int, delta double, low double, high double")


_SUPPLY = """ch AS (SELECT l_suppkey AS case_id, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), cs AS (SELECT DISTINCT case_id FROM ch), ft AS (SELECT DISTINCT feature FROM ch),
    dn AS (SELECT case_id, feature, log2(coalesce(value, 0) + 1) AS x FROM cs CROSS JOIN ft LEFT JOIN ch USING (case_id, feature))"""


def _supply(spark, d):
    from tessera.operators import relational as R

    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    long = rows.groupBy(F.col("l_suppkey").alias("case_id"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return long, R


@query(
    "mat25_top_mad_distance",
    f"""WITH {_SUPPLY}, m AS (SELECT feature, median(x) AS m FROM dn GROUP BY 1), s AS (SELECT feature, median(abs(x - m)) AS mad FROM dn JOIN m USING (feature) GROUP BY 1), tp AS (SELECT feature FROM s ORDER BY round(mad, 9) DESC, feature LIMIT 10),
    z AS (SELECT case_id, feature, x - avg(x) OVER (PARTITION BY case_id) AS x FROM dn SEMI JOIN tp USING (feature)), n AS (SELECT case_id, sqrt(sum(x * x)) AS n FROM z GROUP BY 1)
    SELECT a.case_id AS i, b.case_id AS j, round(1 - sum(a.x * b.x) / (any_value(p.n) * any_value(q.n)), 6) AS value FROM z a JOIN z b ON a.feature = b.feature AND a.case_id < b.case_id JOIN n p ON p.case_id = a.case_id JOIN n q ON q.case_id = b.case_id
    WHERE p.n > 0 AND q.n > 0 GROUP BY 1, 2""",
)
def mat25(spark, d):
    """Correlation distances of the cases over their ten most variable features."""
    long, R = _supply(spark, d)
    top = R.mad_features(long, 0.0, 0.0, 10).select("feature")
    wide = R.dense(long).join(F.broadcast(top), "feature", "left_semi")  # ten features
    rows = wide.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", F.log2(F.col("value") + 1).alias("x")))), lambda e: e["x"]).alias("v"))
    return _round(M.pairs(rows, "case_id", "v", "correlation"), "value")


@query(
    "sec7_set_scores",
    f"""WITH {_SUPPLY}, gs(name, feature) AS (SELECT 'low', 'Brand#' || range FROM range(1, 9) UNION ALL SELECT 'high', 'Brand#' || range FROM range(15, 26) UNION ALL SELECT 'alone', 'Brand#1'),
    ok AS (SELECT name FROM gs SEMI JOIN ft USING (feature) GROUP BY 1 HAVING count(*) >= 3), rk AS (SELECT case_id, feature, rank() OVER (PARTITION BY case_id ORDER BY x) + (count(*) OVER (PARTITION BY case_id, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY case_id) AS n FROM dn)
    SELECT name, case_id, round(avg(r / n), 6) AS score FROM rk JOIN gs USING (feature) SEMI JOIN ok USING (name) GROUP BY 1, 2""",
)
def sec7(spark, d):
    """Scores of feature sets in each case, the mean of their ranks; sets of which fewer than three features are there are left out."""
    long, R = _supply(spark, d)
    sets = [("low", f"Brand#{i}") for i in range(1, 9)] + [("high", f"Brand#{i}") for i in range(15, 26)] + [("alone", "Brand#1")]
    gs = spark.createDataFrame(sets, "name string, feature string")
    there = gs.join(long.select("feature").distinct(), "feature", "left_semi").groupBy("name").agg(F.count("*").alias("n")).filter("n >= 3")
    dense = R.dense(long).withColumn("x", F.log2(F.col("value") + 1))
    ranks = M.average_ranks(dense, ["case_id"], "x")
    n = long.agg(F.count_distinct("feature").alias("n"))
    x = ranks.join(F.broadcast(gs), "feature").join(F.broadcast(there.select("name")), "name", "left_semi").crossJoin(F.broadcast(n))  # the sets
    return x.groupBy("name", "case_id").agg(F.round(F.avg(F.col("rank") / F.col("n")), 6).alias("score"))


@query(
    "sec18_mapping_by_confidence",
    """WITH t AS (SELECT label AS state, (vec_id // 7) % 3 AS reference, abs(embedding[1]) * 5 AS confidence FROM embeddings), c AS (SELECT unnest([0.0, 0.6, 0.8]) AS least),
    n AS (SELECT least, state, reference, count(*) AS n FROM t, c WHERE confidence >= least GROUP BY ALL) SELECT CAST(least AS DOUBLE) AS least, state, reference, n, round(n * 100.0 / sum(n) OVER (PARTITION BY least, state), 6) AS row_pct FROM n""",
)
def sec18(spark, d):
    """States against reference labels, for all cases and for those whose label is sure enough."""
    e = table(spark, d, "embeddings")
    t = e.select(F.col("label").alias("state"), (F.floor(F.col("vec_id") / 7) % 3).alias("reference"), (F.abs(F.get("embedding", F.lit(0))) * 5).alias("confidence"))
    rows = t.withColumn("least", F.explode(F.array(F.lit(0.0), F.lit(0.6), F.lit(0.8)))).filter("confidence >= least")
    n = rows.groupBy("least", "state", "reference").agg(F.count("*").alias("n"))
    whole = n.groupBy("least", "state").agg(F.sum("n").alias("t"))
    return n.join(whole, ["least", "state"]).select("least", "state", "reference", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).alias("row_pct"))


@query(
    "sec19_core_reference",
    f"""WITH t AS (SELECT label AS core, (vec_id // 7) % 3 AS reference FROM embeddings), ce AS (SELECT c.core, r.reference, count(CASE WHEN t.core = c.core AND t.reference = r.reference THEN 1 END) AS a, count(CASE WHEN t.core = c.core AND t.reference <> r.reference THEN 1 END) AS b,
        count(CASE WHEN t.core <> c.core AND t.reference = r.reference THEN 1 END) AS c, count(CASE WHEN t.core <> c.core AND t.reference <> r.reference THEN 1 END) AS d FROM t, (SELECT DISTINCT core FROM t) c, (SELECT DISTINCT reference FROM t) r GROUP BY ALL),
    z AS (SELECT *, {Q.fisher("a", "b", "c", "d")} AS p FROM ce), {Q.adjusted("z", "", "core, reference")}
    SELECT core, reference, a, round(p, 6) AS p, round(q, 6) AS q, CASE WHEN a < 5 THEN 'low' WHEN q < 0.05 THEN 'enriched' ELSE 'none' END AS status FROM adj""",
)
def sec19(spark, d):
    """Reference labels in each core against the other cores, with the status that they give."""
    from tessera.functions import special

    e = table(spark, d, "embeddings")
    t = e.select(F.col("label").alias("core"), (F.floor(F.col("vec_id") / 7) % 3).alias("reference"))
    n = t.groupBy("core", "reference").agg(F.count("*").alias("a"))
    by, col, all_ = n.groupBy("core").agg(F.sum("a").alias("r")), n.groupBy("reference").agg(F.sum("a").alias("s")), n.agg(F.sum("a").alias("t"))
    grid = by.crossJoin(F.broadcast(col)).crossJoin(F.broadcast(all_)).join(n, ["core", "reference"], "left").na.fill(0, ["a"])  # a row for each label
    cells = grid.withColumns({"b": F.col("r") - F.col("a"), "c": F.col("s") - F.col("a"), "d": F.col("t") - F.col("r") - F.col("s") + F.col("a")})
    out = S.benjamini_hochberg(cells.withColumn("p", special.fisher_p("a", "b", "c", "d")), [], tie=["core", "reference"])
    status = F.when(F.col("a") < 5, "low").when(F.col("q") < 0.05, "enriched").otherwise("none")
    return _round(out.select("core", "reference", "a", "p", "q").withColumn("status", status), "p", "q")


@query(
    "sec10_confounder_union",
    f"""WITH {_RECORDS}, w AS (WITH {_chi("variable", "cm")} SELECT 'all' AS scope, variable, chi2, p_perm AS p FROM ch WHERE df > 0), co AS (SELECT g AS target, variable, key, CASE WHEN cm.g = t.g2 THEN 'in' ELSE 'out' END AS g, v, t.g2 AS scope FROM cm, (SELECT DISTINCT g AS g2 FROM cm) t),
    k AS (WITH {_chi("scope, variable", "co")} SELECT scope, variable, chi2, p_perm AS p FROM ch WHERE df > 0) SELECT scope, variable, round(chi2, 6) AS chi2, round(p, 6) AS p FROM (SELECT * FROM w UNION ALL SELECT * FROM k)""",
)
def sec10(spark, d):
    """The confounder tests over all groups, and of each group against the rest, in one table."""
    rows = _records(spark, d).filter("value is not null")
    whole = S.permuted_chi_square(rows, ["variable"], "key", "group", "value", REPEATS).filter("df > 0").select(F.lit("all").alias("scope"), "variable", "chi2", "p")
    each = U.against_rest(rows).withColumn("group", F.when(F.col("group") == F.col("target"), "in").otherwise("out"))
    own = S.permuted_chi_square(each, ["target", "variable"], "key", "group", "value", REPEATS).filter("df > 0").select(F.col("target").alias("scope"), "variable", "chi2", "p")
    return _round(whole.unionByName(own), "chi2", "p")
