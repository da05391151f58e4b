"""Queries: joins, aggregation, ranking, top-k and set operations (2.3 and 2.4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import COHORT, cohort, query, table


@query(
    "agg1_mad_features",
    f"""WITH {COHORT}, cases AS (SELECT DISTINCT case_id FROM cohort), feats AS (SELECT DISTINCT feature FROM cohort),
    dense AS (SELECT case_id, feature, coalesce(value, 0) AS value FROM cases CROSS JOIN feats LEFT JOIN cohort USING (case_id, feature)),
    kept AS (SELECT feature, avg(CASE WHEN value >= 1 THEN 1.0 ELSE 0 END) AS prevalence FROM dense GROUP BY 1 HAVING avg(CASE WHEN value >= 1 THEN 1.0 ELSE 0 END) >= 0.2),
    m AS (SELECT feature, median(log2(value + 1)) AS m FROM dense GROUP BY 1),
    s AS (SELECT feature, prevalence, median(abs(log2(value + 1) - m)) AS mad FROM dense JOIN m USING (feature) JOIN kept USING (feature) GROUP BY 1, 2)
    SELECT feature, round(prevalence, 9) AS prevalence, round(mad, 9) AS mad, row_number() OVER (ORDER BY round(mad, 9) DESC, feature) AS rank FROM s""",
)
def agg1(spark, d):
    return R.mad_features(cohort(spark, d), 1.0, 0.2).withColumn("prevalence", F.round("prevalence", 9)).withColumn("mad", F.round("mad", 9))


@query(
    "agg2_mutation_matrix",
    """WITH p AS (SELECT DISTINCT l_suppkey AS case_id, p_brand AS feature FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_brand <> ''),
    k AS (SELECT feature FROM p GROUP BY 1 HAVING count(*) * 1.0 / (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'R') >= 0.05) SELECT case_id, feature FROM p JOIN k USING (feature)""",
)
def agg2(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return R.one_hot(rows, "l_suppkey", "p_brand", 0.05)


@query("agg5_prevalence", f"WITH {COHORT} SELECT feature, round(count(CASE WHEN value >= 40 THEN 1 END) * 1.0 / (SELECT count(DISTINCT case_id) FROM cohort), 9) AS prevalence FROM cohort GROUP BY 1 HAVING count(CASE WHEN value >= 40 THEN 1 END) * 1.0 / (SELECT count(DISTINCT case_id) FROM cohort) >= 0.3")
def agg5(spark, d):
    long = cohort(spark, d)
    n = long.select("case_id").distinct().count()
    return R.feature_summary(long, F.lit(n), 40.0).filter("prevalence >= 0.3").withColumn("prevalence", F.round("prevalence", 9))


@query(
    "agg6_series_summary",
    """WITH g AS (SELECT user_id, event_type, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, round(median(value), 6) AS median_value, max(gap) AS max_gap, median(gap) AS median_gap, count(*) AS n FROM g GROUP BY 1""",
)
def agg6(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("user_id", "event_type", "value", (ms - F.lag(ms).over(w)).alias("gap"))
    return rows.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.round(F.median("value"), 6).alias("median_value"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"), F.count("*").alias("n"))


@query("agg7_best_series", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, -o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def agg7(spark, d):
    best = F.min_by("o_orderkey", F.struct("o_orderpriority", -F.col("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query("agg8_rank_key", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END, CAST('Infinity' AS DOUBLE)) AS key FROM part")
def agg8(spark, d):
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("double")), F.lit(float("inf"))).alias("key"))


@query(
    "agg9_phase_inference",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    d AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN pos END) AS first_del FROM e GROUP BY 1),
    n AS (SELECT e.user_id, max(CASE WHEN event_type = 'signup' AND (first_del IS NULL OR pos < first_del) THEN pos END) AS last_nc, any_value(first_del) AS first_del FROM e JOIN d USING (user_id) GROUP BY 1)
    SELECT event_id, CASE WHEN first_del IS NOT NULL AND pos > last_nc AND pos < first_del AND event_type = 'view' THEN 'MAIN_CE_HIGH' ELSE event_type END AS phase FROM e JOIN n USING (user_id)""",
)
def agg9(spark, d):
    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.row_number().over(w.orderBy("ts", "event_id")).alias("pos"))
    rows = rows.withColumn("first_del", F.min(F.when(F.col("event_type") == "purchase", F.col("pos"))).over(w))
    early = (F.col("event_type") == "signup") & (F.col("first_del").isNull() | (F.col("pos") < F.col("first_del")))
    rows = rows.withColumn("last_nc", F.max(F.when(early, F.col("pos"))).over(w))
    inside = F.col("first_del").isNotNull() & (F.col("pos") > F.col("last_nc")) & (F.col("pos") < F.col("first_del")) & (F.col("event_type") == "view")
    return rows.select("event_id", F.when(inside, "MAIN_CE_HIGH").otherwise(F.col("event_type")).alias("phase"))


@query("agg10_best_slide", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_quantity DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def agg10(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    order = [F.when(F.col("l_returnflag") == "N", 0).otherwise(1), F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return R.best_row(rows, ["l_orderkey"], order).select("l_orderkey", "l_linenumber")


@query(
    "agg11_middle_slices",
    """WITH p AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT event_id, user_id FROM p WHERE i >= floor(n * 0.25) AND i < n - floor(n * 0.25)""",
)
def agg11(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    return R.middle(rows, "user_id", [F.col("ts"), F.col("event_id")], 0.5).select("event_id", "user_id")


@query(
    "agg12_participants",
    "SELECT user_id, count(*) AS n, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_type, row_number() OVER (ORDER BY user_id) AS number FROM events GROUP BY 1",
)
def agg12(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    return rows.withColumn("number", F.row_number().over(Window.orderBy("user_id")).cast("long"))


@query(
    "agg13_every_kth",
    """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT user_id, round(avg(CASE WHEN value > 1 THEN value END), 6) AS mean_value, count(CASE WHEN value > 1 THEN NULL ELSE 1 END) AS invalid FROM p WHERE i % 4 = 0 GROUP BY 1""",
)
def agg13(spark, d):
    rows = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).filter("i % 4 = 0")
    good = F.col("value") > 1
    return rows.groupBy("user_id").agg(F.round(F.avg(F.when(good, F.col("value"))), 6).alias("mean_value"), F.count_if(~good | F.col("value").isNull()).alias("invalid"))


@query("agg14_contingency", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def agg14(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("agg15_shares", "WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 6) AS row_pct, round(100.0 * n / sum(n) OVER (PARTITION BY source), 6) AS col_pct FROM n")
def agg15(spark, d):
    return R.shares(table(spark, d, "documents"), "lang", "source")


@query(
    "agg16_composition",
    """WITH n AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS k FROM customer GROUP BY 1, 2), p AS (SELECT *, k * 1.0 / sum(k) OVER (PARTITION BY c_nationkey) AS p FROM n)
    SELECT c_nationkey, CAST(sum(k) AS BIGINT) AS n, arg_min(s, struct_pack(a := -k, b := s)) AS dominant, round(max(p), 6) AS purity, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM p GROUP BY 1""",
)
def agg16(spark, d):
    return R.composition(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query(
    "agg17_contingency_missing",
    """SELECT source, coalesce(CAST(toxic AS VARCHAR), 'missing') AS label, count(*) AS n, round(count(toxic) OVER () * 0.0 + count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS share
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, toxic""",
)
def agg17(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    n = rows.groupBy("source", F.coalesce(F.col("toxic").cast("string"), F.lit("missing")).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("agg18_recurrence_summary", "SELECT l_suppkey, min(l_discount) AS lo, round(avg(l_discount), 9) AS mean, median(l_discount) AS mid, count(*) AS n FROM lineitem GROUP BY 1")
def agg18(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(x).alias("lo"), F.round(F.avg(x), 9).alias("mean"), F.median(x).alias("mid"), F.count("*").alias("n"))


@query("agg19_support_summary", "SELECT l_suppkey, l_returnflag, count(CASE WHEN l_discount < 0.05 THEN 1 END) AS significant, arg_min(l_partkey, struct_pack(a := l_discount, b := -l_extendedprice, c := l_partkey)) AS top FROM lineitem GROUP BY 1, 2")
def agg19(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count_if(F.col("l_discount") < 0.05).alias("significant"), F.min_by("l_partkey", F.struct("l_discount", -F.col("l_extendedprice"), "l_partkey")).alias("top"))


@query("agg20_pivot", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS p FROM orders GROUP BY 1")
def agg20(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))
    return wide.toDF("o_orderpriority", "f", "o", "p")


@query("agg20_top_markers", "SELECT p_type, direction, p_partkey, r FROM (SELECT p_type, 'up' AS direction, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part UNION ALL SELECT p_type, 'down', p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) FROM part) WHERE r <= 5")
def agg20b(spark, d):
    part = table(spark, d, "part").select("p_type", "p_partkey", "p_retailprice")
    w = Window.partitionBy("p_type")
    ends = [part.withColumn("direction", F.lit(name)).withColumn("r", F.row_number().over(w.orderBy(key, "p_partkey")).cast("long")).filter("r <= 5") for name, key in (("up", F.desc("p_retailprice")), ("down", F.asc("p_retailprice")))]
    return ends[0].unionByName(ends[1]).select("p_type", "direction", "p_partkey", "r")


@query("agg21_availability", "SELECT variable, round(min(share), 6) AS least, bool_and(share >= 0.18) AS eligible FROM (SELECT o_orderpriority AS variable, o_orderstatus, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS share FROM orders GROUP BY 1, 2) GROUP BY 1")
def agg21(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("variable"), "o_orderstatus").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))
    return n.withColumn("share", share).groupBy("variable").agg(F.round(F.min("share"), 6).alias("least"), F.bool_and(F.col("share") >= 0.18).alias("eligible"))


@query("agg24_agreement", "SELECT user_id, round(max(n) * 1.0 / sum(n), 6) AS agreement, count(*) AS actions FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def agg24(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("agreement"), F.count("*").alias("actions"))


@query("agg26_fragmentation", "SELECT ref, string_agg(var || '=' || n, ',' ORDER BY var) AS parts FROM (SELECT c_nationkey AS ref, c_mktsegment AS var, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def agg26(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("ref"), F.col("c_mktsegment").alias("var")).agg(F.count("*").alias("n"))
    return n.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("var", "n"))), lambda x: F.concat(x["var"], F.lit("="), x["n"])), ",").alias("parts"))


@query("agg27_status", "SELECT l_suppkey, CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) = 0 THEN 'supporting' WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) * 3 > count(*) THEN 'conflicting' ELSE 'mixed' END AS status FROM lineitem GROUP BY 1")
def agg27(spark, d):
    bad = F.count_if(F.col("l_returnflag") == "R")
    status = F.when(bad == 0, "supporting").when(bad * 3 > F.count("*"), "conflicting").otherwise("mixed")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(status.alias("status"))


@query("agg29_events", "SELECT event_id, 'gain' AS kind FROM events WHERE value - 10 >= 0.2 UNION ALL SELECT event_id, 'loss' FROM events WHERE value - 10 <= -0.2")
def agg29(spark, d):
    x = F.col("value") - 10
    return table(spark, d, "events").select("event_id", F.when(x >= 0.2, "gain").when(x <= -0.2, "loss").alias("kind")).filter("kind is not null")


@query("jon1_modalities", "SELECT c_custkey, n_orders, n_lines, n_nation FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON c_custkey = o_custkey JOIN (SELECT o_custkey AS k, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON c_custkey = k JOIN (SELECT n_nationkey, n_name AS n_nation FROM nation) ON c_nationkey = n_nationkey")
def jon1(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    a = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    b = table(spark, d, "lineitem").select("l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_lines"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("n_nation"))
    return table(spark, d, "customer").join(a, "c_custkey").join(b, "c_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_orders", "n_lines", "n_nation")


@query("jon2_either", "SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'P') ON c_custkey = a LEFT JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = b WHERE c_acctbal > 0 AND (a IS NOT NULL OR b IS NOT NULL)")
def jon2(spark, d):
    orders = table(spark, d, "orders").filter("o_orderstatus = 'P' or o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").filter("c_acctbal > 0").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jon3_coverage", "SELECT lang, count(*) AS n, count(toxic) AS known, count(*) - count(toxic) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def jon3(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("toxic").alias("known"), (F.count("*") - F.count("toxic")).alias("missing"))


@query(
    "jon4_concordance",
    """WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS s, sum(c_acctbal) AS x FROM customer WHERE c_acctbal > 1000 GROUP BY 1, 2), b AS (SELECT c_nationkey AS k, c_mktsegment AS s, sum(c_acctbal) AS y FROM customer WHERE c_acctbal < 6000 GROUP BY 1, 2)
    SELECT k, s, round(x, 2) AS x, round(y, 2) AS y, CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE (x > 0) = (y > 0) END AS concordant FROM a FULL JOIN b USING (k, s)""",
)
def jon4(spark, d):
    side = lambda rule, name: table(spark, d, "customer").filter(rule).groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).agg(F.sum("c_acctbal").alias(name))
    return side("c_acctbal > 1000", "x").join(side("c_acctbal < 6000", "y"), ["k", "s"], "full").select("k", "s", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), ((F.col("x") > 0) == (F.col("y") > 0)).alias("concordant"))


@query("jon5_target_rest", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'target' ELSE 'rest' END AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jon5(spark, d):
    orders = table(spark, d, "orders")
    cohort_ = table(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    inside = orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return cohort_.join(inside, "c_custkey", "left_semi").withColumn("side", F.lit("target")).unionByName(cohort_.join(inside, "c_custkey", "left_anti").withColumn("side", F.lit("rest")))


@query("jon6_scopes", "SELECT 'set' AS scope, vec_id FROM embeddings WHERE label = 0 UNION ALL SELECT 'pair', vec_id FROM embeddings WHERE label IN (0, 1) UNION ALL SELECT 'partition', vec_id FROM embeddings")
def jon6(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    scope = F.explode(F.array_compact(F.array(F.when(F.col("label") == 0, "set"), F.when(F.col("label").isin(0, 1), "pair"), F.lit("partition"))))
    return rows.select(scope.alias("scope"), "vec_id")


@query("jon9_pair_tables", "WITH a AS (SELECT l_partkey, l_suppkey, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, avg(l_tax) AS y FROM lineitem GROUP BY 1, 2) SELECT l_partkey, l_suppkey, round(least(x, y), 9) AS lo, round(sqrt(x * y), 9) AS mean, round(abs(x - y), 9) AS gap FROM a JOIN b USING (l_partkey, l_suppkey)")
def jon9(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    return rows.select("l_partkey", "l_suppkey", F.round(F.least("x", "y"), 9).alias("lo"), F.round(F.sqrt(F.col("x") * F.col("y")), 9).alias("mean"), F.round(F.abs(F.col("x") - F.col("y")), 9).alias("gap"))


@query(
    "jon10_best_source",
    """WITH s AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT c_nationkey AS a, count(*) AS na FROM customer GROUP BY 1), u AS (SELECT c_mktsegment AS b, count(*) AS nb FROM customer GROUP BY 1)
    SELECT a, b, round(n * 1.0 / na, 6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n * 1.0 / na DESC, n * 1.0 / (na + nb - n) DESC, b) AS r FROM s JOIN t USING (a) JOIN u USING (b)) WHERE r = 1""",
)
def jon10(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"))
    n = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    n = n.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))
    coverage, jaccard = F.col("n") / F.col("na"), F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return R.best_row(n, ["a"], [coverage.desc(), jaccard.desc(), F.col("b")]).select("a", "b", F.round(coverage, 6).alias("coverage"))
