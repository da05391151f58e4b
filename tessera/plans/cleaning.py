"""Queries: scans, projections and scalar cleaning (2.1 and 2.2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.registry import query, table

_SERIES = {"SMALL": "CT CHEST routine", "LARGE": "CTCHESTABDPEL 5mm", "PROMO": "C/A/P  w contrast", "ECONOMY": "Kidneys pre-contrast", "MEDIUM": "Arterial phase abd", "STANDARD": ""}
_SERIES_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SERIES.items()) + " END"
_PROTOCOL_SQL = "CASE WHEN p_size % 5 = 0 THEN 'NC and delay 5 min' WHEN p_size % 5 = 1 THEN 'nephrographic' WHEN p_size % 5 = 2 THEN 'lung screening' WHEN p_size % 5 = 3 THEN 'status post partial nephrectomy' ELSE 'venous' END"


def _series(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    return part.selectExpr("p_partkey", "p_size", f"{_SERIES_SQL} AS series", f"{_PROTOCOL_SQL} AS protocol", "CASE WHEN p_partkey % 7 = 0 THEN 'Omnipaque' ELSE ' ' END AS agent")


_SERIES_CTE = f"WITH s AS (SELECT p_partkey, p_size, {_SERIES_SQL} AS series, {_PROTOCOL_SQL} AS protocol, CASE WHEN p_partkey % 7 = 0 THEN 'Omnipaque' ELSE ' ' END AS agent FROM part)"
_ANATOMY_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({}), 'CTCHESTABDPEL|CHESTABDPEL', ' CHEST ABD PEL ', 'g'), 'CTCHEST', ' CT CHEST ', 'g'), 'CTCAP', ' CT CAP ', 'g'), 'C\\s*[/\\-]\\s*A\\s*[/\\-]\\s*P', ' CAP ', 'g'), '[^A-Z0-9]+', ' ', 'g')"


@query("prj5_safe_identifier", "SELECT page_id, CASE WHEN s = '' THEN 'artifact' ELSE s END AS safe FROM (SELECT page_id, regexp_replace(trim(url), '[^a-zA-Z0-9._-]+', '_', 'g') AS s FROM pages)")
def prj5(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_identifier(F.col("url")).alias("safe"))


@query("prj6_anatomy", f"{_SERIES_CTE} SELECT p_partkey, {_ANATOMY_SQL.format('series')} AS anatomy FROM s")
def prj6(spark, d):
    return _series(spark, d).select("p_partkey", T.anatomy(F.col("series")).alias("anatomy"))


@query(
    "prj7_chest_only",
    f"""{_SERIES_CTE}, n AS (SELECT p_partkey, {_ANATOMY_SQL.format('series')} AS a, {_ANATOMY_SQL.format('protocol')} AS b FROM s),
    t AS (SELECT p_partkey, CASE WHEN a = '' THEN b ELSE a END AS t FROM n)
    SELECT p_partkey, regexp_matches(t, '\\b(CHEST|THORAX|LUNG)\\b') AND NOT regexp_matches(t, '\\b(ABD|ABDOMEN|PELVIS|RENAL|KIDNEY|CAP)\\b') AS rejected FROM t""",
)
def prj7(spark, d):
    return _series(spark, d).select("p_partkey", T.chest_only(F.col("series"), F.col("protocol")).alias("rejected"))


@query(
    "prj8_candidate_pass",
    f"""{_SERIES_CTE}, n AS (SELECT *, {_ANATOMY_SQL.format('series')} AS a FROM s)
    SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AND NOT (a <> '' AND regexp_matches(a, '\\b(CHEST|THORAX|LUNG)\\b') AND NOT regexp_matches(a, '\\b(ABD|ABDOMEN|PELVIS|RENAL|KIDNEY|CAP)\\b')) AS pass FROM n""",
)
def prj8(spark, d):
    rows = _series(spark, d).selectExpr("*", "CASE WHEN p_size % 2 = 0 THEN ' True' ELSE 'false' END AS a", "CASE WHEN p_size % 3 = 0 THEN 'no' ELSE 'TRUE' END AS b")
    flags = [F.lower(F.trim(c)) == "true" for c in ("a", "b")]
    return rows.select("p_partkey", (flags[0] & flags[1] & ~T.chest_only(F.col("series"), F.lit(""))).alias("pass"))


@query("prj9_pretreatment", f"{_SERIES_CTE} SELECT p_partkey, NOT regexp_matches(series || ' ' || protocol, '(?i)\\b(STATUS\\s+POST|S/P|POST[- ]?(OPERATIVE|OP))\\b[^\\n]{{0,80}}\\b(NEPHRECTOMY|RENAL\\s+ABLATION)\\b') AND NOT regexp_matches(series || ' ' || protocol, '(?i)\\bPOST[- ]?NEPHRECTOMY\\b') AS pretreatment FROM s")
def prj9(spark, d):
    return _series(spark, d).select("p_partkey", T.before_treatment(F.col("series"), F.col("protocol")).alias("pretreatment"))


@query(
    "prj10_phase",
    f"""{_SERIES_CTE}, u AS (SELECT p_partkey, series AS s0, upper(series) AS s, upper(protocol) AS p, trim(agent) AS agent FROM s),
    m AS (SELECT *, regexp_matches(p, '\\bNC\\b') AND regexp_matches(p, '\\b(WC|WITH|CONTRAST|DELAY|ARTERIAL|NEPHRO)\\b') AS multi,
        CASE WHEN regexp_matches(s, '\\bPRE[- ]?CONTRAST\\b|\\bKIDNEYS PRE\\b') THEN 'NC' WHEN regexp_matches(s, '\\bARTERIAL') THEN 'ART' END AS own,
        CASE WHEN regexp_matches(p, '\\bNEPH(RO(GRAPHIC)?)?\\b') THEN 'NEPH' WHEN regexp_matches(p, '\\bDELAY') THEN 'DEL' END AS other FROM u)
    SELECT p_partkey, CASE WHEN own IS NOT NULL THEN own WHEN other IS NOT NULL AND NOT multi THEN other
        WHEN NOT multi AND (agent <> '' OR regexp_matches(s || ' ' || p, '\\bW CONTRAST\\b|\\bVENOUS\\b')) THEN 'CE_UNSPECIFIED' ELSE 'UNKNOWN' END AS phase,
        CASE WHEN own IS NOT NULL THEN 'series_description' WHEN other IS NOT NULL AND NOT multi THEN 'protocol_name'
        WHEN NOT multi AND (agent <> '' OR regexp_matches(s || ' ' || p, '\\bW CONTRAST\\b|\\bVENOUS\\b')) THEN 'contrast_metadata' ELSE 'none' END AS source FROM m""",
)
def prj10(spark, d):
    return _series(spark, d).select("p_partkey", T.contrast_phase(F.col("series"), F.col("protocol"), F.col("agent")).alias("x")).select("p_partkey", "x.phase", "x.source")


@query(
    "prj11_prefilter_reasons",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_type <> 'SMALL' THEN 'not_ct' END, CASE WHEN p_size > 40 THEN 'slice_thickness_out_of_range' END,
        CASE WHEN p_retailprice < 950 THEN 'matrix_too_small' END, CASE WHEN p_size > 3 * 10 AND p_retailprice > 1000 THEN 'large_slice_gap' END) AS reasons FROM part""",
)
def prj11(spark, d):
    rules = {"not_ct": F.col("p_type") != "SMALL", "slice_thickness_out_of_range": F.col("p_size") > 40, "matrix_too_small": F.col("p_retailprice") < 950, "large_slice_gap": (F.col("p_size") > 3 * 10) & (F.col("p_retailprice") > 1000)}
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", T.reasons(rules)).alias("reasons"))


@query(
    "prj12_order_key",
    """WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'late' ELSE strftime(ts, '%H:%M:%S') END AS t, user_id FROM events),
    k AS (SELECT *, try_cast(nullif(replace(t, ':', ''), '') AS DOUBLE) AS n FROM t)
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN n IS NULL THEN 1 ELSE 0 END, coalesce(n, 0), CASE WHEN n IS NULL THEN t ELSE '' END, event_id) AS place FROM k""",
)
def prj12(spark, d):
    t = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "view", "late").otherwise(F.date_format("ts", "HH:mm:ss"))
    rows = table(spark, d, "events").select("event_id", "user_id", T.order_key(t).alias("k"))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("k", "event_id")).cast("long").alias("place"))


@query(
    "prj13_clinical_labels",
    """WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Stage IIIA' WHEN 1 THEN 'iv' WHEN 2 THEN 'Stage I' WHEN 3 THEN 'STAGE II' WHEN 4 THEN NULL ELSE 'n/a' END AS stage,
        CASE p_size % 4 WHEN 0 THEN 'pT2b' WHEN 1 THEN 'T5' WHEN 2 THEN 't3' END AS t, CASE p_size % 3 WHEN 0 THEN 'm0' WHEN 1 THEN 'MX' ELSE 'M1' END AS m FROM part)
    SELECT p_partkey, CASE WHEN upper(stage) LIKE '%STAGE IV%' OR upper(stage) = 'IV' THEN 'IV' WHEN upper(stage) LIKE '%STAGE III%' OR upper(stage) = 'III' THEN 'III'
        WHEN upper(stage) LIKE '%STAGE II%' OR upper(stage) = 'II' THEN 'II' WHEN upper(stage) LIKE '%STAGE I%' OR upper(stage) = 'I' THEN 'I' ELSE '' END AS stage,
        regexp_extract(upper(coalesce(t, '')), 'T[1-4]') AS t_stage, CASE WHEN upper(m) IN ('M0', 'M1') THEN upper(m) ELSE '' END AS m_stage FROM t""",
)
def prj13(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE p_size % 6 WHEN 0 THEN 'Stage IIIA' WHEN 1 THEN 'iv' WHEN 2 THEN 'Stage I' WHEN 3 THEN 'STAGE II' WHEN 4 THEN NULL ELSE 'n/a' END AS stage",
        "CASE p_size % 4 WHEN 0 THEN 'pT2b' WHEN 1 THEN 'T5' WHEN 2 THEN 't3' END AS t", "CASE p_size % 3 WHEN 0 THEN 'm0' WHEN 1 THEN 'MX' ELSE 'M1' END AS m")
    m = F.upper("m")
    return rows.select("p_partkey", T.stage(F.col("stage")).alias("stage"), T.tnm(F.col("t"), "T").alias("t_stage"), F.when(m.isin("M0", "M1"), m).otherwise("").alias("m_stage"))


@query("prj15_subject_id", "SELECT page_id, upper(regexp_extract(url, '[a-z]{2}/[0-9]+')) AS subject FROM pages")
def prj15(spark, d):
    return table(spark, d, "pages").select("page_id", F.upper(F.regexp_extract("url", "[a-z]{2}/[0-9]+", 0)).alias("subject"))


@query("prj16_missing_tokens", "SELECT p_partkey, CASE WHEN upper(trim(v)) NOT IN ('', 'UNKNOWN', 'NA', 'NX', 'MX', 'TX') THEN trim(v) END AS value FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' na ' WHEN 1 THEN 'Unknown' WHEN 2 THEN '' ELSE ' ' || p_name END AS v FROM part)")
def prj16(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "CASE p_size % 5 WHEN 0 THEN ' na ' WHEN 1 THEN 'Unknown' WHEN 2 THEN '' ELSE ' ' || p_name END AS v").select("p_partkey", T.known(F.col("v")).alias("value"))


@query(
    "prj1_missing_views",
    """SELECT c_custkey, concat_ws(',', CASE WHEN max(o_orderkey) IS NULL THEN 'missing_orders' END, CASE WHEN c_acctbal < 0 THEN 'missing_balance' END,
        CASE WHEN count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) = 0 THEN 'missing_urgent' END) AS reasons FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal""",
)
def prj1(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    rules = {"missing_orders": F.col("n").isNull(), "missing_balance": F.col("c_acctbal") < 0, "missing_urgent": F.coalesce("urgent", F.lit(0)) == 0}
    return rows.select("c_custkey", F.concat_ws(",", T.reasons(rules)).alias("reasons"))


@query("prj18_strict_threshold", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45")
def prj18(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "prj17_flag_or_fallback",
    """WITH f AS (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS flagged FROM lineitem)
    SELECT l_orderkey, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM f WHERE (flagged = 1 AND l_returnflag = 'R') OR (flagged = 0 AND l_discount >= 0.05) GROUP BY 1""",
)
def prj17(spark, d):
    flag = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", "l_extendedprice").withColumn("flagged", F.max(flag).over(Window.partitionBy("l_orderkey")))
    return rows.filter((F.col("flagged") & flag) | (~F.col("flagged") & (F.col("l_discount") >= 0.05))).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query("prj21_rates", "SELECT l_suppkey, round(count(CASE WHEN l_returnflag <> 'N' THEN 1 END) * 1.0 / count(*), 6) AS tissue_rate, round(count(CASE WHEN l_returnflag = 'R' THEN 1 END) * 1.0 / nullif(count(CASE WHEN l_returnflag <> 'N' THEN 1 END), 0), 6) AS artifact_rate FROM lineitem GROUP BY 1")
def prj21(spark, d):
    flag = F.col("l_returnflag")
    tissue, artifact = F.count_if(flag != "N"), F.count_if(flag == "R")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(tissue / F.count("*"), 6).alias("tissue_rate"), F.round(F.try_divide(artifact, tissue), 6).alias("artifact_rate"))


@query("prj24_burden", "SELECT o_custkey, count(*) AS n_events, bool_and(o_orderstatus <> 'P') AS all_settled FROM orders GROUP BY 1")
def prj24(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_events"), F.bool_and(F.col("o_orderstatus") != "P").alias("all_settled"))


@query("src5_earliest_study", "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS study_date FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m")
def src5(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").na.drop(subset=["o_custkey", "o_orderdate"])
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    return rows.withColumn("m", first).filter("o_orderdate = m").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("study_date"))


@query("src6_distinct_paths", "SELECT url, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY url")
def src6(spark, d):
    return table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("src8_expression", "SELECT o_custkey, o_orderpriority AS gene, max(o_totalprice) AS tpm, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def src8(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("gene")).agg(F.max("o_totalprice").alias("tpm"), F.sum(F.floor("o_totalprice")).alias("n"))


@query(
    "src9_best_file",
    """WITH q AS (SELECT l_suppkey, l_shipdate AS path, median(l_quantity) AS depth FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, strftime(path, '%Y-%m-%d') AS path, depth FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY depth DESC, path DESC) AS r FROM q) WHERE r = 1""",
)
def src9(spark, d):
    files = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").alias("path")).agg(F.median("l_quantity").alias("depth"))
    best = files.groupBy("l_suppkey").agg(F.max(F.struct(F.coalesce("depth", F.lit(-1.0)).alias("depth"), "path")).alias("b"))
    return best.select("l_suppkey", F.date_format("b.path", "yyyy-MM-dd").alias("path"), F.col("b.depth").alias("depth"))


@query("src11_first_path", "SELECT o_custkey AS case_id, min(o_orderkey) AS path FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def src11(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderkey").alias("path"))


@query(
    "src13_label_collapse",
    """SELECT o_custkey AS case_id, count(*) AS n_rows, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate_consistent' ELSE 'matched' END AS status,
    CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS label FROM orders GROUP BY 1""",
)
def src13(spark, d):
    labels = F.collect_set("o_orderstatus")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("n_rows"), labels.alias("s"))
    status = F.when(F.size("s") > 1, "conflict").when(F.col("n_rows") > 1, "duplicate_consistent").otherwise("matched")
    return rows.select("case_id", "n_rows", status.alias("status"), F.when(F.size("s") == 1, F.get("s", F.lit(0))).alias("label"))


@query("src12_unique_states", "SELECT o_custkey AS case_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1")
def src12(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("n")).filter("n > 1")
