"""Queries: the readers and writers of the cohort's files, as round trips through the shared folder (2.1 and 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.session import folder
from tessera.sources import files as S


@query(
    "src1_case_manifest",
    """SELECT CAST(c_custkey AS VARCHAR) AS "Case_ID", list_filter([CASE WHEN n IS NULL THEN 'missing_CT' END, CASE WHEN c_acctbal < 0 THEN 'missing_WSI' END,
    CASE WHEN c_nationkey = 3 THEN 'missing_WXS' END], lambda x: x IS NOT NULL) AS reasons FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def src1(spark, d):
    """Cases as JSON lists, read with their schema; the required views without a record."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("ct"))
    record = lambda path: F.array(F.struct(path.alias("path")))
    none = F.array().cast("array<struct<path: string>>")
    key = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        key.alias("Case_ID"), F.when(F.col("ct").isNotNull(), record(F.col("ct").cast("string"))).otherwise(none).alias("CT"),
        F.when(F.col("c_acctbal") >= 0, record(key)).otherwise(none).alias("WSI"), record(key).alias("RNA_Seq"), F.when(F.col("c_nationkey") != 3, record(key)).otherwise(none).alias("WXS"))
    path = folder(spark, "manifest")
    S.write_manifest(rows, path)
    return S.missing_views(S.case_manifest(spark, path))


_SHEET = """sh AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"""


def _sheet(spark, d):
    """A sheet with a row for each customer: file names packed in a cell, and one sample type for all of them."""
    cells = F.array_sort(F.collect_list("o_orderkey"))  # the orders of one customer
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(cells, ", ").alias("File Name"), F.min_by("o_orderpriority", "o_orderkey").alias("Sample Type"))
    path = folder(spark, "sheet")
    rows.withColumnRenamed("o_custkey", "Case ID").write.option("header", True).option("sep", "\t").csv(path)
    return S.sample_sheet(spark, path, ["File Name", "Sample Type"])


@query("src2_sample_sheet", f"""WITH {_SHEET}, f AS (SELECT o_custkey, o_orderpriority AS kind FROM sh WHERE i = 0) SELECT o_custkey AS case_id, o_orderkey AS file FROM sh JOIN f USING (o_custkey) WHERE kind IN ('1-URGENT', '2-HIGH')""")
def src2(spark, d):
    rows = _sheet(spark, d).filter(F.col("Sample Type").isin("1-URGENT", "2-HIGH"))
    return rows.select(F.col("Case ID").cast("long").alias("case_id"), F.col("File Name").cast("long").alias("file"))


@query("src4_one_file_a_case", f"WITH {_SHEET} SELECT o_custkey AS case_id, o_orderkey AS file FROM sh WHERE i = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def src4(spark, d):
    """The first of a case's files, if it is there."""
    rows = _sheet(spark, d).select(F.col("Case ID").cast("long").alias("case_id"), F.col("File Name").cast("long").alias("file"))
    first = rows.groupBy("case_id").agg(F.min("file").alias("file"))
    return first.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file")), "file", "left_semi").select("case_id", "file")


@query("src7_slide_portal", "SELECT p_partkey AS slide, p_brand AS brand FROM part WHERE p_size >= 10 AND p_retailprice >= 905 AND p_type = 'STANDARD'")
def src7(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("Slide_ID"), F.col("p_brand").alias("Case_ID"), F.when(F.col("p_size") >= 10, F.col("p_size")).alias("Radiology"),
                       F.when(F.col("p_retailprice") >= 905, F.col("p_retailprice")).alias("Genomics"), F.col("p_type").alias("Specimen_Type"))
    path = folder(spark, "portal")
    rows.write.option("header", True).csv(path)
    kept = S.slide_portal(spark, path, ["Case_ID", "Slide_ID", "Radiology", "Genomics"], kept="STANDARD")
    return kept.select(F.col("Slide_ID").cast("long").alias("slide"), F.col("Case_ID").alias("brand"))


@query("src10_mutations", "SELECT l_suppkey AS case_id, p_brand AS gene, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2")
def src10(spark, d):
    """Mutation files with comments, read for a list of cases whose files all have to be there."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_brand").alias("Hugo_Symbol"), F.col("l_linestatus").alias("Variant_Classification"), F.lit("SNP").alias("Variant_Type"),
                       F.lit("chr1").alias("Chromosome"), F.col("l_suppkey").cast("string").alias("Start_Position"))
    path = folder(spark, "maf")
    rows.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    events = S.mutations(spark, path)
    cases = events.select("file").distinct().withColumn("case_id", F.col("file"))
    return S.mutations(spark, path, cases).groupBy(F.col("start").cast("long").alias("case_id"), "gene").agg(F.count("*").alias("n"))


def _dicom(spark, d):
    """DICOM files of the line items, made here: a participant is a customer, a series an order, an instance a line."""
    from tessera.sources.dicom import header

    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            made = [header({"participant": str(c), "study": f"1.2.{c}", "series": f"1.2.{c}.{o}", "instance": str(n), "modality": "CT"}) for c, o, n in zip(frame["o_custkey"], frame["l_orderkey"], frame["l_linenumber"], strict=True)]
            yield pd.DataFrame({"path": [f"{o}/{n}.dcm" for o, n in zip(frame["l_orderkey"], frame["l_linenumber"], strict=True)], "content": made})

    return S.dicom_headers(lines.mapInPandas(run, "path string, content binary"))


@query("src18_dicom_headers", "SELECT CAST(o_custkey AS VARCHAR) AS participant, '1.2.' || o_custkey || '.' || l_orderkey AS series, CAST(l_linenumber AS VARCHAR) AS instance, 'CT' AS modality FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def src18(spark, d):
    return _dicom(spark, d).select("participant", "series", "instance", "modality")


@query(
    "src17_largest_series",
    """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS participant, '1.2.' || o_custkey || '.' || l_orderkey AS series, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT participant, arg_min(series, struct_pack(a := -n, b := series)) AS series, max(n) AS n FROM n GROUP BY 1""",
)
def src17(spark, d):
    return S.largest_series(_dicom(spark, d))


def _states(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("c_nationkey") == 3, "missing_WXS"), F.when(F.col("c_mktsegment") == "BUILDING", "missing_CT")))
    status = F.when(F.col("c_acctbal") >= 0, "success").otherwise("fail")
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), status.alias("qc"), reasons.alias("missing_view_reason"),
                                              F.array(F.col("c_mktsegment")).alias("candidate_cluster_ids"), F.create_map(F.lit("name"), F.col("c_name")).alias("evidence"))


@query("snk1_patient_states", "SELECT CAST(c_custkey AS VARCHAR) AS case_id, CAST((c_nationkey = 3) AS INTEGER) + CAST((c_mktsegment = 'BUILDING') AS INTEGER) AS reasons, c_name AS name FROM customer WHERE c_acctbal >= 0")
def snk1(spark, d):
    path = folder(spark, "states")
    S.write_states(_states(spark, d), path)
    return S.patient_states(spark, path).select("case_id", F.size("missing_view_reason").alias("reasons"), F.col("evidence")["name"].alias("name"))


@query("snk2_json", "SELECT o_orderpriority AS priority, count(*) AS n, CAST(min(o_orderdate) AS DATE)::VARCHAR AS first FROM orders GROUP BY 1")
def snk2(spark, d):
    """Pretty JSON: dates go as text."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("first"))
    path = folder(spark, "json")
    S.write_json(rows.coalesce(1), path)
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"\}\s*\{", "}\u0001{"), "\u0001")).alias("one"))
    return text.select(F.from_json("one", "priority string, n long, first string").alias("r")).filter("r.priority is not null").select("r.*")


@query(
    "snk3_tool_results",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'success' ELSE 'failure' END AS status, 1 + CAST((p_size <> 13) AS INTEGER) AS metrics, CAST((p_brand <> 'Brand#1') AS INTEGER) AS artifacts,
    CASE WHEN p_size > 40 THEN 2 ELSE 1 END AS errors FROM part""",
)
def snk3(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, " Success").otherwise("error").alias("status"),
        F.create_map(F.lit("price"), F.col("p_retailprice"), F.lit("ratio"), F.when(F.col("p_size") == 13, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double"))).alias("metrics"),
        F.create_map(F.lit("brand"), F.when(F.col("p_brand") == "Brand#1", F.lit(" ")).otherwise(F.col("p_brand"))).alias("artifacts"), F.create_map(F.lit("type"), F.col("p_type")).alias("provenance"),
        F.array(F.lit("late"), F.lit(" late "), F.when(F.col("p_size") > 40, "large").otherwise("")).alias("errors"))
    path = folder(spark, "tools")
    S.tool_results(rows).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("p_partkey", "status", *[F.size(c).alias(c) for c in ("metrics", "artifacts", "errors")])


@query("snk4_pair_table", "SELECT a.c_mktsegment AS view, a.c_custkey AS i, b.c_custkey AS j, round(abs(a.c_acctbal - b.c_acctbal), 2) AS value FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey")
def snk4(spark, d):
    c = table(spark, d, "customer")
    x = c.alias("a").join(c.alias("b"), F.expr("a.c_mktsegment = b.c_mktsegment and a.c_nationkey = b.c_nationkey and a.c_custkey < b.c_custkey"))
    value = F.round(F.abs(F.col("a.c_acctbal") - F.col("b.c_acctbal")), 2)
    path = folder(spark, "pairs")
    S.write_pairs(x.select(F.col("a.c_mktsegment").alias("view"), F.col("a.c_custkey").alias("i"), F.col("b.c_custkey").alias("j"), value.alias("value")), path)
    return S.read_pairs(spark, path, 5).select("view", "i", "j", "value")


@query("snk5_run_tables", "SELECT 'labels' AS name, count(*) AS n FROM embeddings UNION ALL SELECT 'sizes', count(DISTINCT label) FROM embeddings")
def snk5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    path = folder(spark, "run")
    S.write_tables({"labels": e, "sizes": e.groupBy("label").agg(F.count("*").alias("n"))}, path)
    rows = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("labels", "sizes")]
    return rows[0].unionByName(rows[1])


@query(
    "snk6_review_outputs",
    "SELECT o_orderstatus AS run, 'accepted' AS name, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 UNION ALL SELECT o_orderstatus, 'dropped', count(*) FROM orders WHERE o_totalprice <= 100000 GROUP BY 1",
)
def snk6(spark, d):
    """Tables of all runs, a folder for each run."""
    rows = table(spark, d, "orders").withColumn("name", F.when(F.col("o_totalprice") > 100000, "accepted").otherwise("dropped"))
    path = folder(spark, "review")
    rows.withColumnRenamed("o_orderstatus", "run").write.partitionBy("run", "name").json(path)
    return spark.read.json(path).groupBy("run", "name").agg(F.count("*").alias("n"))


@query("snk9_trace", "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS value FROM events")
def snk9(spark, d):
    """Events appended to a log in two goes; numbers that aren't finite come as text."""
    events = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    path = folder(spark, "trace")
    S.append_trace(events.filter("event_type = 'error'"), path)
    S.append_trace(events.filter("event_type <> 'error'"), path)
    return spark.read.schema("event_id long, event_type string, value string").json(path).select("event_id", "event_type", F.get_json_object("value", "$.v").alias("value"))


@query("lin1_file_identity", "SELECT c_nationkey AS shard, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS size FROM customer GROUP BY 1")
def lin1(spark, d):
    """Files by path, size and time, from their metadata: a file for each nation."""
    path = folder(spark, "names")
    table(spark, d, "customer").repartitionById(25, "c_nationkey").select(F.col("c_name").alias("value")).write.text(path)
    files = S.file_table(spark, path).filter("modified_us > 0 and size > 0")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "size")
