"""Readers and writers of the cohort's files. Each reader takes paths that Spark can open and gives a checked table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "array<struct<path: string, `File Path`: string>>"
MANIFEST = f"Case_ID string, CT {RECORDS}, WSI {RECORDS}, RNA_Seq {RECORDS}, WXS {RECORDS}, Clinical struct<demographic: map<string, string>, diagnoses: array<map<string, string>>>"
VIEWS = ("CT", "WSI", "RNA_Seq", "WXS")


def require(df: DataFrame, rule: Column, message: str, what: Column | None = None) -> DataFrame:
    """The rows, or an error at the first one that breaks the rule; a null rule breaks it."""
    text = F.concat(F.lit(f"{message}: "), (what if what is not None else F.lit("")).cast("string"))
    return df.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def case_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of cases, with its declared schema."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_manifest(cases: DataFrame, path: str, files: int = 4) -> None:
    """Cases as JSON lists, `files` of them; the cases of a file meet in a task, as a reader of such a file holds them too."""
    rows = cases.select(F.pmod(F.xxhash64("Case_ID"), F.lit(files)).cast("int").alias("_file"), F.to_json(F.struct(*cases.columns)).alias("_case"))
    lists = rows.groupBy("_file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("_case"), ","), F.lit("]")).alias("value"))
    lists.repartitionById(files, "_file").select("value").write.mode("overwrite").text(path)


def slide_portal(spark: SparkSession, path: str, required: list[str], tissue: str = "Specimen_Type", kept: str = "tumor_tissue") -> DataFrame:
    """Slides of a portal's table: rows without a required column and of other tissues go."""
    rows = spark.read.option("header", True).csv(path)
    return rows.na.drop(subset=required).filter(F.col(tissue) == kept)


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """path, size and modification time of the files under a path, from their metadata: no file is opened by the driver."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us"))


def content_identity(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of the files under a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def with_files(rows: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The rows whose file, named in the column, is among those of `file_table`, with its path."""
    have = files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias(name))
    return rows.join(have, name)


def missing_views(manifest: DataFrame) -> DataFrame:
    """Case_ID and the names of the required views that have no record."""
    none = [F.when(F.coalesce(F.size(v), F.lit(0)) <= 0, F.lit(f"missing_{v}")) for v in VIEWS]
    return manifest.select("Case_ID", F.array_compact(F.array(*none)).alias("reasons"))


def first_paths(manifest: DataFrame, view: str) -> DataFrame:
    """case_id and the first path of a view that isn't blank, in the manifest's order."""
    path = F.filter(F.transform(view, lambda r: F.coalesce(r["File Path"], r["path"])), lambda p: F.trim(p) != "")
    return manifest.select(F.col("Case_ID").alias("case_id"), F.get(path, F.lit(0)).alias("path")).filter("path is not null")


def sample_sheet(spark: SparkSession, path: str, packed: list[str], sep: str = "\t") -> DataFrame:
    """A sheet with lists in its cells: a row for each element of the longest list; shorter lists repeat their first element."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    cells = raw.select("*", *[F.split(F.col(c), r",\s*").alias(f"_{c}") for c in packed])
    n = F.greatest(*[F.size(f"_{c}") for c in packed], F.lit(1))
    rows = cells.withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    pick = {c: F.coalesce(F.get(f"_{c}", "_i"), F.get(f"_{c}", F.lit(0))) for c in packed}
    return rows.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in raw.columns])


def expression(spark: SparkSession, path: str, protein_coding_only: bool = True) -> DataFrame:
    """file, gene, tpm, count from quantification files: a comment line, a header, four metadata lines, then genes. Of genes that
    repeat: the highest tpm and the sum of counts. A tpm that is no number is 0; a count that is no whole number is an error."""
    columns = "gene_id string, gene_name string, gene_type string, unstranded string, stranded_first string, stranded_second string, tpm_unstranded string, fpkm_unstranded string, fpkm_uq_unstranded string"
    raw = spark.read.schema(columns).option("sep", "\t").option("comment", "#").csv(path).withColumn("file", F.input_file_name())
    rows = raw.filter("gene_id <> 'gene_id' and gene_name is not null and trim(gene_name) <> ''")
    if protein_coding_only:
        rows = rows.filter("gene_type = 'protein_coding'")
    count = F.col("unstranded").try_cast("double")
    rows = require(rows, (count >= 0) & (count == F.floor(count)), "counts have to be integer-valued", F.col("gene_name"))
    tpm = F.coalesce(F.col("tpm_unstranded").try_cast("double"), F.lit(0.0))
    return rows.groupBy("file", F.trim("gene_name").alias("gene")).agg(F.max(F.nanvl(tpm, F.lit(0.0))).alias("tpm"), F.sum(count).cast("long").alias("count"))


def mutations(spark: SparkSession, path: str, cases: DataFrame | None = None) -> DataFrame:
    """Mutation events of tab-separated files, plain or gzip, '#' comments skipped; `cases` (file, case_id) have to be there, each with its file."""
    raw = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path).withColumn("file", F.input_file_name())
    names = {"Hugo_Symbol": "gene", "Variant_Classification": "classification", "Variant_Type": "variant_type", "Chromosome": "chromosome", "Start_Position": "start"}
    rows = raw.select("file", *[F.trim(F.col(k)).alias(v) for k, v in names.items()])
    if cases is None:
        return rows
    lost = cases.join(rows.select("file").distinct(), "file", "left_anti").limit(1).collect()
    if lost:
        raise FileNotFoundError(f"no mutation file of case {lost[0]['case_id']}")
    return rows.join(F.broadcast(cases), "file") if cases.count() <= 1_000_000 else rows.join(cases, "file")


def patient_states(spark: SparkSession, path: str) -> DataFrame:
    """States of cases that passed, one JSON object a line; an identifier that repeats is an error."""
    rows = spark.read.schema("case_id string, qc string, missing_view_reason array<string>, candidate_cluster_ids array<string>, evidence map<string, string>").json(path).filter("qc = 'success'")
    twice = rows.groupBy("case_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"case {twice[0]['case_id']} is there twice")
    return rows


def write_states(states: DataFrame, path: str) -> None:
    states.write.mode("overwrite").json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A pair table (view, i, j, value), a folder for each view."""
    pairs.repartition("view").sortWithinPartitions("i", "j").write.mode("overwrite").partitionBy("view").parquet(path)


def read_pairs(spark: SparkSession, path: str, n_views: int | None = None) -> DataFrame:
    """The pair table, checked: i < j, values finite and not negative, each pair once; and as many views as said."""
    rows = spark.read.parquet(path)
    v = F.col("value")
    rows = require(rows, (F.col("i") < F.col("j")) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= 0), "not a distance", F.concat_ws(",", "view", "i", "j"))
    if rows.groupBy("view", "i", "j").count().filter("count > 1").limit(1).count():
        raise ValueError("a pair is there twice")
    if n_views is not None and rows.select("view").distinct().count() != n_views:
        raise ValueError("a view is missing")
    return rows


def tool_results(rows: DataFrame) -> DataFrame:
    """Snapshots made small: of the metrics (map<string, double>) the finite ones stay, of the texts (map<string, string>) those that
    aren't blank, of the errors each message once in its order; any status but success is a failure."""
    finite = F.map_filter("metrics", lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    told = lambda c: F.map_filter(c, lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))
    errors = F.array_distinct(F.filter(F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
    status = F.when(F.lower(F.trim("status")) == "success", "success").otherwise("failure")
    return rows.withColumns({"status": status, "metrics": finite, "artifacts": told("artifacts"), "provenance": told("provenance"), "errors": errors})


def write_json(rows: DataFrame, path: str) -> None:
    """A small table as pretty JSON objects, one after the other; what isn't a number, a text or a list is written as text."""
    kinds = {c: F.col(c) if t.split("<")[0] in ("bigint", "int", "double", "string", "boolean", "array", "map", "struct") else F.col(c).cast("string") for c, t in rows.dtypes}
    rows.select(F.to_json(F.struct(*[v.alias(c) for c, v in kinds.items()]), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a run, a folder for each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_trace(events: DataFrame, path: str) -> None:
    """Events added to a log, a JSON object a line; numbers that aren't finite are written as text."""
    def plain(c: str, kind: str) -> Column:
        x = F.col(c)
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.to_json(F.struct(x.cast("string").alias("v")))).otherwise(F.to_json(F.struct(x.alias("v")))).alias(c) if kind == "double" else x

    events.select(*[plain(c, t) for c, t in events.dtypes]).write.mode("append").json(path)


def changed(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """key and state (new, removed, changed, same) of two tables of signatures."""
    both = old.select(key, F.col(signature).alias("_o")).join(new.select(key, F.col(signature).alias("_n")), key, "full")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed").otherwise("same")
    return both.select(key, state.alias("state"))


def dicom_headers(files: DataFrame) -> DataFrame:
    """participant, study, series, instance, modality, thickness of the files (path, content binary) that are DICOM; absent elements are null."""
    import pandas as pd

    from tessera.sources.dicom import TAGS, read_header

    def run(frames):
        for frame in frames:
            heads = [(p, read_header(bytes(c))) for p, c in zip(frame["path"], frame["content"], strict=True)]
            rows = [(p, *(h.get(t) for t in TAGS)) for p, h in heads if h is not None]
            yield pd.DataFrame(rows, columns=["path", *TAGS])

    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{t} string" for t in TAGS))


def largest_series(headers: DataFrame) -> DataFrame:
    """participant, series, n: of each participant the series of the most files; ties: the first in order."""
    n = headers.groupBy("participant", "series").agg(F.count("*").alias("n"))
    return n.groupBy("participant").agg(F.min_by("series", F.struct(-F.col("n"), "series")).alias("series"), F.max("n").alias("n"))
