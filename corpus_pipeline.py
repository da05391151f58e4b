"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows for the next one, which are written and read again in
between; a stage works on all rows that its predecessor kept and learns from these alone. All but the last
return the columns of `docs`. `run` deletes what a stage left in the shared folder once its result is written, and nothing
else there. Columns of any name stay as they are. Null and empty texts, empty tables, repeated rows and ties: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontam, langid, linededup, minhash, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those that it rejects go (null or empty text, no
    letter, too far from all centroids). Rows that repeat are judged alike. An empty table gives no rows; with no language to learn, all go."""
    common.tuned(spark)
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those of which nothing is left go. n_chars, if there, follows the text.

    Null and empty texts stay as they are. Of rows with equal texts the first doc_id's stay, repeated rows of it too.
    """
    common.tuned(spark)
    aside = {c: common.apart(c, docs) for c in docs.columns if c.lower() in ("n_lines", "n_deleted")}
    rows = linededup.deduplicated(docs.withColumnsRenamed(aside))
    left = rows.filter("n_deleted = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, once if its row repeats.

    Rows that share a doc_id are judged each by its own text. Texts without words, null ones and null doc_ids stay.
    """
    common.tuned(spark)
    return minhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts and repeated rows stay; an empty benchmark takes nothing."""
    common.tuned(spark)
    return decontam.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as op1_packing gives them: null and empty texts are one end id, repeated rows are packed each."""
    import public_tokenizers

    common.tuned(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written to the shared folder."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with common.scope() as made:
            kept = stage(spark, docs, sf_dir)
        docs = common.saved(kept, f"stage-{name}")
        common.discard(spark, made)
    return STAGES[-1][1](spark, docs, sf_dir)
