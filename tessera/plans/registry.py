"""Where queries and their SQL are registered, and the readings of the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import on_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the function as a query of this name, with the DuckDB SQL for its rows."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(on_workers(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The cohort reading: a case is a customer, a feature a brand, the value the quantity bought. Long form.
COHORT = """cohort AS (
    SELECT o_custkey AS case_id, p_brand AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, lines.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("o_custkey").alias("case_id"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))
