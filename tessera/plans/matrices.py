"""Queries: pairwise distances, affinities and what they give (2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import matrices as M
from tessera.plans.registry import query, table

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e)"
_P = f"{_E}, p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, 1 - list_dot_product(a.v, b.v) / (a.n * b.n) AS value FROM u a JOIN u b ON a.vec_id < b.vec_id)"
_B = f"{_P}, w AS (SELECT i, j, li, lj, value FROM p UNION ALL SELECT j, i, lj, li, value FROM p)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding")


def _cosine(spark, d):
    return M.pairs(M.unit_rows(_vectors(spark, d), "embedding"), "vec_id", "embedding")


def _r(df, places=6, *cols):
    for c in cols or ("value",):
        df = df.withColumn(c, F.round(c, places))
    return df


@query("mat1_jaccard", "WITH s AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment || (c_custkey % 5) AS x FROM customer), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1) SELECT a.k AS i, b.k AS j, round(1 - count(*) * 1.0 / (any_value(na.n) + any_value(nb.n) - count(*)), 9) AS value FROM s a JOIN s b ON a.x = b.x AND a.k < b.k JOIN n na ON na.k = a.k JOIN n nb ON nb.k = b.k GROUP BY 1, 2")
def mat1(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", F.concat("c_mktsegment", (F.col("c_custkey") % 5).cast("string")).alias("x"))
    return _r(M.set_distance(rows, "c_nationkey", "x"), 9)


@query(
    "mat2_euclidean",
    f"""WITH {_E}, l AS (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM e), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY 1), z AS (SELECT vec_id, list((x - m) / s ORDER BY pos) AS v FROM l JOIN s USING (pos) GROUP BY 1)
    SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.v, b.v), 6) AS value FROM z a JOIN z b ON a.vec_id < b.vec_id""",
)
def mat2(spark, d):
    return _r(M.pairs(M.z_rows(_vectors(spark, d), "vec_id", "embedding"), "vec_id", "embedding", "euclidean"))


@query("mat3_cosine", f"WITH {_P} SELECT i, j, round(value, 6) AS value FROM p")
def mat3(spark, d):
    return _r(_cosine(spark, d))


@query("mat4_correlation", f"WITH {_E}, c AS (SELECT vec_id, list_transform(v, lambda x: x - list_sum(v) / 64) AS v FROM e), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM c) SELECT a.vec_id AS i, b.vec_id AS j, round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS value FROM n a JOIN n b ON a.vec_id < b.vec_id")
def mat4(spark, d):
    return _r(M.pairs(_vectors(spark, d), "vec_id", "embedding", "correlation"))


_K = f"{_B}, k AS (SELECT i, avg(value) AS m FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value, j) AS r FROM w) WHERE r <= 20 GROUP BY 1)"


@query("mat5_affinity", f"WITH {_K}, s AS (SELECT p.i, p.j, p.value, 0.5 * (a.m + b.m + p.value) / 3 AS sigma FROM p JOIN k a ON a.i = p.i JOIN k b ON b.i = p.j) SELECT i, j, round(exp(-value * value / (2 * sigma * sigma)) / (sigma * sqrt(2 * pi())), 6) AS value FROM s")
def mat5(spark, d):
    return _r(M.affinity(_cosine(spark, d)))


_KERNEL = "d2 AS (SELECT i, j, value * value AS s FROM w UNION ALL SELECT vec_id, vec_id, 0 FROM e), m AS (SELECT i, sum(s) / (SELECT count(*) FROM e) AS m FROM d2 GROUP BY 1), c AS (SELECT d2.i, d2.j, -(s - a.m - b.m + (SELECT avg(m) FROM m)) / 2 AS value FROM d2 JOIN m a ON a.i = d2.i JOIN m b ON b.i = d2.j)"


@query("mat8_centred_kernel", f"WITH {_B}, {_KERNEL} SELECT i, j, round(value, 6) AS value FROM c WHERE i <= j")
def mat8(spark, d):
    p = _cosine(spark, d)
    return _r(M.centred_kernel(p, table(spark, d, "embeddings").count()))


@query(
    "mat9_generalised_rv",
    f"""WITH {_B}, {_KERNEL}, p2 AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS value FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    d3 AS (SELECT i, j, value * value AS s FROM p2 UNION ALL SELECT vec_id, vec_id, 0 FROM e), m3 AS (SELECT i, sum(s) / (SELECT count(*) FROM e) AS m FROM d3 GROUP BY 1), c3 AS (SELECT d3.i, d3.j, -(s - a.m - b.m + (SELECT avg(m) FROM m3)) / 2 AS value FROM d3 JOIN m3 a ON a.i = d3.i JOIN m3 b ON b.i = d3.j)
    SELECT round(sum(c.value * c3.value) / sqrt(sum(c.value * c.value) * sum(c3.value * c3.value)), 6) AS grv FROM c JOIN c3 ON c.i = c3.i AND c.j = c3.j""",
)
def mat9(spark, d):
    n = table(spark, d, "embeddings").count()
    a = M.centred_kernel(_cosine(spark, d), n)
    b = M.centred_kernel(M.pairs(_vectors(spark, d), "vec_id", "embedding", "euclidean"), n)
    return _r(M.generalised_rv(a, b), 6, "grv")


@query("mat10_min_max", f"WITH {_P} SELECT i, j, round((value - (SELECT min(value) FROM p)) / ((SELECT max(value) FROM p) - (SELECT min(value) FROM p)), 6) AS value FROM p")
def mat10(spark, d):
    p = _cosine(spark, d)
    ends = p.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return _r(p.crossJoin(F.broadcast(ends)).select("i", "j", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("value")))


@query("mat11_block_means", f"WITH {_P} SELECT least(li, lj) AS g, greatest(li, lj) AS h, round(avg(value), 6) AS mean, count(*) AS n FROM p GROUP BY 1, 2")
def mat11(spark, d):
    return _r(M.cosine_block_means(_vectors(spark, d), "vec_id", "embedding", "label"), 6, "mean")


_NN = "a AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value, j) AS r FROM w) WHERE r <= 10), q AS (SELECT x.vec_id AS i, y.vec_id AS j, list_distance(x.v, y.v) AS value FROM e x JOIN e y ON x.vec_id <> y.vec_id), b AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value, j) AS r FROM q) WHERE r <= 10), n AS (SELECT a.i, count(*) AS c FROM a JOIN b ON a.i = b.i AND a.j = b.j GROUP BY 1)"


@query("mat12_correlation", f"WITH {_P}, q AS (SELECT x.vec_id AS i, y.vec_id AS j, list_distance(x.v, y.v) AS other FROM e x JOIN e y ON x.vec_id < y.vec_id), t AS (SELECT round(value, 10) AS va, round(other, 10) AS vb, value, other FROM p JOIN q USING (i, j)), r AS (SELECT rank() OVER (ORDER BY va) + (count(*) OVER (PARTITION BY va) - 1) / 2.0 AS a, rank() OVER (ORDER BY vb) + (count(*) OVER (PARTITION BY vb) - 1) / 2.0 AS b, value, other FROM t) SELECT round(corr(value, other), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r")
def mat12(spark, d):
    return _r(M.pair_correlations(_vectors(spark, d), "vec_id", "embedding", ("cosine", "euclidean")), 6, "pearson", "spearman")


@query("mat13_neighbour_jaccard", f"WITH {_B}, {_NN} SELECT vec_id AS i, round(coalesce(c, 0) * 1.0 / (20 - coalesce(c, 0)), 6) AS jaccard FROM e LEFT JOIN n ON n.i = vec_id")
def mat13(spark, d):
    a = M.neighbours(_cosine(spark, d), 10).select("i", "j")
    b = M.neighbours(M.pairs(_vectors(spark, d), "vec_id", "embedding", "euclidean"), 10).select("i", "j")
    c = a.join(b, ["i", "j"]).groupBy("i").agg(F.count("*").alias("c"))
    c = F.coalesce(F.col("c"), F.lit(0)), a.select("i").distinct().join(c, "i", "left")
    return c[1].select("i", F.round(c[0] / (20 - c[0]), 6).alias("jaccard"))


_S = f"{_B}, g AS (SELECT i, li, lj, avg(value) AS m FROM w GROUP BY 1, 2, 3)"


@query("mat15_margins", f"WITH {_S}, x AS (SELECT i, li, max(CASE WHEN li = lj THEN m END) AS a, min(CASE WHEN li <> lj THEN m END) AS b FROM g GROUP BY 1, 2) SELECT li AS label, round(median(b - a), 6) AS margin, round(avg(CASE WHEN b - a > 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM x GROUP BY 1")
def mat15(spark, d):
    m = M.cosine_group_means(_vectors(spark, d), "vec_id", "embedding", "label")
    own = F.max(F.when(F.col("g") == F.col("own"), F.col("mean")))
    other = F.min(F.when(F.col("g") != F.col("own"), F.col("mean")))
    x = m.groupBy("i", "own").agg((other - own).alias("gap"))
    return x.groupBy(F.col("own").alias("label")).agg(F.round(F.median("gap"), 6).alias("margin"), F.round(F.avg((F.col("gap") > 0).cast("double")), 6).alias("positive"))


@query("mat17_silhouette", f"WITH {_S}, x AS (SELECT i, li, max(CASE WHEN li = lj THEN m END) AS a, min(CASE WHEN li <> lj THEN m END) AS b, arg_min(lj, CASE WHEN li <> lj THEN m END) AS near FROM g GROUP BY 1, 2) SELECT i, li AS own, near AS nearest, round((b - a) / greatest(a, b), 6) AS s FROM x")
def mat17(spark, d):
    return _r(M.silhouette_of(M.cosine_group_means(_vectors(spark, d), "vec_id", "embedding", "label")), 6, "s")


@query("mat24_robust_scaling", "WITH q AS (SELECT p_type, median(p_retailprice) AS m, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS r FROM part GROUP BY 1) SELECT p_partkey, round((p_retailprice - m) / r, 6) AS scaled FROM part JOIN q USING (p_type)")
def mat24(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    q = part.groupBy("p_type").agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    scaled = F.try_divide(F.col("p_retailprice") - F.col("q")[1], F.col("q")[2] - F.col("q")[0])
    return part.join(F.broadcast(q), "p_type").select("p_partkey", F.round(scaled, 6).alias("scaled"))


@query("mat20_matrix_checks", f"WITH {_P} SELECT count(*) AS n, count(CASE WHEN value < 0 THEN 1 END) AS negative, count(CASE WHEN isnan(value) THEN 1 END) AS not_finite FROM p")
def mat20(spark, d):
    v = F.col("value")
    return _cosine(spark, d).agg(F.count("*").alias("n"), F.count_if(v < 0).alias("negative"), F.count_if(F.isnan(v) | v.isNull()).alias("not_finite"))


@query("mat28_medoids", f"WITH {_B}, m AS (SELECT i, li, avg(value) AS m FROM w WHERE li = lj GROUP BY 1, 2) SELECT li AS label, arg_min(i, struct_pack(a := round(m, 9), b := i)) AS medoid FROM m GROUP BY 1")
def mat28(spark, d):
    m = M.cosine_group_means(_vectors(spark, d), "vec_id", "embedding", "label").filter("g = own")
    return m.groupBy(F.col("own").alias("label")).agg(F.min_by("i", F.struct(F.round("mean", 9), "i")).alias("medoid"))
