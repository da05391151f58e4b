"""Queries: image-quality metrics (2.12). A slice is an embedding, read as 8 rows of 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import images as I
from tessera.plans.registry import query, table

_PIXELS = "px AS (SELECT vec_id AS slice, i // 8 AS y, i % 8 AS x, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"


def _pixels(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("slice"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("slice", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def _rounded(df, places=6):
    return df.select("slice", *[F.round(c, places).alias(c) for c in df.columns if c != "slice"])


@query(
    "img10_texture",
    f"""WITH {_PIXELS}, e AS (SELECT slice, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), q AS (SELECT px.slice, y, x, CAST(round_even((v - lo) / (hi - lo) * 31, 0) AS INTEGER) AS q FROM px JOIN e USING (slice) WHERE hi > lo),
    n AS (SELECT p.slice, p.q AS a, r.q AS b, count(*) AS n FROM q p, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) o(dy, dx), q r WHERE r.slice = p.slice AND r.y = p.y + dy AND r.x = p.x + dx GROUP BY ALL),
    g AS (SELECT slice, a, b, n * 1.0 / sum(n) OVER (PARTITION BY slice) AS p FROM n), m AS (SELECT slice, sum(a * p) AS ma, sum(b * p) AS mb FROM g GROUP BY 1)
    SELECT slice, round(sum((a - b) * (a - b) * p), 6) AS contrast, round(sum(abs(a - b) * p), 6) AS dissimilarity, round(sum(p * p), 6) AS asm, round(sqrt(sum(p * p)), 6) AS energy, round(sum(p / (1 + (a - b) * (a - b))), 6) AS homogeneity,
    round(sum((a - ma) * (b - mb) * p) / sqrt(sum((a - ma) * (a - ma) * p) * sum((b - mb) * (b - mb) * p)), 6) AS correlation FROM g JOIN m USING (slice) GROUP BY 1""",
)
def texture(spark, d):
    return _rounded(I.texture(_pixels(spark, d)))


@query(
    "img10_wavelets",
    f"""WITH {_PIXELS}, q AS (SELECT slice, y // 2 AS i, x // 2 AS j, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS a, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END) AS b,
        max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END) AS c, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) AS d FROM px GROUP BY ALL), k AS (SELECT slice, unnest([(a - b + c - d) / 4, (a + b - c - d) / 4, (a - b - c + d) / 4]) AS k FROM q)
    SELECT slice, round(avg(abs(k)), 6) AS wcs, round(sum(k * k), 6) AS wce, round(avg(CASE WHEN abs(k) < 0.001 THEN 1.0 ELSE 0 END), 6) AS wqs FROM k GROUP BY 1""",
)
def wavelets(spark, d):
    return _rounded(I.wavelets(_pixels(spark, d)))


@query(
    "img10_local_contrast",
    f"""WITH {_PIXELS}, n AS (SELECT p.slice, p.y, p.x, any_value(p.v) AS v, sum(r.v) - any_value(p.v) AS s FROM px p JOIN px r ON r.slice = p.slice AND abs(r.y - p.y) <= 1 AND abs(r.x - p.x) <= 1 GROUP BY ALL)
    SELECT slice, round(avg(v - s / 8), 6) AS cpp FROM n GROUP BY 1""",
)
def local_contrast(spark, d):
    return _rounded(I.local_contrast(_pixels(spark, d)))


@query(
    "img10_peak_noise",
    f"""WITH {_PIXELS}, o AS (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b), m AS (SELECT p.slice, p.y, p.x, any_value(p.v) AS v, median(coalesce(r.v, 0)) AS m FROM px p CROSS JOIN o
        LEFT JOIN px r ON r.slice = p.slice AND r.y = p.y + dy AND r.x = p.x + dx GROUP BY ALL), s AS (SELECT slice, max(v) AS peak, avg((v - m) * (v - m)) AS mse FROM m GROUP BY 1)
    SELECT slice, round(CASE WHEN peak > 0 AND mse > 0 THEN 10 * log10(peak * peak / mse) END, 6) AS psnr FROM s""",
)
def peak_noise(spark, d):
    return _rounded(I.peak_noise(_pixels(spark, d)))


@query(
    "img10_spectrum",
    f"""WITH {_PIXELS}, f AS (SELECT a.range AS u, b.range AS w, sqrt(pow(CASE WHEN a.range < 4 THEN a.range ELSE a.range - 8 END / 8.0, 2) + pow(CASE WHEN b.range < 4 THEN b.range ELSE b.range - 8 END / 8.0, 2)) AS r FROM range(8) a, range(8) b),
    s AS (SELECT slice, u, w, any_value(r) AS r, sqrt(pow(sum(v * cos(2 * pi() * (u * y + w * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (u * y + w * x) / 8)), 2)) AS m FROM px, f GROUP BY slice, u, w)
    SELECT slice, round(avg(CASE WHEN r <= 2 / 8.0 THEN m END), 6) AS lfr, round(avg(CASE WHEN r >= 2 / 8.0 AND r <= 3 / 8.0 THEN m END), 6) AS hfr,
    round(avg(CASE WHEN r >= 3 / 8.0 AND r <= 4 / 8.0 THEN m END) / (avg(CASE WHEN r <= 2 / 8.0 THEN m END) + 1e-8), 6) AS snrf FROM s GROUP BY 1""",
)
def spectrum(spark, d):
    return _rounded(I.spectrum(_pixels(spark, d)))


@query(
    "img10_failures",
    f"""WITH {_PIXELS}, s AS (SELECT slice, stddev_pop(v) AS sd, avg(v) AS m FROM px WHERE v > 0.1 GROUP BY 1), c AS (SELECT slice, stddev_pop(v - m) AS sc FROM px JOIN s USING (slice) WHERE v > 0.1 GROUP BY 1)
    SELECT slice, CAST(sd IS NULL OR sc = 0 AS INTEGER) + CAST(m IS NULL AS INTEGER) AS failed FROM s JOIN c USING (slice)""",
)
def failures(spark, d):
    """How many of two metrics of the foreground fail: its deviation over that of the centred values (1, or none), and its mean."""
    fg = _pixels(spark, d).filter("v > 0.1")
    s = fg.groupBy("slice").agg(F.stddev_pop("v").alias("sd"), F.avg("v").alias("m"))
    c = fg.join(s, "slice").groupBy("slice").agg(F.max("sd").alias("sd"), F.max("m").alias("m"), F.stddev_pop(F.col("v") - F.col("m")).alias("sc"))
    return I.failures(c.select("slice", F.try_divide("sd", "sc").alias("snr3"), "m"), "slice")


@query(
    "img3_range_check",
    f"WITH {_PIXELS} SELECT slice, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.99), 6) AS p99, quantile_cont(v, 0.01) >= -1 AND quantile_cont(v, 0.99) <= 1 AND quantile_cont(v, 0.99) > quantile_cont(v, 0.01) AS pass FROM px GROUP BY 1",
)
def range_check(spark, d):
    """The first and last percentile of a volume's values, inside the range that is possible."""
    q = _pixels(spark, d).groupBy("slice").agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return q.select("slice", F.round(lo, 6).alias("p1"), F.round(hi, 6).alias("p99"), ((lo >= -1) & (hi <= 1) & (hi > lo)).alias("pass"))
