"""Quality metrics of slices given as pixels (slice, y, x, v). Those of neighbours are joins and aggregations; the spectrum is a transform of a slice.

A slice whose metric isn't defined (one value only, no full quad, no pair of neighbours) has null there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSETS = ((0, 1), (1, 0), (1, 1), (1, -1))


def co_occurrence(pixels: DataFrame, levels: int = 32) -> DataFrame:
    """slice, a, b, p: shares of the pairs of grey levels at the four offsets; values are scaled to the levels within a slice."""
    ends = pixels.groupBy("slice").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("hi > lo")
    q = pixels.join(ends, "slice").select("slice", "y", "x", F.rint((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1)).cast("int").alias("q"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in OFFSETS]))
    near = q.withColumn("o", steps).select("slice", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("q").alias("a"))
    n = near.join(q.withColumnRenamed("q", "b"), ["slice", "y", "x"]).groupBy("slice", "a", "b").agg(F.count("*").alias("n"))
    total = n.groupBy("slice").agg(F.sum("n").alias("t"))
    return n.join(total, "slice").select("slice", "a", "b", (F.col("n") / F.col("t")).alias("p"))


def texture(pixels: DataFrame) -> DataFrame:
    """slice and the six figures of its grey-level co-occurrence: contrast, dissimilarity, asm, energy, homogeneity, correlation."""
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    sums = {"contrast": (a - b) * (a - b) * p, "dissimilarity": F.abs(a - b) * p, "asm": p * p, "homogeneity": p / (1 + (a - b) * (a - b)), "ma": a * p, "mb": b * p, "aa": a * a * p, "bb": b * b * p, "ab": a * b * p}
    s = co_occurrence(pixels).groupBy("slice").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    spread = F.sqrt((F.col("aa") - F.col("ma") * F.col("ma")) * (F.col("bb") - F.col("mb") * F.col("mb")))
    correlation = F.when(spread > 1e-12, (F.col("ab") - F.col("ma") * F.col("mb")) / spread)
    return s.select("slice", "contrast", "dissimilarity", "asm", F.sqrt("asm").alias("energy"), "homogeneity", correlation.alias("correlation"))


def wavelets(pixels: DataFrame, small: float = 1e-3) -> DataFrame:
    """slice, wcs (mean size), wce (energy) and wqs (share of small ones) of the detail coefficients of one Haar step over full quads of pixels."""
    at = lambda y, x: F.max(F.when((F.col("y") % 2 == y) & (F.col("x") % 2 == x), F.col("v")))
    quads = pixels.groupBy("slice", F.floor(F.col("y") / 2).alias("i"), F.floor(F.col("x") / 2).alias("j"))
    q = quads.agg(F.count("*").alias("n"), at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d")).filter("n = 4")
    a, b, c, d = (F.col(x) for x in "abcd")
    detail = F.explode(F.array((a - b + c - d) / 4, (a + b - c - d) / 4, (a - b - c + d) / 4))
    k = q.select("slice", detail.alias("k"))
    return k.groupBy("slice").agg(F.avg(F.abs("k")).alias("wcs"), F.sum(F.col("k") * F.col("k")).alias("wce"), F.avg((F.abs("k") < small).cast("double")).alias("wqs"))


def local_contrast(pixels: DataFrame) -> DataFrame:
    """slice, cpp: the mean of each pixel less an eighth of its neighbours, outside 0. Each pixel counts once, and less an eighth for each neighbour
    that it has, so no neighbours are joined: for full rectangles."""
    size = pixels.groupBy("slice").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    side = lambda c, most: 1 + (F.col(c) > 0).cast("int") + (F.col(c) < F.col(most)).cast("int")
    weight = 1 - (side("y", "h") * side("x", "w") - 1) / 8
    return pixels.join(size, "slice").groupBy("slice").agg(F.avg(F.col("v") * weight).alias("cpp"))


def peak_noise(pixels: DataFrame, reach: int = 2) -> DataFrame:
    """slice, psnr: decibels of the highest value over the mean square of what a median filter of 5 x 5 takes away, outside 0."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    near = pixels.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step))
    places = near.select("slice", "y", "x", F.col("v").alias("own"), (F.col("y") + F.col("dy")).alias("ny"), (F.col("x") + F.col("dx")).alias("nx"))
    other = pixels.select("slice", F.col("y").alias("ny"), F.col("x").alias("nx"), "v")
    m = places.join(other, ["slice", "ny", "nx"], "left").groupBy("slice", "y", "x").agg(F.max("own").alias("own"), F.median(F.coalesce("v", F.lit(0.0))).alias("m"))
    s = m.groupBy("slice").agg(F.max("own").alias("peak"), F.avg((F.col("own") - F.col("m")) * (F.col("own") - F.col("m"))).alias("mse"))
    return s.select("slice", F.when((F.col("peak") > 0) & (F.col("mse") > 0), 10 * F.log10(F.col("peak") * F.col("peak") / F.col("mse"))).alias("psnr"))


def bands(h: int, w: int) -> dict[str, np.ndarray]:
    """Which frequencies of a slice are low, high, and high for their ratio: radii of shares of the smaller side, two pixels at least."""
    side = min(h, w)
    r = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :])
    share = lambda s, least: max(least, int(s * side))
    low, ring = share(0.1, 2), share(0.15, 2)
    inner = share(0.15, low + 1)
    between = lambda a, b: (r >= a / side) & (r <= b / side)
    return {"low": r <= low / side, "high": between(ring, share(0.45, ring + 1)), "ratio": between(inner, share(0.45, inner + 1))}


def spectrum(pixels: DataFrame) -> DataFrame:
    """slice, lfr, hfr, snrf: mean magnitude of the low and of the high frequencies, and their ratio. A slice is transformed in a task."""

    def one(key, frame):
        image = np.zeros((int(frame["y"].max()) + 1, int(frame["x"].max()) + 1))
        image[frame["y"], frame["x"]] = np.nan_to_num(frame["v"])
        size, masks = np.abs(np.fft.fft2(image)), bands(*image.shape)
        mean = {k: float(size[m].mean()) if m.any() else None for k, m in masks.items()}
        ratio = mean["ratio"] / (mean["low"] + 1e-8) if mean["ratio"] is not None else None
        return pd.DataFrame([(key[0], mean["low"], mean["high"], ratio)], columns=["slice", "lfr", "hfr", "snrf"])

    return pixels.groupBy("slice").applyInPandas(one, "slice long, lfr double, hfr double, snrf double")


def failures(metrics: DataFrame, key: str) -> DataFrame:
    """key, failed: how many of the other columns aren't finite numbers."""
    bad = [(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in metrics.columns if c != key]
    return metrics.select(key, sum(bad[1:], bad[0]).alias("failed"))
