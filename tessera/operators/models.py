"""Operators that Spark SQL can't express: small dense algebra on the driver or in one group, and resampling by tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prune_by(names: list[str], r: np.ndarray, limit: float) -> list[str]:
    """Names kept when no two may have |r| beyond the limit: pairs go by |r| descending, then names; of a pair the one with the larger
    mean |r| to those still there is dropped, in a tie the larger name. The order of the names doesn't matter."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    r = np.abs(r[np.ix_(order, order)])
    live = np.ones(len(order), bool)
    i, j = np.triu_indices(len(order), 1)
    over = r[i, j] > limit
    for _, a, b in sorted(zip(-r[i, j][over], i[over].tolist(), j[over].tolist(), strict=True)):
        if live[a] and live[b]:
            mean = [(r[c][live].sum() - 1) / max(1, live.sum() - 1) for c in (a, b)]
            live[a if mean[0] > mean[1] + 1e-12 else b] = False
    return [names[order[k]] for k in np.flatnonzero(live)]


def prune_correlated(names: list[str], x: np.ndarray, limit: float = 0.95) -> list[str]:
    """As prune_by, of the columns of a matrix; columns that are constant up to rounding are dropped first."""
    spread, scale = x.std(axis=0), np.maximum(1.0, np.abs(x).max(axis=0, initial=0))
    live = [i for i in range(len(names)) if spread[i] > 16 * np.finfo(float).eps * scale[i]]
    return prune_by([names[i] for i in live], np.atleast_2d(np.corrcoef(x[:, live], rowvar=False)) if live else np.zeros((0, 0)), limit)


def correlations(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of the entries of the vectors, and their deviations: sums and products are added up in the tasks, so the rows stay there."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = [np.array(r.s) for r in df.select(vector).mapInArrow(run, "s array<double>").collect()]  # a row for each task
    total = sum(parts)
    width = int(len(total) ** 0.5)
    total = total.reshape(width, width)
    mean = total[0, 1:] / total[0, 0]
    cov = total[1:, 1:] / total[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 0, sd, 1)
    return cov / np.outer(scale, scale), sd


def kernel(distance: np.ndarray, k: int = 20, mu: float = 0.5) -> np.ndarray:
    """As matrices.affinity, of a matrix: the density of Normal(0, mu sigma) at each distance, sigma from the k nearest of both rows."""
    k = min(k, len(distance) - 1)
    near = np.sort(distance + np.diag(np.full(len(distance), -np.inf)), axis=1)[:, 1 : k + 1].mean(axis=1)
    sigma = mu * (near[:, None] + near[None, :] + distance) / 3
    sigma = np.maximum(sigma, np.finfo(float).eps)
    return np.exp(-(distance**2) / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi))


def fuse(affinities: list[np.ndarray], k: int = 20, rounds: int = 20) -> np.ndarray:
    """Similarity network fusion (Wang et al., 2014): each view's full kernel is diffused through its nearest neighbours with the mean
    of the other views, t times; the mean of the views, symmetric, with diagonal 1. One view passes through."""
    if len(affinities) == 1:
        return affinities[0]

    def full(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        np.fill_diagonal(w, 0)
        p = w / np.maximum(2 * w.sum(axis=1, keepdims=True), 1e-300)
        np.fill_diagonal(p, 0.5)
        return (p + p.T) / 2

    def sparse(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        np.fill_diagonal(w, np.inf)
        keep = np.argsort(-w, axis=1, kind="stable")[:, : k + 1]
        np.fill_diagonal(w, np.diag(affinities[0]))
        s = np.zeros_like(w)
        np.put_along_axis(s, keep, np.take_along_axis(w, keep, 1), 1)
        return s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)

    p, s = [full(w) for w in affinities], [sparse(w) for w in affinities]
    for _ in range(rounds):
        p = [full(s[v] @ (sum(p[u] for u in range(len(p)) if u != v) / (len(p) - 1)) @ s[v].T) for v in range(len(p))]
    out = sum(p) / len(p)
    out = (out + out.T) / 2
    np.fill_diagonal(out, 1.0)
    return out


def principal_coordinates(distance: np.ndarray, axes: int = 2) -> np.ndarray:
    """Coordinates from the eigenvectors of the centred kernel; each axis has its largest entry positive."""
    n = len(distance)
    j = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * j @ (distance**2) @ j)
    top = np.argsort(-value)[:axes]
    x = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
    return x * np.sign(x[np.abs(x).argmax(axis=0), range(len(top))])


def pseudo_f(d2: np.ndarray, groups: np.ndarray) -> float:
    """Anderson's pseudo-F of squared distances and groups numbered from 0."""
    n, k = len(groups), groups.max() + 1
    total = d2.sum() / 2 / n
    hot = np.eye(k)[groups]
    within = float((np.einsum("ik,ij,jk->k", hot, d2, hot) / 2 / hot.sum(axis=0)).sum())
    return ((total - within) / (k - 1)) / (within / (n - k)) if within and n > k > 1 else float("nan")


def permanova(spark: SparkSession, distance: np.ndarray, groups: np.ndarray, permutations: int = 999, seed: int = 0) -> dict:
    """pseudo-F, R2 and p = (x + 1) / (N + 1); permutations run in tasks, each with a generator of its own number."""
    d2 = distance**2
    seen = pseudo_f(d2, groups)
    shared = spark.sparkContext.broadcast((d2, groups, seen))

    def run(frames):
        d, g, f = shared.value
        for frame in frames:
            yield pd.DataFrame({"over": [int(pseudo_f(d, np.random.default_rng([seed, int(i)]).permutation(g)) >= f - 1e-12) for i in frame["id"]]})

    over = spark.range(0, permutations, 1, min(permutations, 32)).mapInPandas(run, "over int").groupBy().sum("over").first()[0]
    k, n = groups.max() + 1, len(groups)
    return {"pseudo_f": seen, "r2": seen * (k - 1) / (seen * (k - 1) + n - k), "p": (over + 1) / (permutations + 1), "n": n, "groups": int(k)}


def bootstrap_delta(spark: SparkSession, a: np.ndarray, b: np.ndarray, repeats: int = 2000, seed: int = 0) -> tuple[float | None, float | None, float | None]:
    """Cliff's delta with its 95 % percentile interval, None if a group is empty; repeats run in tasks."""
    if not len(a) or not len(b):
        return None, None, None
    shared = spark.sparkContext.broadcast((np.sort(a), np.sort(b)))

    def delta(x: np.ndarray, y: np.ndarray) -> float:
        y = np.sort(y)
        return float((np.searchsorted(y, x, "left").sum() - (len(y) - np.searchsorted(y, x, "right")).sum()) / len(x) / len(y))

    def run(frames):
        x, y = shared.value
        for frame in frames:
            out = []
            for i in frame["id"]:
                r = np.random.default_rng([seed, int(i)])
                out.append(delta(r.choice(x, len(x)), r.choice(y, len(y))))
            yield pd.DataFrame({"delta": out})

    q = spark.range(0, repeats, 1, min(repeats, 32)).mapInPandas(run, "delta double").selectExpr("percentile(delta, array(0.025, 0.975)) AS q").first().q
    return delta(a, b), q[0], q[1]


def cox(df: DataFrame, time: str, event: str, terms: list[str], penalty: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors of a proportional-hazards model (Efron's ties, ridge penalty per row), by Newton steps.

    Each step is one aggregation of the rows by their distinct times; the driver holds sums for each time, not rows.
    """
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(c).cast("double") for c in terms]
    rows = df.select(time, (F.col(event) == 1).alias("_d"), *[c.alias(f"_x{i}") for i, c in enumerate(x)]).na.drop()
    x = [F.col(f"_x{i}") for i in range(k)]
    beta = np.zeros(k)
    for _ in range(rounds):
        w = F.exp(sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0)))
        sums = [w, *[w * c for c in x], *[w * x[i] * x[j] for i, j in pairs]]
        dead = lambda c: F.when(F.col("_d"), c).otherwise(0.0)
        aggregates = [F.count("*"), F.count_if("_d"), *[F.sum(c) for c in sums], *[F.sum(dead(c)) for c in sums], *[F.sum(dead(c)) for c in x]]
        by = rows.groupBy(time).agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).orderBy(F.desc(time)).collect()  # a row for each distinct time
        table = np.array([r[1:] for r in by], float).reshape(len(by), len(aggregates))
        n, size = table[:, 0].sum(), len(sums)
        g, h = -penalty * n * beta, -penalty * n * np.eye(k)
        risk = np.cumsum(table[:, 2 : 2 + size], axis=0)
        for row, at_risk in zip(table, risk, strict=True):
            m, own = int(row[1]), row[2 + size : 2 + 2 * size]
            if not m:
                continue
            share = at_risk[None, :] - (np.arange(m) / m)[:, None] * own[None, :]
            mean = share[:, 1 : 1 + k] / share[:, :1]
            square = np.zeros((k, k))
            for (i, j), v in zip(pairs, (share[:, 1 + k :] / share[:, :1]).sum(axis=0), strict=True):
                square[i, j] = square[j, i] = v
            g = g + row[2 + 2 * size :] - mean.sum(axis=0)
            h = h - (square - mean.T @ mean)
        step = np.linalg.solve(h, g)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(-h)))


def hazards_test(df: DataFrame, time: str, event: str, term: str, penalty: float = 0.1) -> dict:
    """beta, se, and the test of proportional hazards of one term (Grambsch and Therneau, 1994): chi2 of one degree for the
    correlation of Schoenfeld's residuals with the ranks of the event times; p. One row for each distinct time comes to the driver."""
    from tessera.functions.special import chi2_tail

    beta, se = cox(df, time, event, [term], penalty)
    x, d = F.col(term).cast("double"), F.col(event) == 1
    w = F.exp(float(beta[0]) * x)
    by = df.filter(F.col(term).isNotNull()).groupBy(time).agg(F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.count_if(d).alias("m"), F.sum(F.when(d, x).otherwise(0.0)).alias("sx")).orderBy(F.desc(time)).collect()
    table = np.array([r[1:] for r in by], float).reshape(len(by), 4)
    s0, s1 = np.cumsum(table[:, 0]), np.cumsum(table[:, 1])
    m = table[:, 2][::-1]
    residual = (table[:, 3] - table[:, 2] * s1 / np.maximum(s0, 1e-300))[::-1]
    events = m.sum()
    if events < 2:
        return {"beta": float(beta[0]), "se": float(se[0]), "chi2": None, "p": None}
    rank = np.cumsum(m) - m / 2 + 0.5
    rank = rank - (rank * m).sum() / events
    spread = (rank * rank * m).sum()
    chi2 = float(events * se[0] ** 2 * (rank * residual).sum() ** 2 / spread) if spread > 0 else None
    return {"beta": float(beta[0]), "se": float(se[0]), "chi2": chi2, "p": chi2_tail(chi2, 1)}


def image_quality(frame: pd.DataFrame) -> dict[str, float]:
    """Moments and noise ratios of a slice's foreground and background values (column `fg` tells them apart); ratios fall back to the
    foreground's mean over its deviation where the background is unusable."""
    f, b = frame.loc[frame["fg"], "v"].to_numpy(float), frame.loc[~frame["fg"], "v"].to_numpy(float)
    m, s = (f.mean(), f.std()) if len(f) else (np.nan, np.nan)
    mb, sb = (b.mean(), b.std()) if len(b) else (np.nan, np.nan)
    own = m / s if s else np.nan
    usable = len(b) > 0 and sb > 0
    p = np.clip(f / max(np.linalg.norm(f), 1e-300), 1e-12, None)
    median = lambda v: float(np.median(v**2)) if len(v) else np.nan
    return {
        "MEAN": m, "RNG": f.max() - f.min() if len(f) else np.nan, "VAR": s * s, "CV": 100 * s / m if m else np.nan, "CVP": s / m if m else np.nan,
        "SKW": ((f - m) ** 3).mean() / s**3 if s else np.nan, "KURT": ((f - m) ** 4).mean() / s**4 - 3 if s else np.nan,
        "SNR1": s / sb if usable else own, "SNR2": m / sb if usable else own, "SNR4": m / mb if usable and mb else own,
        "CNR": (m - mb) / sb if usable else own, "CJV": (s + sb) / abs(m - mb) if usable and m != mb else own, "FBER": median(f) / median(b) if usable and median(b) else own,
        "EFC": float(-(p * np.log(p)).sum() / np.log(len(f))) if len(f) > 1 else np.nan,
    }


def matrix_of(long: DataFrame, row: str, col: str, value: str) -> tuple[list, list, np.ndarray]:
    """A small long table as (rows, columns, matrix), 0 where it has none."""
    wide = long.toPandas().pivot_table(index=row, columns=col, values=value, fill_value=0.0)
    return list(wide.index), [str(c) for c in wide.columns], wide.to_numpy(float)


def kernel_factors(x: np.ndarray, width: int) -> list[np.ndarray]:
    """The first `width` columns and the others, each centred and scaled so that its kernel z z' has norm 1 (that of z z' is that of z' z)."""
    halves = [half - half.mean(axis=0) for half in (x[:, :width], x[:, width:])]
    return [z / np.sqrt(np.linalg.norm(z.T @ z)) for z in halves]


def kernel_product(a: np.ndarray, b: np.ndarray) -> float:
    """The sum of the products of the entries of the kernels a a' and b b', from the small matrix a' b."""
    small = a.T @ b
    return float((small * small).sum())
