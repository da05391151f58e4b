"""Special functions for p-values, in plain Python and NumPy, and as Pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b) if an * d + b else 1e300
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def chi2_tail(x: float | None, df: float | None) -> float | None:
    """P(X >= x) of the chi-squared distribution; None stays None."""
    if x is None or df is None or math.isnan(x) or df <= 0:
        return None
    return gamma_q(df / 2, x / 2)


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def hypergeometric(n1: int, n2: int, k: int) -> tuple[int, np.ndarray]:
    """The first x and the probabilities of x, x + 1, ... of k drawn from n1 and n2, by the ratio of neighbours from the mode on
    both ways, until they are under 1e-20 of the largest: memory and time go with the spread, not with the cells."""
    lo, hi = max(0, k - n2), min(k, n1)
    mode = min(hi, max(lo, (n1 + 1) * (k + 1) // (n1 + n2 + 2)))
    up, down = [1.0], []
    x = mode
    while x < hi and up[-1] > 1e-20:
        up.append(up[-1] * (n1 - x) * (k - x) / ((x + 1) * (n2 - k + x + 1)))
        x += 1
    x, w = mode, 1.0
    while x > lo and w > 1e-20:
        w *= x * (n2 - k + x) / ((n1 - x + 1) * (k - x + 1))
        down.append(w)
        x -= 1
    p = np.array(down[::-1] + up)
    return mode - len(down), p / p.sum()


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """The two-sided exact p of a 2x2 table: the tables that are as likely as this one or less."""
    first, p = hypergeometric(a + b, c + d, a + c)
    own = p[a - first] if first <= a < first + len(p) else 0.0
    return float(min(1.0, p[p <= own * (1 + 1e-7)].sum()))


def hypergeometric_tail(a: int, b: int, c: int, d: int) -> float:
    """P(X >= a) for the same margins."""
    first, p = hypergeometric(a + b, c + d, a + c)
    return float(min(1.0, p[max(0, a - first) :].sum()))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) for a in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*(int(v) for v in row)) for row in zip(a, b, c, d, strict=True)], dtype="float64")
