"""DuckDB SQL for the tails of distributions, which DuckDB lacks, as text."""

from __future__ import annotations


def lower_gamma(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function, by its series of positive terms."""
    term = f"exp(({a} + term_) * ln({x}) - {x} - lgamma({a} + term_ + 1))"
    return f"list_sum(list_transform(range(0, 400), lambda term_: {term}))"


def chi2_tail(x: str, df: str) -> str:
    """P(X >= x); null stays null, and far out it is 0 (as 1 - p it has 15 decimal places)."""
    x, df = f"CAST({x} AS DOUBLE)", f"CAST({df} AS DOUBLE)"
    p = f"1 - {lower_gamma(f'({df} / 2)', f'({x} / 2)')}"
    return f"CASE WHEN {x} IS NULL OR {df} <= 0 THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {x} > 400 THEN 0.0 ELSE greatest(0, {p}) END"


def normal_two_sided(z: str) -> str:
    return chi2_tail(f"({z}) * ({z})", "1")


def fisher(a: str, b: str, c: str, d: str) -> str:
    """The two-sided exact p of [[a, b], [c, d]], cells as whole numbers: the tables that are as likely as this one or less."""
    a, b, c, d = (f"CAST({x} AS BIGINT)" for x in (a, b, c, d))
    fact = lambda x: f"lgamma({x} + 1)"
    log = lambda x: f"-({fact(x)} + {fact(f'({a} + {b} - {x})')} + {fact(f'({a} + {c} - {x})')} + {fact(f'({d} - {a} + {x})')})"
    lows, highs = f"greatest(0, {a} - {d})", f"least({a} + {b}, {a} + {c})"
    grid = f"list_transform(range({lows}, {highs} + 1), lambda cell_: {log('cell_')})"
    own = log(a)
    weight = f"list_transform({grid}, lambda log_: exp(log_ - {own}))"
    return f"least(1.0, list_sum(list_filter({weight}, lambda share_: share_ <= 1 + 1e-7)) / list_sum({weight}))"


def ranked(source: str, keys: str) -> str:
    """CTE `r`: the rows of `source` (keys, x) with average ranks within the keys and the size of each tie."""
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rk,
        count(*) OVER (PARTITION BY {keys}, x) AS t FROM {source} WHERE x IS NOT NULL)"""


def kruskal(source: str, keys: str) -> str:
    """CTEs that end in `kw`: keys, n, k, h, epsilon2, p of the rows (keys, g, x) of `source`."""
    n3 = "(CAST(n AS DOUBLE) * n * n - n)"
    return f"""{ranked(source, keys)}, kg AS (SELECT {keys}, g, sum(rk) AS s, count(*) AS m FROM r GROUP BY ALL),
        ka AS (SELECT {keys}, CAST(sum(m) AS BIGINT) AS n, count(*) AS k, sum(s * s / m) AS ss FROM kg GROUP BY ALL),
        kt AS (SELECT {keys}, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r GROUP BY ALL),
        kh AS (SELECT {keys}, n, k, CASE WHEN k > 1 AND tie < {n3} THEN (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - tie / {n3}) END AS h FROM ka JOIN kt USING ({keys})),
        kw AS (SELECT *, greatest(0, least(1, (h - k + 1) / (n - k))) AS epsilon2, {chi2_tail("h", "k - 1")} AS p FROM kh)"""


def two_samples(source: str, keys: str) -> str:
    """CTEs that end in `mw`: keys, n1, n2, m1, m2 (medians), smd, delta, p of the rows (keys, f, x) of `source`, f telling the first sample."""
    pick = lambda f, x, own: f"{f}(CASE WHEN {own} THEN {x} END)"
    a, b = "CAST(n1 AS DOUBLE)", "CAST(n2 AS DOUBLE)"
    sd = f"sqrt({a} * {b} / 12 * (({a} + {b} + 1) - tie / (({a} + {b}) * ({a} + {b} - 1))))"
    z = f"greatest(abs(u - {a} * {b} / 2) - 0.5, 0) / nullif({sd}, 0)"
    pooled = f"nullif(sqrt((({a} - 1) * v1 + ({b} - 1) * v2) / ({a} + {b} - 2)), 0)"
    return f"""{ranked(source, keys)}, ws AS (SELECT {keys}, count(CASE WHEN f THEN 1 END) AS n1, count(CASE WHEN NOT f THEN 1 END) AS n2,
        {pick("median", "x", "f")} AS m1, {pick("median", "x", "NOT f")} AS m2, {pick("avg", "x", "f")} AS a1, {pick("avg", "x", "NOT f")} AS a2,
        {pick("var_samp", "x", "f")} AS v1, {pick("var_samp", "x", "NOT f")} AS v2, sum(CASE WHEN f THEN rk ELSE 0 END) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r GROUP BY ALL),
        wu AS (SELECT *, r1 - {a} * ({a} + 1) / 2 AS u FROM ws WHERE n1 > 0 AND n2 > 0), wz AS (SELECT *, {z} AS z FROM wu),
        mw AS (SELECT {keys}, n1, n2, m1, m2, (a1 - a2) / {pooled} AS smd, 2 * u / ({a} * {b}) - 1 AS delta, {normal_two_sided("z")} AS p FROM wz)"""


def adjusted(source: str, family: str, tie: str, method: str = "bh", name: str = "adj", out: str = "q") -> str:
    """CTE `name`: the rows of `source` with `out`, adjusted within the family; a null p isn't in it."""
    own = f"PARTITION BY {family}, p IS NULL" if family else "PARTITION BY p IS NULL"
    order = f"({own} ORDER BY p, {tie}"
    count, i = f"count(p) OVER ({own})", f"row_number() OVER {order})"
    if method == "bh":
        value = f"least(1, min(p * {name}_m / {name}_i) OVER ({own} ORDER BY {name}_i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    else:
        value = f"least(1, max(p * ({name}_m - {name}_i + 1)) OVER ({own} ORDER BY {name}_i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    return f"{name}_n AS (SELECT *, {i} AS {name}_i, {count} AS {name}_m FROM {source}), {name} AS (SELECT *, CASE WHEN p IS NOT NULL THEN {value} END AS {out} FROM {name}_n)"
