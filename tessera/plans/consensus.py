"""Queries: clustering of cases, consensus over draws, cores and families, and partitions matched with each other (2.5 to 2.7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import matrices as M
from tessera.operators import models as L
from tessera.operators import partitions as P
from tessera.plans.partitions import _OVER, _RUNS, _consensus, _joint_means, _overlaps, _relations, _runs, _sets
from tessera.plans.registry import query, table

VIEWS, WIDTH = 4, 16  # four views of the vectors: entries 0-15, 16-31, 32-47, 48-63


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _cosine_matrix(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    out = 1 - unit @ unit.T
    np.fill_diagonal(out, 0)
    return np.maximum((out + out.T) / 2, 0)


def cohort_views(spark, d) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cases in order, and an affinity of them for each view: a matrix with a row for each case, so it is for cohorts."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    return rows["vec_id"].to_numpy(), [L.kernel(_cosine_matrix(x[:, v * WIDTH : (v + 1) * WIDTH])) for v in range(VIEWS)]


@query("clu2_kmedoids")
def clu2(spark, d):
    """Three medoids in each label of the vectors, a group in a task."""

    def one(key, frame):
        frame = frame.sort_values("vec_id")
        label = P.kmedoids(_cosine_matrix(np.array(frame["embedding"].tolist(), float)), min(3, len(frame)), 0, "heuristic")
        return pd.DataFrame({"label": key[0], "node": frame["vec_id"], "cluster": label})

    return table(spark, d, "embeddings").groupBy("label").applyInPandas(one, "label int, node long, cluster long")


@query("sec41_cluster_once")
def sec41(spark, d):
    """Each algorithm with the options of three repeats, in each label of the vectors."""

    def one(key, frame):
        frame = frame.sort_values("vec_id")
        affinity = L.kernel(_cosine_matrix(np.array(frame["embedding"].tolist(), float)), 5)
        affinity /= affinity.max()
        np.fill_diagonal(affinity, 1)
        rows = [(key[0], a, r, n, int(c)) for a in ("hierarchical", "spectral", "kmedoids") for r in range(3) for n, c in zip(frame["vec_id"], P.cluster_once(affinity, 2, a, r), strict=True)]
        return pd.DataFrame(rows, columns=["label", "algorithm", "repeat", "node", "cluster"])

    return table(spark, d, "embeddings").groupBy("label").applyInPandas(one, "label int, algorithm string, repeat int, node long, cluster int")


CANDIDATES, REPEATS = (2, 3, 4), 24


def _resampled(spark, d):
    cases, views = cohort_views(spark, d)
    out = P.resampled_consensus(spark, views, CANDIDATES, REPEATS)
    names = spark.createDataFrame(pd.DataFrame({"pos": range(len(cases)), "node": cases}), "pos long, node long")
    return out.join(names.toDF("i", "ni"), "i").join(names.toDF("j", "nj"), "j").select("k", F.col("ni").alias("i"), F.col("nj").alias("j"), "seen", "value")


@query("clu3_resampled_consensus")
def clu3(spark, d):
    return _rounded(_resampled(spark, d), "value", places=9)


@query("clu4_candidates")
def clu4(spark, d):
    """Sets of each k by average linkage of its consensus, named K{k}_C{number} by their first case. A draw, then a k, lies in a task that holds a matrix of the cases."""
    sets = P.consensus_sets(P.drawn_labels(table(spark, d, "embeddings"), "vec_id", "embedding", VIEWS, CANDIDATES, REPEATS))
    return sets.select(F.format_string("K%d_C%04d", "k", F.col("cluster") + 1).alias("set_id"), "node")


def _kept(x):
    """Accepted sets: those with a tenth of the cases or more."""
    return x.filter("10 * size >= cases")


def _accepted(spark, d):
    """set, node, run of the accepted sets of all runs."""
    s = _sets(spark, d)
    n = s.groupBy("set").agg(F.count("*").alias("size")).crossJoin(F.broadcast(table(spark, d, "embeddings").agg(F.count("*").alias("cases"))))
    return s.join(_kept(n).select("set"), "set", "left_semi").withColumn("run", F.floor(F.col("set") / 8).cast("int"))


_ACCEPTED = f"""{_RUNS}, n AS (SELECT run * 8 + label AS set, count(*) AS n FROM m GROUP BY 1), ac AS (SELECT run * 8 + label AS set, run, node FROM m SEMI JOIN
    (SELECT * FROM n WHERE 10 * n >= (SELECT count(*) FROM embeddings)) k ON k.set = run * 8 + label), z AS (SELECT run, set, count(*) AS n FROM ac GROUP BY 1, 2),
    o AS (SELECT a.run AS ra, b.run AS rb, a.set AS a, b.set AS b, count(*) AS shared FROM ac a JOIN ac b USING (node) WHERE a.run < b.run GROUP BY ALL),
    x AS (SELECT o.*, p.n AS na, q.n AS nb, shared * 1.0 / (p.n + q.n - shared) AS jaccard FROM o JOIN z p ON p.set = a JOIN z q ON q.set = b)"""


def _assignment(gains: str, rows: int, columns: int, keys: str) -> str:
    """CTEs that end in `best`: keys, total and path (the column of each row, -1: none) of the largest total of `gains` (keys, r, c, v), by subsets."""
    steps = [f"t0 AS (SELECT {keys}, 0 AS mask, CAST(0 AS DOUBLE) AS total, CAST([] AS INTEGER[]) AS path FROM (SELECT DISTINCT {keys} FROM {gains}))"]
    for i in range(rows):
        steps.append(f"""t{i + 1} AS (SELECT {keys}, mask, max(total) AS total, arg_max(path, total) AS path FROM (SELECT {keys}, mask | (1 << c) AS mask, total + v AS total, list_append(path, c) AS path
        FROM t{i} JOIN {gains} USING ({keys}) WHERE r = {i} AND mask & (1 << c) = 0 UNION ALL SELECT {keys}, mask, total, list_append(path, -1) FROM t{i}) GROUP BY {keys}, mask)""")
    return ", ".join([*steps, f"best AS (SELECT {keys}, max(total) AS total, arg_max(path, total) AS path FROM t{rows} GROUP BY {keys})"])


def _accepted_overlaps(spark, d):
    s = _accepted(spark, d).select("set", "node")
    run = lambda c: F.floor(F.col(c) / 8).cast("int")
    return P.set_overlaps(s, s).withColumns({"ra": run("a"), "rb": run("b")}).filter("ra < rb")


def _sizes(spark, d):
    return _accepted(spark, d).groupBy("run", "set").agg(F.count("*").alias("n"))


def _matched_runs(spark, d):
    """ra, rb, a, b, jaccard, shared: the accepted sets of any two runs, matched."""
    sizes = _sizes(spark, d)
    runs = sizes.select("run").distinct()
    pairs = runs.toDF("ra").join(runs.toDF("rb"), F.expr("ra < rb"))
    left = pairs.join(sizes.select(F.col("run").alias("ra"), F.col("set").alias("a")), "ra").select("ra", "rb", "a")
    right = pairs.join(sizes.select(F.col("run").alias("rb"), F.col("set").alias("b")), "rb").select("ra", "rb", "b")
    return P.matched(_accepted_overlaps(spark, d), left, right, ["ra", "rb"])


_GAINS = "gn AS (SELECT ra, rb, CAST(a % 8 AS INTEGER) AS r, CAST(b % 8 AS INTEGER) AS c, jaccard AS v FROM x)"
_COUNTS = "ct AS (SELECT a.run AS ra, b.run AS rb, a.k AS ka, b.k AS kb FROM (SELECT run, count(*) AS k FROM z GROUP BY 1) a JOIN (SELECT run, count(*) AS k FROM z GROUP BY 1) b ON a.run < b.run)"


@query(
    "cmp2_run_comparison",
    f"""WITH {_ACCEPTED}, {_GAINS}, {_COUNTS}, {_assignment("gn", 8, 8, "ra, rb")},
    cv AS (SELECT a.run AS ra, b.run AS rb, count(*) AS met FROM ac a JOIN ac b USING (node) WHERE a.run < b.run GROUP BY ALL), nn AS (SELECT run, count(*) AS n FROM ac GROUP BY 1),
    s AS (SELECT ra, rb, sum(shared * (shared - 1) / 2.0) AS s FROM o GROUP BY ALL), sa AS (SELECT ra, rb, sum(n * (n - 1) / 2.0) AS sr FROM (SELECT ra, rb, a, sum(shared) AS n FROM o GROUP BY ALL) GROUP BY ALL),
    sb AS (SELECT ra, rb, sum(n * (n - 1) / 2.0) AS sc FROM (SELECT ra, rb, b, sum(shared) AS n FROM o GROUP BY ALL) GROUP BY ALL)
    SELECT ra, rb, round(met * 1.0 / (p.n + q.n - met), 6) AS coverage, round(total / greatest(ka, kb), 6) AS matched,
    round((s - sr * sc / (met * (met - 1) / 2.0)) / ((sr + sc) / 2 - sr * sc / (met * (met - 1) / 2.0)), 6) AS ari
    FROM best JOIN ct USING (ra, rb) JOIN cv USING (ra, rb) JOIN s USING (ra, rb) JOIN sa USING (ra, rb) JOIN sb USING (ra, rb) JOIN nn p ON p.run = ra JOIN nn q ON q.run = rb""",
)
def cmp2(spark, d):
    """Coverage and agreement of the nodes that both runs accept, and the matched Jaccard over the larger number of sets."""
    x = _accepted_overlaps(spark, d)
    n = _accepted(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("set").alias("k"))
    ari = P.adjusted_rand(x.select("ra", "rb", F.col("a").alias("x"), F.col("b").alias("y"), F.col("shared").alias("n")), ["ra", "rb"])
    both = x.groupBy("ra", "rb").agg(F.sum("shared").alias("both"))
    total = _matched_runs(spark, d).groupBy("ra", "rb").agg(F.sum("jaccard").alias("total"))
    rows = total.join(both, ["ra", "rb"]).join(ari, ["ra", "rb"]).join(n.toDF("ra", "na", "ka"), "ra").join(n.toDF("rb", "nb", "kb"), "rb")
    coverage = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return _rounded(rows.select("ra", "rb", coverage.alias("coverage"), (F.col("total") / F.greatest("ka", "kb")).alias("matched"), "ari"), "coverage", "matched", "ari")


@query(
    "cmp5_padded_jaccard",
    f"""WITH {_ACCEPTED}, {_GAINS}, {_COUNTS}, {_assignment("gn", 8, 8, "ra, rb")}, pt AS (SELECT ra, rb, unnest(path) AS c, unnest(range(8)) AS r FROM best),
    mt AS (SELECT ra, rb, coalesce(v, 0) AS v FROM pt JOIN z ON z.run = ra AND z.set = ra * 8 + r LEFT JOIN gn USING (ra, rb, r, c)), pd AS (SELECT ra, rb, sum(v) AS s, min(v) AS lo, count(*) AS n FROM mt GROUP BY ALL)
    SELECT ra, rb, round(s / greatest(ka, kb), 6) AS mean, round(CASE WHEN ka <> kb THEN 0 ELSE lo END, 6) AS least, greatest(0, kb - ka) AS extra, greatest(0, ka - kb) AS missing FROM pd JOIN ct USING (ra, rb)""",
)
def cmp5(spark, d):
    """The matching padded with zeros to the larger number of sets: mean and least, with the sets that are too many or too few."""
    k = _sizes(spark, d).groupBy("run").agg(F.count("*").alias("k"))
    rows = _matched_runs(spark, d).groupBy("ra", "rb").agg(F.sum("jaccard").alias("s"), F.min("jaccard").alias("lo")).join(k.toDF("ra", "ka"), "ra").join(k.toDF("rb", "kb"), "rb")
    least = F.when(F.col("ka") != F.col("kb"), 0.0).otherwise(F.col("lo"))
    gap = lambda a, b: F.greatest(F.lit(0).cast("long"), F.col(a) - F.col(b))
    out = rows.select("ra", "rb", (F.col("s") / F.greatest("ka", "kb")).alias("mean"), least.alias("least"), gap("kb", "ka").alias("extra"), gap("ka", "kb").alias("missing"))
    return _rounded(out, "mean", "least")


@query(
    "cmp7_directional_jaccard",
    f"""WITH {_ACCEPTED}, {_GAINS}, {_COUNTS}, {_assignment("gn", 8, 8, "ra, rb")}, lf AS (SELECT ra, rb, sum(v) AS s FROM (SELECT ra, rb, a, max(jaccard) AS v FROM x GROUP BY ALL) GROUP BY ALL),
    rt AS (SELECT ra, rb, sum(v) AS t FROM (SELECT ra, rb, b, max(jaccard) AS v FROM x GROUP BY ALL) GROUP BY ALL)
    SELECT ra, rb, round(total / greatest(ka, kb), 6) AS matched, round(s / ka, 6) AS left_to_right, round(t / kb, 6) AS right_to_left FROM best JOIN ct USING (ra, rb) JOIN lf USING (ra, rb) JOIN rt USING (ra, rb)""",
)
def cmp7(spark, d):
    """The matched mean, and the mean best partner in both directions."""
    x = _accepted_overlaps(spark, d)
    k = _sizes(spark, d).groupBy("run").agg(F.count("*").alias("k"))
    best = lambda c, name: x.groupBy("ra", "rb", c).agg(F.max("jaccard").alias("v")).groupBy("ra", "rb").agg(F.sum("v").alias(name))
    total = _matched_runs(spark, d).groupBy("ra", "rb").agg(F.sum("jaccard").alias("total"))
    rows = total.join(best("a", "s"), ["ra", "rb"]).join(best("b", "t"), ["ra", "rb"]).join(k.toDF("ra", "ka"), "ra").join(k.toDF("rb", "kb"), "rb")
    out = rows.select("ra", "rb", (F.col("total") / F.greatest("ka", "kb")).alias("matched"), (F.col("s") / F.col("ka")).alias("left_to_right"), (F.col("t") / F.col("kb")).alias("right_to_left"))
    return _rounded(out, "matched", "left_to_right", "right_to_left")


#: The cores are the labels of the table; each run is a variant of them.
_CORES = f"""{_ACCEPTED}, co AS (SELECT label AS core, count(*) AS size FROM embeddings GROUP BY 1), y AS (SELECT run, label AS core, set, count(*) AS shared FROM ac JOIN embeddings ON vec_id = node GROUP BY ALL),
    gn AS (SELECT run, CAST(core AS INTEGER) AS r, CAST(set % 8 AS INTEGER) AS c, shared, z.n AS n, shared * 1.0 / (co.size + z.n - shared) AS v FROM y JOIN co USING (core) JOIN z USING (run, set)),
    {_assignment("gn", 10, 8, "run")}, pt AS (SELECT run, unnest(path) AS c, unnest(range(10)) AS r FROM best),
    mt AS (SELECT run, r AS core, size, CASE WHEN g.v IS NOT NULL THEN run * 8 + c END AS variant, coalesce(g.shared, 0) AS shared, coalesce(g.n, 0) AS n, coalesce(g.v, 0) AS jaccard FROM pt JOIN co ON core = r LEFT JOIN gn g USING (run, r, c))"""


def _core_matches(spark, d):
    """run, core, variant, jaccard, shared, size, n."""
    core = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("set"), F.col("vec_id").alias("node"))
    ac = _accepted(spark, d)
    x = P.set_overlaps(core, ac.select("set", "node")).withColumn("run", F.floor(F.col("b") / 8).cast("int"))
    size = core.groupBy(F.col("set").alias("a")).agg(F.count("*").alias("size"))
    sizes = _sizes(spark, d)
    left = size.select("a").crossJoin(sizes.select("run").distinct()).select("run", "a")
    out = P.matched(x, left, sizes.select("run", F.col("set").cast("long").alias("b")), ["run"])
    out = out.join(size, "a").join(sizes.select(F.col("set").alias("b"), "n"), "b", "left").na.fill(0, ["n"])
    # a partner that shares nothing is none
    return out.select("run", F.col("a").alias("core"), F.when(F.col("shared") > 0, F.col("b")).alias("variant"), "jaccard", "shared", "size", F.when(F.col("shared") > 0, F.col("n")).otherwise(0).alias("n"))


@query(
    "cmp3_core_matching",
    f"""WITH {_CORES} SELECT run, CAST(core AS INTEGER) AS core, CAST(variant AS INTEGER) AS variant, size, shared, round(shared * 1.0 / size, 6) AS retention,
    round(CASE WHEN n > 0 THEN shared * 1.0 / n ELSE 0 END, 6) AS purity, round(jaccard, 6) AS jaccard FROM mt""",
)
def cmp3(spark, d):
    x = _core_matches(spark, d)
    purity = F.when(F.col("n") > 0, F.col("shared") / F.col("n")).otherwise(0.0)
    return _rounded(x.select("run", "core", "variant", "size", "shared", (F.col("shared") / F.col("size")).alias("retention"), purity.alias("purity"), "jaccard"), "retention", "purity", "jaccard")


@query(
    "sec34_jaccard_by_core",
    f"WITH {_CORES}, k AS (SELECT run, count(*) AS k FROM z GROUP BY 1) SELECT run, round(sum(jaccard) / greatest(10, any_value(k)), 6) AS mean, round(min(jaccard), 6) AS least FROM mt JOIN k USING (run) GROUP BY 1",
)
def sec34(spark, d):
    k = _sizes(spark, d).groupBy("run").agg(F.count("*").alias("k"))
    n = table(spark, d, "embeddings").agg(F.count_distinct("label").alias("cores"))
    rows = _core_matches(spark, d).groupBy("run").agg(F.sum("jaccard").alias("s"), F.min("jaccard").alias("least")).join(k, "run").crossJoin(F.broadcast(n))
    return _rounded(rows.select("run", (F.col("s") / F.greatest("cores", "k")).alias("mean"), "least"), "mean", "least")


@query(
    "sec55_core_comparison",
    f"""WITH {_CORES}, nn AS (SELECT run, sum(n) AS vn FROM z GROUP BY 1) SELECT run, round(sum(shared) * 1.0 / sum(size), 6) AS core_coverage, round(sum(shared) * 1.0 / any_value(vn), 6) AS variant_coverage,
    round(avg(CASE WHEN variant IS NOT NULL THEN jaccard END), 6) AS matched, round(avg(jaccard), 6) AS penalised, count(*) - count(variant) AS unmatched FROM mt JOIN nn USING (run) GROUP BY 1""",
)
def sec55(spark, d):
    whole = _sizes(spark, d).groupBy("run").agg(F.sum("n").alias("vn"))
    x = _core_matches(spark, d).groupBy("run").agg(
        (F.sum("shared") / F.sum("size")).alias("core_coverage"), F.sum("shared").alias("s"), F.avg(F.when(F.col("variant").isNotNull(), F.col("jaccard"))).alias("matched"),
        F.avg("jaccard").alias("penalised"), F.count_if(F.col("variant").isNull()).alias("unmatched"))
    out = x.join(whole, "run").select("run", "core_coverage", (F.col("s") / F.col("vn")).alias("variant_coverage"), "matched", "penalised", "unmatched")
    return _rounded(out, "core_coverage", "variant_coverage", "matched", "penalised")


@query(
    "cmp10_core_recovery",
    f"""WITH {_RUNS}, t AS (SELECT run, e.label AS x, m.label AS y, CAST(count(*) AS DOUBLE) AS n FROM m JOIN embeddings e ON vec_id = node GROUP BY ALL),
    p AS (SELECT run, n, sum(n) OVER (PARTITION BY run) AS t, sum(n) OVER (PARTITION BY run, x) AS r, sum(n) OVER (PARTITION BY run, y) AS c FROM t),
    i AS (SELECT run, 2 * sum(n / t * ln(n * t / (r * c))) / (-sum(n / t * ln(r / t)) - sum(n / t * ln(c / t))) AS nmi, sum(n * (n - 1) / 2) AS s, any_value(t) AS t FROM p GROUP BY 1),
    r AS (SELECT run, sum(n * (n - 1) / 2) AS sr FROM (SELECT run, x, sum(n) AS n FROM t GROUP BY ALL) GROUP BY 1), c AS (SELECT run, sum(n * (n - 1) / 2) AS sc FROM (SELECT run, y, sum(n) AS n FROM t GROUP BY ALL) GROUP BY 1)
    SELECT run, round((s - sr * sc / (t * (t - 1) / 2)) / ((sr + sc) / 2 - sr * sc / (t * (t - 1) / 2)), 6) AS ari, round(nmi, 6) AS nmi FROM i JOIN r USING (run) JOIN c USING (run)""",
)
def cmp10(spark, d):
    t = _runs(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("x")), "node")
    t = t.groupBy("run", "x", F.col("label").alias("y")).agg(F.count("*").alias("n"))
    return _rounded(P.adjusted_rand(t, ["run"]).join(P.normalised_information(t, ["run"]), "run"), "ari", "nmi")


def _recurrence(spark, d):
    return P.recurrence(_accepted(spark, d).select("set", "node"))


@query("clu9_recurrence_subtypes")
def clu9(spark, d):
    """Complete linkage of the recurrence similarity of cases, cut at 0.5, sets of three or more."""
    groups = P.linked_groups(_recurrence(spark, d).select("i", "j", "value"), 0.5)
    wide = groups.groupBy("part").agg(F.count("*").alias("n")).filter("n >= 3")
    return groups.join(wide.select("part"), "part", "left_semi").select(F.col("part").alias("subtype"), "node")


def _acceptance(spark, d):
    """node, value: the share of runs in which the node is in an accepted set."""
    return _accepted(spark, d).groupBy("node").agg((F.count("*") / 8).alias("value"))


@query("clu13_cores")
def clu13(spark, d):
    return P.label_cores(_runs(spark, d), "run", "node", "label", _acceptance(spark, d), 0.5, 3)


@query("clu22_leave_one_k_out")
def clu22(spark, d):
    """Cores without the runs of each k (run modulo 4), matched with the cores of all runs."""
    runs, acceptance = _runs(spark, d), _acceptance(spark, d)
    whole = P.cores(_consensus(spark, d), acceptance, 0.5, 3).select(F.col("core").alias("set"), "node")
    out = None
    for k in range(4):
        joint = P.coassignment(runs.filter(F.col("run") % 4 != k), "run", "node", "label")
        own = P.cores(joint, acceptance, 0.5, 3).select(F.col("core").alias("set"), "node")
        x = P.set_overlaps(whole, own).withColumn("excluded", F.lit(k))
        left = whole.select(F.lit(k).alias("excluded"), F.col("set").alias("a")).distinct()
        right = own.select(F.lit(k).alias("excluded"), F.col("set").alias("b")).distinct()
        n = own.agg(F.count_distinct("set").alias("cores"))
        m = P.matched(x, left, right, ["excluded"]).groupBy("excluded").agg(F.count("*").alias("reference"), F.sum("jaccard").alias("s"), F.min("jaccard").alias("lo")).crossJoin(n)
        row = m.select("excluded", "reference", "cores", (F.col("s") / F.greatest("reference", "cores")).alias("mean"), F.when(F.col("cores") > F.col("reference"), 0.0).otherwise(F.col("lo")).alias("least"))
        out = row if out is None else out.unionByName(row)
    return _rounded(out, "mean", "least")


_FAMILIES = f"""WITH RECURSIVE {_OVER}, cl AS (SELECT a, b FROM x WHERE jaccard >= 0.1 AND overlap >= 0.2), e AS (SELECT a, b FROM cl UNION ALL SELECT b, a FROM cl),
    rc(set, reach) AS (SELECT set, set FROM n UNION SELECT rc.set, e.b FROM rc JOIN e ON rc.reach = e.a), f AS (SELECT set, min(reach) AS family FROM rc GROUP BY 1),
    sz AS (SELECT family, count(*) AS sets, count(DISTINCT (set // 8) % 4) AS ks FROM f GROUP BY 1), cf AS (SELECT family, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS conflicts FROM (SELECT family, set // 8 AS run, count(*) AS n FROM f GROUP BY ALL) GROUP BY 1),
    pr AS (SELECT p.family, count(CASE WHEN jaccard >= 0.1 AND overlap >= 0.2 THEN 1 END) AS close, avg(jaccard) AS mean, min(jaccard) AS least FROM x JOIN f p ON p.set = a JOIN f q ON q.set = b AND q.family = p.family GROUP BY 1)"""


@query(
    "clu16_set_families",
    f"""{_FAMILIES} SELECT CAST(family AS INTEGER) AS family, sets, ks, conflicts, sets >= 2 AND ks >= 2 AS recurrent, sets >= 2 AND ks >= 2 AND conflicts = 0 AND coalesce(close = sets * (sets - 1) / 2, false) AS cohesive,
    round(mean, 6) AS mean_jaccard, round(least, 6) AS least_jaccard FROM sz JOIN cf USING (family) LEFT JOIN pr USING (family)""",
)
def clu16(spark, d):
    sets = _sets(spark, d).select("set").distinct().withColumns({"run": F.floor(F.col("set") / 8), "k": F.floor(F.col("set") / 8) % 4})
    return _rounded(P.families(sets, _overlaps(spark, d), 0.1, 0.2), "mean_jaccard", "least_jaccard")


@query("clu17_cohesive_families")
def clu17(spark, d):
    """Sets of which any two, of different runs, are one to one and reach the thresholds: complete linkage of distances 0 and 1."""
    close = _relations(_overlaps(spark, d).filter("jaccard >= 0.1 and overlap >= 0.2")).filter("relation = 'one-to-one'")
    groups = P.linked_groups(close.select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1.0).alias("value")), 1.0)
    ks = groups.groupBy("part").agg(F.count_distinct(F.floor(F.col("node") / 8) % 4).alias("ks"))
    return groups.join(ks.filter("ks >= 2").select("part"), "part", "left_semi").select(F.col("part").alias("family"), F.col("node").alias("set"))


@query("clu19_macro_states")
def clu19(spark, d):
    """The ten labels clustered by their mean coassignment, for two linkages and three numbers of states; one row for each of the labels."""
    means = _joint_means(spark, d).filter("g <> h").select(F.lit(0).alias("one"), F.col("g").alias("i"), F.col("h").alias("j"), F.col("mean").alias("value"))

    def one(frame):
        nodes = sorted(set(frame["i"]) | set(frame["j"]))
        similar = P.square(frame, nodes, 0.0, 1.0)
        out = []
        for k in (2, 3, 4):
            for method in ("average", "complete"):
                label = P.linkage_cut(1 - similar, clusters=k, method=method)
                same = label[:, None] == label[None, :]
                upper = np.triu(np.ones_like(same), 1).astype(bool)
                inside, outside = similar[same & upper], similar[~same & upper]
                gap = float(inside.mean() - outside.mean()) if len(inside) and len(outside) else None
                out += [(k, method, int(n), int(c), gap) for n, c in zip(nodes, label, strict=True)]
        return pd.DataFrame(out, columns=["k", "linkage", "core", "state", "within_minus_between"])

    return means.groupBy("one").applyInPandas(one, "k int, linkage string, core int, state int, within_minus_between double")


@query(
    "clu29_diverse_medoids",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
    p AS MATERIALIZED (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.label = b.label), m AS (SELECT label, i, avg(s) AS m FROM p GROUP BY 1, 2),
    one AS (SELECT label, arg_max(i, struct_pack(a := round(m, 9), b := -i)) AS x FROM m GROUP BY 1),
    two AS (SELECT m.label, arg_max(m.i, struct_pack(a := round(m - s, 9), b := -m.i)) AS x FROM m JOIN one USING (label) JOIN p ON p.i = m.i AND p.j = one.x WHERE m.i <> one.x GROUP BY 1),
    three AS (SELECT m.label, arg_max(m.i, struct_pack(a := round(m - greatest(p.s, q.s), 9), b := -m.i)) AS x FROM m JOIN one USING (label) JOIN two ON two.label = m.label JOIN p ON p.i = m.i AND p.j = one.x
        JOIN p q ON q.i = m.i AND q.j = two.x WHERE m.i NOT IN (one.x, two.x) GROUP BY 1)
    SELECT label, 1 AS place, x AS node FROM one UNION ALL SELECT label, 2, x FROM two UNION ALL SELECT label, 3, x FROM three""",
)
def clu29(spark, d):
    rows = M.unit_rows(table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("group"), "embedding"), "embedding")
    return M.diverse_medoids(rows, "node", "group", "embedding", 3).select(F.col("group").alias("label"), "place", "node")


_VIEWS_SQL = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), b AS (SELECT unnest(range(4)) AS b),
    vw AS (SELECT 'all' AS view, vec_id, v FROM e UNION ALL SELECT 'only' || b, vec_id, list_slice(v, b * 16 + 1, b * 16 + 16) FROM e, b
        UNION ALL SELECT 'without' || b, vec_id, list_concat(list_slice(v, 1, b * 16), list_slice(v, b * 16 + 17, 64)) FROM e, b),
    vn AS (SELECT view, vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM vw),
    vp AS MATERIALIZED (SELECT x.view, x.vec_id AS i, y.vec_id AS j, round(1 - list_dot_product(x.v, y.v) / (x.n * y.n), 9) AS value FROM vn x JOIN vn y ON x.view = y.view AND x.vec_id < y.vec_id)"""


def _all_views(spark, d):
    """view, vec_id, vector: all entries, each view alone, and all but each view."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    kinds = {"all": F.col("v")}
    for b in range(VIEWS):
        kinds[f"only{b}"] = F.slice("v", b * WIDTH + 1, WIDTH)
        before, after = F.slice("v", 1, b * WIDTH) if b else F.array().cast("array<double>"), F.slice("v", (b + 1) * WIDTH + 1, 64)
        kinds[f"without{b}"] = F.concat(before, after)
    return {name: e.select("vec_id", v.alias("v")) for name, v in kinds.items()}


@query(
    "mat14_affinity_audit",
    f"""WITH {_VIEWS_SQL}, w AS (SELECT view, i, j, value FROM vp UNION ALL SELECT view, j, i, value FROM vp),
    nn AS (SELECT view, i, j FROM (SELECT *, row_number() OVER (PARTITION BY view, i ORDER BY value, j) AS r FROM w) WHERE r <= 10),
    c AS (SELECT y.view, y.i, count(*) AS c FROM nn x JOIN nn y ON x.i = y.i AND x.j = y.j AND x.view = 'all' AND y.view <> 'all' GROUP BY 1, 2),
    k AS (SELECT view, avg(coalesce(c, 0) * 1.0 / (20 - coalesce(c, 0))) AS jaccard FROM (SELECT DISTINCT view, i FROM nn WHERE view <> 'all') LEFT JOIN c USING (view, i) GROUP BY 1),
    r AS (SELECT view, i, j, rank() OVER (PARTITION BY view ORDER BY value) + (count(*) OVER (PARTITION BY view, value) - 1) / 2.0 AS rk FROM vp),
    s AS (SELECT y.view, corr(x.rk, y.rk) AS rho FROM r x JOIN r y ON x.i = y.i AND x.j = y.j AND x.view = 'all' AND y.view <> 'all' GROUP BY 1)
    SELECT view, round(rho, 6) AS rho, round(jaccard, 6) AS jaccard FROM s JOIN k USING (view)""",
)
def mat14(spark, d):
    """Each view against all: rank correlation of the distances, and the mean Jaccard of ten nearest neighbours. Ranks are taken within a view."""
    own = {name: _rounded(M.pairs(M.unit_rows(rows, "v"), "vec_id", "v"), "value", places=9) for name, rows in _all_views(spark, d).items()}
    p = [x.withColumn("view", F.lit(name)) for name, x in own.items()]
    p = P.reduce(lambda a, b: a.unionByName(b), p)
    near = M.neighbours_of(p, ["view"], 10)
    both = near.filter("view <> 'all'").join(near.filter("view = 'all'").select("i", "j"), ["i", "j"]).groupBy("view", "i").agg(F.count("*").alias("c"))
    cases = near.filter("view <> 'all'").select("view", "i").distinct().join(both, ["view", "i"], "left").na.fill(0, ["c"])
    jaccard = cases.groupBy("view").agg(F.avg(F.col("c") / (20 - F.col("c"))).alias("jaccard"))
    ranks = M.average_ranks(p, ["view"], "value")
    x = ranks.filter("view <> 'all'").join(ranks.filter("view = 'all'").select("i", "j", F.col("rank").alias("other")), ["i", "j"])
    return _rounded(x.groupBy("view").agg(F.corr("rank", "other").alias("rho")).join(jaccard, "view"), "rho", "jaccard")


@query(
    "mat19_one_geometry",
    f"""WITH {_RUNS}, g AS (SELECT run, count(*) AS cases, min(node) AS first, max(node) AS last FROM m GROUP BY 1)
    SELECT count(DISTINCT (cases, first, last)) = 1 AS one_geometry, count(*) AS runs, min(cases) AS cases FROM g""",
)
def mat19(spark, d):
    g = _runs(spark, d).groupBy("run").agg(F.count("*").alias("cases"), F.min("node").alias("first"), F.max("node").alias("last"))
    return g.agg((F.count_distinct("cases", "first", "last") == 1).alias("one_geometry"), F.count("*").alias("runs"), F.min("cases").alias("cases"))
