"""Operators on small literal tables."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.functions import text as T
from tessera.operators import matrices, partitions, relational, statistics


def test_corrections_keep_nulls_and_families(spark):
    df = spark.createDataFrame([("a", "f", 0.01), ("b", "f", 0.02), ("c", "f", 0.03), ("d", "f", None), ("e", "g", 0.04)], "id string, family string, p double")
    q = {r.id: r.q for r in statistics.benjamini_hochberg(df, ["family"]).collect()}
    h = {r.id: r.p_holm for r in statistics.holm(df, ["family"]).collect()}
    assert q["d"] is None and h["d"] is None
    assert [round(q[k], 9) for k in "abce"] == [0.03, 0.03, 0.03, 0.04]
    assert [round(h[k], 9) for k in "abce"] == [0.03, 0.04, 0.04, 0.04]


def test_odds_ratio_of_a_table_with_a_zero(spark):
    df = spark.createDataFrame([(1, 1, 0, 2)], "a int, b int, c int, d int")
    odds = statistics.odds_ratio(*[F.col(c) for c in "abcd"])[0]
    assert df.select(odds.alias("x")).first().x == pytest.approx(5.0)


def test_special_functions():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.48571428571)
    assert special.chi2_tail(None, 3) is None


def test_jaccard_distances(spark):
    df = spark.createDataFrame([(0, "x"), (2, "x"), (2, "y")], "k int, f string")
    assert [(r.i, r.j, r.value) for r in matrices.set_distance(df, "k", "f").collect()] == [(0, 2, 0.5)]


def test_recurrence_similarity(spark):
    rows = [(s, 1) for s in "abc"] + [(s, 2) for s in "bcde"]
    out = partitions.recurrence(spark.createDataFrame(rows, "set string, node int")).collect()
    assert [(r.i, r.j, r.shared, r.value) for r in out] == [(1, 2, 2, 0.5)]


def test_closed_sets(spark):
    sets = {"a": [1, 2, 3], "b": [1, 2, 3], "c": [2, 3], "d": [3, 4]}
    rows = [(k, v) for k, own in sets.items() for v in own]
    out = {tuple(r.members): r.support for r in partitions.closed_sets(spark.createDataFrame(rows, "set string, node int")).collect()}
    assert out == {(1, 2, 3): 2, (2, 3): 3, (3, 4): 1, (3,): 4}


def test_linkage_and_medoids_find_two_blocks():
    d = np.where(np.equal.outer([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1]), 0.1, 0.9)
    np.fill_diagonal(d, 0)
    for label in (partitions.linkage_cut(d, clusters=2), partitions.linkage_cut(d, threshold=0.5, method="average"), partitions.kmedoids(d, 2)):
        assert len(set(label[:3])) == len(set(label[3:])) == 1 and label[0] != label[3]


def test_optimal_assignment_beats_greedy():
    gain = np.array([[0.9, 0.8, 0.1], [0.8, 0.1, 0.0]])
    assert partitions.optimal_assignment(gain) == [(0, 1), (1, 0)]
    assert partitions.optimal_assignment(gain.T) == [(0, 1), (1, 0)]


def test_survival_reaches_zero_when_all_at_risk_go(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 1)], "g string, t int, e int")
    out = [r.survival for r in statistics.kaplan_meier(df, "g", "t", "e").orderBy("t").collect()]
    assert out == [pytest.approx(2 / 3), pytest.approx(2 / 3), 0.0]


def test_text_rules(spark):
    df = spark.createDataFrame([("CT CHEST", ""), ("CHEST AND ABD", ""), ("", "thorax"), (None, None)], "s string, f string")
    assert [r.x for r in df.select(T.chest_only(F.col("s"), F.col("f")).alias("x")).collect()] == [True, False, True, False]
    names = spark.createDataFrame([(" a b/c ",), ("  ",)], "s string").select(T.safe_identifier(F.col("s")).alias("x")).collect()
    assert [r.x for r in names] == ["a_b_c", "artifact"]


def test_mad_features_count_missing_cases_as_zero(spark):
    rows = [(c, "f", 3.0) for c in range(3)] + [(c, "g", 1.0) for c in range(4)]
    out = {r.feature: (r.prevalence, r.mad) for r in relational.mad_features(spark.createDataFrame(rows, "case_id int, feature string, value double"), 1.0, 0.5).collect()}
    assert out == {"f": (0.75, 0.0), "g": (1.0, 0.0)}


def test_silhouette_of_one_alone_is_zero(spark):
    p = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (1, 2, 0.7)], "i long, j long, value double")
    g = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "k long, g string")
    s = {r.i: r.s for r in matrices.silhouette(p, g, "k", "g").collect()}
    assert s[2] == 0.0 and math.isclose(s[0], (0.9 - 0.1) / 0.9)


def test_two_by_two_tables_take_all_rows(spark):
    from tessera import catalog

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = catalog.queries()["sta13_fisher_enrichment"](spark, data).collect()
    assert sum(r.a + r.b + r.c + r.d for r in rows) == spark.read.parquet(f"{data}/lineitem.parquet").filter("l_returnflag is not null and l_quantity is not null").count()


def test_models_of_customers_take_all_rows(spark):
    from tessera import catalog

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal").toPandas()
    own = rows["c_mktsegment"] == "BUILDING"
    gap = np.subtract.outer(rows.loc[own, "c_acctbal"].to_numpy(), rows.loc[~own, "c_acctbal"].to_numpy())
    assert catalog.queries()["sta5_bootstrap_delta"](spark, data).first().delta == pytest.approx(np.sign(gap).mean())

    orders = spark.read.parquet(f"{data}/orders.parquet").groupBy("o_custkey").agg(F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("event")).toPandas()
    both = orders.merge(rows, left_on="o_custkey", right_on="c_custkey")
    x = np.stack([both["c_acctbal"] / 1000, both["c_mktsegment"] == "BUILDING"], axis=1).astype(float)
    beta = {r.term: r.beta for r in catalog.queries()["sta36_cox"](spark, data).collect()}
    got, days, event, n = np.array([beta["balance"], beta["building"]]), both["days"].to_numpy(), both["event"].to_numpy(bool), len(both)

    def likelihood(b):
        w, out = np.exp(x @ b), -0.005 * n * b @ b
        for t in np.unique(days[event]):
            dead = (days == t) & event
            m = dead.sum()
            out += (x[dead] @ b).sum() - sum(np.log(w[days >= t].sum() - i / m * w[dead].sum()) for i in range(m))
        return out

    assert all(likelihood(got) > likelihood(got + step) for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]))


def test_rest_of_values_that_differ_when_made_twice(spark, monkeypatch):
    """sums of doubles depend on the order of their rows; the rest of a group is all other rows all the same."""
    import random

    from tessera.plans import suites

    rows = spark.createDataFrame([("spend", n, "ab"[n % 2], float(n)) for n in range(40)], "feature string, node long, group string, value double")
    noise = F.udf(lambda x: x + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    monkeypatch.setattr(suites, "_spend", lambda spark, d: rows.withColumn("value", noise("value")))
    assert [(r.n1, r.n2) for r in suites.sec2(spark, None).collect()] == [(20, 20), (20, 20)]
