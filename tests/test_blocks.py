"""Pairs by blocks against brute force on small tables, with blocks of a few rows, and without a shuffle of pairs or copies."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import blocks, matrices, partitions


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "in_blocks", lambda df, size=1024, own=blocks.in_blocks: own(df, 7))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["cosine", "euclidean", "correlation"])
def test_vector_pairs(spark, small, kind):
    x = np.random.default_rng(1).normal(size=(60, 5))
    x[3] = 2.0  # without spread
    rows = spark.createDataFrame([(100 - i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    got = {(r.i, r.j): r.value for r in matrices.pairs(rows, "k", "v", kind).collect()}
    c = x - x.mean(axis=1, keepdims=True)
    size = np.linalg.norm(c, axis=1)
    c = np.divide(c, size[:, None], out=np.zeros_like(c), where=size[:, None] > 1e-12)
    want = {"cosine": lambda a, b: 1 - x[a] @ x[b], "euclidean": lambda a, b: np.linalg.norm(x[a] - x[b]), "correlation": lambda a, b: 1 - c[a] @ c[b]}[kind]
    assert set(got) == set(itertools.combinations(range(41, 101), 2))
    assert all(v == pytest.approx(want(100 - i, 100 - j), abs=1e-9) for (i, j), v in got.items())


def test_no_rows_and_one_row(spark):
    rows = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    assert matrices.pairs(rows, "k", "v").count() == matrices.pairs(rows.limit(0), "k", "v").count() == 0


def test_set_distances(spark, small):
    draw = np.random.default_rng(2)
    sets = {f"c{i}": {f"x{v}" for v in draw.integers(0, 12, draw.integers(0, 5))} for i in range(40)}
    rows = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s for _ in range(2)], "k string, x string")
    cases = spark.createDataFrame([(k,) for k in sets], "k string")
    got = {(r.i, r.j): r.value for r in matrices.full_set_distance(cases, rows, "k", "x", 0.5).collect()}
    assert got == {(i, j): pytest.approx(1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) if sets[i] | sets[j] else 0.5 for i, j in itertools.combinations(sorted(sets), 2)}
    near = {(r.i, r.j): r.value for r in matrices.set_distance(rows, "k", "x").collect()}
    assert near == {(i, j): got[i, j] for i, j in got if sets[i] & sets[j]}


def members(spark):
    """Runs that lack nodes, null labels, and what the pairs of nodes share: same, seen by run."""
    draw = np.random.default_rng(3)
    rows = [(r, n, None if draw.random() < 0.1 else int(draw.integers(0, 4))) for n in range(40) for r in range(6) if draw.random() < 0.8]
    held = {n: {r: x for r, m, x in rows if m == n} for n in range(40)}
    same = lambda i, j, runs: sum(held[i].get(r) is not None and held[i][r] == held[j].get(r) for r in runs)
    seen = lambda i, j, runs: sum(r in held[i] and r in held[j] for r in runs)
    return spark.createDataFrame(rows, "run int, node long, label int"), same, seen


def test_coassignments(spark, small):
    rows, same, seen = members(spark)
    pairs = [p for p in itertools.combinations(range(40), 2) if same(*p, range(6))]
    got = {(r.i, r.j): (r.same, r.seen, r.value) for r in partitions.coassignment(rows, "run", "node", "label").collect()}
    assert got == {p: (same(*p, range(6)), seen(*p, range(6)), same(*p, range(6)) / seen(*p, range(6))) for p in pairs}
    halves = [range(0, 6, 2), range(1, 6, 2)]
    got = {(r.i, r.j): r.value for r in partitions.combined_coassignment(rows, "run", "node", "label", [F.expr(f"run % 2 = {h}") for h in (0, 1)]).collect()}
    assert got == {p: pytest.approx(sum(same(*p, h) / max(1, seen(*p, h)) for h in halves) / 2) for p in pairs}
    total = {r.i: (r.mass, r.partners) for r in partitions.coassignment_totals(rows, "run", "node", "label").collect()}
    for n in range(40):
        own = [same(*p, range(6)) / seen(*p, range(6)) for p in pairs if p[0] == n]
        assert total.get(n, (0, 0)) == (pytest.approx(sum(own)), len(own))


def test_recurrence_by_blocks(spark, small):
    rows, _, _ = members(spark)
    sets = rows.select(F.concat_ws("|", "run", F.coalesce("label", F.lit(-1))).alias("set"), "node")
    held = {}
    for r in sets.collect():
        held.setdefault(r.node, set()).add(r.set)
    got = {(r.i, r.j): (r.shared, r.value) for r in partitions.recurrence(sets).collect()}
    shared = {(i, j): len(held[i] & held[j]) for i, j in itertools.combinations(sorted(held), 2)}
    assert got == {(i, j): (n, n / max(len(held[i]), len(held[j]))) for (i, j), n in shared.items() if n}


def test_many_items(spark):
    """Counts of common items go through more items than a matrix has columns."""
    import pyarrow as pa

    a, b = (pa.table({"items": pa.array([list(range(s, s + 50)), [], [s, None, s]])}) for s in (0, 30))
    want = [[20, 0, 2], [0, 0, 0], [0, 0, 0]]
    assert blocks.common(a, b, "items").tolist() == blocks.common(a, b, "items", 7).tolist() == want


@pytest.mark.parametrize("name", ["mat4_correlation", "clu5_consensus", "clu8_recurrence", "clu12_combined", "sec35_variable_empty_distance"])
def test_pairs_are_not_shuffled(spark, name):
    """neither pairs nor a copy of a row for each block is dealt out."""
    assert "Exchange" not in plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_totals_are_added_up_by_blocks(spark):
    """F16: what is shuffled has a row for each node of a pair of blocks."""
    df = catalog.queries()["mat26_mean_coassignment"](spark, "/root/testdata/sf0.001")
    assert "CartesianProduct" in plan(df) and df.agg(F.sum("partners")).first()[0] == catalog.queries()["clu5_consensus"](spark, "/root/testdata/sf0.001").count()


def test_correlations_of_pairs(spark, small):
    """in runs of a few pairs, with ties within and across blocks, against ranks over all pairs; the pairs are rows nowhere."""
    import pandas as pd

    x = np.random.default_rng(6).integers(-2, 3, (40, 3)) + 0.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = pd.DataFrame([(1 - u[i] @ u[j], np.linalg.norm(x[i] - x[j])) for i, j in itertools.combinations(range(40), 2)])
    for share in (20, 1 << 19):
        got = matrices.pair_correlations(rows, "k", "v", ("cosine", "euclidean"), share=share).first()
        assert got.pearson == pytest.approx(pairs.corr().iloc[0, 1])
        assert got.spearman == pytest.approx(pairs.round(10).rank().corr().iloc[0, 1])


def test_no_rank_joins(spark, monkeypatch):
    monkeypatch.setattr(matrices, "average_ranks", None)
    assert catalog.queries()["mat12_correlation"](spark, "/root/testdata/sf0.001").count() == 1


def _ranked(spark, x):
    import pandas as pd

    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = pd.DataFrame([(1 - u[i] @ u[j], np.linalg.norm(x[i] - x[j])) for i, j in itertools.combinations(range(len(x)), 2)])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), pairs.corr().iloc[0, 1], pairs.round(10).rank().corr().iloc[0, 1]


def test_correlations_without_dealing_pairs(spark, small, monkeypatch):
    """pairs of nearly unit vectors are counted, not dealt; what the bounds settle is what ranks over all pairs give."""
    monkeypatch.setattr(matrices, "_dealt_correlations", None)
    x = np.random.default_rng(8).normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[20:22] = x[20]  # copies
    rows, pearson, spearman = _ranked(spark, x.astype(np.float32).astype(float))
    got = matrices.pair_correlations(rows, "k", "v", ("cosine", "euclidean")).first()
    assert (round(got.pearson, 6), round(got.spearman, 6)) == (round(pearson, 6), round(spearman, 6))


def test_correlations_that_ranges_leave_open(spark, small):
    """few ranges don't settle the digits, so the pairs are sorted; bounds of any number of ranges hold the correlation of ranks."""
    x = np.random.default_rng(9).normal(size=(50, 4)) * np.random.default_rng(10).uniform(0.2, 3, (50, 1))
    rows, pearson, spearman = _ranked(spark, x)
    packed = blocks.in_blocks(rows)
    assert matrices._counted_correlations(packed, ("cosine", "euclidean"), 10, 6, 64) is None
    got = matrices.pair_correlations(rows, "k", "v", ("cosine", "euclidean"), ranges=64).first()
    assert (got.pearson, got.spearman) == (pytest.approx(pearson, abs=1e-12), pytest.approx(spearman, abs=1e-12))
    for ranges, digits in ((1 << 12, 1), (1 << 20, 3)):
        found = matrices._counted_correlations(packed, ("cosine", "euclidean"), 10, digits, ranges)
        assert found is not None and round(found[1], digits) == round(spearman, digits)


def test_bounds_of_ranks():
    """Sums over ranges bound the correlation of any ranks in them."""
    draw = np.random.default_rng(11)
    for share in (0.0, 0.5, 0.99, -0.99):
        a, b = draw.permutation(400) + 1.0, draw.normal(size=400)
        b = (share * (a - 200) / 115 + (1 - abs(share)) * b).argsort().argsort() + 1.0
        for width in (1, 5, 80):
            mean, within = [], []
            for r in (a, b):
                at = ((r - 1) // width).astype(int)
                mean.append(np.array([r[at == g].mean() for g in at]) - r.mean())
                within.append((400 // width) * width * (width**2 - 1) / 12)
            low, high = matrices._bounds(float(mean[0] @ mean[1]), *((float(m @ m), w) for m, w in zip(mean, within)))
            assert low - 1e-9 <= np.corrcoef(a, b)[0, 1] <= high + 1e-9 and (width > 1 or high - low < 1e-5)
