"""Clustering, consensus, families of tests and dense algebra against brute force on small tables."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import matrices, models, partitions, statistics, suites


def points(n, seed=0, width=2):
    x = np.random.default_rng(seed).random((n, width))
    return np.linalg.norm(x[:, None] - x[None], axis=2)


def cost(distance, label, medoids):
    return sum(distance[i, medoids[c]] for i, c in enumerate(label))


def test_medoids_are_a_fixed_point():
    for seed, init in itertools.product(range(5), ("k-medoids++", "random", "heuristic")):
        d = points(30, seed)
        label = partitions.kmedoids(d, 4, seed, init)
        medoids = [np.flatnonzero(label == c)[d[np.ix_(label == c, label == c)].sum(axis=1).argmin()] for c in range(4)]
        again = d[:, medoids].argmin(axis=1)
        assert cost(d, again, medoids) == pytest.approx(cost(d, label, medoids))
        assert (label == partitions.kmedoids(d, 4, seed, init)).all()


def test_medoids_of_copies_and_errors():
    d = np.zeros((6, 6))
    label = partitions.kmedoids(d, 3, 1)  # all rows are copies: three medoids keep their own labels, ties go to the first
    assert sorted(np.bincount(label, minlength=3)) == [1, 1, 4]
    assert partitions.kmedoids(d, 6, 1).tolist() == partitions.kmedoids(d, 6, 1).tolist() and len(set(partitions.kmedoids(d, 6, 1))) == 6
    with pytest.raises(ValueError):
        partitions.kmedoids(points(5), 2, init="other")
    with pytest.raises(ValueError):
        partitions.kmedoids(points(5), 6)
    with pytest.raises(ArithmeticError):
        partitions.kmedoids(points(60, 3), 5, 0, "heuristic", rounds=1)


def naive_linkage(d, k, method):
    groups = [[i] for i in range(len(d))]
    far = max if method == "complete" else (lambda v: sum(v) / len(v))
    while len(groups) > k:
        _, a, b = min((far([d[i, j] for i in x for j in y]), a, b) for (a, x), (b, y) in itertools.combinations(enumerate(groups), 2))
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups)


def test_linkage_against_the_plain_method():
    for seed, k, method in itertools.product(range(4), (1, 2, 3, 5), ("complete", "average")):
        d = points(14, seed)
        label = partitions.linkage_cut(d, clusters=k, method=method)
        assert sorted(np.flatnonzero(label == c).tolist() for c in set(label)) == naive_linkage(d, k, method)
    assert partitions.linkage_cut(points(1), clusters=1).tolist() == [0]


def test_complete_linkage_blocks_chains(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.1), (7, 8, 0.8), (8, 9, 0.4)], "i long, j long, value double")
    out = {r.node: r.part for r in partitions.linked_groups(pairs, 0.7).collect()}
    assert out[7] == out[8] == 7 and 9 not in out and len({out[1], out[2], out[3]}) == 2
    joined = spark.createDataFrame([(i, 1.0 if i != 2 else 0.2) for i in (1, 2, 3, 7, 8)], "node long, value double")
    assert [(r.core, r.node) for r in partitions.cores(pairs, joined, 0.7, 2).orderBy("node").collect()] == [(7, 7), (7, 8)]


def test_linked_groups_against_one_matrix(spark):
    r = np.random.default_rng(5)
    s = np.triu(r.random((25, 25)) ** 2, 1)
    s = s + s.T
    i, j = np.triu_indices(25, 1)
    pairs = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "value": s[i, j]}))
    label = partitions.linkage_cut(1 - s, threshold=0.5)
    want = {tuple(np.flatnonzero(label == c)) for c in set(label) if (label == c).sum() > 1}
    got: dict = {}
    for row in partitions.linked_groups(pairs, 0.5).collect():
        got.setdefault(row.part, []).append(row.node)
    assert {tuple(sorted(v)) for v in got.values() if len(v) > 1} == want


def test_components_and_families(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 19), (19, 18), (18, 17), (17, 3)], "i long, j long")
    out = {r.node: r.family for r in partitions.components(edges).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 17: 1, 18: 1, 19: 1, 20: 1, 10: 10, 11: 10}
    assert partitions.components(edges.limit(0)).collect() == []
    sets = spark.createDataFrame([(0, 0, 0), (8, 1, 1), (16, 2, 0), (17, 2, 0), (24, 3, 1)], "set long, run int, k int")
    pairs = spark.createDataFrame([(0, 8, 0.9, 1.0), (0, 16, 0.8, 0.9), (8, 16, 0.7, 0.8), (8, 17, 0.2, 0.3), (16, 24, 0.1, 0.1)], "a long, b long, jaccard double, overlap double")
    got = {r.family: r for r in partitions.families(sets, pairs, 0.5, 0.5).collect()}
    assert sorted(got) == [0, 17, 24] and (got[0].sets, got[0].ks, got[0].conflicts, got[0].recurrent, got[0].cohesive) == (3, 2, 0, True, True)
    assert got[0].least_jaccard == pytest.approx(0.7) and not got[17].recurrent and got[17].mean_jaccard is None
    loose = {r.family: r for r in partitions.families(sets, pairs, 0.2, 0.3).collect()}
    assert loose[0].sets == 4 and loose[0].conflicts == 1 and not loose[0].cohesive


def test_matching_is_the_best_of_all(spark):
    r = np.random.default_rng(2)
    rows = [(k, a, 100 + b, int(10 * v), float(v)) for k, (n, m) in enumerate([(3, 4), (4, 3), (2, 2)]) for a in range(n) for b, v in enumerate(r.random(m))]
    x = spark.createDataFrame(rows, "k int, a long, b long, shared long, jaccard double")
    left, right = x.select("k", "a").distinct(), x.select("k", "b").distinct()
    out = partitions.matched(x, left.unionByName(spark.createDataFrame([(9, 5)], "k int, a long")), right, ["k"]).collect()
    for k, (n, m) in enumerate([(3, 4), (4, 3), (2, 2)]):
        gain = {(a, b): v for kk, a, b, _, v in rows if kk == k}
        small, large = sorted((list(range(n)), list(range(100, 100 + m))), key=len)
        best = max(sum(gain.get((s, t), gain.get((t, s))) for s, t in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
        assert sum(o.jaccard for o in out if o.k == k) == pytest.approx(best) and sum(o.k == k for o in out) == n
    assert [(o.a, o.b, o.jaccard) for o in out if o.k == 9] == [(5, None, 0.0)]


def test_spectral_labels_find_blocks():
    w = np.where(np.equal.outer([0] * 5 + [1] * 6 + [2] * 4, [0] * 5 + [1] * 6 + [2] * 4), 1.0, 0.02)
    label = partitions.spectral_labels(w, 3)
    assert len({tuple(sorted(set(label[s]))) for s in (slice(0, 5), slice(5, 11), slice(11, 15))}) == 3
    for algorithm, repeat in itertools.product(("hierarchical", "spectral"), range(3)):
        assert sorted(np.bincount(partitions.cluster_once(w, 3, algorithm, repeat)).tolist()) == [4, 5, 6]
    assert all(len(set(partitions.cluster_once(w, 3, "kmedoids", repeat))) == 3 for repeat in range(6))  # a start may end elsewhere
    with pytest.raises(ValueError):
        partitions.cluster_once(w, 3, "other", 0)


def test_resampled_consensus_counts_the_draws(spark):
    w = np.where(np.equal.outer([0] * 6 + [1] * 6, [0] * 6 + [1] * 6), 1.0, 0.1) + points(12, 4) * 0.01
    np.fill_diagonal(w, 1)
    out = {(r.i, r.j): (r.seen, r.value) for r in partitions.resampled_consensus(spark, [w, w], (2,), 12).collect()}
    draws = [set(partitions.draw(12, rep, 0.8).tolist()) for rep in range(12)]
    assert set(out) == set(itertools.combinations(range(12), 2))
    for (i, j), (seen, value) in out.items():
        assert seen == sum(i in d and j in d for d in draws)
        assert value == pytest.approx(float((i < 6) == (j < 6)))
    with pytest.raises(Exception, match="never drawn together"):
        partitions.resampled_consensus(spark, [w], (2,), 1).collect()


def test_diverse_medoids_against_pairs(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(20, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "node long, g int, v array<double>")
    got: dict = {}
    for row in matrices.diverse_medoids(df, "node", "g", "v", 3).orderBy("place").collect():
        got.setdefault(row.g, []).append(row.node)
    for g in (0, 1):
        own = np.arange(g, 20, 2)
        s = v[own] @ v[own].T
        chosen: list = []
        for _ in range(3):
            score = s.mean(axis=1) - (s[:, chosen].max(axis=1) if chosen else 0)
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))
        assert got[g] == own[chosen].tolist()


def test_pseudo_f_from_sums_is_that_of_pairs(spark):
    r = np.random.default_rng(1)
    x, g = r.normal(size=(30, 3)), r.integers(0, 3, 30)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(g, x, strict=True))], "node long, g int, v array<double>")
    row = suites.pseudo_f(df, [], "g", "v", 3).first()
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert row.f == pytest.approx(models.pseudo_f(d2, g)) and row.n == 30 and row.k == 3
    p = suites.permanova(df.withColumn("v", F.transform("v", lambda e: e + F.col("g") * 9.0)), [], "node", "g", "v", 3, 19).first()
    assert p.p == pytest.approx(0.05) and 0 < p.r2 <= 1


def test_two_samples_against_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(f"f{k}", int(g), float(v)) for k in range(3) for g, v in zip(r.integers(0, 2, 25), r.integers(0, 9, 25), strict=True)] + [("f0", 0, None)]
    df = spark.createDataFrame(rows, "feature string, group int, value double")
    for row in suites.two_samples(df, ["feature"], F.col("group") == 0).collect():
        a, b = ([v for f, g, v in rows if f == row.feature and g == own and v is not None] for own in (0, 1))
        assert row.delta == pytest.approx(np.mean([np.sign(x - y) for x in a for y in b])) and (row.n1, row.n2) == (len(a), len(b))
        pooled = math.sqrt(((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / (len(a) + len(b) - 2))
        assert row.smd == pytest.approx((np.mean(a) - np.mean(b)) / pooled) and row.median1 == np.median(a) and 0 < row.p <= 1


def test_gate_and_families(spark):
    r = np.random.default_rng(11)
    rows = [(f, i, i % 3, float(r.normal() + (3 * (i % 3) if f == "moves" else 0))) for f in ("moves", "stays") for i in range(60)]
    long = spark.createDataFrame(rows, "feature string, node long, group int, value double")
    gate = suites.numeric_omnibus(long).filter("q < 0.05")
    assert [x.feature for x in gate.collect()] == ["moves"]
    pairs = suites.compared_pairs(long, gate).collect()
    assert {(p.feature, p.group_a, p.group_b) for p in pairs} == {("moves", 0, 1), ("moves", 0, 2), ("moves", 1, 2)} and all(p.p < 0.05 for p in pairs)


def test_sparse_tables_are_permuted(spark):
    rows = [(t, i, i % 2, "x" if (i + (t == "rare") * (i > 1)) % 2 else "y") for t, n in (("rare", 8), ("wide", 80)) for i in range(n)]
    df = spark.createDataFrame(rows, "t string, key long, group int, value string")
    out = {r.t: r for r in statistics.categorical_tests(df, ["t"], "key", "group", "value", F.col("least_expected") < 5, 99).collect()}
    assert out["rare"].method == "permutation" and out["wide"].method == "pearson" and out["wide"].p < 1e-6
    assert (out["rare"].p * 100) == pytest.approx(round(out["rare"].p * 100))


def test_fisher_against_all_tables():
    def plain(a, b, c, d):
        w = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        return sum(v for v in w.values() if v <= w[a] * (1 + 1e-7)) / sum(w.values()), sum(v for x, v in w.items() if x >= a) / sum(w.values())

    r = np.random.default_rng(0)
    for _ in range(200):
        cells = [int(v) for v in r.integers(0, 15, 4)]
        two, tail = plain(*cells)
        assert special.fisher_two_sided(*cells) == pytest.approx(two) and special.hypergeometric_tail(*cells) == pytest.approx(tail)
    assert special.fisher_two_sided(10**6, 10**6, 10**6, 10**6) == pytest.approx(1.0)
    assert special.fisher_two_sided(10**6, 0, 0, 10**6) == 0.0


def test_pruning_fusion_coordinates_and_quality():
    r = np.random.default_rng(6)
    x = r.normal(size=(50, 3))
    x = np.column_stack([x, x[:, 0] + 1e-3 * r.normal(size=50), np.ones(50)])
    names = ["a", "b", "c", "copy", "flat"]
    kept = models.prune_correlated(names, x, 0.9)
    order = [3, 1, 4, 0, 2]
    assert sorted(kept) == sorted(models.prune_correlated([names[i] for i in order], x[:, order], 0.9)) and len(set(kept) & {"a", "copy"}) == 1 and set(kept) >= {"b", "c"}
    d = points(12, 7)
    y = models.principal_coordinates(d)
    assert np.linalg.norm(y[:, None] - y[None], axis=2) == pytest.approx(d, abs=1e-6)
    w = models.kernel(d, 4)
    assert (w == w.T).all() and models.fuse([w]) is w
    fused = models.fuse([w, w.T.copy()], 4, 5)
    assert fused == pytest.approx(fused.T) and np.diag(fused) == pytest.approx(np.ones(12))
    frame = pd.DataFrame({"fg": [True] * 4 + [False] * 4, "v": [2.0, 4, 6, 8, 1, 1, 2, 2]})
    q = models.image_quality(frame)
    assert [q[k] for k in ("MEAN", "RNG", "VAR", "SNR2", "CNR")] == pytest.approx([5, 6, 5, 10, 7])
    assert models.image_quality(frame[frame["fg"]])["SNR1"] == pytest.approx(5 / 5**0.5)


def test_linkage_by_merges_of_sets(spark):
    rows = [(i, str(i % 3), i > 4) for i in range(9)]
    df = partitions.merge_sets(spark.createDataFrame(rows, "node long, set string, part boolean"), ["1", "0"])
    out = {r.node: r.set for r in partitions.split_set(df, "2", "part").collect()}
    assert out == {i: "0_M_1" if i % 3 < 2 else ("2_S1" if i <= 4 else "2_S2") for i in range(9)}


def test_correlations_from_sums(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(40, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    got, sd = models.correlations(df, "v")
    assert got == pytest.approx(np.corrcoef(x, rowvar=False)) and sd == pytest.approx(x.std(axis=0))


def test_group_means_in_shards_and_blocks(spark):
    r = np.random.default_rng(10)
    x, g = r.normal(size=(30, 4)), r.integers(0, 5, 30)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(g, x, strict=True))], "k long, g int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for shard in (10_000, 2):
        for row in matrices.cosine_group_means(df, "k", "v", "g", shard).collect():
            own = [j for j in range(30) if g[j] == row.g and j != row.i]
            assert row.n == len(own) and row.mean == pytest.approx(d[row.i, own].mean()) and row.own == g[row.i]
        assert matrices.cosine_group_means(df, "k", "v", "g", shard).count() == sum(sum(g[j] == c for j in range(30) if j != i) > 0 for i in range(30) for c in range(5))
    for row in matrices.cosine_block_means(df, "k", "v", "g").collect():
        own = [d[i, j] for i in range(30) for j in range(30) if g[i] == row.g and g[j] == row.h and (row.g != row.h or i < j)]
        assert row.n == len(own) and row.mean == pytest.approx(np.mean(own))


def test_counts_below_in_ranges(spark):
    r = np.random.default_rng(12)
    rows = [(k, float(v), int(c)) for k in (0, 1) for v, c in zip(r.permutation(200), r.integers(1, 5, 200), strict=True)]
    got = {(x.k, x.v): x.upto for x in matrices.counts_below(spark.createDataFrame(rows, "k int, v double, c int"), ["k"], "v", "c", 8).collect()}
    assert got == {(k, v): sum(c2 for k2, v2, c2 in rows if k2 == k and v2 <= v) for k, v, _ in rows}


def test_hazards_test_sees_a_changing_effect(spark):
    r = np.random.default_rng(13)
    rows = []
    for i in range(600):
        g = i % 2
        early = r.random() < (0.8 if g else 0.2)  # one group goes early or late, so its effect turns round
        rows.append((int(r.integers(1, 20) if early else r.integers(60, 80)) if g else int(r.integers(20, 60)), 1, float(g)))
    turned = models.hazards_test(spark.createDataFrame(rows, "t int, e int, g double"), "t", "e", "g", 0.0)
    steady = models.hazards_test(spark.createDataFrame([(int(1 + 50 * r.exponential() / (1.5 if i % 2 else 1)), 1, float(i % 2)) for i in range(600)], "t int, e int, g double"), "t", "e", "g", 0.0)
    assert turned["p"] < 1e-6 < 0.001 < steady["p"] and steady["beta"] == pytest.approx(math.log(1.5), abs=0.3)


def test_kernels_are_compared_without_matrices_of_cases():
    """the product of two kernels of the cases, permuted or not, from the small matrix of their factors."""
    x, order = np.random.default_rng(3).random((40, 10)), np.random.default_rng(4).permutation(40)
    a, b = models.kernel_factors(x, 4)
    kernels = [z @ z.T / np.linalg.norm(z @ z.T) for z in (x[:, :4] - x[:, :4].mean(0), x[:, 4:] - x[:, 4:].mean(0))]
    assert models.kernel_product(a, b) == pytest.approx((kernels[0] * kernels[1]).sum())
    assert models.kernel_product(a, b[order]) == pytest.approx((kernels[0] * kernels[1][np.ix_(order, order)]).sum())


def test_consensus_of_groups_without_pairs(spark):
    """Counts of pairs, means and sums of a consensus against all pairs; a null label is together with none."""
    draw = np.random.default_rng(5)
    label = [[int(v) if v < 3 else None for v in draw.integers(0, 4, 4)] for _ in range(30)]
    group = [int(v) for v in draw.integers(0, 3, 30)]
    rows = spark.createDataFrame([(r, n, label[n][r]) for n in range(30) for r in range(4)], "run int, node long, label int")
    lists = partitions.label_lists(rows, "run", "node", "label").join(spark.createDataFrame(list(enumerate(group)), "node long, g int"), "node")
    same = {(i, j): sum(a is not None and a == b for a, b in zip(label[i], label[j], strict=True)) for i, j in itertools.combinations(range(30), 2)}
    counts, mass = {}, {}
    for (i, j), k in same.items():
        key = (*sorted((group[i], group[j])), k)
        counts[key] = counts.get(key, 0) + 1
        for a, b in ((i, j), (j, i)):
            mass[a, group[b]] = mass.get((a, group[b]), 0) + k / 4
    got = {(r.g, r.h, r.same): r.n for r in partitions.joint_counts(lists, 4, "g").collect()}
    assert got == {k: n for k, n in counts.items() if k[2]}
    whole = {r.same: r.n for r in partitions.joint_counts(lists, 4).collect()}
    assert whole == {k: sum(v == k for v in same.values()) for k in set(same.values()) - {0}}
    for r in partitions.joint_means(lists, 4, "g").collect():
        own = {k[2]: n for k, n in counts.items() if k[:2] == (r.g, r.h) and k[2]}
        assert (r.n, r.mean) == (sum(own.values()), pytest.approx(sum(k * n for k, n in own.items()) / sum(own.values()) / 4))
    assert {(r.i, r.g): r.t for r in partitions.joint_mass(lists, 4, "g").collect() if r.t} == {k: v for k, v in mass.items() if v}


@pytest.mark.parametrize("name", ["clu7_consensus_silhouette", "clu19_macro_states", "clu23_pac", "clu24_cdf_area", "clu27_item_consensus", "clu28_representatives", "mat27_core_coassignment", "sec25_hierarchy_rows", "sec26_state_structure"])
def test_no_pairs_of_cases_for_figures_of_groups(spark, monkeypatch, name):
    from tessera import catalog

    monkeypatch.setattr(partitions, "coassignment", None)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
