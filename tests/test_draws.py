"""Draws that are fused and clustered in tasks against those of whole matrices, and without the cases' matrices on the driver."""

import numpy as np
import pytest

from tessera import catalog
from tessera.operators import models, partitions
from tessera.plans import consensus


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    return np.repeat(r.normal(size=(3, 8)), 20, axis=0) + 0.4 * r.normal(size=(60, 8))


def of_vectors(spark, x):
    return spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)][::-1], "vec_id long, embedding array<double>").repartition(3)


def test_sets_against_matrices(spark, vectors):
    ks, x = (2, 3), vectors[::-1]  # in the order of keys
    views = [models.kernel(consensus._cosine_matrix(x[:, v * 4 : v * 4 + 4])) for v in range(2)]
    want = set()
    for k, frame in partitions.resampled_consensus(spark, views, ks, 16).toPandas().groupby("k"):
        label = partitions.linkage_cut(1 - partitions.square(frame, range(60), 0.0, 1.0), clusters=k, method="average")
        want |= {(k, 941 + i, int(c)) for i, c in enumerate(label)}
    got = partitions.consensus_sets(partitions.drawn_labels(of_vectors(spark, vectors), "vec_id", "embedding", 2, ks, 16)).collect()
    assert len(got) == 120 and {tuple(r) for r in got} == want


@pytest.mark.parametrize("repeat", range(6))
def test_one_linkage_and_one_set_of_eigenvectors_for_all_k(vectors, repeat):
    w = models.kernel(consensus._cosine_matrix(vectors), 6)
    w /= w.max()
    np.fill_diagonal(w, 1)
    names = ("hierarchical", "spectral", "kmedoids")
    got = partitions.cluster_all(w.copy(), (2, 3, 4), names, repeat)
    assert len(got) == 9
    for (k, name), label in got.items():
        assert label.tolist() == partitions.cluster_once(w, k, name, repeat).tolist()
    with pytest.raises(ValueError, match="other"):
        partitions.cluster_all(w, (2,), ("other",), 0)


def test_pairs_that_no_draw_has(spark, vectors):
    with pytest.raises(Exception, match="never drawn together"):
        partitions.consensus_sets(partitions.drawn_labels(of_vectors(spark, vectors), "vec_id", "embedding", 2, (2,), 1)).collect()


@pytest.mark.parametrize("copies", [1, 3])
def test_krylov_vectors_against_all_eigenvectors(monkeypatch, copies):
    """Also where parts are not connected, so that the largest value occurs several times."""
    r = np.random.default_rng(2)
    one = np.exp(-((r.normal(size=(150, 1, 3)) - r.normal(size=(1, 150, 3))) ** 2).sum(axis=2))
    w = np.kron(np.eye(copies), one + one.T)
    np.fill_diagonal(w, 0)
    want = partitions.leading_vectors(w, copies + 1)
    monkeypatch.setattr(partitions, "DENSE", 100)
    got = partitions.leading_vectors(w, copies + 1)
    k = copies  # the largest values; with copies the next one occurs several times too
    assert np.abs(got[:, -k:] @ got[:, -k:].T - want[:, -k:] @ want[:, -k:].T).max() < 1e-8
    assert got.T @ got == pytest.approx(np.eye(copies + 1), abs=1e-10)
    with pytest.raises(ArithmeticError):
        partitions.leading_vectors(w, 1, restarts=1, depth=1)


def test_no_matrix_of_the_cases_on_the_driver(spark, monkeypatch):
    """before, the affinities of the views lay on the driver, and all pairs of a k met in a task."""
    monkeypatch.setattr(consensus, "cohort_views", None)
    assert catalog.queries()["clu4_candidates"](spark, "/root/testdata/sf0.001").count() == 1500
