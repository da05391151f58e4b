"""Fusion by strips against that of matrices, and without the cases' matrices on the driver."""

import numpy as np
import pytest

from tessera import catalog
from tessera.operators import fusion, models
from tessera.plans import consensus


@pytest.mark.parametrize(("strip", "doubles", "error"), [(256, 1 << 40, 1e-12), (7, 1 << 40, 1e-12), (16, 0, 2e-6)])
def test_strips_against_matrices(monkeypatch, strip, doubles, error):
    monkeypatch.setattr(fusion, "STRIP", strip)
    monkeypatch.setattr(fusion, "DOUBLES", doubles)
    r = np.random.default_rng(3)
    views = [r.normal(size=(45, 5)) for _ in range(3)]
    for x in views:
        x[10:14] = x[10]  # copies: neighbours tie
    want = models.fuse([models.kernel(consensus._cosine_matrix(x), 6) for x in views], 6, 5)
    units = [fusion.unit_rows(x) for x in views]
    strips = fusion.fused_strips(45, [fusion.cosine_kernel(u, fusion.near_means(u, 6)) for u in units], 6, 5)
    got = {(i, j): v for b in fusion.pair_batches(np.arange(45), strips) for i, j, v in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    i, j = np.triu_indices(45, 1)
    assert list(got) == list(zip(i.tolist(), j.tolist(), strict=True))
    assert list(got.values()) == pytest.approx(want[i, j], rel=error)


def test_no_matrix_of_the_cases_on_the_driver(spark, monkeypatch):
    """before, the affinities of the views and their fusion were made on the driver."""
    monkeypatch.setattr(consensus, "cohort_views", None)
    assert catalog.queries()["mat6_fused_network"](spark, "/root/testdata/sf0.001").count() == 500 * 499 // 2
