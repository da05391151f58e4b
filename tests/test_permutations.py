"""Permutations by hashed orders against their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import digests
from tessera.operators import statistics


def test_permuted_figures_are_those_of_the_rows(spark):
    """counts and sums of each repeat against the rows of the permuted groups, with nulls; and no row for a member of a repeat."""
    draw = np.random.default_rng(4)
    rows = [(b, 100 * b + n, "xyz"[draw.integers(3)] if draw.random() < 0.9 else None, bool(draw.integers(2)), float(draw.random()) if draw.random() < 0.8 else None) for b in range(3) for n in range(25 * b + 1)]
    df = spark.createDataFrame(rows, "b int, key long, group string, y boolean, x double")
    dealt = statistics.permuted_groups(df, 40, by=["b"]).cache()
    want = {tuple(r) for r in dealt.groupBy("b", "rep", "group", "y").count().collect()}
    assert {tuple(r) for r in statistics.permuted_counts(df, 40, "key", "group", "y", ["b"]).collect()} == want
    sums = {tuple(r[:4]): r[4] for r in statistics.permuted_sums(df, 40, "key", "group", "x", ["b"]).collect()}
    assert sums == {tuple(r[:4]): pytest.approx(r[4] or 0.0) for r in dealt.groupBy("b", "rep", "group").agg(F.count("x"), F.sum("x")).collect()}


@pytest.mark.parametrize("name", ["sta18_permuted_chi_square", "sta48_permutation"])
def test_no_rows_of_permutations(spark, monkeypatch, name):
    monkeypatch.setattr(statistics, "permuted_groups", None)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_digests_of_many_texts():
    import hashlib

    texts = [b"%d" % (7**n) for n in range(50)] + [b"", b"\xff" * 51]
    for head in (b"", b"7|", b"1234567|", b"x" * 40):
        high, low = digests.PrefixedMd5(texts)(head)
        assert [f"{h:016x}{n:016x}" for h, n in zip(high.tolist(), low.tolist(), strict=True)] == [hashlib.md5(head + t).hexdigest() for t in texts]
        high, low = digests.PrefixedMd5(texts[:12])(head)
        assert [f"{h:016x}{n:016x}" for h, n in zip(high.tolist(), low.tolist(), strict=True)] == [hashlib.md5(head + t).hexdigest() for t in texts[:12]]
