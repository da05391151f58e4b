"""Pairs of recurrence as blocks: written, read again, and the same pairs."""

import numpy as np
import pytest

from tessera import catalog
from tessera.operators import blocks, partitions


@pytest.mark.parametrize("size", [7, 1024])
def test_blocks_hold_the_pairs(spark, tmp_path, monkeypatch, size):
    r = np.random.default_rng(1)
    rows = [(int(s), f"n{n:02d}") for n in range(40) for s in r.permutation(12)[: r.integers(0, 5)]] + [(3, None)]
    rows += [(100 + s, n) for s in range(300) for n in ("n01", "n02")]  # more shared sets than a byte holds
    sets = spark.createDataFrame(rows, "set long, node string")
    whole = blocks.in_blocks
    monkeypatch.setattr(blocks, "in_blocks", lambda df: whole(df, size))
    partitions.recurrence_blocks(sets).write.parquet(str(tmp_path / "pairs"))
    again = spark.read.parquet(str(tmp_path / "pairs"))
    want = sorted(map(tuple, partitions.recurrence(sets).collect()))
    assert sorted(map(tuple, partitions.recurrence_of(again).collect())) == want and max(w[2] for w in want) >= 300
    assert sum(x.n for x in partitions.recurrence_counts(again).collect()) == len(want)


def test_no_row_of_text_for_each_pair(spark, monkeypatch):
    """before, each pair was a line of a CSV file."""
    monkeypatch.setattr(partitions, "recurrence", None)
    assert {r.name: r.n for r in catalog.queries()["snk7_recurrence_outputs"](spark, "/root/testdata/sf0.001").collect()}["cases"] == 500
