"""Every query of the catalogue against its SQL on the smallest tables, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessera import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, oracle, name):
    df = catalog.queries()[name](spark, DATA)
    want = oracle.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(_text(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
