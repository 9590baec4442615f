import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans.catalogue import CATALOGUE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    return None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", CATALOGUE)
def test_catalogue(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    ours = sorted(([plain(r[c]) for c in names] for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    assert ours == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


def test_entry(spark):
    if os.path.isdir(FOLDER):
        assert __spark_entry__.entry(spark).columns == ["name", "order_id"]
