"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terrafold.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple("null" if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)[:10] for v in r) for r in pdf.itertuples(index=False)), key=lambda r: [(isinstance(v, str), v) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.toPandas()), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5 for p, q in zip(x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
