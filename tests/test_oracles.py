"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, str(SF))
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in got.dtypes} == kinds
    order = [want.columns.index(c) for c in cols]
    rows = [tuple(plain(r[c]) for c in cols) for r in got.collect()]
    assert sorted(rows, key=str) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)


def test_every_query_of_the_library_has_sql():
    own = {n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 400
