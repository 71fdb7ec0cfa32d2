"""Every registered query against its SQL twin on the smallest data."""

import importlib
from collections import Counter

import duckdb
import pytest

from workload.oracle import build
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations part labels".split()
ENTRY = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    v = v.item() if hasattr(v, "item") else v
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else None if v is None else str(v)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(build()) and set(QUERIES) <= set(ENTRY.queries()) and set(ENTRY.oracle_sql()) <= set(ENTRY.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = ENTRY.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(ENTRY.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert got == want
    assert got or name == "high_entropy"  # too few documents at this size


def test_entry(spark):
    assert ENTRY.entry(spark).columns == ["repo", "risk_score", "finding_count"]
