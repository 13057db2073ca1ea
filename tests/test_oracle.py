"""Every registered query with an oracle agrees with DuckDB on the same tables (sf0.001)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from ledeframe.session import TABLES

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_a_callable():
    assert len(QUERIES) >= 100
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF)
    s = _digest(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(SQL[key])
    d = _digest([c[0] for c in res.description], res.fetchall())
    assert s == d


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["split", "label", "n_rows", "mean_known_share", "mean_known_in_window"]
