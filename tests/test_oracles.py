"""Every registered query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: (v is None, str(type(v)), v)
    tidy = lambda v: (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v
    return sorted([tuple(tidy(r[i]) for i in order) for r in rows], key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    theirs = [d[0] for d in result.description]
    assert sorted(ours.columns) == sorted(theirs)
    assert plain([tuple(r) for r in ours.collect()], ours.columns) == plain(result.fetchall(), theirs)
