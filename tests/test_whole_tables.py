"""Queries that take whole tables where their SQL takes a part, against brute force."""

import math

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """700 customers: more than the SQL of the clusters has."""
    sf = str(tmp_path_factory.mktemp("customers"))
    spark.range(700).selectExpr("id AS c_custkey").write.parquet(f"{sf}/customer.parquet")
    return sf, {i: ((i * 37) % 1300 - 100.0, (i * 91) % 1300 - 100.0) for i in range(700)}


def test_exact_clusters_of_all_places(spark, customers):
    sf, places = customers
    cell = {i: (x // 40, y // 40) for i, (x, y) in places.items()}
    first = {}
    for i in sorted(places):
        first.setdefault(cell[i], i)
    got = {r.pid: r.node for r in QUERIES["exact_endpoint_clusters"](spark, sf).collect()}
    assert got == {i: first[cell[i]] for i in places}


def test_snapped_clusters_of_all_places(spark, customers):
    sf, places = customers
    node = {i: i for i in places}

    def head(i):
        while node[i] != i:
            i = node[i]
        return i

    for a, p in places.items():
        for b, q in places.items():
            if a < b and math.hypot(p[0] - q[0], p[1] - q[1]) <= 45:
                u, v = head(a), head(b)
                node[max(u, v)] = min(u, v)
    got = {r.pid: r.node for r in QUERIES["snapped_endpoint_clusters"](spark, sf).collect()}
    assert got == {i: head(i) for i in places}


def test_crossings_of_all_lines(spark, tmp_path):
    spark.range(90).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {}
    for a in range(90):
        for b in range(a + 1, 90):
            start, end = (b - a) * 10.0, ((b * 7) % 100 - (a * 7) % 100) * 10.0
            if start != end and 0 <= start / (start - end) <= 1:
                t = start / (start - end)
                want[a, b] = (a * 10.0 + t * ((a * 7) % 100 * 10.0 - a * 10.0), t * 1000.0)
    got = {(r.a, r.b): (r.x, r.y) for r in QUERIES["line_crossings"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and max(b for _, b in got) > 40
    for pair, p in got.items():
        assert p == pytest.approx(want[pair], abs=2e-3)
