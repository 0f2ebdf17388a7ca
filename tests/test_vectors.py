"""Clipping, rasterising, validity: cases with known answers and a plain second opinion."""

import random

import pytest
from pyspark.sql import functions as F

from terraweave import fixtures
from terraweave.errors import IngestError
from terraweave.model import Bounds, Grid, VectorLayer
from terraweave.operators import records, vector

BOX = Bounds(0, 0, 10, 10, fixtures.CRS)


def layer(spark, *shapes):
    rows = [(i, (kind, [[(float(x), float(y)) for x, y in part] for part in parts]), {}) for i, (kind, parts) in enumerate(shapes)]
    return VectorLayer(spark.createDataFrame(rows, fixtures.VECTOR), fixtures.CRS)


def cut(spark, *shapes, mode="truncate"):
    out = vector.clip_features(layer(spark, *shapes), BOX, mode).df.orderBy("feature_index").collect()
    return {r.feature_index: (r.geom.type, [[(p.x, p.y) for p in part] for part in r.geom.parts]) for r in out}


def line(*points):
    return "LineString", [list(points)]


def test_lines_keep_their_parts(spark):
    ring = [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]
    got = cut(
        spark, line(*ring), line((5, 5), (15, 5), (15, 6), (5, 6)), line((10, 4), (12, 4)), line((-1, 11), (11, 11)), line((1, 1), (2, 1), (2, 1), (3, 1)),
        line((-5, 5), (5, 5), (5, 15)), ("MultiLineString", [[(1, 1), (2, 2)], [(8, 8), (12, 12)]]), line((8, 12), (10, 10), (12, 8)), line((-2, 0), (12, 0)),
    )
    assert got[0] == line(*ring)
    assert got[1] == ("MultiLineString", [[(5, 5), (10, 5)], [(10, 6), (5, 6)]])
    assert got[2] == ("Point", [[(10, 4)]]) and 3 not in got
    assert got[4][1][0][0] == (1, 1) and got[4][1][0][-1] == (3, 1)
    assert got[5] == line((0, 5), (5, 5), (5, 10)) and got[6][1] == [[(1, 1), (2, 2)], [(8, 8), (10, 10)]]
    assert got[7] == ("Point", [[(10, 10)]]) and got[8] == line((0, 0), (10, 0))


def test_polygons_are_cut_side_by_side(spark):
    square = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
    got = cut(spark, ("Polygon", [square(-5, -5, 30)]), ("Polygon", [square(8, 8, 5)]), ("Polygon", [square(20, 20, 5)]), ("Polygon", [square(-5, -5, 30), square(-2, -2, 20)]), ("Polygon", [square(10, 0, 4)]))
    area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2
    assert set(got) == {0, 1} and area(got[0][1][0]) == 100 and area(got[1][1][0]) == 4
    assert all(part[0] == part[-1] for _, parts in got.values() for part in parts)
    assert set(cut(spark, ("Polygon", [square(-5, -5, 30)]), ("Polygon", [square(10, 0, 4)]), line((10, 4), (12, 4)), line((0, 2), (0, 8)), mode="intersects")) == {0, 1, 2, 3}
    assert set(cut(spark, ("Polygon", [square(2, 2, 3)]), line((0, 2), (0, 8)), line((0, 2), (10, 8)), ("Point", [[(0, 0)]]), ("Point", [[(1, 1)]]), mode="within")) == {0, 2, 4}
    with pytest.raises(IngestError):
        cut(spark, line((1, 1), (2, 2)), mode="sideways")


def test_random_lines_keep_their_length_inside(spark):
    """Against sampling: a line's length inside is about its share of many small steps there."""
    rng = random.Random(5)
    shapes = [line(*[(rng.uniform(-8, 18), rng.uniform(-8, 18)) for _ in range(rng.randint(2, 7))]) for _ in range(60)]
    got = cut(spark, *shapes)
    length = lambda part: sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(part, part[1:], strict=False))
    for i, (_, (part,)) in enumerate(shapes):
        inside = 0.0
        for a, b in zip(part, part[1:], strict=False):
            at = [(a[0] + (b[0] - a[0]) * (k + 0.5) / 4000, a[1] + (b[1] - a[1]) * (k + 0.5) / 4000) for k in range(4000)]
            inside += length([a, b]) * sum(0 <= x <= 10 and 0 <= y <= 10 for x, y in at) / 4000
        assert sum(map(length, got.get(i, ("", []))[1])) == pytest.approx(inside, abs=0.1)


def test_rasterising_with_holes_and_outlines(spark):
    shell, hole = [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]
    rows = [(0, 1, [shell, hole]), (1, 2, [[(7, 7), (9.2, 7), (9.2, 9.2), (7, 9.2), (7, 7)]]), (2, 3, [[(3.1, 3.1), (3.2, 3.1), (3.2, 3.2), (3.1, 3.1)]])]
    polygons = spark.createDataFrame([(i, c, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, c, rings in rows], "feature_index bigint, code int, rings array<array<struct<x:double,y:double>>>")
    grid = Grid(0.0, 10.0, 1.0, 1.0, 10, 10)
    cells = {(r.row, r.col): r.value for r in vector.rasterise(polygons, grid, 255).collect()}
    inside = lambda x, y, ring: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1
    for (r, c), value in cells.items():
        x, y, want = c + 0.5, 10 - r - 0.5, 255
        for _, code, rings in rows:
            if sum(inside(x, y, ring) for ring in rings) % 2:
                want = code
        assert value == want, (r, c)
    assert len(cells) == 100 and [r.code for r in vector.lost_codes(polygons, vector.rasterise(polygons, grid, 255)).collect()] == [3]
    touched = vector.burned_cells(polygons, grid, all_touched=True)
    assert touched.where("code = 3").select("row", "col").collect() == [(6, 3)] and touched.where("code = 2 and row = 0 and col = 9").count() == 1
    with pytest.raises(IngestError):
        vector.rasterise(polygons.withColumn("code", F.col("code") + 40), grid, 255, scheme=records.DEMO_SCHEME)


def test_invalid_geometries(spark):
    bow = [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    eight = [(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]
    spike = [(0, 0), (4, 0), (4, 4), (4, 2), (4, 6), (0, 4), (0, 0)]
    shapes = [
        ("Polygon", [bow]), ("Polygon", [square]), ("Polygon", [square, hole]), ("Polygon", [square, [(x + 9, y) for x, y in hole]]), ("Polygon", [square[:-1]]), ("Polygon", [[(0, 0), (1, 1), (0, 0)]]),
        line((1, 1), (1, 1)), line((0, 0), (1, 1), (0, 0)), ("Point", [[(float("nan"), 0)]]), ("Polygon", [eight]), ("Polygon", [spike]), ("Polygon", [square, [(1, 1), (6, 1), (6, 2), (1, 2), (1, 1)]]),
    ]
    got = {r.feature_index: r.reason for r in vector.invalid_features(layer(spark, *shapes)).collect()}
    assert got == {0: "self-intersection", 3: "hole outside", 4: "open ring", 5: "open ring", 6: "short line", 8: "coordinate", 9: "self-intersection", 10: "self-intersection", 11: "self-intersection"}


def test_overlapping_bands(spark):
    rows = [("a", 0, 15), ("a", 15, 65), ("a", 65, None), ("b", 0, 20), ("b", 10, 30), ("b", 25, 40), ("c", 0, None), ("c", 70, 80)]
    bands = spark.createDataFrame(rows, "settlement_id string, lower int, upper int")
    got = sorted(tuple(r) for r in records.overlapping_strata(bands, "settlement_id").collect())
    assert got == [("b", 0, 20, 10, 30), ("b", 10, 30, 25, 40), ("c", 0, None, 70, 80)]
