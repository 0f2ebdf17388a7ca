"""Road graphs on small networks with known answers, and sources."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave import fixtures
from terraweave.errors import BundleError, GraphError, IngestError, UnknownCRSError
from terraweave.functions.geometry import length
from terraweave.model import Bounds, Grid, Provenance
from terraweave.operators import roads, vector
from terraweave.plans.components import connected_components
from terraweave.sources.bundle import read_bundle, write_bundle
from terraweave.sources.raster import decode_tiff, read_geotiff, read_npz, read_raster, write_raster
from terraweave.sources.vector import read_geojson, read_osm_roads, write_geojson

RECORD = Provenance("x", "observed")


def counts(g):
    return g.nodes.count(), g.edges.count(), roads.components(g.nodes, g.edges).select("component").distinct().count()


def test_t_junction_at_an_interior_vertex(spark):
    layer = fixtures.lines(spark, [(0, 0), (100, 0), (200, 0)], [(100, 0), (100, 80)])
    g = roads.build_graph(layer)
    assert counts(g) == (4, 3, 1) and g.edges.agg(F.sum("length_m")).first()[0] == 280
    assert counts(roads.build_graph(layer, node_shared=False))[1:] == (2, 2)


def test_crossings_are_noded_on_request(spark):
    layer = fixtures.lines(spark, [(0, 50), (100, 50)], [(50, 0), (50, 100)])
    off, on = roads.build_graph(layer), roads.build_graph(layer, node_crossings=True)
    assert counts(off) == (4, 2, 2) and roads.crossings_without_node(off).count() == 1
    assert counts(on) == (5, 4, 1) and roads.crossings_without_node(on).count() == 0


def test_chained_snapping_is_transitive(spark):
    points = spark.createDataFrame([(i, 0.9 * i, 0.0) for i in range(3)] + [(9, 50.0, 50.0)], "pid bigint, x double, y double")
    got = roads.cluster_endpoints(points, 1.0)
    assert {r.pid: r.node for r in got.collect()} == {0: 0, 1: 0, 2: 0, 9: 9}
    assert max(r.span for r in roads.cluster_spans(got).collect()) == pytest.approx(1.8)
    with pytest.raises(GraphError):
        roads.cluster_endpoints(points, -1.0)


def graph(spark, edges, exits=(), homes=()):
    nodes = sorted({n for e in edges for n in e})
    e = spark.createDataFrame([(i, u, v, 10.0) for i, (u, v) in enumerate(edges)], "edge_id bigint, u bigint, v bigint, length_m double")
    n = spark.createDataFrame([(x,) for x in nodes], "node bigint")
    marks = spark.createDataFrame([(x, x in exits, x in homes) for x in nodes], "node bigint, is_exit boolean, is_settlement boolean")
    return n, e, roads.components(n, e), marks


def test_parallel_edges_are_no_bridge(spark):
    _, e, c, _ = graph(spark, [(1, 2), (1, 2), (2, 3), (2, 3)])
    assert roads.bridges(e, c).count() == 0
    assert [r.node for r in roads.articulation_points(e, c).collect()] == [2]


@pytest.mark.parametrize(
    "edges,exits,homes,want",
    [
        ([(1, 2), (2, 3), (3, 4), (3, 4), (4, 5)], (1,), (5,), {(1, 2), (2, 3), (4, 5)}),
        ([(1, 2), (2, 3)], (3,), (3,), set()),
        ([(1, 2), (2, 3), (2, 4)], (1,), (3, 4), {(1, 2), (2, 3), (2, 4)}),
        ([(1, 2), (8, 9)], (1,), (9,), set()),
        ([(1, 2), (2, 3)], (1, 3), (2,), set()),
    ],
)
def test_critical_links(spark, edges, exits, homes, want):
    _, e, c, m = graph(spark, edges, exits, homes)
    assert {(r.u, r.v) for r in roads.critical_links(e, c, m).collect()} == want


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components_in_one_task_and_in_rounds(spark, one_task):
    """A long path, self-loops, null ends and a random graph; both ways alike."""
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(path, one_task=one_task)
    assert got.count() == 301 and {r.component for r in got.collect()} == {0}
    assert connected_components(path.limit(0), one_task=one_task).count() == 0
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500, 500), (7, 7), (None, 3), (3, None), (9, 8), (8, 9)]
    near, want = {}, {}
    for a, b in pairs:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    found = connected_components(spark.createDataFrame(pairs, "u bigint, v bigint"), one_task=one_task)
    assert {r.node: r.component for r in found.collect()} == want and found.count() == len(want)


def test_duplicates_forward_and_back(spark):
    layer = fixtures.lines(spark, [(0, 0), (5, 5)], [(5, 5), (0, 0)], [(0, 9), (5, 9)], [(0, 9), (5, 9)])
    g = roads.build_graph(layer, node_shared=False)
    assert sorted(r.n for r in roads.duplicate_geometry(g.edges).collect()) == [2, 2]


def test_truncation_cuts_lines_at_the_box(spark):
    layer = fixtures.lines(spark, [(-50, 10), (50, 10), (150, 90)], [(500, 500), (600, 600)])
    cut = vector.clip_features(layer, Bounds(0, 0, 100, 100, fixtures.CRS), "truncate").df
    assert cut.count() == 1
    assert cut.select(length(F.col("geom.parts")[0])).first()[0] == pytest.approx(50 + (50**2 + 40**2) ** 0.5)


def test_guards_of_graphs(spark):
    with pytest.raises(GraphError):
        roads.build_graph(fixtures.lines(spark, [(1, 1), (1, 1)]))


def test_geojson_round_trip_and_guards(spark, tmp_path):
    text = '{"type":"FeatureCollection","crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::5187"}},"features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]},"properties":{"highway":"track","lanes":2}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":null}]}'
    (tmp_path / "a.geojson").write_text(text)
    layer = read_geojson(spark, str(tmp_path / "a.geojson"), RECORD)
    rows = layer.df.orderBy("feature_index").collect()
    assert layer.crs.code == "EPSG:5187" and rows[0].props == {"highway": "track", "lanes": "2"} and rows[1].geom.parts[0][0].y == 2
    with pytest.raises(IngestError):
        read_geojson(spark, str(tmp_path / "a.geojson"), RECORD, "EPSG:5186")
    write_geojson(layer, str(tmp_path / "out.geojson"))
    again = read_geojson(spark, str(tmp_path / "out.geojson"), RECORD)
    assert again.crs == layer.crs and again.df.orderBy("feature_index").collect() == rows
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    with pytest.raises(UnknownCRSError):
        read_geojson(spark, str(tmp_path / "b.geojson"), RECORD)


def test_osm_ways_need_all_their_nodes(spark, tmp_path):
    way = lambda i, refs, kind: f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + f'<tag k="highway" v="{kind}"/></way>'
    nodes = "".join(f'<node id="{i}" lat="{36 + i / 100}" lon="{129 + i / 50}"/>' for i in (1, 2, 3))
    (tmp_path / "m.osm").write_text(f"<osm>{nodes}{way(10, [3, 1, 2], 'track')}{way(11, [1, 7], 'service')}{way(12, [1, 2], 'footway')}{way(13, [1], 'road')}</osm>")
    layer, dropped = read_osm_roads(spark, str(tmp_path / "m.osm"), RECORD)
    rows = layer.df.collect()
    assert [r.feature_index for r in rows] == [10] and [p.x for p in rows[0].geom.parts[0]] == [129.06, 129.02, 129.04]
    assert rows[0].props["osm_id"] == "10" and dropped.first()[0] == 2


def test_rasters_and_bundles_round_trip(spark, tmp_path):
    import json
    import struct

    dem = fixtures.voids(spark)
    write_raster(dem, str(tmp_path / "r"))
    back = read_raster(spark, str(tmp_path / "r"), verify=True)
    assert back.grid == dem.grid and sorted(back.df.collect(), key=str) == sorted(dem.df.collect(), key=str)
    values = np.array([[1.0, -9999.0], [3.0, 4.0]])
    np.savez(tmp_path / "a.npz", values=values)
    grid = {"x_origin": 0, "y_origin": 2, "x_size": 1, "y_size": 1, "rows": 2, "cols": 2}
    (tmp_path / "a.json").write_text(json.dumps({"format": "npz_raster_v1", "grid": grid, "crs": "EPSG:5187", "nodata": -9999.0}))
    npz = read_npz(spark, str(tmp_path / "a.npz"), str(tmp_path / "a.json"), RECORD)
    assert sorted((r.row, r.col, r.value) for r in npz.df.where("value is not null").collect()) == [(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, 16), (339, 3, 1, 3), (33550, 12, 3, 24), (33922, 12, 6, 48), (42113, 2, 6, 96)]
    data = values.astype("<f4").tobytes()
    extra = struct.pack("<3d", 1, 1, 0) + struct.pack("<6d", 0, 0, 0, 100, 202, 0) + b"-9999\0"
    head = 8 + len(data) + len(extra)
    tags = [(t, k, n, v if t < 33550 else v) for t, k, n, v in tags]
    body = b"II*\0" + struct.pack("<I", head) + data + extra + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, n, v in tags) + b"\0" * 4
    (tmp_path / "a.tif").write_bytes(body)
    assert decode_tiff(body)[0].tolist() == values.tolist()
    tif = read_geotiff(spark, str(tmp_path / "a.tif"), RECORD, "EPSG:5187")
    assert tif.nodata == -9999 and tif.grid == Grid(100, 202, 1, 1, 2, 2) and tif.df.where("value is null").count() == 1
    path = str(tmp_path / "bundle")
    write_bundle(spark, path, "area", {"x": (dem.df, RECORD)})
    record = read_bundle(spark, path)[1]["x"][1]
    assert record.checksum != "UNKNOWN" and record == replace(RECORD, layer_name="x", checksum=record.checksum, checksum_algorithm=record.checksum_algorithm)
    dem.df.limit(3).write.mode("append").parquet(f"{path}/layers/x")
    with pytest.raises(BundleError):
        read_bundle(spark, path)
