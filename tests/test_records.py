"""Settlements, facilities, raster files and the assessment of a road network."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave import fixtures
from terraweave.errors import IngestError, PrivacyError, RasterError
from terraweave.functions.geometry import GEOMETRY, POINT, in_ring, interior_point, middle_vertex
from terraweave.model import Bounds, Grid, Provenance, VectorLayer
from terraweave.operators import records, roads
from terraweave.sources.raster import decode_tiff, encode_tiff, read_any, write_geotiff, write_npz
from terraweave.sources.vector import read_osm_facilities

RECORD = Provenance("x", "observed")


def layer(spark, *rows):
    return VectorLayer(spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], f"feature_index bigint, geom {GEOMETRY}, props map<string,string>"), fixtures.CRS, RECORD)


def point(x, y):
    return ("Point", [[(float(x), float(y))]])


SQUARE = ("Polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]])


def test_settlements_keep_what_is_missing(spark):
    props = {"settlement_id": "a", "population_total": "12.0", "young": "4", "note": "n"}
    got = records.settlements(layer(spark, (point(1, 2), props), (SQUARE, {"settlement_id": "b"})), strata=(("young", 0, 15), ("old", 65, None))).orderBy("settlement_id").collect()
    assert got[0].population_total == 12 and [s["count"] for s in got[0].strata] == [4, None] and got[0].attributes == {"note": "n"}
    assert got[0].centroid_kind == "source_provided" and got[1].centroid_kind == "UNKNOWN" and got[1].population_total is None
    assert tuple(got[1].point) == (2.0, 2.0) and got[1].name == "UNKNOWN"


def test_settlements_refuse(spark):
    with pytest.raises(IngestError):
        records.settlements(layer(spark, (point(1, 2), {"settlement_id": " "})))
    with pytest.raises(IngestError):
        records.settlements(layer(spark, (point(1, 2), {"settlement_id": "a", "population_total": "-1"})))
    with pytest.raises(IngestError):
        records.settlements(layer(spark, (point(1, 2), {"settlement_id": "a"})), strata=(("x", 0, 20), ("y", 15, None)))
    with pytest.raises(PrivacyError):
        records.settlements(layer(spark, (point(1, 2), {"settlement_id": "a", "patient_id": "1"})))


def test_facilities_assign_no_role_of_their_own(spark):
    rows = layer(spark, (point(1, 2), {"facility_id": "f", "kind": "school", "cap": "30", "state": "operational"}), (point(3, 4), {"facility_id": "g", "kind": "odd"}))
    with pytest.raises(IngestError):
        records.facilities_from_layer(rows, {"school": "shelter"})
    got = records.facilities_from_layer(rows, {"school": "shelter"}, capacity_property="cap", status_property="state", unmapped="other").orderBy("facility_id").collect()
    assert [(r.kind, r.capacity_persons, r.operational_status) for r in got] == [("shelter", 30, "operational"), ("other", None, "UNKNOWN")]
    with pytest.raises(IngestError):
        records.facilities_from_layer(layer(spark, (point(1, 2), {"facility_id": "f", "kind": "school", "state": "fine"})), {"school": "shelter"}, status_property="state")


def test_points_lie_inside_and_on(spark):
    horseshoe = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (8.0, 10.0), (8.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    flat = [(0.0, 1.0), (2.0, 1.0), (4.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(horseshoe,), (flat,)], f"ring array<{POINT}>").withColumn("p", interior_point(F.col("ring")))
    got = df.select("p", in_ring(F.col("p.x"), F.col("p.y"), F.col("ring")).alias("inside")).collect()
    assert got[0].inside and tuple(got[1].p) == (0.0, 1.0)
    line = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (5.0, 0.0), (10.0, 0.0)],), ([(3.0, 3.0)],)], f"l array<{POINT}>")
    assert [tuple(r[0]) for r in line.select(middle_vertex(F.col("l"))).collect()] == [(5.0, 0.0), (3.0, 3.0)]


def test_osm_facilities(spark, tmp_path):
    text = """<osm><node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="4"/><node id="3" lat="4" lon="4"/><node id="4" lat="4" lon="0"/>
    <node id="5" lat="9" lon="8"><tag k="amenity" v="clinic"/><tag k="name" v="C"/></node><node id="6" lat="1" lon="1"><tag k="amenity" v="bench"/></node>
    <way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="building" v="school"/></way>
    <way id="8"><nd ref="98"/><nd ref="99"/><tag k="amenity" v="school"/></way></osm>"""
    (tmp_path / "a.osm").write_text(text)
    got, dropped = read_osm_facilities(spark, str(tmp_path / "a.osm"), RECORD)
    rows = {r.props["facility_id"]: r for r in got.df.collect()}
    assert set(rows) == {"osm:node/5", "osm:way/7"} and dropped.first()[0] == 1
    assert rows["osm:way/7"].props["osm_matched_tag"] == "building=school" and tuple(rows["osm:way/7"].geom.parts[0][0]) == (2.0, 2.0)
    with pytest.raises(IngestError):
        read_osm_facilities(spark, str(tmp_path / "a.osm"), RECORD, (("amenity", "police"),))


def test_raster_files_go_round(spark, tmp_path):
    plane = fixtures.voids(spark)
    want = sorted(tuple(r) for r in plane.df.where("value is not null").select("row", "col", "value").collect())
    write_geotiff(plane, str(tmp_path / "a.tif"))
    write_npz(plane, str(tmp_path / "b.npz"), str(tmp_path / "b.json"))
    for name, options in (("a.tif", {"crs": plane.crs}), ("b.npz", {})):
        back = read_any(spark, str(tmp_path / name), RECORD, **options)
        assert back.grid == plane.grid and sorted(tuple(r) for r in back.df.where("value is not null").select("row", "col", "value").collect()) == want
    with pytest.raises(RasterError):
        write_geotiff(plane, str(tmp_path / "c.tif"), limit=10)
    with pytest.raises(IngestError):
        read_any(spark, str(tmp_path / "a.bmp"), RECORD)


def test_tiff_strips():
    values = np.arange(1300.0).reshape(130, 10)
    got, tags = decode_tiff(encode_tiff(values, Grid(5.0, 9.0, 2.0, 3.0, 130, 10), -9.0))
    assert (got == values).all() and tags[42113] == "-9.0" and tags[33550][:2] == (2.0, 3.0)


def test_assessment_of_a_network(spark):
    g = roads.build_graph(fixtures.lines(spark, [(0, 0), (100, 0)], [(100, 0), (200, 0)], [(500, 500), (600, 500)]))
    places = spark.createDataFrame([("p", 201.0, 1.0), ("far", 9000.0, 9000.0)], "place_id string, x double, y double")
    got = roads.assess(g, Bounds(0, -50, 1000, 1000, fixtures.CRS), places)
    assert {k: t.count() for k, t in got.items() if k in ("components", "exits", "settlements", "crossings", "self_loops")} == {"components": 2, "exits": 1, "settlements": 2, "crossings": 0, "self_loops": 0}
    both = {r.edge_count: r for r in got["components"].collect()}
    assert both[2].single_egress and both[1].is_isolated and not both[1].no_egress
    assert got["bridges"].where(F.size("cut_off") > 0).count() == 2
