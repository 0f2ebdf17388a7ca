"""Closed-form terrain, units, coordinates, provenance, privacy and guards."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from terraweave import fixtures
from terraweave.errors import ConfigError, CRSError, CRSMismatchError, GeographicCRSError, IngestError, MissingDataError, PrivacyError, ProvenanceError, RasterError, RasterGeometryError, UnitMismatchError, UnknownCRSError, UnknownUnitError
from terraweave.functions import crs, units
from terraweave.model import Bounds, Grid, Provenance, combine_data_classes, migrate_provenance
from terraweave.operators import raster, records, study, validation


def one(df):
    return df.first().asDict()


def test_plane_slope_and_aspect(spark):
    dem = fixtures.plane(spark)
    s = one(raster.statistics(raster.slope(dem).df))
    assert s["mean"] == pytest.approx(math.degrees(math.atan(math.hypot(0.2, 0.1))), abs=1e-5) and s["valid_count"] == 23 * 23
    a = one(raster.circular_mean(raster.aspect(dem).df))
    assert a["mean_deg"] == pytest.approx(296.565051, abs=1e-4) and a["resultant"] == pytest.approx(1)


def test_integration_plane(spark):
    dem = fixtures.plane(spark, 14, 14, base=100.0, east=0.1, north=0.0)
    s = one(raster.statistics(raster.slope(dem).df))
    assert (s["valid_count"], s["missing_count"]) == (144, 52) and s["max"] == pytest.approx(5.710593, abs=1e-5)
    assert one(raster.circular_mean(raster.aspect(dem).df))["mean_deg"] == pytest.approx(270)


def test_flat_terrain_has_no_aspect(spark):
    dem = fixtures.flat(spark)
    assert one(raster.statistics(raster.slope(dem).df))["max"] == 0
    assert one(raster.circular_mean(raster.aspect(dem).df)) == {"n": 0, "mean_deg": None, "resultant": None}


def test_one_void_costs_nine_cells_and_tiles_change_nothing(spark, monkeypatch):
    dem = fixtures.plane(spark, 15, 15, missing=(F.col("row") == 7) & (F.col("col") == 7))
    want = sorted(raster.horn(dem.df, 30.0, 30.0).collect())
    assert sum(r.dz_dx is None for r in want) == 15 * 15 - 13 * 13 + 9
    monkeypatch.setattr(raster, "TILE", 4)
    assert sorted(raster.horn(dem.df, 30.0, 30.0).collect()) == want


def test_sentinel_and_nan_are_missing(spark):
    df = spark.createDataFrame([(0, 0, float("nan")), (0, 1, -9999.0), (0, 2, 1.0)], "row int, col int, value double")
    got = df.select(raster.normalised(F.col("value"), -9999.0).alias("value"))
    assert [r.value for r in got.collect()] == [None, None, 1.0]
    assert one(raster.statistics(got.where("value is null")))["mean"] is None


def test_clip_moves_by_whole_cells_and_refuses_nothing(spark):
    dem = fixtures.plane(spark)
    b = Bounds(226100, 477100, 226400, 477400, fixtures.CRS)
    plain, wide = raster.clip(dem, b), raster.clip(dem, b, 2)
    assert (wide.grid.rows - plain.grid.rows, wide.grid.cols - plain.grid.cols) == (4, 4)
    assert (plain.grid.x_origin - dem.grid.x_origin) % 30 == 0
    with pytest.raises(RasterGeometryError):
        raster.clip(dem, Bounds(0, 0, 10, 10, fixtures.CRS))
    with pytest.raises(CRSMismatchError):
        raster.clip(dem, Bounds(0, 0, 1, 1, "EPSG:5186"))


def test_study_area_is_derived_with_a_halo(spark):
    b = Bounds(226090, 477090, 226390, 477390, fixtures.CRS)
    area = study.build(fixtures.CRS, b, dem=fixtures.plane(spark), fuels=fixtures.half_and_half(spark))
    inner = raster.clip(area.slope, b)
    assert one(raster.statistics(area.slope.df))["missing_count"] == 44 and one(raster.statistics(inner.df))["missing_count"] == 0
    assert {r.layer: r.rows for r in study.summary(area).collect()} == {"dem": 144, "slope": 144, "aspect": 144, "fuels": 144} and area.dem.grid == area.fuels.grid


def test_class_codes_are_never_averaged(spark):
    cover = fixtures.half_and_half(spark)
    with pytest.raises(RasterError):
        raster.resample(cover, cover.grid, "bilinear")
    # Another grid within one system is refused, the same one gives the layer; whole numbers need a nodata value.
    assert raster.warp(cover, cover.crs, cover.grid, "nearest") is cover
    with pytest.raises(ConfigError):
        raster.warp(cover, cover.crs, cover.grid.offset(0, 1, (5, 5)), "nearest")
    whole = replace(cover, df=cover.df.withColumn("value", F.col("value").cast("int")), nodata=None)
    with pytest.raises(MissingDataError):
        raster.warp(whole, "EPSG:5186", cover.grid, "nearest")
    with pytest.raises(RasterError):
        raster.statistics(cover.df, cover.kind)
    assert sum(r.fraction for r in raster.categorical_statistics(cover.df).collect()) == pytest.approx(1)


def test_projection_anchor_and_refusals(spark):
    x, y = crs.project(crs.REGISTRY["EPSG:5186"], F.lit(126.75), F.lit(35.05))
    p = one(spark.range(1).select(x.alias("x"), y.alias("y")))
    assert (p["x"], p["y"]) == (pytest.approx(177191.8, abs=0.1), pytest.approx(272670.5, abs=0.1))
    assert not crs.crs_equal(None, None) and crs.check_notes() == []
    with pytest.raises(CRSError):
        crs.transform("EPSG:5174", "EPSG:4326", F.lit(0.0), F.lit(0.0))
    with pytest.raises(UnknownCRSError):
        crs.require_same_crs([None, "EPSG:5187"], "test")
    with pytest.raises(GeographicCRSError):
        crs.require_projected_metre("EPSG:4326", "test")
    with pytest.raises(UnknownCRSError):
        crs.parse_crs("EPSG:99999")


def test_units_and_grids():
    assert units.require_same_length_unit(["m", "metres"], "x") == "m"
    for bad, error in ((["m", "ft"], UnitMismatchError), ([], UnitMismatchError), (["US survey foot"], UnknownUnitError)):
        with pytest.raises(error):
            units.require_same_length_unit(bad, "x")
    g = Grid(0, 10, 1, 1, 5, 5)
    assert Grid.from_gdal(g.to_gdal(), 5, 5) == g and g.is_square
    for bad in ((0, 1, 0.1, 10, 0, -1), (0, 1, 0, 10, 0, 1)):
        with pytest.raises(RasterGeometryError):
            Grid.from_gdal(bad, 5, 5)


def test_provenance_only_grows():
    p = Provenance("dem", "observed", sources=({"name": "s", "licence": "UNKNOWN"},), checksum="abc")
    child = p.derive("slope", "slope")
    assert child.data_class == "derived" and child.parents == ("dem",) and child.checksum == "UNKNOWN" and len(child.transformations) == 1
    assert Provenance("x", "synthetic").derive("y", "op").data_class == "synthetic"
    assert "sources[0].licence" in p.unknown_fields() and Provenance.from_dict(child.to_dict()) == child
    assert combine_data_classes(["observed", "synthetic", "derived"]) == "derived"
    assert migrate_provenance({"schema_version": "1.0.0"})["schema_version"] == "1.1.0"
    for bad in (lambda: Provenance("x", "derived"), lambda: migrate_provenance({"schema_version": "9"}), lambda: Provenance.from_dict({"schema_version": "1.1.0", "odd": 1}), lambda: combine_data_classes([])):
        with pytest.raises(ProvenanceError):
            bad()


def test_privacy_and_facilities(spark):
    df = spark.createDataFrame([({"Patient-ID": "1"},)], "props map<string,string>")
    with pytest.raises(PrivacyError):
        records.require_private_free(df, "layer")
    tags = spark.createDataFrame([("a",), ("b",)], "tag string")
    assert sorted(r.kind for r in records.facilities(tags, "tag", {"a": "shelter"}, "other").collect()) == ["other", "shelter"]
    with pytest.raises(IngestError):
        records.facilities(tags, "tag", {"a": "shelter"})
    with pytest.raises(IngestError):
        records.ClassScheme("x", {0: "a"}, 0, "synthetic")


def test_the_catalogue_is_whole():
    assert len(validation.CODES) == 63
    assert {r[1] for r in validation.RULES.values()} == set(validation.RANK)


def test_percentiles_of_more_values_than_one_task_holds(spark):
    """Brackets instead of one state with every value: ties, few values, none."""
    import numpy as np

    rng = np.random.default_rng(3)
    for values in (rng.normal(0, 1, 3000), rng.integers(0, 4, 2500).astype(float), np.array([5.0] * 700), np.arange(901.0)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "value double")
        got = raster.statistics(df, held=40).first()
        assert [got[f"p{p}"] for p in raster.PERCENTILES] == pytest.approx(np.percentile(values, raster.PERCENTILES).tolist(), abs=1e-12)
        assert got["total_count"] == len(values) + 9 and got["missing_count"] == 9
    ranks = raster.order_statistics(df, [0, 450, 900], held=5)
    assert ranks == {0: 0.0, 450: 450.0, 900: 900.0}


def test_horn_deals_tiles_once(spark):
    plan = raster.slope(fixtures.plane(spark)).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tr") == 1
    whole = raster.terrain_statistics(fixtures.voids(spark)).first()
    dem = fixtures.voids(spark)
    assert tuple(whole) == pytest.approx(tuple(raster.terrain_statistics(dem, raster.slope(dem), raster.aspect(dem)).first()))


def test_a_cut_archive_is_refused(spark, tmp_path):
    from terraweave.sources.raster import read_npz, write_npz

    dem = fixtures.voids(spark)
    write_npz(dem, str(tmp_path / "a.npz"), str(tmp_path / "a.json"))
    assert read_npz(spark, str(tmp_path / "a.npz"), str(tmp_path / "a.json"), dem.provenance).df.where("value is null").count() == 17
    (tmp_path / ".a.npz.crc").unlink()
    with open(tmp_path / "a.npz", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="checksum"):
        read_npz(spark, str(tmp_path / "a.npz"), str(tmp_path / "a.json"), dem.provenance).df.count()


def test_tiled_predicted_and_banded_tiffs(spark, tmp_path):
    import struct
    import zlib

    import numpy as np

    from terraweave.sources.raster import decode_tiff, read_geotiff

    bands = [np.arange(35 * 20, dtype="<u2").reshape(35, 20) * k for k in (1, 3)]
    tiles = []
    for band in bands:
        full = np.zeros((48, 32), "<u2")
        full[:35, :20] = band
        for r in range(0, 48, 16):
            for c in range(0, 32, 16):
                t = full[r : r + 16, c : c + 16].copy()
                t[:, 1:] -= full[r : r + 16, c : c + 16][:, :-1]
                tiles.append(zlib.compress(t.tobytes()))
    at, starts, body = 8, [], b"".join(tiles)
    for t in tiles:
        starts.append(at)
        at += len(t)
    entries = [(256, "H", [20]), (257, "H", [35]), (258, "H", [16, 16]), (259, "H", [8]), (277, "H", [2]), (284, "H", [2]), (317, "H", [2]), (322, "H", [16]), (323, "H", [16]), (324, "I", starts), (325, "I", [len(t) for t in tiles]), (339, "H", [1]), (33550, "d", [2.0, 2.0, 0.0]), (33922, "d", [0.0, 0, 0, 10.0, 90.0, 0])]
    after, rows, tail = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, letter, values in entries:
        data = struct.pack(f"<{len(values)}{letter}", *values)
        rows += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12}[letter], len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + len(tail)))
        tail += b"" if len(data) <= 4 else data
    content = struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(entries)) + rows + b"\0" * 4 + tail
    for k, band in enumerate(bands, 1):
        assert (decode_tiff(content, k)[0] == band).all()
    (tmp_path / "t.tif").write_bytes(content)
    layer = read_geotiff(spark, str(tmp_path / "t.tif"), Provenance("t", "observed"), "EPSG:5187", band=2)
    assert layer.grid == Grid(10.0, 90.0, 2.0, 2.0, 35, 20) and layer.df.agg(F.sum("value")).first()[0] == float(bands[1].sum())
    (tmp_path / "more").mkdir()
    for name in "ab":
        (tmp_path / "more" / f"{name}.tif").write_bytes(content)
    with pytest.raises(IngestError):
        read_geotiff(spark, str(tmp_path / "more"), Provenance("t", "observed"), "EPSG:5187")
