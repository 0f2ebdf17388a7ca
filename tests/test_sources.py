"""Small readers, writers and texts around layers."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from terraweave import fixtures
from terraweave.errors import ConfigError, IngestError, NetworkAccessError, ProvenanceError, RasterError
from terraweave.functions import text as T
from terraweave.model import Bounds, Provenance
from terraweave.operators.records import DEMO_SCHEME, ClassScheme
from terraweave.plans.joins import join_hot
from terraweave.plans.staging import checkpoint_dir
from terraweave.sources import files, remote
from terraweave.sources.raster import class_layer, read_any, read_raster, write_any
from terraweave.sources.vector import read_roads, write_geojson

RECORD = Provenance("x", "observed")


def test_rasters_by_suffix(spark, tmp_path):
    dem = fixtures.voids(spark)
    cells = lambda layer: sorted((r.row, r.col, r.value) for r in layer.df.where("value is not null").collect())
    for name in ("a.npz", "a.tif"):
        write_any(dem, f"{tmp_path}/{name}")
        options = {"crs": dem.crs} if name.endswith("tif") else {}
        assert cells(read_any(spark, f"{tmp_path}/{name}", RECORD, **options)) == cells(dem)
    write_any(dem, f"{tmp_path}/folder")
    assert cells(read_raster(spark, f"{tmp_path}/folder")) == cells(dem)
    with pytest.raises(RasterError):
        write_any(dem, f"{tmp_path}/a.png")


def test_class_layers_and_schemes(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 255)], "row int, col int, value int")
    grid = fixtures.half_and_half(spark).grid
    assert class_layer(df, grid, fixtures.CRS, DEMO_SCHEME, RECORD).df.where("value is null").count() == 1
    with pytest.raises(IngestError):
        class_layer(df.withColumn("value", F.col("value") + 9), grid, fixtures.CRS, DEMO_SCHEME, RECORD)
    with pytest.raises(RasterError):
        class_layer(df.withColumn("value", F.lit(1.5)), grid, fixtures.CRS, DEMO_SCHEME, RECORD)
    for wrong in (lambda: ClassScheme.of_pairs("s", [(1, "a"), (1, "b")], 0, data_class="synthetic"), lambda: ClassScheme("s", {}, 0, "synthetic"), lambda: ClassScheme("s", {1: "a"}, 0, "observed", "x", "crosswalk")):
        with pytest.raises(IngestError):
            wrong()


def test_texts_of_missing_values():
    assert (T.nodata_text(None), T.nodata_text(math.nan), T.nodata_text(-9999.0)) == ("none_declared", "nan", "-9999.0")
    assert T.nodata_json(math.nan) == "nan" and math.isnan(T.nodata_of_json("nan")) and T.nodata_of_json(None) is None and T.unit_text(None) == "UNKNOWN"
    with pytest.raises(IngestError):
        T.nodata_of_json("none")
    assert files.json_checksum({"a": 1, "b": [2]}) == files.json_checksum({"b": [2], "a": 1}) != files.json_checksum({"a": 1})


def test_records_change_by_their_own_ways():
    assert RECORD.with_note("a").with_note("b").notes == "a | b" and RECORD.with_updates(value_unit="m").value_unit == "m"
    with pytest.raises(ProvenanceError):
        RECORD.with_updates(checksum="x")


def test_tiles_are_fetched_only_with_leave(spark, tmp_path):
    box = Bounds(226000, 477000, 226400, 477400, fixtures.CRS)
    (name, url), = remote.tiles(spark, box, "dem")
    assert name == "Copernicus_DSM_COG_10_N36_00_E129_00_DEM" and url.endswith(f"/{name}/{name}.tif")
    assert remote.tiles(spark, box, "cover")[0][1].endswith("ESA_WorldCover_10m_2021_v200_N36E129_Map.tif")
    with pytest.raises(NetworkAccessError):
        remote.fetch_tile(spark, box, "dem", str(tmp_path), RECORD)
    with pytest.raises(IngestError):
        remote.fetch_tile(spark, box.grown(90_000), "dem", str(tmp_path), RECORD)
    write_any(fixtures.plane(spark), f"{tmp_path}/{name}.tif")
    layer = remote.fetch_tile(spark, box, "dem", str(tmp_path), RECORD)
    assert layer.provenance.sources[0]["url_or_identifier"] == url and layer.df.count() == 625
    with pytest.raises(NetworkAccessError):
        remote.fetch_roads(spark, box, f"{tmp_path}/m.osm", RECORD)


def test_road_layers_hold_lines(spark, tmp_path):
    roads = fixtures.integration_roads(spark)
    write_geojson(roads, f"{tmp_path}/r.geojson")
    assert read_roads(spark, f"{tmp_path}/r.geojson", RECORD).df.count() == 3
    for name, layer in (("e", replace(roads, df=roads.df.limit(0))), ("p", fixtures.integration_facilities(spark))):
        write_geojson(layer, f"{tmp_path}/{name}.geojson")
        with pytest.raises(IngestError):
            read_roads(spark, f"{tmp_path}/{name}.geojson", RECORD)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_hot_joins_are_joins(spark, how):
    rows = spark.range(400).selectExpr("IF(id % 3 = 0, 7, IF(id % 50 = 1, NULL, id)) AS k", "id AS v", "1 AS _salt")
    table = spark.createDataFrame([(7, "a"), (11, "b"), (None, "c")], "k bigint, w string")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(rows.join(table, "k", how))
    assert key(join_hot(rows, table, ["k"], F.col("v"), how)) == want == key(join_hot(rows, table, ["k"], F.col("v"), how, max_bytes=0))


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Other:
        sparkContext = Context()

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(ConfigError):
            checkpoint_dir(Other())
