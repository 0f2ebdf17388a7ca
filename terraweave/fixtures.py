"""Closed-form test layers; every cell comes from its row and column."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError
from .model import Grid, Provenance, RasterLayer, VectorLayer

CRS, ORIGIN = "EPSG:5187", (226000.0, 477000.0)
VECTOR = "feature_index bigint, geom struct<type:string,parts:array<array<struct<x:double,y:double>>>>, props map<string,string>"


def _cells(spark: SparkSession, rows: int, cols: int):
    return spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def _record(name: str) -> Provenance:
    return Provenance(name, "synthetic", temporal_reference="not_applicable", valid_from="not_applicable", valid_to="not_applicable", sources=({"name": "closed form", "licence": "not_applicable"},))


def plane(spark: SparkSession, rows: int = 25, cols: int = 25, cell: float = 30.0, base: float = 400.0, east: float = 0.2, north: float = -0.1, missing=None) -> RasterLayer:
    """A tilted plane; missing may be a condition on row and col."""
    value = F.lit(base) + east * (F.col("col") + 0.5) * cell + north * (rows - F.col("row") - 0.5) * cell
    value = value if missing is None else F.when(~missing, value)
    grid = Grid(ORIGIN[0], ORIGIN[1] + rows * cell, cell, cell, rows, cols)
    return RasterLayer(_cells(spark, rows, cols).withColumn("value", value), grid, CRS, nodata=-9999.0, provenance=_record("plane"))


def flat(spark: SparkSession) -> RasterLayer:
    return plane(spark, 20, 20, base=412.0, east=0.0, north=0.0)


def voids(spark: SparkSession) -> RasterLayer:
    inside = (F.col("row").between(3, 6) & F.col("col").between(3, 6)) | ((F.col("row") == 10) & (F.col("col") == 10))
    return plane(spark, 15, 15, missing=inside)


def half_and_half(spark: SparkSession) -> RasterLayer:
    """Class 1 in the west, 2 in the east, nodata at rows and columns 5 and 6."""
    value = F.when(~(F.col("row").between(5, 6) & F.col("col").between(5, 6)), F.when(F.col("col") < 7, 1).otherwise(2).cast("double"))
    return RasterLayer(_cells(spark, 14, 14).withColumn("value", value), Grid(ORIGIN[0], ORIGIN[1] + 14 * 30.0, 30.0, 30.0, 14, 14), CRS, "categorical", 255, _record("cover"))


def lines(spark: SparkSession, *coords: list[tuple[float, float]], props: list[dict] | None = None) -> VectorLayer:
    rows = [(i, ("LineString", [[(float(x), float(y)) for x, y in c]]), {k: str(v) for k, v in (props[i] if props else {}).items()}) for i, c in enumerate(coords)]
    return VectorLayer(spark.createDataFrame(rows, VECTOR), CRS, _record("lines"))


def points(spark: SparkSession, *rows: tuple[float, float, dict], name: str = "points") -> VectorLayer:
    data = [(i, ("Point", [[(float(x), float(y))]]), {k: str(v) for k, v in props.items() if v is not None}) for i, (x, y, props) in enumerate(rows)]
    return VectorLayer(spark.createDataFrame(data, VECTOR), CRS, _record(name))


def squares(spark: SparkSession, *rows: tuple[float, float, float, dict], name: str = "squares") -> VectorLayer:
    """Closed squares from their lower left corner and side."""
    ring = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
    data = [(i, ("Polygon", [[(float(p), float(q)) for p, q in ring(x, y, a)]]), {k: str(v) for k, v in props.items() if v is not None}) for i, (x, y, a, props) in enumerate(rows)]
    return VectorLayer(spark.createDataFrame(data, VECTOR), CRS, _record(name))


def _at(dx: float, dy: float) -> tuple[float, float]:
    return ORIGIN[0] + dx, ORIGIN[1] + dy


def single_exit_network(spark: SparkSession) -> VectorLayer:
    """A stem with two settlements behind it; the only way out is tagged."""
    coords = [[_at(0, 300), _at(200, 300)], [_at(200, 300), _at(400, 300)], [_at(400, 300), _at(600, 300)]]
    return lines(spark, *coords, props=[{"segment_id": i, "road_class": "track", "exit": "yes" if i == 0 else "no"} for i in range(3)])


def two_exit_network(spark: SparkSession) -> VectorLayer:
    """A ring with a spoke to each side: no link is critical."""
    ring = [_at(200, 200), _at(400, 200), _at(400, 400), _at(200, 400)]
    coords = [[ring[i], ring[(i + 1) % 4]] for i in range(4)] + [[_at(0, 200), ring[0]], [ring[2], _at(600, 400)]]
    return lines(spark, *coords, props=[{"segment_id": i, "road_class": "service", "exit": "yes" if i > 3 else "no"} for i in range(6)])


def disconnected_network(spark: SparkSession) -> VectorLayer:
    """Three components: a chain of two, and two lines that cross without a node."""
    coords = [[_at(0, 0), _at(100, 0)], [_at(100, 0), _at(200, 0)], [_at(300, 300), _at(400, 400)], [_at(300, 400), _at(400, 300)]]
    return lines(spark, *coords, props=[{"segment_id": i, "road_class": "track"} for i in range(4)])


def incompatible_crs_pair(spark: SparkSession) -> tuple[VectorLayer, VectorLayer]:
    """One geometry under two systems; whatever combines them must raise."""
    here = single_exit_network(spark)
    return here, VectorLayer(here.df, "EPSG:4326", _record("elsewhere"))


def station_settlement(spark: SparkSession) -> VectorLayer:
    """One settlement whose bands add up to its total, 42."""
    return points(spark, (*_at(600, 300), {"settlement_id": "SYN-S-001", "name": "station", "population_total": 42, "pop_0_14": 4, "pop_15_64": 20, "pop_65_plus": 18, "count_basis": "registered", "reference_date": "2023"}), name="population")


def villages(spark: SparkSession) -> VectorLayer:
    """Three settlements: one sound, one without total, one below the floor whose bands disagree and whose basis is unknown."""
    rows = [
        (ORIGIN[0] + 100, ORIGIN[1] + 100, 60.0, {"settlement_id": "SYN-V-001", "name": "a", "population_total": 30, "pop_0_14": 3, "pop_15_64": 12, "pop_65_plus": 15, "count_basis": "registered"}),
        (ORIGIN[0] + 300, ORIGIN[1] + 300, 60.0, {"settlement_id": "SYN-V-002", "name": "b", "population_total": None, "pop_0_14": 1, "pop_15_64": 2, "pop_65_plus": 3, "count_basis": "registered"}),
        (ORIGIN[0] + 500, ORIGIN[1] + 100, 60.0, {"settlement_id": "SYN-V-003", "name": "c", "population_total": 3, "pop_0_14": 1, "pop_15_64": 1, "pop_65_plus": 2}),
    ]
    return squares(spark, *rows, name="population")


def facilities(spark: SparkSession) -> VectorLayer:
    """Five facilities, one of which states a capacity."""
    kinds = ("shelter", "fire_station", "responder_base", "shelter", "other")
    return points(spark, *[(*_at(100 * i + 50, 120), {"facility_id": f"SYN-F-{i:03d}", "name": f"f{i}", "kind": k, "operational_status": "UNKNOWN", "capacity_persons": 60 if i == 0 else None}) for i, k in enumerate(kinds)], name="facilities")


def valley(spark: SparkSession, rows: int = 208, cols: int = 208, cell: float = 30.0) -> RasterLayer:
    """A valley between two ridges with a fixed rough surface, in place of random noise."""
    x, y = (F.col("col") + 0.5) / cols, (F.col("row") + 0.5) / rows
    ridge = lambda at, height: height * F.exp(-((x - at) ** 2) / 0.02)
    rough = 3.0 * F.sin(F.col("row") * 12.9898 + F.col("col") * 78.233)
    value = (220.0 + 60.0 * y + ridge(0.2, 260.0) + ridge(0.8, 220.0) + rough).cast("float")
    grid = Grid(ORIGIN[0], ORIGIN[1] + rows * cell, cell, cell, rows, cols)
    return RasterLayer(_cells(spark, rows, cols).withColumn("value", value), grid, CRS, nodata=-9999.0, provenance=_record("valley"))


def valley_cover(spark: SparkSession) -> RasterLayer:
    """Classes 1 to 6 by bands of the valley's elevation; a block without data."""
    dem = valley(spark)
    z = F.col("value")
    code = F.when(z > 450, 5).when(z > 380, 6).when(z > 300, 4).when(z < 250, 2).when((F.col("row") * 7 + F.col("col") * 13) % 25 < 2, 3).otherwise(1)
    block = F.col("row").between(10, 24) & F.col("col").between(10, 24)
    return RasterLayer(dem.df.withColumn("value", F.when(~block, code.cast("double"))), dem.grid, CRS, "categorical", 255, _record("cover"))


def valley_roads(spark: SparkSession) -> VectorLayer:
    """A valley road with a spur, a loop, an orphan and a crossing without a node."""
    main = [_at(100 + 500 * i, 3100) for i in range(5)]
    coords = [[main[i], main[i + 1]] for i in range(4)] + [
        [main[1], _at(600, 3900)], [main[2], _at(1300, 3700), _at(1400, 3100 + 300)], [_at(1400, 3400), main[3]], [_at(4000, 4000), _at(4300, 4000)],
        [_at(300, 2900), _at(300, 3300)], [main[4], _at(2600, 3100)], [_at(2600, 3100), _at(6300, 3100)],
    ]
    return lines(spark, *coords, props=[{"segment_id": i, "road_class": "unclassified"} for i in range(len(coords))])


def integration_dem(spark: SparkSession) -> RasterLayer:
    """16 x 16 cells that rise a tenth to the east: slope 5.710593 degrees, facing west."""
    return plane(spark, 16, 16, base=100.0, east=0.1, north=0.0)


def integration_roads(spark: SparkSession) -> VectorLayer:
    """480 m in three roads: two exits at the sides, one stem of 120 m."""
    coords = [[_at(30, 200), _at(240, 200)], [_at(240, 200), _at(390, 200)], [_at(240, 200), _at(240, 320)]]
    return lines(spark, *coords, props=[{"road_id": f"r{i}", "highway": "residential", "exit": "yes" if i < 2 else "no"} for i in range(3)])


def integration_villages(spark: SparkSession) -> VectorLayer:
    """One settlement of 40 = 4 + 24 + 12 at the end of the stem."""
    return points(spark, (*_at(240, 320), {"settlement_id": "SYN-I-001", "name": "i", "population_total": 40, "pop_0_14": 4, "pop_15_64": 24, "pop_65_plus": 12, "count_basis": "registered", "reference_date": "2023"}), name="population")


def integration_facilities(spark: SparkSession) -> VectorLayer:
    return points(spark, *[(*_at(200 + 40 * i, 200), {"facility_id": f"SYN-I-F{i}", "kind": k, "operational_status": "UNKNOWN"}) for i, k in enumerate(("responder_base", "shelter"))], name="facilities")


RASTERS = {
    "tilted_plane": plane, "flat_terrain": flat, "missing_cells_raster": voids, "half_and_half": half_and_half, "korean_valley_dem": valley, "korean_valley_fuels": valley_cover,
    "integration_fixture_dem": integration_dem, "integration_fixture_fuels": half_and_half,
}
VECTORS = {
    "single_exit_network": single_exit_network, "two_exit_network": two_exit_network, "disconnected_network": disconnected_network, "korean_valley_roads": valley_roads, "integration_fixture_roads": integration_roads,
    "village_shelter_station": station_settlement, "korean_valley_villages": villages, "integration_fixture_villages": integration_villages, "korean_valley_facilities": facilities, "integration_fixture_facilities": integration_facilities,
}
FIXTURES = RASTERS | VECTORS | {"incompatible_crs_pair": incompatible_crs_pair}


def make_fixture(spark: SparkSession, name: str, **options):
    if name not in FIXTURES:
        raise ConfigError(f"unknown fixture {name!r}; known: {sorted(FIXTURES)}")
    return FIXTURES[name](spark, **options)
