"""Registered queries over the test tables and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .expected import findings_sql
from .functions import crs as C
from .functions import geometry as G
from .functions import text as T
from .functions import units as U
from .model import CLASS_PRECEDENCE, Bounds, Grid, Provenance, VectorLayer
from .operators import contract, facts, raster, records, roads, validation, vector
from .plans.staging import checkpoint_dir
from .sources import raster as raster_files
from .sources.vector import join_ways, read_geojson, write_geojson

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ---- rasters

_W = "lag({0}) OVER {1} + 2 * {0} + lead({0}) OVER {1}"
HORN = f"""dem AS ({A.DEM}), a AS (SELECT row, col, value, {_W.format('value', 'wc')} AS v, {_W.format('value', 'wr')} AS h FROM dem WINDOW wr AS (PARTITION BY row ORDER BY col), wc AS (PARTITION BY col ORDER BY row)),
b AS (SELECT row, col, value, (lead(v) OVER wr - lag(v) OVER wr) / 240.0 AS gx, (lead(h) OVER wc - lag(h) OVER wc) / 240.0 AS gs FROM a WINDOW wr AS (PARTITION BY row ORDER BY col), wc AS (PARTITION BY col ORDER BY row)),
g AS (SELECT row, col, CASE WHEN value IS NOT NULL AND gx IS NOT NULL AND gs IS NOT NULL THEN gx END AS dz_dx, CASE WHEN value IS NOT NULL AND gx IS NOT NULL AND gs IS NOT NULL THEN -gs END AS dz_dy FROM b)"""
_SLOPE = "degrees(atan(sqrt(dz_dx * dz_dx + dz_dy * dz_dy)))"
_ASPECT = "CASE WHEN sqrt(dz_dx * dz_dx + dz_dy * dz_dy) > 0 THEN CASE WHEN atan2(-dz_dx, -dz_dy) < 0 THEN degrees(atan2(-dz_dx, -dz_dy)) + 360.0 ELSE degrees(atan2(-dz_dx, -dz_dy)) END END"


def _stats_sql(places: int) -> str:
    r = lambda e: f"round({e}, {places})"
    ps = ", ".join(f"{r(f'quantile_cont(value, {p / 100})')} AS p{p}" for p in raster.PERCENTILES)
    return f"count(*) AS total_count, count(value) AS valid_count, count(*) - count(value) AS missing_count, {r('1 - count(value) / count(*)')} AS missing_fraction, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {ps}"


@query(f"WITH {HORN}, s AS (SELECT CAST({_SLOPE} AS FLOAT) AS f FROM g), t AS (SELECT CAST(f AS DOUBLE) AS value FROM s) SELECT {_stats_sql(3)} FROM t")
def slope_statistics(spark, sf):
    return rounded(raster.statistics(raster.slope(A.dem(spark, sf)).df), 3)


@query(f"WITH {HORN} SELECT row, col, round(dz_dx, 6) AS dz_dx, round(dz_dy, 6) AS dz_dy FROM g")
def horn_gradients(spark, sf):
    return rounded(raster.horn(A.dem(spark, sf).df, 30.0, 30.0).drop("value"))


@query(f"WITH {HORN} SELECT row, col, round(CAST(CAST({_ASPECT} AS FLOAT) AS DOUBLE), 2) AS aspect FROM g")
def aspect_cells(spark, sf):
    return raster.aspect(A.dem(spark, sf)).df.select("row", "col", F.round(F.col("value").cast("double"), 2).alias("aspect"))


@query(f"WITH {HORN}, t AS (SELECT {_ASPECT} AS value FROM g), m AS (SELECT count(value) AS n, sum(sin(radians(value))) AS s, sum(cos(radians(value))) AS c FROM t) SELECT n, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360.0 ELSE degrees(atan2(s, c)) END, 2) AS mean_deg, round(sqrt(s * s + c * c) / n, 4) AS resultant FROM m")
def aspect_circular_mean(spark, sf):
    m = raster.circular_mean(raster.aspect(A.dem(spark, sf)).df)
    return m.select("n", F.round("mean_deg", 2).alias("mean_deg"), F.round("resultant", 4).alias("resultant"))


@query(f"WITH t AS ({A.BIG}) SELECT {_stats_sql(6)} FROM t")
def raster_statistics(spark, sf):
    return rounded(raster.statistics(A.rows(spark, sf, A.BIG)))


@query(f"WITH t AS ({A.CODES}), c AS (SELECT value AS code, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY value) SELECT code, n, round(n / sum(n) OVER (), 6) AS fraction FROM c")
def categorical_statistics(spark, sf):
    return rounded(raster.categorical_statistics(A.rows(spark, sf, A.CODES)))


@query(f"WITH {HORN}, s AS (SELECT CAST(CAST({_SLOPE} AS FLOAT) AS DOUBLE) AS v, {_ASPECT} AS a FROM g), d AS (SELECT min(value) AS z_min, max(value) AS z_max, max(value) - min(value) AS relief, count(value) * 900.0 AS valid_area_m2 FROM dem), q AS (SELECT avg(v) AS slope_mean, max(v) AS slope_max, sum(sin(radians(a))) AS s, sum(cos(radians(a))) AS c, count(a) AS n FROM s) SELECT round(z_min, 3) AS z_min, round(z_max, 3) AS z_max, round(relief, 3) AS relief, round(valid_area_m2, 3) AS valid_area_m2, round(slope_mean, 3) AS slope_mean, round(slope_max, 3) AS slope_max, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360.0 ELSE degrees(atan2(s, c)) END, 2) AS mean_deg, round(sqrt(s * s + c * c) / n, 3) AS resultant FROM d, q")
def terrain_statistics(spark, sf):
    d = A.dem(spark, sf)
    t = rounded(raster.terrain_statistics(d), 3)
    return t.withColumn("mean_deg", F.round("mean_deg", 2))


@query(f"WITH t AS ({A.DEM}) SELECT row - 1 AS row, col - 9 AS col, value FROM t WHERE row >= 1 AND row < (SELECT max(row) FROM t) AND col >= 9 AND col < 21")
def clip_raster(spark, sf):
    d = A.dem(spark, sf)
    h = d.grid.rows * 30.0
    return raster.clip(d, Bounds(301.0, 61.0, 599.0, h - 61.0, A.CRS), buffer_cells=1).df


def _target(d) -> Grid:
    """A coarser, shifted grid over the whole raster."""
    return Grid(20.0, d.grid.y_origin - 10.0, 75.0, 75.0, -(-d.grid.rows * 30 // 75), 16)


@query(f"WITH t AS ({A.DEM}), n AS (SELECT max(row) + 1 AS r FROM t), o AS (SELECT CAST(a.i AS INT) AS trow, CAST(b.i AS INT) AS tcol FROM (SELECT unnest(range(CAST(ceil(r * 30 / 75.0) AS BIGINT))) AS i FROM n) a, range(16) b(i)) SELECT trow AS row, tcol AS col, value FROM o LEFT JOIN t ON t.row = floor(((trow + 0.5) * 75.0 + 10.0) / 30.0) AND t.col = floor(((tcol + 0.5) * 75.0 + 20.0) / 30.0)")
def warp_nearest(spark, sf):
    d = A.dem(spark, sf)
    return raster.resample(d, _target(d), "nearest").df


@query(f"WITH t AS ({A.DEM}), n AS (SELECT max(row) + 1 AS r FROM t), o AS (SELECT CAST(a.i AS INT) AS trow, CAST(b.i AS INT) AS tcol, ((a.i + 0.5) * 75.0 + 10.0) / 30.0 - 0.5 AS r, ((b.i + 0.5) * 75.0 + 20.0) / 30.0 - 0.5 AS c FROM (SELECT unnest(range(CAST(ceil(r * 30 / 75.0) AS BIGINT))) AS i FROM n) a, range(16) b(i)), k AS (SELECT trow, tcol, floor(r) + i.i AS rr, floor(c) + j.i AS cc, (1 - abs(r - floor(r) - i.i)) * (1 - abs(c - floor(c) - j.i)) AS w FROM o, range(2) i(i), range(2) j(i)) SELECT trow AS row, tcol AS col, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS value FROM k LEFT JOIN t ON t.row = rr AND t.col = cc GROUP BY trow, tcol")
def warp_bilinear(spark, sf):
    d = A.dem(spark, sf)
    return rounded(raster.resample(d, _target(d), "bilinear").df)


@query("SELECT p_partkey AS id, (p_partkey % 40 + 0.5) * 30.0 AS x, 1000.0 - (floor(p_partkey / 40) + 0.5) * 30.0 AS y, CAST(floor((1000.0 - p_retailprice) / 30.0) AS BIGINT) AS row_of, CAST(floor(p_size / 30.0) AS BIGINT) AS col_of FROM part")
def grid_addressing(spark, sf):
    g = Grid(0.0, 1000.0, 30.0, 30.0, 30, 40)
    p = spark.read.parquet(f"{sf}/part.parquet")
    x, y = g.xy(F.floor(F.col("p_partkey") / 40), F.col("p_partkey") % 40)
    r, c = g.rowcol(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return p.select(F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"), r.alias("row_of"), c.alias("col_of"))


@query(f"WITH p AS ({A.PLACES}) SELECT place_id FROM p WHERE x >= 0 AND x < 500 AND y >= 100 AND y < 700")
def bounds_contains(spark, sf):
    return A.rows(spark, sf, A.PLACES).where(Bounds(0, 100, 500, 700).contains(F.col("x"), F.col("y"))).select("place_id")


@query(f"WITH t AS ({A.DEM}), z AS (SELECT row, col, value, CASE WHEN value > 1000 THEN 'high' ELSE 'low' END AS band FROM t) SELECT band, count(*) AS n_cells, count(value) AS n_valid, count(*) - count(value) AS n_missing FROM z GROUP BY band")
def missing_cells(spark, sf):
    return raster.cell_counts(A.rows(spark, sf, A.DEM).withColumn("band", F.when(F.col("value") > 1000, "high").otherwise("low")), "band")


# ---- units, text, coordinates


@query("SELECT p_partkey AS id, round(p_size * 0.3048 / 1000.0, 9) AS km, round(p_size * 60.0 / 3600.0, 9) AS hours, round(p_size * 10000.0 / 1000000.0, 9) AS km2, round(degrees(atan(p_size / 100.0)), 6) AS slope_deg, round(tan(radians(CAST(p_size AS DOUBLE))) * 100.0, 6) AS slope_percent FROM part")
def unit_conversions(spark, sf):
    v = F.col("p_size").cast("double")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("id"), F.round(U.convert_length(v, "ft", "km"), 9).alias("km"), F.round(U.convert_time(v, "min", "h"), 9).alias("hours"), F.round(U.convert_area(v, "ha", "km2"), 9).alias("km2"),
        F.round(U.convert_slope(v, "percent", "degree"), 6).alias("slope_deg"), F.round(U.convert_slope(v, "degree", "percent"), 6).alias("slope_percent"),
    )


_SPELLINGS = [" Metre ", "feet", "US survey foot", "km", "%", "Degrees", "rad", "international foot"]


@query("WITH s AS (SELECT n_nationkey AS id, list_extract(['" + "','".join(_SPELLINGS) + "'], CAST(n_nationkey % 8 + 1 AS INT)) AS w FROM nation) SELECT id, CASE WHEN lower(trim(w)) = 'metre' THEN 'm' WHEN w IN ('feet', 'international foot') THEN 'ft' WHEN w = 'km' THEN 'km' END AS length_unit, CASE w WHEN '%' THEN 'percent' WHEN 'Degrees' THEN 'degree' WHEN 'rad' THEN 'radian' END AS slope_unit FROM s")
def unit_spellings(spark, sf):
    w = F.array(*map(F.lit, _SPELLINGS))[(F.col("n_nationkey") % 8).cast("int")]
    return spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("id"), U.parse_length_unit(w).alias("length_unit"), U.parse_slope_unit(w).alias("slope_unit"))


_LATLON = "CAST(c_custkey % 170 AS DOUBLE) - 85.5 AS lat, CAST((c_custkey * 7) % 350 AS DOUBLE) - 175.25 AS lon"


def _tile(lat, lon, step):
    f = lambda v: f"CAST(floor({v} / {step}) * {step} AS INT)"
    return f"CASE WHEN {f(lat)} >= 0 THEN 'N' ELSE 'S' END", f"lpad(CAST(abs({f(lat)}) AS VARCHAR), 2, '0')", f"CASE WHEN {f(lon)} >= 0 THEN 'E' ELSE 'W' END", f"lpad(CAST(abs({f(lon)}) AS VARCHAR), 3, '0')"


_D, _L = _tile("lat", "lon", 1), _tile("lat", "lon", 3)


@query(f"WITH p AS (SELECT c_custkey AS id, {_LATLON} FROM customer) SELECT id, concat('Copernicus_DSM_COG_10_', {_D[0]}, {_D[1]}, '_00_', {_D[2]}, {_D[3]}, '_00_DEM') AS dem_tile, concat({', '.join(_L)}) AS cover_tile FROM p")
def tile_names(spark, sf):
    p = A.rows(spark, sf, f"SELECT c_custkey AS id, {_LATLON} FROM customer")
    return p.select("id", T.dem_tile_name(F.col("lat"), F.col("lon")).alias("dem_tile"), T.cover_tile_name(F.col("lat"), F.col("lon")).alias("cover_tile"))


@query("SELECT c_custkey AS id, printf('%.6f,%.6f,%.6f,%.6f', c_custkey / 8.0, c_custkey / 4.0, c_custkey / 2.0, c_custkey * 1.0) AS bbox FROM customer")
def bbox_text(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("id"), T.bbox_text(k / 8.0, k / 4.0, k / 2.0, k * F.lit(1.0)).alias("bbox"))


_TIMES = ["UNKNOWN", "not_applicable", "2023", "2023-05", "2023-05-01", "2026-03-14T09:00:00", "2026-03-14T09:00:00+09:00", "2026-03-14T09:00Z", "May 2023", ""]


@query("WITH s AS (SELECT c_custkey AS id, list_extract(['" + "','".join(_TIMES) + "'], CAST(c_custkey % 10 + 1 AS INT)) AS w FROM customer) SELECT id, CASE WHEN w = '' THEN 'invalid' WHEN w IN ('UNKNOWN', 'not_applicable') THEN w WHEN regexp_full_match(w, '[0-9]{4}') THEN 'year' WHEN regexp_full_match(w, '[0-9]{4}-[0-9]{2}') THEN 'month' WHEN regexp_full_match(w, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'day' WHEN regexp_full_match(w, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2})?(Z|[+-][0-9]{2}:[0-9]{2})') THEN 'instant' ELSE 'invalid' END AS kind FROM s")
def temporal_precision(spark, sf):
    w = F.array(*map(F.lit, _TIMES))[(F.col("c_custkey") % 10).cast("int")]
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), T.temporal_kind(w).alias("kind"))


_FIELDS = ["Patient ID", "population_total", "household-id", "full name", "phone", "care grade", "medication", "icd 10", "(rrn)", "e-mail"]


@query("WITH s AS (SELECT c_custkey AS id, list_extract(['" + "','".join(_FIELDS) + "'], CAST(c_custkey % 10 + 1 AS INT)) AS name FROM customer) SELECT id, name, CAST(CASE name WHEN 'Patient ID' THEN 5 WHEN 'household-id' THEN 19 WHEN 'full name' THEN 6 WHEN 'phone' THEN 18 WHEN 'care grade' THEN 13 WHEN 'medication' THEN 10 WHEN 'icd 10' THEN 9 END AS INT) AS pattern FROM s WHERE name NOT IN ('population_total', '(rrn)', 'e-mail')")
def privacy_guard(spark, sf):
    w = F.array(*map(F.lit, _FIELDS))[(F.col("c_custkey") % 10).cast("int")]
    names = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), w.alias("name"))
    return names.select("id", "name", T.private_pattern(F.col("name")).alias("pattern")).where("pattern is not null")


_GEO = "CAST(126.0 + (c_custkey % 300) / 100.0 AS DOUBLE) AS lon, CAST(33.5 + (c_custkey % 450) / 100.0 AS DOUBLE) AS lat"


@query(f"WITH p AS (SELECT c_custkey AS id, {_GEO} FROM customer) SELECT id, round(degrees(atan(tan(radians(lon - 129.0)) * sin(radians(lat)))), 6) AS convergence, true AS round_trip FROM p")
def projection_round_trip(spark, sf):
    """Forward and back under 5187 within 1e-9 degrees, and the convergence there."""
    p, c = A.rows(spark, sf, f"SELECT c_custkey AS id, {_GEO} FROM customer"), C.REGISTRY["EPSG:5187"]
    x, y = C.project(c, F.col("lon"), F.col("lat"))
    p = p.withColumns({"x": x, "y": y})
    lon, lat = C.unproject(c, F.col("x"), F.col("y"))
    near = (F.abs(lon - F.col("lon")) < 1e-9) & (F.abs(lat - F.col("lat")) < 1e-9)
    return p.select("id", F.round(C.meridian_convergence(c, F.col("lon"), F.col("lat")), 6).alias("convergence"), near.alias("round_trip"))


# ---- vectors

_EDGE_XY = f"nodes AS ({A.NODES}), edges AS ({A.EDGES}), e AS (SELECT edge_id, edges.u, edges.v, length_m, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges JOIN nodes a ON a.node = edges.u JOIN nodes b ON b.node = edges.v)"


@query(f"WITH {_EDGE_XY} SELECT min(least(x1, x2)) AS x_min, min(least(y1, y2)) AS y_min, max(greatest(x1, x2)) AS x_max, max(greatest(y1, y2)) AS y_max FROM e WHERE edge_id % 3 = 0")
def filtered_layer_bounds(spark, sf):
    layer = vector.filter_features(A.lines(spark, sf), F.try_element_at("props", F.lit("highway")) == "track")
    return vector.layer_bounds(layer)


@query("SELECT * FROM (VALUES ('bridge'), ('highway')) t(key)")
def property_keys(spark, sf):
    return vector.property_keys(A.lines(spark, sf))


@query(f"WITH {_EDGE_XY} SELECT 'LineString' AS type, count(*) AS n FROM e")
def geometry_types(spark, sf):
    return vector.geometry_types(A.lines(spark, sf))


_IN = "x1 >= 150 AND x1 <= 550 AND x2 >= 150 AND x2 <= 550 AND y1 >= 100 AND y1 <= 450 AND y2 >= 100 AND y2 <= 450"
_INSIDE_LEN = "greatest(0, least(greatest(x1, x2), 550) - greatest(least(x1, x2), 150)) + greatest(0, least(greatest(y1, y2), 450) - greatest(least(y1, y2), 100))"
_MEETS = "least(x1, x2) <= 550 AND greatest(x1, x2) >= 150 AND least(y1, y2) <= 450 AND greatest(y1, y2) >= 100"
_BOX = Bounds(150, 100, 550, 450, A.CRS)


@query(f"WITH {_EDGE_XY} SELECT edge_id AS feature_index FROM e WHERE {_MEETS}")
def clip_intersects(spark, sf):
    return vector.clip_features(A.lines(spark, sf), _BOX).df.select("feature_index")


@query(f"WITH {_EDGE_XY} SELECT edge_id AS feature_index FROM e WHERE {_IN} AND NOT (y1 = y2 AND y1 IN (100, 450)) AND NOT (x1 = x2 AND x1 IN (150, 550))")
def clip_within(spark, sf):
    return vector.clip_features(A.lines(spark, sf), _BOX, "within").df.select("feature_index")


@query(f"WITH {_EDGE_XY} SELECT edge_id AS feature_index, round({_INSIDE_LEN}, 6) AS length_m FROM e WHERE {_MEETS} AND {_INSIDE_LEN} > 0")
def clip_truncate(spark, sf):
    cut = vector.clip_features(A.lines(spark, sf), _BOX, "truncate").df
    length = F.aggregate("geom.parts", F.lit(0.0), lambda s, p: s + G.length(p))
    return cut.select("feature_index", F.round(length, 6).alias("length_m")).where("length_m > 0")


@query(f"WITH {_EDGE_XY}, p AS (SELECT edge_id % 6 + 1 AS code, edge_id AS k, u FROM e WHERE edge_id % 4 = 0), b AS (SELECT k, code, n.x + 10 AS x0, n.y + 10 AS y0 FROM p JOIN nodes n ON n.node = p.u), g AS (SELECT CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, (c.i + 0.5) * 25.0 AS x, (SELECT max(y) + 100 FROM nodes) - (r.i + 0.5) * 25.0 AS y FROM (SELECT unnest(range(CAST((SELECT max(y) + 100 FROM nodes) / 25 AS BIGINT))) AS i) r, range(40) c(i)), m AS (SELECT row, col, arg_max(code, k) AS code FROM g JOIN b ON x > x0 AND x < x0 + 130 AND y > y0 AND y < y0 + 70 GROUP BY row, col) SELECT g.row, g.col, CAST(coalesce(code, 255) AS BIGINT) AS value FROM g LEFT JOIN m ON m.row = g.row AND m.col = g.col")
def rasterise_polygons(spark, sf):
    g = A.graph(spark, sf)
    p = g.edges.where("edge_id % 4 = 0").join(g.nodes.select(F.col("node").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0")), "u")
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    ring = F.array(corner(10.0, 10.0), corner(140.0, 10.0), corner(140.0, 80.0), corner(10.0, 80.0), corner(10.0, 10.0))
    p = p.select(F.col("edge_id").alias("feature_index"), (F.col("edge_id") % 6 + 1).alias("code"), ring.alias("ring"))
    top = g.nodes.agg(F.max("y")).first()[0] + 100.0
    return vector.rasterise(p, Grid(0.0, top, 25.0, 25.0, int(top / 25), 40), 255).select("row", "col", F.col("value").cast("long").alias("value"))


#: Five kinds of features by the box: a closed road inside, one that leaves and comes back, one that only touches, a polygon around the box, one over its corner.
_CASES = "SELECT c_custkey AS k, c_custkey % 5 AS kind, CAST(c_custkey % 50 AS DOUBLE) AS d FROM customer"


@query(f"WITH c AS ({_CASES}) SELECT k AS feature_index, CASE kind WHEN 0 THEN 'LineString' WHEN 1 THEN 'MultiLineString' WHEN 2 THEN 'Point' ELSE 'Polygon' END AS type, CAST(CASE kind WHEN 1 THEN 2 ELSE 1 END AS INT) AS n_parts, CAST(CASE kind WHEN 0 THEN 16.0 WHEN 1 THEN 100.0 ELSE 0.0 END AS DOUBLE) AS length_m, CAST(CASE kind WHEN 3 THEN 140000.0 WHEN 4 THEN (10 + d) * 20 ELSE 0.0 END AS DOUBLE) AS area_m2 FROM c")
def clip_cases(spark, sf):
    """What cutting leaves of each, by closed forms in the SQL."""
    p = lambda x, y: F.struct((F.lit(0.0) + x).alias("x"), (F.lit(0.0) + y).alias("y"))
    d = F.col("d")
    box = lambda x0, y0, x1, y1: F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))
    shape = (
        F.when(F.col("kind") == 0, box(200 + d, 200, 204 + d, 204))
        .when(F.col("kind") == 1, F.array(p(500, 200 + d), p(600, 200 + d), p(600, 210 + d), p(500, 210 + d)))
        .when(F.col("kind") == 2, F.array(p(550, 150 + d), p(650, 160 + d)))
        .when(F.col("kind") == 3, box(-d, -d, 1000 + d, 1000))
        .otherwise(box(540 - d, 430, 640 - d, 530))
    )
    geom = F.struct(F.when(F.col("kind") < 3, "LineString").otherwise("Polygon").alias("type"), F.array(shape).alias("parts"))
    none = F.create_map().cast("map<string,string>")
    layer = VectorLayer(A.rows(spark, sf, _CASES).select(F.col("k").alias("feature_index"), geom.alias("geom"), none.alias("props")), A.CRS, Provenance("cases", "observed"))
    cut = vector.clip_features(layer, _BOX, "truncate").df
    line = F.col("geom.type").isin("LineString", "MultiLineString")
    length = F.aggregate("geom.parts", F.lit(0.0), lambda t, part: t + G.length(part))
    area = F.aggregate("geom.parts", F.lit(0.0), lambda t, part: t + G.ring_area(part))
    return cut.select("feature_index", F.col("geom.type").alias("type"), F.size("geom.parts").alias("n_parts"), F.when(line, F.round(length, 6)).otherwise(0.0).alias("length_m"), F.when(F.col("geom.type") == "Polygon", F.round(area, 6)).otherwise(0.0).alias("area_m2"))


@query(f"WITH {_EDGE_XY} SELECT edge_id AS feature_index, x1, y1, x2, y2, CASE WHEN edge_id % 3 = 0 THEN 'track' ELSE 'service' END AS highway FROM e")
def geojson_round_trip(spark, sf):
    """The lattice written as one FeatureCollection and read again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/terraweave-{uuid.uuid4().hex}.geojson"
    layer = A.lines(spark, sf)
    # Features are numbered by their place in the file, so their own number goes along as a property.
    numbered = layer.df.withColumn("props", F.map_concat("props", F.create_map(F.lit("number"), F.col("feature_index").cast("string"))))
    write_geojson(VectorLayer(numbered, layer.crs, layer.provenance), path)
    back = read_geojson(spark, path, layer.provenance)
    at = lambda i, c: F.col("geom.parts")[0][i][c]
    prop = lambda k: F.try_element_at("props", F.lit(k))
    return back.df.select(prop("number").cast("long").alias("feature_index"), at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(1, "x").alias("x2"), at(1, "y").alias("y2"), prop("highway").alias("highway"))


@query(f"WITH {_EDGE_XY} SELECT edge_id AS feature_index, true AS returns FROM e")
def vector_reprojection(spark, sf):
    """To the next belt and back within a millimetre, and elsewhere in between."""
    layer = A.lines(spark, sf)
    there = vector.reproject(layer, "EPSG:5186")
    both = vector.reproject(there, A.CRS).df.select("feature_index", F.col("geom.parts")[0][0].alias("q"))
    far = there.df.select("feature_index", F.col("geom.parts")[0][0].alias("m"))
    met = layer.df.select("feature_index", F.col("geom.parts")[0][0].alias("p")).join(both, "feature_index").join(far, "feature_index")
    gap = lambda a, b: F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))
    return met.select("feature_index", ((gap("p", "q") < 1e-3) & (gap("p", "m") > 1000)).alias("returns"))


# ---- road graphs

_ADJ = f"edges AS ({A.EDGES}), adj AS (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges)"
_COMP = f"nodes AS ({A.NODES}), {_ADJ}, reach(node, seen) AS (SELECT node, node FROM nodes UNION SELECT reach.node, adj.b FROM reach JOIN adj ON adj.a = reach.seen), comps AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"


def _comps(spark, sf):
    g = A.graph(spark, sf)
    return g, roads.components(g.nodes, g.edges)


@query(f"WITH RECURSIVE {_COMP} SELECT node, component FROM comps")
def connected_components(spark, sf):
    return _comps(spark, sf)[1]


_SUMMARY = f"marks AS ({A.MARKS}), n AS (SELECT component, count(*) AS node_count, sum(CASE WHEN is_exit THEN 1 ELSE 0 END) AS exit_count, sum(CASE WHEN is_settlement THEN 1 ELSE 0 END) AS settlement_count FROM comps JOIN marks ON marks.node = comps.node GROUP BY component), m AS (SELECT component, count(*) AS edge_count, sum(length_m) AS length_m FROM edges JOIN comps ON comps.node = edges.u GROUP BY component), summary AS (SELECT n.component, node_count, CAST(exit_count AS BIGINT) AS exit_count, CAST(settlement_count AS BIGINT) AS settlement_count, coalesce(edge_count, 0) AS edge_count, coalesce(length_m, 0) AS length_m, coalesce(edge_count, 0) = 1 AND exit_count = 0 AS is_isolated, settlement_count > 0 AND exit_count = 1 AS single_egress, settlement_count > 0 AND exit_count = 0 AS no_egress FROM n LEFT JOIN m ON m.component = n.component)"


@query(f"WITH RECURSIVE {_COMP}, {_SUMMARY} SELECT component, node_count, exit_count, settlement_count, edge_count, CAST(length_m AS DOUBLE) AS length_m, is_isolated, single_egress, no_egress FROM summary")
def component_summary(spark, sf):
    g, comps = _comps(spark, sf)
    return roads.component_summary(g.nodes, g.edges, comps, A.rows(spark, sf, A.MARKS))


@query(f"WITH RECURSIVE {_COMP}, {_SUMMARY} SELECT component, edge_count, round(edge_count / (SELECT sum(edge_count) FROM summary), 4) AS edge_fraction FROM summary ORDER BY edge_count DESC, component LIMIT 1")
def largest_component(spark, sf):
    return roads.largest_component(component_summary(spark, sf))


@query(f"WITH edges AS ({A.EDGES}), d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) t GROUP BY node) SELECT degree, count(*) AS n FROM d GROUP BY degree")
def degree_histogram(spark, sf):
    return roads.degrees(A.graph(spark, sf).edges).groupBy("degree").agg(F.count("*").alias("n"))


@query(f"WITH edges AS ({A.EDGES}) SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS multiplicity, CAST(min(length_m) AS DOUBLE) AS length_m FROM edges WHERE u <> v GROUP BY 1, 2")
def simple_graph(spark, sf):
    return roads.simple_edges(A.graph(spark, sf).edges).select("u", "v", "multiplicity", F.col("length_m").cast("double").alias("length_m"))


@query(f"WITH edges AS ({A.EDGES}) SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS multiplicity FROM edges WHERE u <> v GROUP BY 1, 2 HAVING count(*) > 1")
def parallel_edges(spark, sf):
    return roads.parallel_edges(A.graph(spark, sf).edges)


@query(f"WITH {_EDGE_XY} SELECT min(edge_id) AS first_edge, count(*) AS n FROM e GROUP BY least(u, v), greatest(u, v) HAVING count(*) > 1")
def duplicate_geometry(spark, sf):
    return roads.duplicate_geometry(A.graph(spark, sf).edges)


_CUT = "pairs AS (SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS m, min(length_m) AS length_m FROM edges WHERE u <> v GROUP BY 1, 2), walk(eu, ev, seen) AS (SELECT u, v, u FROM pairs WHERE m = 1 UNION SELECT eu, ev, adj.b FROM walk JOIN adj ON adj.a = walk.seen AND NOT (adj.a = eu AND adj.b = ev) AND NOT (adj.a = ev AND adj.b = eu)), bridge AS (SELECT u, v, length_m FROM pairs WHERE m = 1 AND NOT EXISTS (SELECT 1 FROM walk WHERE eu = u AND ev = v AND seen = v))"


@query(f"WITH RECURSIVE {_ADJ}, {_CUT} SELECT u, v, CAST(length_m AS DOUBLE) AS length_m FROM bridge")
def bridge_edges(spark, sf):
    g, comps = _comps(spark, sf)
    return roads.bridges(g.edges, comps)


@query(f"WITH RECURSIVE {_COMP}, tries AS (SELECT a AS cut, min(b) AS start FROM adj GROUP BY a), walk(cut, seen) AS (SELECT cut, start FROM tries UNION SELECT cut, adj.b FROM walk JOIN adj ON adj.a = walk.seen AND adj.b <> cut), size AS (SELECT component, count(*) AS n FROM comps GROUP BY component), got AS (SELECT cut, count(*) AS n FROM walk GROUP BY cut) SELECT got.cut AS node FROM got JOIN comps ON comps.node = got.cut JOIN size ON size.component = comps.component WHERE got.n < size.n - 1")
def articulation_points(spark, sf):
    g, comps = _comps(spark, sf)
    return roads.articulation_points(g.edges, comps)


_FLAGS = f"marks AS ({A.MARKS})"


@query(f"WITH RECURSIVE {_COMP}, {_FLAGS}, {_CUT}, side(bu, bv, home, seen) AS (SELECT bridge.u, bridge.v, marks.node, marks.node FROM bridge JOIN comps c ON c.node = bridge.u JOIN comps d ON d.component = c.component JOIN marks ON marks.node = d.node AND marks.is_settlement UNION SELECT bu, bv, home, adj.b FROM side JOIN adj ON adj.a = side.seen AND NOT (adj.a = bu AND adj.b = bv) AND NOT (adj.a = bv AND adj.b = bu)), ok AS (SELECT bu, bv, home, max(CASE WHEN is_exit THEN 1 ELSE 0 END) AS safe FROM side JOIN marks ON marks.node = side.seen GROUP BY 1, 2, 3), before AS (SELECT a.node AS home FROM comps a JOIN comps b ON b.component = a.component JOIN marks ON marks.node = b.node AND marks.is_exit GROUP BY a.node) SELECT bu AS u, bv AS v, CAST(min(bridge.length_m) AS DOUBLE) AS length_m, count(DISTINCT ok.home) AS n_cut_off FROM ok JOIN before ON before.home = ok.home JOIN bridge ON bridge.u = bu AND bridge.v = bv WHERE safe = 0 GROUP BY bu, bv")
def critical_links(spark, sf):
    g, comps = _comps(spark, sf)
    found = roads.critical_links(g.edges, comps, A.rows(spark, sf, A.MARKS))
    return found.select("u", "v", "length_m", F.size("cut_off").cast("long").alias("n_cut_off"))


@query(f"WITH edges AS ({A.EDGES}), marks AS ({A.MARKS}), d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) t GROUP BY node) SELECT d.node FROM d JOIN marks ON marks.node = d.node WHERE degree = 1 AND NOT is_exit")
def dead_ends(spark, sf):
    return roads.dead_ends(A.graph(spark, sf).edges, A.rows(spark, sf, A.MARKS).where("is_exit"))


_EXIT_BOX = Bounds(150, 100, 550, 450, A.CRS)


@query(f"WITH {_EDGE_XY}, inn AS (SELECT node, x >= 150 AND x < 550 AND y >= 100 AND y < 450 AS i FROM nodes), dep AS (SELECT e.*, a.i AS iu, b.i AS iv FROM e JOIN inn a ON a.node = e.u JOIN inn b ON b.node = e.v), ends AS (SELECT edge_id, x1, x2, y1, y2, u AS node FROM dep WHERE iu OR NOT iv UNION ALL SELECT edge_id, x1, x2, y1, y2, v FROM dep WHERE iv OR NOT iu), r AS (SELECT node, 1 AS k FROM ends WHERE edge_id % 10 = 0 UNION ALL SELECT node, 2 FROM ends WHERE {_MEETS} AND {_INSIDE_LEN} > 0 AND {_INSIDE_LEN} < greatest(x1, x2) - least(x1, x2) + greatest(y1, y2) - least(y1, y2) UNION ALL SELECT node, 3 FROM nodes WHERE (x >= 150 AND x <= 550 AND y >= 100 AND y <= 450 AND least(x - 150, 550 - x, y - 100, 450 - y) <= 60) OR (NOT (x >= 150 AND x <= 550 AND y >= 100 AND y <= 450) AND sqrt(pow(greatest(150 - x, 0, x - 550), 2) + pow(greatest(100 - y, 0, y - 450), 2)) <= 60)) SELECT node, CASE min(k) WHEN 1 THEN 'tagged' WHEN 2 THEN 'crossing' ELSE 'boundary' END AS source FROM r GROUP BY node")
def exit_nodes(spark, sf):
    return roads.exit_nodes(A.graph(spark, sf), _EXIT_BOX, 60.0, "bridge")


@query(f"WITH nodes AS ({A.NODES}), p AS ({A.PLACES}), d AS (SELECT place_id, node, sqrt(pow(p.x - nodes.x, 2) + pow(p.y - nodes.y, 2)) AS dist FROM p, nodes), r AS (SELECT place_id, node, dist, row_number() OVER (PARTITION BY place_id ORDER BY dist, node) AS k FROM d WHERE dist <= 60) SELECT p.place_id, node, round(dist, 6) AS distance FROM p LEFT JOIN r ON r.place_id = p.place_id AND k = 1")
def settlement_nodes(spark, sf):
    return rounded(roads.nearest_nodes(A.graph(spark, sf).nodes, A.rows(spark, sf, A.PLACES), 60.0))


@query(f"WITH p AS ({A.PLACES}), q AS (SELECT place_id, floor(x / 40) AS x, floor(y / 40) AS y FROM p) SELECT place_id AS pid, min(place_id) OVER (PARTITION BY x, y) AS node FROM q")
def exact_endpoint_clusters(spark, sf):
    p = A.rows(spark, sf, A.PLACES).select(F.col("place_id").alias("pid"), F.floor(F.col("x") / 40).cast("double").alias("x"), F.floor(F.col("y") / 40).cast("double").alias("y"))
    return roads.cluster_endpoints(p, 0.0).select("pid", "node")


@query(f"WITH RECURSIVE p AS (SELECT place_id, x, y FROM ({A.PLACES}) t), n AS (SELECT a.place_id AS a, b.place_id AS b FROM p a, p b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 45), reach(a, b) AS (SELECT a, b FROM n UNION SELECT reach.a, n.b FROM reach JOIN n ON n.a = reach.b) SELECT a AS pid, min(b) AS node FROM reach GROUP BY a")
def snapped_endpoint_clusters(spark, sf):
    p = A.rows(spark, sf, A.PLACES).select(F.col("place_id").alias("pid"), "x", "y")
    return roads.cluster_endpoints(p, 45.0).select("pid", "node")


_DIAGONALS = "SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) * 10.0 AS x1, CAST(0 AS DOUBLE) AS y1, CAST((s_suppkey * 7) % 100 AS DOUBLE) * 10.0 AS x2, CAST(1000 AS DOUBLE) AS y2 FROM supplier"
_DIAG = _DIAGONALS
_DEN = "((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1))"
_TT = f"(((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / {_DEN})"


@query(f"WITH s AS ({_DIAG}), m AS (SELECT a.id AS a, b.id AS b, a.x1 + {_TT} * (a.x2 - a.x1) AS x, a.y1 + {_TT} * (a.y2 - a.y1) AS y FROM s a JOIN s b ON a.id < b.id AND {_DEN} <> 0) SELECT a, b, round(x, 3) AS x, round(y, 3) AS y FROM m WHERE y BETWEEN -1e-9 AND 1000 + 1e-9")
def line_crossings(spark, sf):
    s = A.rows(spark, sf, _DIAGONALS)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    met = roads.crossing_points(s.select("id", F.array(p("x1", "y1"), p("x2", "y2")).alias("line")), "id")
    # Rounded once and as the SQL does, by the product: half of it away from zero.
    whole = lambda c: F.floor(F.abs(c) * 1000) + F.when(F.abs(c) * 1000 - F.floor(F.abs(c) * 1000) >= 0.5, 1).otherwise(0)
    return met.select("a", "b", *[(F.signum(c) * whole(F.col(c)) / 1000.0).alias(c) for c in ("x", "y")])


@query(f"WITH s AS ({_DIAG}), m AS (SELECT a.id AS a, b.id AS b, a.x1 + {_TT} * (a.x2 - a.x1) AS x, a.y1 + {_TT} * (a.y2 - a.y1) AS y FROM s a JOIN s b ON a.id < b.id AND {_DEN} <> 0), e AS (SELECT x1 AS x, y1 AS y FROM s UNION SELECT x2, y2 FROM s) SELECT a, b FROM m WHERE y BETWEEN -1e-9 AND 1000 + 1e-9 AND NOT EXISTS (SELECT 1 FROM e WHERE sqrt(pow(e.x - m.x, 2) + pow(e.y - m.y, 2)) <= 0.5)")
def crossings_without_node(spark, sf):
    s = A.rows(spark, sf, _DIAGONALS)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    nodes = s.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(s.select(F.col("x2").alias("x"), F.col("y2").alias("y"))).distinct()
    g = roads.RoadGraph(nodes, s.select(F.col("id").alias("edge_id"), F.array(p("x1", "y1"), p("x2", "y2")).alias("line")), C.parse_crs(A.CRS))
    return roads.crossings_without_node(g).select("a", "b")


_CELLS = f"SELECT CAST(floor(x / 130) * 100 + floor(y / 130) AS BIGINT) AS node, x, y FROM ({A.PLACES}) p"


@query(f"WITH p AS ({_CELLS}) SELECT a.node, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS span FROM p a JOIN p b ON a.node = b.node GROUP BY a.node")
def cluster_spans(spark, sf):
    return rounded(roads.cluster_spans(A.rows(spark, sf, _CELLS)))


@query(f"WITH p AS ({_CELLS}) SELECT node, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p GROUP BY node")
def cluster_centroids(spark, sf):
    return rounded(roads.centroids(A.rows(spark, sf, _CELLS)))


@query(f"WITH e AS (SELECT edge_id, u, CASE WHEN edge_id % 5 = 0 THEN u ELSE v END AS v FROM ({A.EDGES}) t) SELECT edge_id, u FROM e WHERE u = v")
def self_loops(spark, sf):
    return roads.self_loops(A.rows(spark, sf, f"SELECT edge_id, u, CASE WHEN edge_id % 5 = 0 THEN u ELSE v END AS v FROM ({A.EDGES}) t")).select("edge_id", "u")


@query(f"WITH {_EDGE_XY}, b AS (SELECT * FROM (VALUES ('all', 0, 0, 900, 900), ('sw', 0, 0, 450, 450), ('se', 450, 0, 900, 450), ('nw', 0, 450, 450, 900), ('ne', 450, 450, 900, 900)) t(box, x0, y0, xe, ye)), l AS (SELECT box, x0, y0, xe, ye, CASE WHEN least(x1, x2) <= xe AND greatest(x1, x2) >= x0 AND least(y1, y2) <= ye AND greatest(y1, y2) >= y0 THEN greatest(0, least(greatest(x1, x2), xe) - greatest(least(x1, x2), x0)) + greatest(0, least(greatest(y1, y2), ye) - greatest(least(y1, y2), y0)) ELSE 0 END AS len FROM e, b) SELECT box, round(sum(len) / 1000.0, 6) AS length_km, round(sum(len) / 1000.0 / (min(xe - x0) * min(ye - y0) / 1e6), 3) AS km_per_km2 FROM l GROUP BY box")
def network_density(spark, sf):
    return roads.network_density(A.graph(spark, sf).edges, Bounds(0, 0, 900, 900, A.CRS))


@query(f"WITH edges AS ({A.EDGES}), t AS (SELECT 'highway' AS attribute, CASE WHEN edge_id % 3 = 0 THEN 'track' ELSE 'service' END AS value FROM edges UNION ALL SELECT 'bridge', CASE WHEN edge_id % 10 = 0 THEN 'yes' ELSE 'no' END FROM edges), c AS (SELECT attribute, value, count(*) AS n FROM t GROUP BY 1, 2) SELECT attribute, value, n, CAST(row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value) AS INT) AS rank FROM c")
def attribute_values(spark, sf):
    return roads.attribute_availability(A.graph(spark, sf).edges)[1]


@query(f"WITH edges AS ({A.EDGES}), a AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in roads.ATTRIBUTES)}) t(attribute)) SELECT attribute, CASE WHEN attribute IN ('highway', 'bridge') THEN (SELECT count(*) FROM edges) ELSE 0 END AS present, CASE WHEN attribute IN ('highway', 'bridge') THEN 1.0 ELSE 0.0 END AS fraction FROM a")
def attribute_availability(spark, sf):
    return roads.attribute_availability(A.graph(spark, sf).edges)[0]


@query(f"WITH edges AS ({A.EDGES}) SELECT edge_id FROM edges WHERE edge_id % 10 = 0")
def grade_separations(spark, sf):
    return roads.grade_separations(A.graph(spark, sf).edges).select("edge_id")


@query(f"WITH RECURSIVE {_COMP} SELECT (SELECT count(*) FROM nodes WHERE node IN (SELECT a FROM adj)) AS nodes, (SELECT count(*) FROM edges) AS edges, CAST((SELECT count(*) FROM edges) * 100.0 AS DOUBLE) AS length_m, (SELECT count(DISTINCT component) FROM comps WHERE node IN (SELECT a FROM adj)) AS components")
def build_road_graph(spark, sf):
    """The whole construction from a line layer: explode, node, cluster, link."""
    g = roads.build_graph(A.lines(spark, sf), 1.0)
    one = g.nodes.agg(F.count("*").alias("nodes")).join(g.edges.agg(F.count("*").alias("edges"), F.sum("length_m").alias("length_m")))
    return one.join(roads.components(g.nodes, g.edges).agg(F.count_distinct("component").alias("components")))


@query("WITH w AS (SELECT l_orderkey AS way, l_linenumber AS i, l_partkey AS ref FROM lineitem), j AS (SELECT way, i, ref, p_partkey, p_retailprice FROM w LEFT JOIN (SELECT * FROM part WHERE p_partkey % 20 <> 0) p ON p_partkey = ref) SELECT way, count(*) AS n_refs, round(sum(p_retailprice), 2) AS checksum FROM j GROUP BY way HAVING count(*) = count(p_partkey) AND count(*) >= 2")
def way_node_join(spark, sf):
    """Ordered references of ways to nodes: a way with an absent node or under two points goes."""
    w = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("ref"))
    n = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("ref"), "p_retailprice")
    j = join_ways(w, n, keep=["p_retailprice"]).where("n = found and n >= 2")
    return j.select("way", F.col("n").alias("n_refs"), F.round(F.aggregate("ps", F.lit(0.0), lambda t, q: t + q["p"]["p_retailprice"]), 2).alias("checksum"))


# ---- records


def _strata():
    s = lambda lo, hi, c: F.struct(F.lit(lo).cast("int").alias("lower"), F.lit(hi).cast("int").alias("upper"), F.col(c).alias("count"))
    return F.array(s(0, 15, "young"), s(15, None, "old"))


@query(f"WITH p AS ({A.POPULATION}) SELECT settlement_id, total, young + coalesce(old, 0) AS counted, CASE WHEN total IS NOT NULL AND old IS NOT NULL THEN young + old = total END AS matches FROM p")
def population_strata(spark, sf):
    p = A.rows(spark, sf, A.POPULATION).withColumn("strata", _strata())
    return p.select("settlement_id", "total", records.strata_total(F.col("strata")).alias("counted"), records.strata_match(F.col("strata"), F.col("total")).alias("matches"))


@query(f"WITH p AS ({A.POPULATION}) SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(CASE WHEN total IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(sum(CASE WHEN total IS NOT NULL AND old IS NOT NULL AND young + old <> total THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch FROM p")
def population_summary(spark, sf):
    return records.population_summary(A.rows(spark, sf, A.POPULATION).withColumn("strata", _strata()), total="total")


_BANDS = "SELECT CAST(n_nationkey * 10 AS INT) AS lower, CAST(CASE WHEN n_nationkey = 24 THEN NULL ELSE n_nationkey * 10 + 10 + n_nationkey % 4 * 3 END AS INT) AS upper FROM nation"


@query(f"WITH s AS ({_BANDS}) SELECT a.lower AS l1, a.upper AS u1, b.lower AS l2, b.upper AS u2 FROM s a, s b WHERE a.lower < b.lower AND b.lower < coalesce(a.upper, 1000)")
def strata_overlaps(spark, sf):
    return records.overlapping_strata(A.rows(spark, sf, _BANDS)).select("l1", "u1", "l2", "u2")


@query(f"WITH s AS ({_BANDS}) SELECT lower, CASE WHEN upper IS NULL THEN concat(CAST(lower AS VARCHAR), '+') ELSE concat(CAST(lower AS VARCHAR), '-', CAST(upper - 1 AS VARCHAR)) END AS label FROM s")
def strata_labels(spark, sf):
    return A.rows(spark, sf, _BANDS).select("lower", records.stratum_label(F.col("lower"), F.col("upper")).alias("label"))


_KINDS = {"0": "shelter", "1": "temporary_refuge_candidate", "2": "responder_base", "3": "fire_station", "4": "shelter"}


@query(f"WITH f AS ({A.FACILITIES}), k AS (SELECT CASE tag {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in _KINDS.items())} ELSE 'other' END AS kind, capacity, assessed FROM f) SELECT kind, count(*) AS n, count(capacity) AS with_capacity, CAST(sum(CASE WHEN assessed THEN 1 ELSE 0 END) AS BIGINT) AS assessed FROM k GROUP BY kind")
def facilities_summary(spark, sf):
    return records.facilities_summary(records.facilities(A.rows(spark, sf, A.FACILITIES), "tag", _KINDS, "other"), "capacity", "assessed")


@query(f"WITH t AS ({A.CODES}), c AS (SELECT DISTINCT coalesce(value * 2 - 1, 255) AS code FROM t) SELECT CAST(code AS INT) AS code, CASE code WHEN 255 THEN 'nodata' {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in records.DEMO_CLASSES.items())} ELSE 'UNKNOWN' END AS label FROM c")
def class_labels(spark, sf):
    c = A.rows(spark, sf, A.CODES).select(F.coalesce(F.col("value") * 2 - 1, F.lit(255)).alias("code")).distinct()
    return c.select("code", records.DEMO_SCHEME.label(F.col("code")).alias("label"))


@query(f"WITH t AS ({A.CODES}) SELECT DISTINCT CAST(value * 2 - 1 AS INT) AS code FROM t WHERE value * 2 - 1 NOT IN (1, 2, 3, 4, 5, 6, 255)")
def unknown_codes(spark, sf):
    return records.DEMO_SCHEME.unknown_codes(A.rows(spark, sf, A.CODES).withColumn("value", F.col("value") * 2 - 1))


# ---- provenance, validation, contract


@query(f"WITH l AS ({A.LAYERS}), r AS (SELECT bundle, CASE data_class WHEN 'derived' THEN 5 WHEN 'synthetic' THEN 6 ELSE 7 END AS k FROM l) SELECT bundle, CASE min(k) WHEN 5 THEN 'derived' WHEN 6 THEN 'synthetic' ELSE 'observed' END AS data_class FROM r GROUP BY bundle")
def combined_data_class(spark, sf):
    return facts.combined_classes(A.rows(spark, sf, A.LAYERS), "bundle")


_FIELDS_U = ("crs", "temporal_reference", "checksum", "valid_from", "licence")


@query(f"WITH l AS ({A.LAYERS}), u AS ({' UNION ALL '.join(f'SELECT bundle, {chr(39)}{f}{chr(39)} AS field FROM l WHERE {f} = {chr(39)}UNKNOWN{chr(39)}' for f in _FIELDS_U)}) SELECT field, count(*) AS n FROM u GROUP BY field")
def unknown_fields(spark, sf):
    return facts.unknown_fields(A.rows(spark, sf, A.LAYERS), _FIELDS_U)


@query(f"WITH l AS ({A.LAYERS}) SELECT DISTINCT bundle, licence, strpos(licence, 'ODbL') > 0 OR strpos(lower(licence), 'attribution') > 0 AS attribution FROM l WHERE licence <> 'UNKNOWN'")
def licence_rollup(spark, sf):
    return contract.licence_rollup(A.rows(spark, sf, A.LAYERS).where("licence <> 'UNKNOWN'"), "bundle")


def _checks(name: str, facts: str, table: str, subject: str) -> None:
    def run(spark, sf):
        return validation.findings(A.rows(spark, sf, facts), table, subject)

    run.__name__ = name
    query(findings_sql(facts, table, subject))(run)


_checks("validate_layers", A.LAYERS, "layer", "layer")
_checks("validate_population", f"SELECT settlement_id, total, CASE WHEN old IS NOT NULL THEN young + old END AS strata_sum, count_basis FROM ({A.POPULATION}) p", "population", "settlement_id")
_checks("validate_facilities", f"SELECT tag, sum(CASE WHEN assessed THEN 0 ELSE 1 END) AS n_unassessed, sum(CASE WHEN operational_status = 'UNKNOWN' THEN 1 ELSE 0 END) AS n_status_unknown, sum(CASE WHEN capacity IS NULL THEN 1 ELSE 0 END) AS n_without_capacity FROM ({A.FACILITIES}) f GROUP BY tag", "facilities", "tag")
_checks("validate_roads", A.ROADS, "roads", "network")
_checks("validate_bundles", A.BUNDLES, "bundle", "bundle_id")
_checks("validate_directories", A.DIRECTORIES, "directory", "directory")
_checks("validate_files", A.FILES, "files", "file")


@query(f"WITH f AS ({findings_sql(A.ROADS, 'roads', 'network')}) SELECT CAST(sum(CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN severity = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS warnings, CAST(sum(CASE WHEN severity = 'INFO' THEN 1 ELSE 0 END) AS BIGINT) AS infos, 'pass_with_warnings' AS status FROM f")
def validation_status(spark, sf):
    return validation.status(QUERIES["validate_roads"](spark, sf))


_TAG_SQL = [("n_unknown > 0", "INCOMPLETE_PROVENANCE"), ("coalesce(licence, '') IN ('', 'UNKNOWN')", "LICENCE_UNKNOWN"), ("checksum = 'UNKNOWN'", "NOT_CHECKSUMMED"), ("data_kind = 'raster' AND NOT nodata_declared AND nodata_text <> 'not_applicable'", "NO_NODATA_DECLARED"), ("n_sources = 0", "NO_SOURCE_RECORDED"), ("data_kind = 'raster' AND own_grid", "REPROJECTED_ONTO_ITS_OWN_GRID"), ("surface_model = 'dsm'", "SURFACE_MODEL_NOT_TERRAIN"), ("valid_from = 'UNKNOWN' OR valid_to = 'UNKNOWN'", "TEMPORAL_VALIDITY_NOT_ESTABLISHED")]


@query(f"WITH l AS ({A.LAYERS}) SELECT layer, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{t}{chr(39)} END' for c, t in _TAG_SQL)}) AS tags FROM l")
def layer_limitations(spark, sf):
    return A.rows(spark, sf, A.LAYERS).select("layer", F.array_join(contract.limitations(), ",").alias("tags"))


_GRIDS = f"SELECT bundle, CASE WHEN data_kind = 'raster' THEN x_size END AS x_size, y_size, floor(bundle / 40) * 0 + CASE WHEN bundle % 2 = 0 THEN 0 ELSE x_origin END AS x_origin, 0 AS y_origin, n_rows, n_cols FROM ({A.LAYERS}) l WHERE layer % 23 <> 0 AND bundle <> 6"


@query(f"WITH g AS ({_GRIDS}), d AS (SELECT DISTINCT bundle, x_size, y_size, x_origin, y_origin, n_rows, n_cols FROM g WHERE x_size IS NOT NULL), n AS (SELECT bundle, count(*) AS n FROM d GROUP BY bundle), b AS (SELECT DISTINCT bundle FROM g) SELECT b.bundle, CASE WHEN n IS NULL THEN 'NO_RASTERS' WHEN n = 1 THEN 'SHARED' ELSE 'MISMATCHED' END AS grid_status FROM b LEFT JOIN n ON n.bundle = b.bundle")
def canonical_grid(spark, sf):
    return contract.canonical_grid(A.rows(spark, sf, _GRIDS), "bundle")


_SLOT_ROWS = "SELECT CAST(floor(o_orderkey / 5) AS BIGINT) % 40 AS bundle, o_orderkey % 5 AS k FROM orders"
_SLOTS = f"SELECT bundle, CASE WHEN (bundle * 7 + k * 3) % 11 = 0 THEN 'other' WHEN k = 0 THEN 'terrain' WHEN k = 1 THEN 'roads' WHEN k = 2 THEN 'fuels' WHEN k = 3 THEN 'population' ELSE 'facilities' END AS slot, min((bundle + k) % 9) <> 5 AS usable, min((bundle + k) % 6) = 0 AS material FROM ({_SLOT_ROWS}) s GROUP BY 1, 2"
_GRID_STATUS = "SELECT n_nationkey AS bundle, CASE WHEN n_nationkey % 3 = 0 THEN 'MISMATCHED' ELSE 'SHARED' END AS grid_status FROM nation"
_NEED = ", ".join(f"('{p}', '{s}')" for p, ss in contract.PROFILES.items() for s in ss)


@query(f"WITH s AS ({_SLOTS}), g AS ({_GRID_STATUS}), need AS (SELECT * FROM (VALUES {_NEED}) t(profile, slot)), h AS (SELECT g.bundle, profile, grid_status, need.slot, NOT coalesce(usable, false) AS missing, coalesce(material, false) AS material FROM g CROSS JOIN need LEFT JOIN s ON s.bundle = g.bundle AND s.slot = need.slot) SELECT bundle, profile, CASE WHEN max(CASE WHEN missing THEN 1 ELSE 0 END) = 1 THEN 'INCOMPLETE' WHEN max(CASE WHEN material THEN 1 ELSE 0 END) = 1 OR (profile <> 'ASSISTED_DISPATCH' AND grid_status = 'MISMATCHED') THEN 'READY_WITH_LIMITATIONS' ELSE 'READY' END AS status, coalesce(string_agg(CASE WHEN missing THEN slot END, ',' ORDER BY slot), '') AS missing FROM h GROUP BY bundle, profile, grid_status")
def consumer_readiness(spark, sf):
    s = A.rows(spark, sf, _SLOTS).select("bundle", "slot", "usable", F.when(F.col("material"), F.array(F.lit("LICENCE_UNKNOWN"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return contract.compatibility(s, A.rows(spark, sf, _GRID_STATUS), "bundle")


@query("WITH m AS (SELECT p_partkey AS k, p_size AS c FROM part WHERE p_partkey % 3 <> 0), d AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 1 THEN -1 ELSE p_size END AS c FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(m.k, d.k) AS file, CASE WHEN m.k IS NULL THEN 'orphan' WHEN d.k IS NULL THEN 'missing' ELSE 'changed' END AS state FROM m FULL OUTER JOIN d ON m.k = d.k WHERE m.k IS NULL OR d.k IS NULL OR m.c <> d.c")
def manifest_differences(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    m = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("c"))
    d = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("file"), F.when(F.col("p_partkey") % 10 == 1, -1).otherwise(F.col("p_size")).alias("c"))
    return contract.differences(m, d, "file", "c")


@query("SELECT p_partkey AS file, sha256(concat(CAST(p_partkey AS VARCHAR), '|', p_name)) AS checksum FROM part")
def row_checksums(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").withColumnRenamed("p_partkey", "file")
    return raster_files.row_checksums(p, "file", ["file", "p_name"])


def _records(df: DataFrame, name: str, **props) -> VectorLayer:
    """Rows as point features whose properties are texts; a missing value is no property."""
    pairs = F.create_map(*[c for k, v in props.items() for c in (F.lit(k), F.col(v).cast("string"))])
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))).alias("parts"))
    return VectorLayer(df.select(F.monotonically_increasing_id().alias("feature_index"), geom.alias("geom"), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("props")), A.CRS, Provenance(name, "observed"))


@query(f"SELECT CAST(settlement_id AS VARCHAR) AS settlement_id, total AS population_total, young, old, count_basis, CASE WHEN young IS NULL AND old IS NULL THEN NULL ELSE coalesce(young, 0) + coalesce(old, 0) END AS counted FROM ({A.POPULATION}) p")
def settlement_records(spark, sf):
    layer = _records(A.rows(spark, sf, A.POPULATION), "population", settlement_id="settlement_id", population_total="total", young="young", old="old", count_basis="count_basis")
    out = records.settlements(layer, strata=(("young", 0, 15), ("old", 15, None)))
    return out.select("settlement_id", "population_total", F.col("strata")[0]["count"].alias("young"), F.col("strata")[1]["count"].alias("old"), "count_basis", records.strata_total(F.col("strata")).alias("counted"))


@query(f"SELECT CAST(facility_id AS VARCHAR) AS facility_id, CASE tag WHEN '0' THEN 'shelter' WHEN '1' THEN 'fire_station' WHEN '2' THEN 'responder_base' ELSE 'other' END AS kind, CAST(capacity AS BIGINT) AS capacity_persons, 'UNKNOWN' AS operational_status, tag AS source_kind_tag FROM ({A.FACILITIES}) f")
def facility_records(spark, sf):
    layer = _records(A.rows(spark, sf, A.FACILITIES), "facilities", facility_id="facility_id", kind="tag", capacity="capacity")
    out = records.facilities_from_layer(layer, {"0": "shelter", "1": "fire_station", "2": "responder_base"}, capacity_property="capacity", unmapped="other")
    return out.select("facility_id", "kind", "capacity_persons", "operational_status", "source_kind_tag")


@query(f"SELECT place_id, x + 1.5 AS x, y + 2.0 AS y FROM ({A.PLACES}) p")
def representative_points(spark, sf):
    """Triangles with a right angle at each place."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(6, 0), corner(0, 4), corner(0, 0))
    rows = A.rows(spark, sf, A.PLACES).withColumn("parts", F.array(ring))
    return rows.select("place_id", G.representative_point(F.lit("Polygon"), F.col("parts")).alias("p")).select("place_id", "p.x", "p.y")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
