"""The driver's star-schema tables read as layers; each mapping is one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Grid, Provenance, RasterLayer, VectorLayer
from .operators.roads import RoadGraph

CRS = "EPSG:5187"
DEM_COLS, BIG_COLS, SIDE, CELL = 40, 250, 10, 100.0

DEM = f"SELECT CAST(floor(p_partkey / {DEM_COLS}) AS INT) AS row, CAST(p_partkey % {DEM_COLS} AS INT) AS col, CASE WHEN p_size <> 50 THEN p_retailprice + p_size END AS value FROM part"
BIG = f"SELECT CAST(floor(event_id / {BIG_COLS}) AS INT) AS row, CAST(event_id % {BIG_COLS} AS INT) AS col, CASE WHEN event_id % 17 <> 3 THEN value END AS value FROM events"
CODES = f"SELECT CAST(floor(event_id / {BIG_COLS}) AS INT) AS row, CAST(event_id % {BIG_COLS} AS INT) AS col, CASE WHEN event_id % 11 <> 5 THEN CAST(length(event_type) % 5 + 1 AS INT) END AS value FROM events"
#: A lattice with holes: rows of it hang together by columns, and some edges are doubled.
NODES = f"SELECT s_suppkey AS node, CAST(s_suppkey % {SIDE} AS DOUBLE) * {CELL} AS x, CAST(floor(s_suppkey / {SIDE}) AS DOUBLE) * {CELL} AS y FROM supplier"
EDGES = f"""SELECT 4 * s_suppkey AS edge_id, s_suppkey AS u, s_suppkey + 1 AS v, {CELL} AS length_m FROM supplier WHERE s_suppkey % {SIDE} < {SIDE - 1} AND s_suppkey % 7 <> 3
UNION ALL SELECT 4 * s_suppkey + 1, s_suppkey, s_suppkey + {SIDE}, {CELL} FROM supplier WHERE s_suppkey % 12 = 5 AND s_suppkey + {SIDE} <= (SELECT max(s_suppkey) FROM supplier)
UNION ALL SELECT 4 * s_suppkey + 2, s_suppkey, s_suppkey + 1, {CELL + 20} FROM supplier WHERE s_suppkey % {SIDE} < {SIDE - 1} AND s_suppkey % 7 = 1"""
MARKS = "SELECT s_suppkey AS node, s_suppkey % 9 = 4 AS is_exit, s_suppkey % 5 = 2 AS is_settlement FROM supplier"
#: Road courses: straight pieces along the lattice and long diagonals that cross them.
PLACES = "SELECT c_custkey AS place_id, CAST((c_custkey * 37) % 1300 AS DOUBLE) - 100 AS x, CAST((c_custkey * 91) % 1300 AS DOUBLE) - 100 AS y FROM customer"
POPULATION = """SELECT n_nationkey AS settlement_id, CASE WHEN n_nationkey % 8 <> 3 THEN count(c_custkey) + CASE WHEN n_nationkey % 6 = 1 THEN 1 ELSE 0 END END AS total,
CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS young, CASE WHEN n_nationkey % 10 <> 4 THEN CAST(sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) END AS old,
CASE WHEN n_nationkey % 4 = 0 THEN 'UNKNOWN' ELSE 'registered' END AS count_basis FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey"""
FACILITIES = "SELECT s_suppkey AS facility_id, CAST(s_nationkey % 6 AS VARCHAR) AS tag, CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal) AS INT) END AS capacity, CASE WHEN s_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE 'in_service' END AS operational_status, s_suppkey % 4 = 0 AS assessed FROM supplier"
#: Layer facts from documents; a document without a label has an unknown checksum.
LAYERS = """SELECT d.doc_id AS layer, d.doc_id % 50 AS bundle, CASE WHEN d.doc_id % 13 = 0 THEN 'UNKNOWN' WHEN d.doc_id % 13 = 1 THEN 'EPSG:4326' WHEN d.doc_id % 13 = 2 THEN 'EPSG:5186' ELSE 'EPSG:5187' END AS crs,
d.doc_id % 13 = 1 AS geographic, CASE WHEN d.doc_id % 29 = 3 THEN 'ft' ELSE 'm' END AS axis_unit, d.doc_id % 13 > 1 AS northing_first, 'EPSG:5187' AS ref_crs,
CASE WHEN d.doc_id % 3 = 0 THEN 'vector' ELSE 'raster' END AS data_kind, d.doc_id % 7 <> 2 AS nodata_declared, d.doc_id % 5 = 1 AS integer_cells, d.n_chars AS total_count,
CASE WHEN d.doc_id % 31 = 1 THEN 0 WHEN d.doc_id % 4 = 0 THEN d.n_chars ELSE d.n_chars - CAST(floor(d.n_chars * (d.doc_id % 20) / 100) AS BIGINT) END AS valid_count,
CAST(30.0 AS DOUBLE) AS x_size, CAST(CASE WHEN d.doc_id % 23 = 0 THEN 31.0 ELSE 30.0 END AS DOUBLE) AS y_size, CAST((d.doc_id % 40) * 15 AS DOUBLE) AS x_origin, CAST((d.doc_id % 16) * 30 AS DOUBLE) AS y_origin,
CAST(30.0 AS DOUBLE) AS ref_x_size, CAST(30.0 AS DOUBLE) AS ref_y_size, CAST(0.0 AS DOUBLE) AS ref_x_origin, CAST(0.0 AS DOUBLE) AS ref_y_origin, CAST(10 AS INT) AS n_rows, CAST(10 AS INT) AS n_cols,
CAST(CASE WHEN d.doc_id % 13 = 0 THEN 1 ELSE 0 END AS INT) AS n_unknown_blocking, CAST(d.doc_id % 3 AS INT) AS n_unknown_other, CAST(d.doc_id % 13 + d.doc_id % 3 AS INT) AS n_unknown, CAST(d.doc_id % 4 AS INT) AS n_sources,
CASE WHEN d.doc_id % 6 = 0 THEN 'derived' WHEN d.doc_id % 6 = 1 THEN 'synthetic' ELSE 'observed' END AS data_class, CAST(d.doc_id % 2 AS INT) AS n_parents,
CASE WHEN d.doc_id % 9 = 0 THEN 'retrospective' ELSE 'static' END AS temporal_class, CASE WHEN d.doc_id % 18 = 0 THEN 'UNKNOWN' ELSE '2023' END AS temporal_reference,
CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' ELSE 'known' END AS checksum, CASE WHEN d.doc_id % 10 = 0 THEN 'dsm' ELSE 'dtm' END AS surface_model, CASE WHEN d.doc_id % 21 = 0 THEN 'UNKNOWN' ELSE '2021' END AS valid_from, '2024' AS valid_to,
CASE d.doc_id % 8 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'Data under ODbL 1.0' WHEN 2 THEN 'open, ATTRIBUTION required' ELSE 'CC-BY 4.0' END AS licence, CASE WHEN d.doc_id % 14 = 2 THEN 'not_applicable' ELSE 'none' END AS nodata_text, d.doc_id % 15 = 0 AS own_grid,
CAST(d.doc_id % 12 AS INT) AS n_features, CAST(1 + d.doc_id % 2 AS INT) AS n_geometry_types, CAST(CASE WHEN d.doc_id % 27 = 3 THEN 2 ELSE 0 END AS INT) AS n_invalid FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"""
BUNDLES = """SELECT concat(CASE WHEN o_orderkey % 3 = 0 THEN 'synthetic_' ELSE 'area_' END, CAST(o_orderkey AS VARCHAR)) AS bundle_id, CAST(o_orderkey % 6 AS INT) AS n_layers, o_orderkey % 4 <> 1 AS terrain_covers,
CAST(o_orderkey % 50 AS INT) AS slope_missing, CAST(o_orderkey % 7 AS INT) AS dem_missing, o_orderkey % 2 = 0 AS has_fuels, o_orderkey % 8 <> 0 AS fuels_categorical, o_orderkey % 10 <> 0 AS fuels_scheme, CAST(o_orderkey % 5 AS INT) AS n_synthetic,
CAST(CASE WHEN o_orderkey % 25 = 0 THEN 3 ELSE 0 END AS INT) AS n_undefined_codes, CAST(255 AS INT) AS fuels_nodata, CAST(CASE WHEN o_orderkey % 14 = 0 THEN 0 ELSE 255 END AS INT) AS scheme_nodata, CAST(CASE WHEN o_orderkey % 33 = 0 THEN 1 ELSE 0 END AS INT) AS n_private_fields FROM orders"""
DIRECTORIES = "SELECT c_custkey AS directory, c_custkey % 5 <> 0 AS has_manifest, c_custkey % 7 <> 0 AS manifest_readable, c_custkey % 4 <> 0 AS has_contract, c_custkey % 9 <> 0 AS contract_readable, c_custkey % 11 = 0 AS contract_differs FROM customer"
FILES = "SELECT p_partkey AS file, CASE WHEN p_partkey % 3 = 0 THEN 'layer' WHEN p_partkey % 3 = 1 THEN 'sidecar' ELSE 'extra' END AS role, p_partkey % 5 <> 0 AS on_disk, p_partkey % 7 <> 0 AS in_manifest, p_partkey % 4 <> 0 AS has_sidecar, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS VARCHAR) END AS recorded, CAST(CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_size END AS VARCHAR) AS actual FROM part"
ROADS = "SELECT n_nationkey AS network, CAST(n_nationkey % 3 AS INT) AS n_components, CAST(n_nationkey % 4 AS INT) AS n_isolated, CAST(n_nationkey % 5 AS INT) AS n_single_egress, CAST(n_nationkey % 2 AS INT) AS n_no_egress, CAST(n_nationkey % 6 AS INT) AS n_boundary_exits, CAST(n_nationkey % 7 AS INT) AS n_unnoded_crossings, CAST(n_nationkey % 8 AS INT) AS n_unmatched FROM nation"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the SQL texts over the Parquet tables; unused tables are never read."""
    for name in TABLES:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", lambda m, n=name: f"{m[1]} parquet.`{sf_dir}/{n}.parquet`", text)
    return spark.sql(text.replace("VARCHAR", "STRING"))


def dem(spark: SparkSession, sf_dir: str) -> RasterLayer:
    df = rows(spark, sf_dir, DEM)
    n = df.agg(F.max("row")).first()[0] + 1
    return RasterLayer(df, Grid(0.0, n * 30.0, 30.0, 30.0, n, DEM_COLS), CRS, nodata=50.0, provenance=Provenance("dem", "observed"))


def graph(spark: SparkSession, sf_dir: str) -> RoadGraph:
    nodes, edges = rows(spark, sf_dir, NODES), rows(spark, sf_dir, EDGES)
    xy = lambda c: nodes.select(F.col("node").alias(c), F.struct("x", "y").alias(f"p{c}"))
    edges = edges.join(xy("u"), "u").join(xy("v"), "v").select("edge_id", "u", "v", "length_m", F.col("edge_id").alias("feature_index"), F.array("pu", "pv").alias("line"), F.create_map(F.lit("highway"), F.when(F.col("edge_id") % 3 == 0, "track").otherwise("service"), F.lit("bridge"), F.when(F.col("edge_id") % 10 == 0, "yes").otherwise("no")).alias("props"))
    return RoadGraph(nodes, edges, CRS)


def lines(spark: SparkSession, sf_dir: str) -> VectorLayer:
    """The lattice's edges as a line layer."""
    e = graph(spark, sf_dir).edges
    return VectorLayer(e.select("feature_index", F.struct(F.lit("LineString").alias("type"), F.array("line").alias("parts")).alias("geom"), "props"), CRS, Provenance("roads", "observed"))
