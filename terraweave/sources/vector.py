"""GeoJSON and OSM XML as vector layers; no network is used."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError, UnknownCRSError
from ..functions.crs import crs_equal, crs_text, parse_crs
from ..functions.geometry import POINT, interior_point, middle_vertex
from ..model import Provenance, VectorLayer
from ..operators.roads import HIGHWAY_VALUES
from .files import write_stream

# The key=value pairs that mark a facility, in order of precedence.
FACILITY_TAGS = tuple(
    [("amenity", v) for v in ("shelter", "townhall", "school", "community_centre", "fire_station", "police", "hospital", "clinic", "place_of_worship")]
    + [("emergency", v) for v in ("fire_station", "assembly_point")]
    + [("building", v) for v in ("civic", "public", "school", "community_centre")]
)
_TAGS = "tag array<struct<_k:string,_v:string>>"

_SCHEMA = "type string, crs struct<properties:struct<name:string>>, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def _point(c: Column) -> Column:
    return F.struct(c[0].alias("x"), c[1].alias("y"))


def _parts(kind: Column, text: Column) -> Column:
    line = lambda a: F.transform(a, _point)
    as_type = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    empty = F.array().cast(f"array<array<{POINT}>>")
    return (
        F.when(kind == "Point", F.array(F.array(_point(as_type(1)))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(line(as_type(2))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(as_type(3), line))
        .when(kind == "MultiPolygon", F.transform(F.flatten(as_type(4)), line))
        .otherwise(empty)
    )


def read_geojson(spark: SparkSession, path: str, provenance: Provenance, crs=None, require_crs: bool = True) -> VectorLayer:
    """A FeatureCollection; its own system and the caller's must agree, and one must be given.

    A feature without geometry raises; WGS 84 is never assumed.
    """
    whole = spark.read.schema(_SCHEMA).option("multiLine", True).json(path)
    heads = whole.select("type", "crs.properties.name").distinct().collect()
    if any(h["type"] != "FeatureCollection" for h in heads):
        raise IngestError("a FeatureCollection is needed")
    names = {h["name"] for h in heads if h["name"]}
    named = {parse_crs(n.replace("urn:ogc:def:crs:EPSG::", "EPSG:").replace("urn:ogc:def:crs:", "")) for n in names}
    if len(named) > 1 or (named and crs is not None and not crs_equal(crs, next(iter(named)))):
        raise IngestError("the file's coordinate system is not the caller's")
    crs = crs or (next(iter(named)) if named else None)
    if crs is None and require_crs:
        raise UnknownCRSError("no coordinate system is declared")
    rows = whole.select(F.posexplode("features").alias("feature_index", "f"))
    rows = rows.select(F.col("feature_index").cast("long").alias("feature_index"), F.col("f.geometry").alias("g"), F.coalesce("f.properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("props"))
    if not rows.where("g is null or g.type is null").isEmpty():
        raise IngestError("a feature has no geometry")
    geom = F.struct(F.col("g.type").alias("type"), _parts(F.col("g.type"), F.col("g.coordinates")).alias("parts"))
    return VectorLayer(rows.select("feature_index", geom.alias("geom"), "props"), crs, provenance)


def read_roads(spark: SparkSession, path: str, provenance: Provenance, crs=None) -> VectorLayer:
    """Road lines; an empty layer or any other geometry raises."""
    layer = read_geojson(spark, path, provenance, crs)
    kinds = {r["t"] for r in layer.df.select(F.col("geom.type").alias("t")).distinct().collect()}
    if not kinds or kinds - {"LineString", "MultiLineString"}:
        raise IngestError(f"a road layer holds lines, not {sorted(kinds) or 'nothing'}")
    return layer


def write_geojson(layer: VectorLayer, path: str) -> None:
    """One FeatureCollection file in the layer's own system, which it names and which must be declared.

    Features are written as they arrive, one partition after the other, in order of
    feature_index, so the driver never holds them all.
    """
    if layer.crs is None:
        raise UnknownCRSError("no coordinate system is declared")
    flat = lambda part: F.transform(part, lambda p: F.array(p["x"], p["y"]))
    t = F.col("geom.type")
    text = lambda c: F.to_json(c)
    coordinates = (
        F.when(t == "Point", text(flat(F.col("geom.parts")[0])[0]))
        .when(t.isin("LineString", "MultiPoint"), text(flat(F.col("geom.parts")[0])))
        .when(t == "MultiPolygon", text(F.transform("geom.parts", lambda ring: F.array(flat(ring)))))
        .otherwise(text(F.transform("geom.parts", flat)))
    )
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), t, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), F.coalesce(F.to_json("props"), F.lit("{}")), F.lit("}"))
    rows = layer.df.select("feature_index", line.alias("value")).orderBy("feature_index").select("value")
    name = json.dumps({"type": "name", "properties": {"name": crs_text(layer.crs)}})

    def lines():
        yield '{"type":"FeatureCollection","crs":' + name + ',"features":[\n'
        for i, r in enumerate(rows.toLocalIterator()):
            yield (",\n" if i else "") + r["value"]
        yield "\n]}\n"

    write_stream(layer.df.sparkSession, path, lines())


def _elements(spark: SparkSession, path: str, kind: str, columns: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", kind).schema(f"_id long, {columns}, {_TAGS}").load(path)


def join_ways(refs: DataFrame, nodes: DataFrame, *, keep: list[str]) -> DataFrame:
    """way, n (references), found (with a node) and ps, the kept node columns in order, for each way.

    refs hold way, i and ref, nodes hold ref; a way is whole where n = found and n >= 2.
    """
    met = refs.join(nodes.select("ref", F.struct(*keep).alias("p")), "ref", "left")
    return met.groupBy("way").agg(F.count("*").alias("n"), F.count("p").alias("found"), F.array_sort(F.collect_list(F.struct("i", "p"))).alias("ps"))


def _tag_map() -> Column:
    none = F.array().cast("array<struct<_k:string,_v:string>>")
    return F.map_from_entries(F.transform(F.coalesce("tag", none), lambda t: F.struct(t["_k"], t["_v"])))


def read_osm_roads(spark: SparkSession, path: str, provenance: Provenance, highway_values=HIGHWAY_VALUES) -> tuple[VectorLayer, DataFrame]:
    """Ways of accepted classes as lines in WGS 84, and the count of ways dropped.

    A way with an absent node or under two points is dropped and counted; no attribute is ever
    filled in; an empty result raises.
    """
    nodes = _elements(spark, path, "node", "_lat double, _lon double").select(F.col("_id").alias("ref"), F.col("_lon").alias("x"), F.col("_lat").alias("y"))
    ways = _elements(spark, path, "way", "nd array<struct<_ref:long>>").select("_id", "nd", _tag_map().alias("props"))
    ways = ways.where(F.try_element_at("props", F.lit("highway")).isin(*highway_values))
    refs = ways.select(F.col("_id").alias("way"), F.posexplode("nd").alias("i", "n")).select("way", "i", F.col("n._ref").alias("ref"))
    lines = join_ways(refs, nodes, keep=["x", "y"]).withColumnRenamed("way", "_id")
    joined = ways.select("_id", "props").join(lines, "_id", "left")
    good = (F.col("n") == F.col("found")) & (F.col("n") >= 2)
    geom = F.struct(F.lit("LineString").alias("type"), F.array(F.transform("ps", lambda q: q["p"])).alias("parts"))
    kept = joined.where(good).select(F.col("_id").alias("feature_index"), geom.alias("geom"), F.map_concat("props", F.create_map(F.lit("osm_id"), F.col("_id").cast("string"))).alias("props"))
    if kept.isEmpty():
        raise IngestError("no usable way")
    return VectorLayer(kept, "EPSG:4326", provenance), joined.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))


def match_facility(tags: Column, wanted: list[tuple[str, str]]) -> Column:
    """The first wanted key=value that the tags hold, in the order given."""
    return F.coalesce(*[F.when(F.try_element_at(tags, F.lit(k)) == v, F.lit(f"{k}={v}")) for k, v in wanted])


def read_osm_facilities(spark: SparkSession, path: str, provenance: Provenance, wanted: tuple[tuple[str, str], ...] = FACILITY_TAGS) -> tuple[VectorLayer, DataFrame]:
    """Nodes and ways with a wanted tag as points in WGS 84, and the count of ways without geometry.

    A closed way of four points or more gives a point inside it, another way one of its vertices.
    Absent vertices are left out; a way with under two points is counted. No role is assigned:
    props hold the tags, the tag that matched and the element's own identity
    (facility_id `osm:<node or way>/<id>`); an empty result raises.
    """
    nodes = _elements(spark, path, "node", "_lat double, _lon double").select("_id", F.struct(F.col("_lon").alias("x"), F.col("_lat").alias("y")).alias("p"), _tag_map().alias("tags"))
    ways = _elements(spark, path, "way", "nd array<struct<_ref:long>>").select("_id", "nd", _tag_map().alias("tags"))
    matched = match_facility(F.col("tags"), list(wanted))
    ways = ways.withColumn("matched", matched).where("matched is not null")
    refs = ways.select("_id", F.posexplode("nd").alias("i", "n")).select(F.col("_id").alias("way"), "i", F.col("n._ref").alias("_id"))
    lines = refs.join(nodes.select("_id", "p"), "_id").groupBy("way").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("ps"))
    lines = lines.select(F.col("way").alias("_id"), F.transform("ps", lambda q: q["p"]).alias("line"))
    shaped = ways.join(lines, "_id", "left").withColumn("whole", F.coalesce(F.size("line") >= 2, F.lit(False)))
    line = F.col("line")
    closed = (F.size(line) >= 4) & (line[0] == F.element_at(line, -1))
    of_ways = shaped.where("whole").select(F.lit("way").alias("kind"), "_id", "tags", "matched", F.when(closed, interior_point(line)).otherwise(middle_vertex(line)).alias("p"))
    of_nodes = nodes.withColumn("matched", matched).where("matched is not null").select(F.lit("node").alias("kind"), "_id", "tags", "matched", "p")
    every = of_nodes.unionByName(of_ways)
    own = {"facility_id": F.concat(F.lit("osm:"), "kind", F.lit("/"), F.col("_id").cast("string")), "osm_id": F.col("_id").cast("string"), "osm_type": F.col("kind"), "osm_matched_tag": F.col("matched")}
    tags = F.map_filter("tags", lambda k, _: ~k.isin(*own))
    props = F.map_concat(tags, F.create_map(*[c for k, v in own.items() for c in (F.lit(k), v)]))
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.array("p")).alias("parts"))
    out = every.select(F.xxhash64("kind", "_id").alias("feature_index"), geom.alias("geom"), props.alias("props"))
    if out.isEmpty():
        raise IngestError("no element has a wanted tag")
    return VectorLayer(out, "EPSG:4326", provenance), shaped.agg(F.count_if(~F.col("whole")).alias("without_geometry"))
