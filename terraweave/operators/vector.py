"""Vector operators: selection, clipping, summaries, reprojection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IngestError, RasterGeometryError
from ..functions import geometry as G
from ..functions.crs import crs_equal, parse_crs, require_same_crs, transformed
from ..model import Bounds, VectorLayer


def filter_features(layer: VectorLayer, predicate: Column, name: str | None = None) -> VectorLayer:
    """Rows that satisfy a Column; a NULL answer drops the row."""
    return replace(layer, df=layer.df.where(predicate), provenance=layer.provenance.with_transformation("filter", name=name))


def points_of(geom: str = "geom") -> Column:
    return F.flatten(F.col(geom)["parts"])


def layer_bounds(layer: VectorLayer) -> DataFrame:
    """One row; NULLs for an empty layer."""
    b = layer.df.select(G.bbox(points_of()).alias("b"))
    return b.agg(F.min("b.x_min").alias("x_min"), F.min("b.y_min").alias("y_min"), F.max("b.x_max").alias("x_max"), F.max("b.y_max").alias("y_max"))


def property_keys(layer: VectorLayer) -> DataFrame:
    return layer.df.select(F.explode(F.map_keys("props")).alias("key")).distinct()


def geometry_types(layer: VectorLayer) -> DataFrame:
    return layer.df.groupBy(F.col("geom.type").alias("type")).agg(F.count("*").alias("n"))


def _area_holds(x: float, y: float) -> Column:
    """Whether a polygon's area, by the even-odd rule over all of its rings, holds a point."""
    odd = F.aggregate("geom.parts", F.lit(False), lambda odd, ring: odd != G.in_ring(F.lit(x), F.lit(y), ring))
    return F.col("geom.type").isin("Polygon", "MultiPolygon") & odd


def clip_features(layer: VectorLayer, bounds: Bounds, mode: str = "intersects") -> VectorLayer:
    """Features by a closed box: keep whole what meets it, what lies within, or cut to it.

    A feature that only touches the box meets it, as does a polygon around it. What lies within
    has no point outside and one strictly inside. "truncate" cuts: a line gives a part for each
    run inside the box, and one point where it only touches; a polygon's rings are cut side by
    side, and one that only touches goes. The ends that cutting makes are boundary exits of a
    road network, not dead ends. A bounding-box condition comes before all exact tests.
    """
    require_same_crs([layer.crs, bounds.crs], "clip")
    box = (bounds.x_min, bounds.y_min, bounds.x_max, bounds.y_max)
    x0, y0, x1, y1 = map(F.lit, box)
    b = G.bbox(points_of())
    inside = lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)
    near = (b["x_min"] <= x1) & (b["x_max"] >= x0) & (b["y_min"] <= y1) & (b["y_max"] >= y0)
    if mode == "within":
        strictly = lambda x, y: (x > x0) & (x < x1) & (y > y0) & (y < y1)
        middle = lambda s: strictly((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2)
        inner = F.exists("geom.parts", lambda part: F.exists(part, lambda p: strictly(p["x"], p["y"])) | F.exists(G.segments(part), lambda s: F.coalesce(middle(s), F.lit(False))))
        df = layer.df.where(F.forall(points_of(), inside) & (inner | F.col("geom.type").isin("Polygon", "MultiPolygon")))
    elif mode in ("intersects", "truncate"):
        joined = ~F.col("geom.type").isin("Point", "MultiPoint")
        crosses = lambda s: F.transform(F.array(G.interval_in_box(s["a"], s["b"], *box)), lambda t: t["lo"] <= t["hi"])[0]
        meets = F.exists("geom.parts", lambda part: F.exists(part, inside) | (joined & F.exists(G.segments(part), lambda s: F.coalesce(crosses(s), F.lit(False)))))
        df = layer.df.where(near & (meets | _area_holds(bounds.x_min, bounds.y_min)))
        if mode == "truncate":
            df = _truncated(df, box)
    else:
        raise IngestError(f"unknown clip mode {mode!r}")
    return replace(layer, df=df, provenance=layer.provenance.with_transformation("clip_vector", mode=mode))


def _truncated(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Geometries cut to the box; what is empty then goes."""
    x0, y0, x1, y1 = map(F.lit, box)
    kind = F.col("geom.type")
    none = F.array().cast(f"array<array<{G.POINT}>>")
    points = F.filter(F.transform("geom.parts", lambda part: F.filter(part, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))), lambda part: F.size(part) > 0)
    runs = F.flatten(F.transform("geom.parts", lambda part: G.line_in_box(part, *box)))
    rings = F.filter(F.transform("geom.parts", lambda part: G.ring_in_box(part, *box)), lambda ring: (F.size(ring) > 3) & (G.ring_area(ring) > 0))
    df = df.withColumn("_runs", F.when(kind.isin("LineString", "MultiLineString"), runs).otherwise(none))
    lines = F.filter("_runs", lambda run: F.size(run) > 1)
    touched = F.size(lines) == 0
    spots = F.array_distinct(F.flatten("_runs"))
    line_type = F.when(~touched, F.when(F.size(lines) > 1, "MultiLineString").otherwise("LineString")).when(F.size(spots) > 1, "MultiPoint").otherwise("Point")
    line_parts = F.when(touched, F.array(spots)).otherwise(lines)
    polygon, line = kind.isin("Polygon", "MultiPolygon"), kind.isin("LineString", "MultiLineString")
    cut = F.struct(F.when(line, line_type).otherwise(kind).alias("type"), F.when(polygon, rings).when(line, line_parts).otherwise(points).alias("parts"))
    return df.withColumn("geom", cut).drop("_runs").where(F.size(F.flatten("geom.parts")) > 0)


def reproject(layer: VectorLayer, dst) -> VectorLayer:
    """Each vertex on its own; the same system gives the layer itself."""
    if crs_equal(layer.crs, dst):
        return layer

    def move(p):
        return transformed(layer.crs, dst, p["x"], p["y"])

    geom = F.struct(F.col("geom.type").alias("type"), F.transform("geom.parts", lambda part: F.transform(part, move)).alias("parts"))
    return layer.derived(layer.df.withColumn("geom", geom), layer.provenance.layer_name, "reproject", crs=parse_crs(dst))


def _rings(polygons: DataFrame) -> DataFrame:
    """feature_index, code and rings; a column ring is a polygon without holes."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    return polygons.select("feature_index", "code", rings.alias("rings"))


def burned_cells(polygons: DataFrame, grid, all_touched: bool = False) -> DataFrame:
    """(feature_index, code, row, col): the grid's cells whose centre lies in a polygon.

    Each edge meets only the rows whose centre lines it crosses; the crossings of a row, in
    order, bound the spans of cells inside by the even-odd rule, so holes need nothing more. With
    all_touched, cells that an outline passes count too.
    """
    edges = _rings(polygons).select("feature_index", "code", F.explode("rings").alias("ring")).select("feature_index", "code", F.explode(G.segments(F.col("ring"))).alias("s")).where("s.b is not null")
    ya, yb = F.col("s.a.y"), F.col("s.b.y")
    # The centre of row r lies at y_origin - (r + 1/2) * y_size.
    place = lambda y: (grid.y_origin - y) / grid.y_size - 0.5
    first = F.greatest(F.floor(place(F.greatest(ya, yb))), F.lit(0))
    last = F.least(F.ceil(place(F.least(ya, yb))), F.lit(grid.rows - 1))
    met = edges.where((ya != yb) & (first <= last)).withColumn("row", F.explode(F.sequence(first, last)))
    _, y = grid.xy(F.col("row"), F.lit(0))
    met = met.where((ya > y) != (yb > y)).select("feature_index", "code", "row", (F.col("s.a.x") + (F.col("s.b.x") - F.col("s.a.x")) * (y - ya) / (yb - ya)).alias("x"))
    xs = met.groupBy("feature_index", "code", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    column = lambda x: F.ceil((x - grid.x_origin) / grid.x_size - 0.5)
    spans = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.greatest(column(F.col("xs")[2 * i]), F.lit(0)).alias("c0"), F.least(column(F.col("xs")[2 * i + 1]) - 1, F.lit(grid.cols - 1)).alias("c1")))
    runs = xs.where(F.size("xs") > 1).select("feature_index", "code", "row", F.explode(spans).alias("c")).where("c.c0 <= c.c1")
    inside = runs.select("feature_index", "code", F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.col("c.c0").cast("int"), F.col("c.c1").cast("int"))).alias("col"))
    if not all_touched:
        return inside
    if grid.x_size != grid.y_size:
        raise RasterGeometryError("all_touched needs square cells")
    passed = G.cells_passed(edges, "s", grid.x_size, grid.x_origin, grid.y_origin)
    passed = passed.select("feature_index", "code", (-F.col("cy") - 1).cast("int").alias("row"), F.col("cx").cast("int").alias("col"))
    passed = passed.where(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1))
    return inside.unionByName(passed).distinct()


def rasterise(polygons: DataFrame, grid, nodata: int, all_touched: bool = False, scheme=None) -> DataFrame:
    """(row, col, value): the code of the last polygon (by feature_index) over each cell.

    polygons hold feature_index, code, and ring (array of points) or rings (the outer one and its
    holes). With a scheme, a code that it does not define raises.
    """
    if scheme is not None:
        wrong = [r["code"] for r in scheme.unknown_codes(polygons.select(F.col("code").alias("value"))).limit(20).collect()]
        if wrong:
            raise IngestError(f"codes {wrong} are not in the scheme {scheme.name}")
    burned = burned_cells(polygons, grid, all_touched).groupBy("row", "col").agg(F.max_by("code", "feature_index").alias("value"))
    from .raster import densify

    return densify(burned, grid).withColumn("value", F.coalesce("value", F.lit(nodata)))


def lost_codes(polygons: DataFrame, cells: DataFrame) -> DataFrame:
    """Codes of polygons that no cell holds: too small, covered by later ones, or off the grid."""
    return polygons.select("code").distinct().join(cells.select(F.col("value").alias("code")).distinct(), "code", "left_anti").orderBy("code")


def invalid_features(layer: VectorLayer) -> DataFrame:
    """(feature_index, reason) of geometries on which area and intersection have no meaning.

    No point, a coordinate that is no number, a line of one place, a ring that is open, has under
    four points, meets itself anywhere but between neighbours, or a hole outside its shell. Edges of
    a polygon are compared in the cells that they pass, never all with all.
    """
    kind = F.col("geom.type")
    bad_number = F.exists(points_of(), lambda p: F.coalesce(F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")), F.lit(True)))
    polygon = kind.isin("Polygon", "MultiPolygon")
    short_line = kind.isin("LineString", "MultiLineString") & F.exists("geom.parts", lambda part: F.size(F.array_distinct(part)) < 2)
    open_ring = polygon & F.exists("geom.parts", lambda ring: (F.size(ring) < 4) | (F.get(ring, F.lit(0)) != F.try_element_at(ring, F.lit(-1))))
    shell = F.get("geom.parts", F.lit(0))
    outside = (kind == "Polygon") & F.exists(F.slice("geom.parts", 2, F.greatest(F.size("geom.parts") - 1, F.lit(1))), lambda hole: ~G.in_ring(hole[0]["x"], hole[0]["y"], shell))
    reason = (
        F.when(F.col("geom").isNull() | (F.size(points_of()) < 1), "empty").when(bad_number, "coordinate").when(short_line, "short line")
        .when(open_ring, "open ring").when(outside, "hole outside")
    )
    told = layer.df.select("feature_index", "geom", reason.alias("reason"))
    plain = told.where("reason is not null").select("feature_index", "reason")
    rings = told.where(F.col("reason").isNull() & polygon).select("feature_index", F.posexplode("geom.parts").alias("ring", "line"))
    edges = rings.select("feature_index", "ring", (F.size("line") - 1).alias("n"), F.posexplode(G.segments(F.col("line"))).alias("i", "s")).where(F.col("s.a") != F.col("s.b"))
    size = edges.agg(F.avg(F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")))).first()[0] or 1.0
    here = G.cells_passed(edges, "s", size)
    a = here.select("feature_index", "cx", "cy", "n", F.col("ring").alias("ra"), F.col("i").alias("ia"), F.col("s").alias("sa"))
    b = here.select("feature_index", "cx", "cy", F.col("ring").alias("rb"), F.col("i").alias("ib"), F.col("s").alias("sb"))
    met = a.join(b, ["feature_index", "cx", "cy"]).where(F.struct("ra", "ia") < F.struct("rb", "ib"))
    next_to = (F.col("ra") == F.col("rb")) & ((F.col("ib") - F.col("ia") == 1) | (F.col("ib") - F.col("ia") == F.col("n") - 1))
    point = G.crossing_point(F.col("sa.a"), F.col("sa.b"), F.col("sb.a"), F.col("sb.b"))
    flat = G.cross(F.col("sa.a"), F.col("sa.b"), F.col("sb.a")) == 0
    flat = flat & (G.cross(F.col("sa.a"), F.col("sa.b"), F.col("sb.b")) == 0)
    along = lambda c: F.least(F.greatest("sa.a." + c, "sa.b." + c), F.greatest("sb.a." + c, "sb.b." + c)) - F.greatest(F.least("sa.a." + c, "sa.b." + c), F.least("sb.a." + c, "sb.b." + c))
    overlap = flat & (along("x") >= 0) & (along("y") >= 0) & (along("x") + along("y") > 0)
    # Rings may touch in a point; one ring may not meet itself, and no two edges may share a length or cross.
    ends = lambda s: (point == F.col(f"{s}.a")) | (point == F.col(f"{s}.b"))
    proper = point.isNotNull() & ~(ends("sa") | ends("sb"))
    crossing = overlap | (~next_to & point.isNotNull() & (F.col("ra") == F.col("rb"))) | ((F.col("ra") != F.col("rb")) & proper)
    return plain.unionByName(met.where(F.coalesce(crossing, F.lit(False))).select("feature_index").distinct().withColumn("reason", F.lit("self-intersection")))
