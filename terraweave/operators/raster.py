"""Raster operators: ingest, clip, statistics, Horn derivatives, warping."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, MissingDataError, RasterAlignmentError, RasterError, RasterGeometryError
from ..functions.crs import crs_equal, require_projected_metre, require_same_crs, transform
from ..functions.units import convert_slope
from ..model import Bounds, Grid, RasterLayer

#: Cells of a side of one tile, by which windows are split so that no task holds a whole row.
TILE = 512
PERCENTILES = (5, 25, 50, 75, 95)
#: Values that one task may hold for exact percentiles, and the accuracy of the sketch used beyond.
HELD_VALUES = 1 << 20
SKETCH = 10_000


def normalised(value: Column, nodata: float | None) -> Column:
    """NULL where a value is NaN or exactly the declared sentinel."""
    value = F.when(~F.isnan(value.cast("double")), value)
    return value if nodata is None else F.when(value != F.lit(nodata), value)


def densify(df: DataFrame, grid: Grid) -> DataFrame:
    """Every cell of the grid once, with NULL where df has none."""
    cells = df.sparkSession.range(grid.rows * grid.cols).select((F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))
    return cells.join(df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value"), ["row", "col"], "left")


def clip(layer: RasterLayer, bounds: Bounds, buffer_cells: int = 0, allow_partial: bool = True) -> RasterLayer:
    """Whole cells that meet the bounds; the grid moves by whole cells only.

    An empty window raises, as does a cut-off one unless allow_partial. The condition on row
    and col reaches the scan of a raster stored by row and col.
    """
    require_same_crs([layer.crs, bounds.crs], "clip")
    bounds.require_area("clip")
    g = layer.grid
    r0, r1 = math.floor((g.y_origin - bounds.y_max) / g.y_size) - buffer_cells, math.ceil((g.y_origin - bounds.y_min) / g.y_size) + buffer_cells
    c0, c1 = math.floor((bounds.x_min - g.x_origin) / g.x_size) - buffer_cells, math.ceil((bounds.x_max - g.x_origin) / g.x_size) + buffer_cells
    a, b, c, d = max(r0, 0), min(r1, g.rows), max(c0, 0), min(c1, g.cols)
    if a >= b or c >= d:
        raise RasterGeometryError("clip: the bounds don't meet the raster")
    if not allow_partial and (a, b, c, d) != (r0, r1, c0, c1):
        raise RasterGeometryError("clip: the raster does not cover the bounds")
    cut = layer.df.where((F.col("row") >= a) & (F.col("row") < b) & (F.col("col") >= c) & (F.col("col") < d))
    cut = cut.withColumns({"row": F.col("row") - a, "col": F.col("col") - c})
    return replace(layer, df=cut, grid=g.offset(a, c, (b - a, d - c)), provenance=layer.provenance.with_transformation("clip", truncated=(a, b, c, d) != (r0, r1, c0, c1)))


def _haloed(df: DataFrame) -> DataFrame:
    """Each cell in its tile, and border cells once more in the neighbour tiles, as halo."""
    tr, tc = F.floor(F.col("row") / TILE), F.floor(F.col("col") / TILE)
    near = lambda v, t: F.array_distinct(F.array(t, F.floor((F.col(v) - 1) / TILE), F.floor((F.col(v) + 1) / TILE)))
    out = df.withColumn("tr", F.explode(near("row", tr))).withColumn("tc", F.explode(near("col", tc)))
    return out.withColumn("own", (F.col("tr") == tr) & (F.col("tc") == tc))


def horn(df: DataFrame, x_size: float, y_size: float) -> DataFrame:
    """(row, col, dz_dx, dz_dy) by Horn's 3x3 kernel; NULL unless all nine cells are valid.

    Two window passes inside tiles with a halo of one cell, so a task holds a tile and not a
    whole row or column of the raster. Tiles are dealt once: all four windows need no other
    exchange. The grid must be dense; value is kept beside the gradients.
    """
    z = F.col("value")
    wr = Window.partitionBy("tr", "tc", "row").orderBy("col")
    wc = Window.partitionBy("tr", "tc", "col").orderBy("row")
    df = _haloed(df.select("row", "col", "value")).repartition("tr", "tc")
    df = df.withColumn("v", F.lag(z).over(wc) + 2 * z + F.lead(z).over(wc)).withColumn("h", F.lag(z).over(wr) + 2 * z + F.lead(z).over(wr))
    df = df.withColumn("gs", (F.lead("h").over(wc) - F.lag("h").over(wc)) / (8.0 * y_size))
    df = df.withColumn("gx", (F.lead("v").over(wr) - F.lag("v").over(wr)) / (8.0 * x_size))
    valid = z.isNotNull() & F.col("gx").isNotNull() & F.col("gs").isNotNull()
    return df.where("own").select("row", "col", "value", F.when(valid, F.col("gx")).alias("dz_dx"), F.when(valid, -F.col("gs")).alias("dz_dy"))


def _slope_of(unit: str = "degree") -> Column:
    return convert_slope(F.atan(F.hypot("dz_dx", "dz_dy")), "radian", unit).cast("float")


def _aspect_of(flat_tolerance: float = 0.0) -> Column:
    a = F.degrees(F.atan2(-F.col("dz_dx"), -F.col("dz_dy")))
    return F.when(F.hypot("dz_dx", "dz_dy") > flat_tolerance, F.when(a < 0, a + 360.0).otherwise(a)).cast("float")


def slope(layer: RasterLayer, unit: str = "degree") -> RasterLayer:
    require_projected_metre(layer.crs, "slope")
    layer.require_kind("continuous", "slope")
    g = horn(layer.df, layer.grid.x_size, layer.grid.y_size)
    return layer.derived(g.select("row", "col", _slope_of(unit).alias("value")), "slope", "slope")


def aspect(layer: RasterLayer, flat_tolerance: float = 0.0) -> RasterLayer:
    """Downslope direction in degrees from north; missing where flat."""
    require_projected_metre(layer.crs, "aspect")
    g = horn(layer.df, layer.grid.x_size, layer.grid.y_size)
    return layer.derived(g.select("row", "col", _aspect_of(flat_tolerance).alias("value")), "aspect", "aspect")


def order_statistics(df: DataFrame, ranks: list[int], held: int = HELD_VALUES) -> dict[int, float]:
    """The values of some ranks (from 0) among the valid ones, exactly, without sorting them all.

    A sketch brackets each rank; one pass counts what lies below and inside the bracket; a bracket
    of more than held values is bracketed again. What reaches the driver is held values for each
    rank at most, and no task holds more than a sketch.
    """
    v = F.col("value").cast("double")
    df = df.where("value is not null").select(v.alias("value"))
    n = df.count()
    # low, high (both included), values below low, values inside
    brackets: dict[int, tuple[float, float, int, int]] = {r: (float("-inf"), float("inf"), 0, n) for r in ranks}
    found: dict[int, float] = {}
    while brackets:
        ready = [r for r, (low, high, _, inside) in brackets.items() if low == high or inside <= held]
        for r in ready:
            low, high, below, _ = brackets.pop(r)
            if low == high:
                found[r] = low
                continue
            for row in df.where(F.col("value").between(low, high)).groupBy("value").agg(F.count("*").alias("n")).orderBy("value").toLocalIterator():
                below += row["n"]
                if below > r:
                    found[r] = row["value"]
                    break
        if not brackets:
            break
        inside = {r: F.when(F.col("value").between(b[0], b[1]), F.col("value")) for r, b in brackets.items()}
        near = lambda r: [min(1.0, max(0.0, (r - brackets[r][2]) / brackets[r][3] + d)) for d in (-2 / SKETCH, 2 / SKETCH)]
        guess = df.agg(*[F.percentile_approx(inside[r], near(r), SKETCH).alias(str(r)) for r in brackets]).first()
        count = df.agg(*[c for r in brackets for c in (F.count_if(F.col("value") < guess[str(r)][0]).alias(f"b{r}"), F.count_if(F.col("value") <= guess[str(r)][1]).alias(f"u{r}"))]).first()
        for r, (low, high, below, _) in list(brackets.items()):
            left, right, b, u = *guess[str(r)], count[f"b{r}"], count[f"u{r}"]
            if r < b:
                brackets[r] = (low, math.nextafter(left, -math.inf), below, b - below)
            elif r >= u:
                brackets[r] = (math.nextafter(right, math.inf), high, u, below + brackets[r][3] - u)
            else:
                brackets[r] = (left, right, b, u - b)
    return found


def statistics(df: DataFrame, kind: str = "continuous", held: int = HELD_VALUES) -> DataFrame:
    """One row over valid cells; NULL statistics, not zeros, where none is valid.

    Percentiles are exact and interpolate between neighbours. Over up to held valid cells one
    aggregate has them all; beyond, it would hold every value in one task, and order_statistics
    finds the neighbours' values instead.
    """
    if kind != "continuous":
        raise RasterError("statistics of class codes have no meaning")
    v = F.col("value").cast("double")
    plain = [
        F.count("*").alias("total_count"), F.count("value").alias("valid_count"), (F.count("*") - F.count("value")).alias("missing_count"),
        (1 - F.count("value") / F.count("*")).alias("missing_fraction"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
    ]
    n = df.agg(F.count("value")).first()[0]
    if n <= held:
        every = df.agg(*plain, F.percentile(v, [p / 100 for p in PERCENTILES]).alias("ps"))
        return every.select(*every.columns[:-1], *[F.get("ps", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTILES)])
    at = {p: (n - 1) * p / 100 for p in PERCENTILES}
    value = order_statistics(df, sorted({r for x in at.values() for r in (math.floor(x), math.ceil(x))}), held)
    mixed = lambda x: value[math.floor(x)] if x == math.floor(x) else (math.ceil(x) - x) * value[math.floor(x)] + (x - math.floor(x)) * value[math.ceil(x)]
    return df.agg(*plain).select("*", *[F.lit(mixed(x)).alias(f"p{p}") for p, x in at.items()])


def cell_counts(df: DataFrame, group: str) -> DataFrame:
    """(group, n_cells, n_valid, n_missing) of each group of cells."""
    return df.groupBy(group).agg(F.count("*").alias("n_cells"), F.count("value").alias("n_valid"), (F.count("*") - F.count("value")).alias("n_missing"))


def categorical_statistics(df: DataFrame) -> DataFrame:
    """Cells of each code; fractions are of the valid cells."""
    counts = df.where("value is not null").groupBy(F.col("value").cast("int").alias("code")).agg(F.count("*").alias("n"))
    return counts.select("code", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("fraction"))


def _mean_direction() -> tuple[Column, Column, Column]:
    """Aggregates of value: its count, mean direction and resultant length."""
    s, c, n = F.sum(F.sin(F.radians("value"))), F.sum(F.cos(F.radians("value"))), F.count("value")
    mean = F.degrees(F.atan2(s, c))
    return n, F.when(n > 0, F.when(mean < 0, mean + 360.0).otherwise(mean)), F.when(n > 0, F.hypot(s, c) / n)


def circular_mean(df: DataFrame) -> DataFrame:
    """Mean direction (NULL if none or balanced) and resultant length."""
    n, mean, length = _mean_direction()
    return df.agg(n.alias("n"), mean.alias("mean_deg"), length.alias("resultant"))


def require_aligned(a: RasterLayer, b: RasterLayer) -> None:
    require_same_crs([a.crs, b.crs], "aligned rasters")
    if a.grid != b.grid:
        raise RasterAlignmentError("the rasters' grids differ")


def require_any_valid(layer: RasterLayer, context: str) -> None:
    if layer.df.where("value is not null").isEmpty():
        raise MissingDataError(f"{context}: no valid cell")


def terrain_statistics(dem: RasterLayer, slope_layer: RasterLayer | None = None, aspect_layer: RasterLayer | None = None) -> DataFrame:
    """One row of elevation, slope and aspect; without derived layers, all from one pass of Horn's kernel."""
    area = F.lit(dem.grid.x_size * dem.grid.y_size)
    if slope_layer is None and aspect_layer is None:
        require_projected_metre(dem.crs, "terrain statistics")
        cells = horn(dem.df, dem.grid.x_size, dem.grid.y_size).select(F.col("value").cast("double").alias("z"), _slope_of().cast("double").alias("s"), _aspect_of().cast("double").alias("value"))
        n, direction, length = _mean_direction()
        return cells.agg(
            F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.max("z") - F.min("z")).alias("relief"), (F.count("z") * area).alias("valid_area_m2"),
            F.avg("s").alias("slope_mean"), F.max("s").alias("slope_max"), direction.alias("mean_deg"), length.alias("resultant"),
        )
    for other in (slope_layer, aspect_layer):
        require_aligned(dem, other)
    z, s = F.col("value").cast("double"), F.col("value").cast("double")
    one = dem.df.agg(F.min(z).alias("z_min"), F.max(z).alias("z_max"), (F.max(z) - F.min(z)).alias("relief"), (F.count(z) * area).alias("valid_area_m2"))
    two = slope_layer.df.agg(F.avg(s).alias("slope_mean"), F.max(s).alias("slope_max"))
    three = circular_mean(aspect_layer.df).select("mean_deg", "resultant")
    # Three tables of one row each.
    return one.join(F.broadcast(two)).join(F.broadcast(three))


def warp(layer: RasterLayer, dst_crs, target: Grid, method: str | None = None) -> RasterLayer:
    """The raster in another system, on a target grid.

    Within one system there is nothing to warp: the grid it has gives the layer itself, another
    one raises (resample says so openly). Whole numbers without a nodata value raise, as cells
    that the source does not cover would have no value to hold.
    """
    if crs_equal(layer.crs, dst_crs):
        if layer.grid != target:
            raise ConfigError("warp: another grid within one system is a resampling, not a reprojection")
        return layer
    if layer.nodata is None and dict(layer.df.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint"):
        raise MissingDataError("warp: whole numbers need a declared nodata value")
    return _onto(layer, dst_crs, target, method, "reproject_raster")


def resample(layer: RasterLayer, target: Grid, method: str | None = None) -> RasterLayer:
    """The raster on another grid of its own system."""
    return _onto(layer, layer.crs, target, method, "resample")


def _onto(layer: RasterLayer, dst_crs, target: Grid, method: str | None, operation: str) -> RasterLayer:
    """Cells of the target look up their own place in the source.

    "nearest" for class codes, "bilinear" else by default; averaging codes raises. Bilinear
    weights are renormalised over the valid neighbours.
    """
    method = method or ("nearest" if layer.kind == "categorical" else "bilinear")
    if layer.kind == "categorical" and method != "nearest":
        raise RasterError("class codes can't be averaged")
    g, spark = layer.grid, layer.df.sparkSession
    cells = spark.range(target.rows * target.cols).select((F.col("id") / target.cols).cast("int").alias("trow"), (F.col("id") % target.cols).cast("int").alias("tcol"))
    x, y = transform(dst_crs, layer.crs, *target.xy(F.col("trow"), F.col("tcol")))
    cells = cells.select("trow", "tcol", ((g.y_origin - y) / g.y_size).alias("fr"), ((x - g.x_origin) / g.x_size).alias("fc"))
    if method == "nearest":
        cells = cells.select("trow", "tcol", F.floor("fr").cast("int").alias("row"), F.floor("fc").cast("int").alias("col"))
        out = cells.join(layer.df, ["row", "col"], "left").select(F.col("trow").alias("row"), F.col("tcol").alias("col"), "value")
    else:
        r, c = F.col("fr") - 0.5, F.col("fc") - 0.5
        corners = F.array(*[F.struct((F.floor(r) + i).cast("int").alias("row"), (F.floor(c) + j).cast("int").alias("col"), ((1 - F.abs(r - F.floor(r) - i)) * (1 - F.abs(c - F.floor(c) - j))).alias("w")) for i in (0, 1) for j in (0, 1)])
        near = cells.select("trow", "tcol", F.explode(corners).alias("k")).select("trow", "tcol", "k.*")
        near = near.join(layer.df, ["row", "col"], "left")
        w = F.sum(F.when(F.col("value").isNotNull(), F.col("w")))
        out = near.groupBy(F.col("trow").alias("row"), F.col("tcol").alias("col")).agg(F.when(w > 0, F.sum(F.col("w") * F.col("value")) / w).alias("value"))
    return layer.derived(out, layer.provenance.layer_name, operation, grid=target, crs=dst_crs)
