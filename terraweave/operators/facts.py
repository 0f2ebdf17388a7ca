"""Tables of facts that the checks read, computed from layers, records, graphs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import crs_equal, crs_text
from ..model import CLASS_PRECEDENCE, UNKNOWN, Provenance, RasterLayer, VectorLayer
from . import records, vector

#: Provenance fields without which a layer's values can't be interpreted.
BLOCKING = ("output_crs", "value_unit", "nodata_representation")
_WHOLE = ("tinyint", "smallint", "int", "bigint")
LAYER_FACTS = (
    "layer string, data_kind string, crs string, geographic boolean, axis_unit string, northing_first boolean, ref_crs string, nodata_declared boolean, integer_cells boolean, total_count bigint, valid_count bigint, "
    "x_size double, y_size double, x_origin double, y_origin double, ref_x_size double, ref_y_size double, ref_x_origin double, ref_y_origin double, n_rows int, n_cols int, "
    "data_class string, n_sources int, n_parents int, temporal_class string, temporal_reference string, checksum string, surface_model string, valid_from string, valid_to string, "
    "n_unknown_blocking int, n_unknown_other int, n_unknown int, licence string, nodata_text string, own_grid boolean, n_features bigint, n_geometry_types bigint, n_invalid bigint"
)


def provenance_facts(p: Provenance) -> dict:
    unknown = set(p.unknown_fields())
    blocking = unknown & set(BLOCKING)
    own = any(t["operation"] == "reproject_raster" and t.get("parameters", {}).get("target_grid_supplied") is False for t in p.transformations)
    return {
        "data_class": p.data_class, "n_sources": len(p.sources), "n_parents": len(p.parents), "temporal_class": p.temporal_class, "temporal_reference": p.temporal_reference, "checksum": p.checksum,
        "surface_model": p.surface_model, "valid_from": p.valid_from, "valid_to": p.valid_to, "n_unknown_blocking": len(blocking), "n_unknown_other": len(unknown - blocking), "n_unknown": len(unknown),
        "licence": p.sources[0].get("licence", UNKNOWN) if p.sources else UNKNOWN, "nodata_text": p.nodata_representation, "own_grid": own,
    }


def unknown_fields(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, n): in how many rows each field is UNKNOWN; a field that never is has no row."""
    pairs = F.array(*[F.when(F.col(f) == UNKNOWN, F.lit(f)) for f in fields])
    return rows.select(F.explode(F.array_compact(pairs)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def combined_classes(rows: DataFrame, group: str) -> DataFrame:
    """(group, data_class): the class that dominates each group."""
    names = F.array(*map(F.lit, CLASS_PRECEDENCE))
    return rows.groupBy(group).agg(F.min(F.array_position(names, F.col("data_class"))).alias("k")).select(group, names[(F.col("k") - 1).cast("int")].alias("data_class"))


def _crs_facts(crs) -> dict:
    if crs is None:
        return {"crs": UNKNOWN}
    return {"crs": crs_text(crs), "geographic": crs.geographic, "axis_unit": "degree" if crs.geographic else crs.unit, "northing_first": not crs.axis_xy}


def layer_facts(spark: SparkSession, layers: dict[str, RasterLayer | VectorLayer], validity: bool = True) -> DataFrame:
    """One row for each layer; grids are held against the first raster's, systems against the first layer's.

    Cells and features are counted by one aggregate for each layer; only the counts reach the driver.
    Without validity, geometries are not tested and their count of invalid ones is NULL.
    """
    rows, names = [], [f.split()[0] for f in LAYER_FACTS.split(", ")]
    first = next(iter(layers.values()), None)
    grid = next((x.grid for x in layers.values() if isinstance(x, RasterLayer)), None)
    for name, layer in layers.items():
        row = {"layer": name, "ref_crs": crs_text(first.crs) if first.crs is not None else UNKNOWN} | _crs_facts(layer.crs) | provenance_facts(layer.provenance)
        if layer.crs is not None and first.crs is not None and crs_equal(layer.crs, first.crs):
            row["crs"] = row["ref_crs"]
        if isinstance(layer, RasterLayer):
            g = layer.grid
            row |= {"data_kind": "raster", "nodata_declared": layer.nodata is not None, "integer_cells": dict(layer.df.dtypes)["value"] in _WHOLE, "total_count": g.rows * g.cols, "valid_count": layer.df.agg(F.count("value")).first()[0]}
            row |= {"x_size": g.x_size, "y_size": g.y_size, "x_origin": g.x_origin, "y_origin": g.y_origin, "n_rows": g.rows, "n_cols": g.cols}
            row |= {"ref_x_size": grid.x_size, "ref_y_size": grid.y_size, "ref_x_origin": grid.x_origin, "ref_y_origin": grid.y_origin}
        else:
            n = layer.df.agg(F.count("*").alias("n"), F.count_distinct("geom.type").alias("t")).first()
            row |= {"data_kind": "vector", "n_features": n["n"], "n_geometry_types": n["t"], "n_invalid": (vector.invalid_features(layer).count() if n["n"] else 0) if validity else None}
        rows.append(tuple(row.get(c) for c in names))
    return spark.createDataFrame(rows, LAYER_FACTS)


def population_facts(settlements: DataFrame) -> DataFrame:
    """settlement_id, total, strata_sum, count_basis of settlement records."""
    return settlements.select("settlement_id", F.col("population_total").alias("total"), records.strata_total(F.col("strata")).alias("strata_sum"), "count_basis")


def facility_facts(facilities: DataFrame, layer: str = "facilities") -> DataFrame:
    """One row; none where there is no facility."""
    assessed = F.col("suitability_assessed") if "suitability_assessed" in facilities.columns else F.lit(False)
    one = facilities.agg(F.count("*").alias("n"), F.count_if(~assessed).alias("n_unassessed"), F.count_if(F.col("operational_status") == UNKNOWN).alias("n_status_unknown"), F.count_if(F.col("capacity_persons").isNull()).alias("n_without_capacity"))
    return one.where("n > 0").select(F.lit(layer).alias("layer"), "n_unassessed", "n_status_unknown", "n_without_capacity")


def road_facts(spark: SparkSession, report: dict, layer: str = "roads") -> DataFrame:
    """One row from a network's report (roads.report)."""
    c, e = report["connectivity"], report["egress"]
    row = (
        layer, c["component_count"], c["isolated_segments"]["count"], e["single_egress_candidates"]["count"], e["no_egress_components"]["count"],
        int(e["exits"]["clip_boundary_warning"]) * max(1, e["exits"]["from_boundary"]), report["crossings_without_node"]["count"], e["settlements"]["unmatched"]["count"],
    )
    return spark.createDataFrame([row], "layer string, n_components bigint, n_isolated bigint, n_single_egress bigint, n_no_egress bigint, n_boundary_exits bigint, n_unnoded_crossings bigint, n_unmatched bigint")


def bundle_facts(spark: SparkSession, area) -> DataFrame:
    """One row of what only a whole study area tells."""
    layers = area.layers()
    count = lambda layer: layer.grid.rows * layer.grid.cols - layer.df.agg(F.count("value")).first()[0]
    dem, fuels, scheme = area.dem, area.fuels, area.scheme
    covers = None
    if dem is not None and crs_equal(dem.crs, area.bounds.crs):
        covers = dem.grid.bounds(dem.crs).covers(area.bounds)
    both = dem is not None and area.slope is not None
    undefined = scheme.unknown_codes(fuels.df).count() if fuels is not None and scheme is not None else None
    private = 0
    if area.population is not None:
        private = records.check_privacy(vector.property_keys(area.population).select(F.col("key").alias("name"))).count()
    row = (
        area.id, len(layers), covers, count(area.slope) if both else None, count(dem) if both else None, fuels is not None, fuels is not None and fuels.kind == "categorical", scheme is not None, undefined,
        None if fuels is None or fuels.nodata is None else float(fuels.nodata), None if scheme is None else float(scheme.nodata), sum(x.provenance.data_class == "synthetic" for x in layers.values()), private,
    )
    return spark.createDataFrame([row], "bundle_id string, n_layers int, terrain_covers boolean, slope_missing bigint, dem_missing bigint, has_fuels boolean, fuels_categorical boolean, fuels_scheme boolean, n_undefined_codes bigint, fuels_nodata double, scheme_nodata double, n_synthetic int, n_private_fields bigint")


