"""The study-area pipeline: load, reproject, clip, derive, assemble, check; layers stay distributed."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.crs import crs_equal, crs_text, require_projected_metre, require_same_crs
from ..model import NOT_APPLICABLE, UNKNOWN, Bounds, Grid, RasterLayer, VectorLayer, combine_data_classes
from . import facts, raster, records, roads, validation, vector


@dataclass(frozen=True)
class StudyArea:
    """Layers of one projected system and window, with the records and reports made of them."""

    id: str = "area"
    crs: Any = None
    bounds: Bounds | None = None
    dem: RasterLayer | None = None
    slope: RasterLayer | None = None
    aspect: RasterLayer | None = None
    fuels: RasterLayer | None = None
    scheme: records.ClassScheme | None = None
    roads: VectorLayer | None = None
    graph: roads.RoadGraph | None = None
    qa: dict | None = None
    population: VectorLayer | None = None
    villages: DataFrame | None = None
    facilities: VectorLayer | None = None
    facility_records: DataFrame | None = None
    absent: dict = field(default_factory=dict)

    def layers(self) -> dict[str, RasterLayer | VectorLayer]:
        """The layers that are there, in a stable order."""
        named = {k: getattr(self, k) for k in ("dem", "slope", "aspect", "fuels", "roads", "population", "facilities")}
        return {k: v for k, v in named.items() if v is not None}

    def tables(self) -> dict[str, DataFrame]:
        """Tables made of layers."""
        named = {"road_nodes": self.graph.nodes if self.graph else None, "road_edges": self.graph.edges if self.graph else None, "villages": self.villages, "facility_records": self.facility_records}
        return {k: v for k, v in named.items() if v is not None}

    @property
    def data_class(self) -> str:
        return combine_data_classes(x.provenance.data_class for x in self.layers().values())


def recorded(layer):
    """A layer whose record also holds what the layer itself tells: its system, its missing cells."""
    known = {"output_crs": crs_text(layer.crs)}
    if isinstance(layer, RasterLayer):
        known["nodata_representation"] = UNKNOWN if layer.nodata is None else f"NULL cells; {layer.nodata} in files"
    else:
        known |= {"value_unit": NOT_APPLICABLE, "nodata_representation": NOT_APPLICABLE, "resolution_unit": NOT_APPLICABLE}
    own = {k: v for k, v in known.items() if getattr(layer.provenance, k) == UNKNOWN}
    return replace(layer, provenance=replace(layer.provenance, **own))


def build(
    crs, bounds: Bounds, *, id: str = "area", dem: RasterLayer | None = None, target: Grid | None = None, fuels: RasterLayer | None = None, scheme: records.ClassScheme | None = None,
    road_lines: VectorLayer | None = None, population: VectorLayer | None = None, facilities: VectorLayer | None = None, buffer_cells: int = 1, snap_tolerance: float = 1.0,
    exit_property: str | None = None, settlement_snap: float = 250.0, settlement_options: dict | None = None, facility_options: dict | None = None, absent: dict | None = None,
) -> StudyArea:
    """Bring all layers into one projected system and one window, with records and a road report.

    Elevation is clipped with a halo of buffer_cells and derived; the cells that derivation loses
    lie in the halo, which stays. Land cover of another system goes straight onto that grid. With settlement_options (arguments of
    records.settlements) settlements become records and points that roads are assessed for; with
    facility_options (of records.facilities_from_layer) facilities become records. Guards raise
    before any plan runs.
    """
    crs = require_projected_metre(crs, "study area")
    require_same_crs([crs, bounds.crs], "study area")
    bounds.require_area("study area")
    if dem is not None and buffer_cells < 1:
        raise ConfigError("derivatives need a buffer of one cell")
    done: dict = {"id": id, "crs": crs, "bounds": bounds, "scheme": scheme, "absent": absent or {}}
    if dem is not None:
        if dem.crs != crs:
            if target is None:
                raise ConfigError("reprojection needs a target grid")
            dem = raster.warp(dem, crs, target)
        dem = raster.clip(dem, bounds, buffer_cells)
        done |= {"dem": dem, "slope": raster.slope(dem), "aspect": raster.aspect(dem)}
    if fuels is not None:
        # Land cover of the same system keeps its own cells; another grid is a limitation, not a repair.
        if crs_equal(fuels.crs, crs):
            done["fuels"] = raster.clip(fuels, bounds, buffer_cells)
        elif dem is not None:
            done["fuels"] = raster.warp(fuels, crs, done["dem"].grid, "nearest")
        else:
            raise ConfigError("land cover of another system needs the elevation's grid")
    for name, layer in (("population", population), ("facilities", facilities), ("roads", road_lines)):
        if layer is not None:
            done[name] = vector.clip_features(vector.reproject(layer, crs), bounds)
    done |= {k: recorded(v) for k, v in done.items() if isinstance(v, (RasterLayer, VectorLayer))}
    if population is not None:
        records.require_private_free(done["population"].df, "population")
        if settlement_options is not None:
            done["villages"] = records.settlements(done["population"], **settlement_options)
    if facilities is not None and facility_options is not None:
        done["facility_records"] = records.facilities_from_layer(done["facilities"], **facility_options)
    if road_lines is not None:
        done["graph"] = roads.build_graph(done["roads"], snap_tolerance)
        places = done["villages"].select(F.col("settlement_id").alias("place_id"), "point.x", "point.y") if "villages" in done else None
        tables = roads.assess(done["graph"], bounds, places, settlement_snap, exit_property)
        done["qa"] = roads.report(done["graph"], tables, settlement_snap)
    return StudyArea(**done)


def findings(spark: SparkSession, area: StudyArea) -> DataFrame:
    """All findings of the checks over a study area's layers, records, road report and the whole."""
    whole = validation.findings(facts.bundle_facts(spark, area), "bundle", "bundle_id")
    if not area.layers():
        return whole.where("code = 'BND-001'")
    found = [whole, validation.findings(facts.layer_facts(spark, area.layers()), "layer", "layer")]
    if area.villages is not None:
        found.append(validation.findings(facts.population_facts(area.villages), "population", "settlement_id"))
    if area.facility_records is not None:
        found.append(validation.findings(facts.facility_facts(area.facility_records), "facilities", "layer"))
    if area.qa is not None:
        found.append(validation.findings(facts.road_facts(spark, area.qa), "roads", "layer"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def summary(area: StudyArea) -> DataFrame:
    """(layer, rows): the same whether built or read again."""
    out = None
    for name, df in ({k: v.df for k, v in area.layers().items()} | area.tables()).items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ConfigError("the study area has no layer")
    return out


def describe(area: StudyArea) -> dict:
    """What a study area holds, for people and JSON: layers, terrain, classes, settlements, facilities, roads."""
    if not area.layers():
        raise ConfigError("the study area has no layer")
    out: dict = {"bundle_id": area.id, "crs": crs_text(area.crs), "data_class": area.data_class, "layers": {}}
    rows = {r["layer"]: r["rows"] for r in summary(area).collect()}
    for name, layer in area.layers().items():
        p = layer.provenance
        out["layers"][name] = {"rows": rows[name], "data_class": p.data_class, "sources": [s.get("name", UNKNOWN) for s in p.sources], "unknown_fields": len(p.unknown_fields())}
        if isinstance(layer, RasterLayer):
            out["layers"][name] |= {"shape": [layer.grid.rows, layer.grid.cols], "cell": [layer.grid.x_size, layer.grid.y_size]}
    if area.dem is not None:
        out["terrain"] = raster.terrain_statistics(area.dem, area.slope, area.aspect).first().asDict() if area.slope and area.aspect else raster.statistics(area.dem.df).first().asDict()
    if area.fuels is not None:
        label = area.scheme.label(F.col("code")) if area.scheme else F.lit(UNKNOWN)
        out["fuels"] = {r["code"]: {"cells": r["n"], "label": r["label"]} for r in raster.categorical_statistics(area.fuels.df).withColumn("label", label).orderBy("code").collect()}
    if area.villages is not None:
        out["population"] = records.population_summary(area.villages).first().asDict()
    if area.facility_records is not None:
        out["facilities"] = {r["kind"]: r["n"] for r in records.facilities_summary(area.facility_records).collect()}
    if area.qa is not None:
        out["roads"] = area.qa
    return out
