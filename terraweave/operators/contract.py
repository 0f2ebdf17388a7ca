"""The integration contract: limitation tags, the canonical grid and consumers' readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import crs_text
from ..model import PLANNER_CLASSES, UNKNOWN, Provenance, RasterLayer, now
from . import facts

# Layer slots, what each consumer needs, and tags that it must read.
SLOTS = ("terrain", "roads", "fuels", "population", "facilities")
PROFILES = {"FORECAST_VALUE": ("terrain", "roads", "fuels", "facilities", "population"), "OSSE": ("terrain", "fuels"), "ASSISTED_DISPATCH": ("roads", "facilities")}
GRID_SENSITIVE = ("FORECAST_VALUE", "OSSE")
MATERIAL = ("SURFACE_MODEL_NOT_TERRAIN", "TEMPORAL_VALIDITY_NOT_ESTABLISHED", "LICENCE_UNKNOWN", "NO_NODATA_DECLARED", "NO_SOURCE_RECORDED")
TAGS = {
    "dsm": "SURFACE_MODEL_NOT_TERRAIN", "validity": "TEMPORAL_VALIDITY_NOT_ESTABLISHED", "checksum": "NOT_CHECKSUMMED", "source": "NO_SOURCE_RECORDED",
    "licence": "LICENCE_UNKNOWN", "nodata": "NO_NODATA_DECLARED", "grid": "REPROJECTED_ONTO_ITS_OWN_GRID", "record": "INCOMPLETE_PROVENANCE",
}
SLOT_LAYERS = {"terrain": ("dem", "slope", "aspect"), "roads": ("roads",), "fuels": ("fuels",), "population": ("population",), "facilities": ("facilities",)}
CONTRACT_VERSION = "1.1.0"


def limitations() -> Column:
    """Sorted tags of a row of layer facts; only the first source's licence counts."""
    tag = lambda condition, name: F.when(F.expr(condition), F.lit(name))
    tags = F.array(
        tag("surface_model = 'dsm'", TAGS["dsm"]),
        tag("valid_from = 'UNKNOWN' OR valid_to = 'UNKNOWN'", TAGS["validity"]),
        tag("checksum = 'UNKNOWN'", TAGS["checksum"]),
        tag("n_sources = 0", TAGS["source"]),
        tag("coalesce(licence, '') IN ('', 'UNKNOWN')", TAGS["licence"]),
        tag("data_kind = 'raster' AND NOT nodata_declared AND nodata_text <> 'not_applicable'", TAGS["nodata"]),
        tag("data_kind = 'raster' AND own_grid", TAGS["grid"]),
        tag("n_unknown > 0", TAGS["record"]),
    )
    return F.array_sort(F.array_distinct(F.array_compact(tags)))


def canonical_grid(rasters: DataFrame, group: str) -> DataFrame:
    """NO_RASTERS, SHARED or MISMATCHED for each group of raster facts (grid columns, NULL: none)."""
    grid = F.struct("x_origin", "y_origin", "x_size", "y_size", "n_rows", "n_cols")
    n = F.count_distinct(F.when(F.col("x_size").isNotNull(), grid))
    return rasters.groupBy(group).agg(F.when(n == 0, "NO_RASTERS").when(n == 1, "SHARED").otherwise("MISMATCHED").alias("grid_status"))


def compatibility(slots: DataFrame, grids: DataFrame, group: str) -> DataFrame:
    """(group, profile, status, missing): READY, READY_WITH_LIMITATIONS or INCOMPLETE.

    slots hold (group, slot, usable, tags). A slot that is absent or not usable is missing;
    material tags, or rasters on different grids where cells are compared, are limitations.
    """
    spark = slots.sparkSession
    needs = spark.createDataFrame([(p, s) for p, ss in PROFILES.items() for s in ss], "profile string, slot string")
    groups = grids.select(group, "grid_status")
    # PROFILES and its slots are ten rows.
    wanted = groups.crossJoin(F.broadcast(needs))
    have = wanted.join(slots, [group, "slot"], "left")
    missing = ~F.coalesce("usable", F.lit(False))
    material = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, MATERIAL)))
    out = have.groupBy(group, "profile", "grid_status").agg(
        F.count_if(missing).alias("n_missing"), F.count_if(material).alias("n_material"),
        F.array_join(F.array_sort(F.collect_list(F.when(missing, F.col("slot")))), ",").alias("missing"),
    )
    limited = (F.col("n_material") > 0) | (F.col("profile").isin(*GRID_SENSITIVE) & (F.col("grid_status") == "MISMATCHED"))
    return out.select(group, "profile", F.when(F.col("n_missing") > 0, "INCOMPLETE").when(limited, "READY_WITH_LIMITATIONS").otherwise("READY").alias("status"), "missing")


def obliges(licence: Column) -> Column:
    """Whether a licence's text names share-alike of databases or attribution, wherever it stands."""
    return F.coalesce(licence.contains("ODbL") | F.lower(licence).contains("attribution"), F.lit(False))


def licence_rollup(sources: DataFrame, group: str) -> DataFrame:
    """(group, licence, attribution): each group's licences once, and whether they oblige."""
    return sources.select(group, "licence", obliges(F.col("licence")).alias("attribution")).distinct()


def licences(records: dict[str, Provenance]) -> list[dict]:
    """Every layer's source with what it was licensed under, each once, by layer and source."""
    fields = ("licence", "licence_url", "publisher", "url_or_identifier")
    found = {(name, s.get("name", UNKNOWN), *(s.get(f, UNKNOWN) for f in fields)) for name, p in records.items() for s in p.sources}
    return [dict(zip(("layer", "source", *fields), row, strict=True)) for row in sorted(found, key=str)]


def obligations(entries: list[dict]) -> list[str]:
    """The sources whose licence travels with the data; the same rule as obliges."""
    return sorted({f"{e['source']}: {e['licence']}" for e in entries if "ODbL" in e["licence"] or "attribution" in e["licence"].lower()})


def differences(recorded: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): orphan (only actual), missing (only recorded) or changed."""
    a = recorded.select(F.col(key), F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = actual.select(F.col(key), F.col(value).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "orphan").when(F.col("in_b").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def layer_entry(name: str, layer, tags: list[str]) -> dict:
    """What a consumer reads of one layer."""
    p, is_raster = layer.provenance, isinstance(layer, RasterLayer)
    return {
        "name": name, "geometry": "raster" if is_raster else "vector", "crs": crs_text(layer.crs), "data_class": p.data_class.upper(), "planner_legal": p.data_class in PLANNER_CLASSES,
        "temporal": {"class": p.temporal_class, "reference": p.temporal_reference, "valid_from": p.valid_from, "valid_to": p.valid_to}, "surface_model": p.surface_model,
        "units": {"values": p.value_unit, "resolution": p.resolution_unit, "vertical_datum": p.vertical_datum}, "resolution": [layer.grid.x_size, layer.grid.y_size] if is_raster else None,
        "missing_data": p.nodata_representation, "checksum": p.checksum, "checksum_algorithm": p.checksum_algorithm, "sources": list(p.sources), "licence": p.sources[0].get("licence", UNKNOWN) if p.sources else UNKNOWN,
        "unknown_fields": p.unknown_fields(), "derived_from": list(p.parents), "random_seed": p.random_seed, "limitations": tags,
    }


def scheme_entry(scheme) -> dict:
    """The class scheme, or that there is none; classes are no model of fire behaviour."""
    if scheme is None:
        return {"status": "ABSENT", "name": UNKNOWN}
    return {"status": "PRESENT", "name": scheme.name, "class_count": len(scheme.labels), "nodata_code": scheme.nodata, "data_class": scheme.data_class, "source": scheme.source, "is_fire_behaviour_fuel_model": False}


def graph_entry(qa: dict | None) -> dict:
    """Counts of the road graph from its report, which is kept, so built and read bundles agree."""
    if qa is None:
        return {"status": "ABSENT", "reason": "no road report in this bundle"}
    return {"status": "PRESENT", **qa["graph"], "component_count": qa["connectivity"]["component_count"]}


def build(spark: SparkSession, area, validation: dict | None = None, created_at: str | None = None) -> dict:
    """The contract manifest of a study area: the fixed five slots, one grid or none, readiness of consumers.

    A slot holds its layers' entries, or ABSENT with its reason. Nothing is asserted by hand.
    """
    layers = area.layers()
    told = facts.layer_facts(spark, layers, validity=False).withColumn("bundle", F.lit(area.id)).withColumn("tags", limitations())
    tags = {r["layer"]: list(r["tags"]) for r in told.select("layer", "tags").collect()}
    slots = {}
    for slot, names in SLOT_LAYERS.items():
        have = [n for n in names if n in layers]
        slots[slot] = {"status": "PRESENT", "layers": [layer_entry(n, layers[n], tags[n]) for n in have]} if have else {"status": "ABSENT", "reason": area.absent.get(slot, "not supplied")}
    if slots["fuels"]["status"] == "PRESENT":
        slots["fuels"]["class_scheme"] = scheme_entry(area.scheme)
    if slots["roads"]["status"] == "PRESENT":
        slots["roads"]["graph"] = graph_entry(area.qa)
    status = canonical_grid(told, "bundle").first()["grid_status"]
    grid = next((x.grid.__dict__ for x in layers.values() if isinstance(x, RasterLayer)), None) if status == "SHARED" else None
    rows = []
    for slot, entry in slots.items():
        if entry["status"] == "PRESENT":
            usable = slot != "fuels" or area.scheme is not None
            rows.append((area.id, slot, usable, sorted({t for e in entry["layers"] for t in e["limitations"]})))
    given = spark.createDataFrame(rows, "bundle string, slot string, usable boolean, tags array<string>")
    ready = compatibility(given, spark.createDataFrame([(area.id, status)], "bundle string, grid_status string"), "bundle").collect()
    return {
        "contract_version": CONTRACT_VERSION, "bundle_id": area.id, "created_at": created_at or now(), "crs": crs_text(area.crs), "canonical_grid": {"status": status, "grid": grid}, "slots": slots,
        "record_versions": sorted({x.provenance.schema_version for x in layers.values()}), "compatibility": {r["profile"]: {"status": r["status"], "missing": r["missing"]} for r in ready},
        "validation": validation or {"status": "NOT_RUN"},
    }
