"""Record builders: settlements with age strata, facilities, class schemes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IngestError, PrivacyError
from ..functions.geometry import representative_point
from ..functions.text import private_pattern
from ..model import UNKNOWN, VectorLayer

# Roles and states of facilities, and the shipped class schemes.
FACILITY_KINDS = ("shelter", "temporary_refuge_candidate", "responder_base", "fire_station", "other")
FACILITY_STATES = ("operational", "not_operational", "UNKNOWN")
DEMO_CLASSES = {1: "non_vegetated", 2: "grass_or_crop", 3: "shrub", 4: "broadleaf_forest", 5: "conifer_forest", 6: "mixed_forest"}
COVER_CLASSES = {
    10: "tree_cover", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built_up", 60: "bare_or_sparse_vegetation", 70: "snow_and_ice",
    80: "permanent_water_bodies", 90: "herbaceous_wetland", 95: "mangroves", 100: "moss_and_lichen",
}


@dataclass(frozen=True)
class ClassScheme:
    name: str
    labels: dict[int, str]
    nodata: int
    data_class: str = "observed"
    source: str = "UNKNOWN"
    #: legend (the publisher's own classes) or crosswalk (a model of them).
    kind: str = "legend"

    @staticmethod
    def of_pairs(name: str, pairs: list[tuple[int, str]], nodata: int, **more) -> ClassScheme:
        """A scheme from a list, in which no code may stand twice."""
        codes = [c for c, _ in pairs]
        if len(set(codes)) < len(codes):
            raise IngestError(f"codes {sorted({c for c in codes if codes.count(c) > 1})} stand twice")
        return ClassScheme(name, dict(pairs), nodata, **more)

    def __post_init__(self):
        if not self.name.strip() or not self.labels:
            raise IngestError("a scheme has a name and classes")
        if self.kind not in ("legend", "crosswalk") or (self.kind == "crosswalk" and self.data_class == "observed"):
            raise IngestError("a scheme is a legend or a crosswalk, and a crosswalk is never observed")
        if self.nodata in self.labels:
            raise IngestError("the nodata code is no class")
        if self.data_class != "synthetic" and self.source == "UNKNOWN":
            raise IngestError("a scheme that is not synthetic needs a source")

    def label(self, code: Column) -> Column:
        """nodata, a label, or UNKNOWN."""
        table = F.create_map(*[F.lit(x) for pair in self.labels.items() for x in pair])
        return F.when(code == self.nodata, "nodata").otherwise(F.coalesce(F.try_element_at(table, code), F.lit("UNKNOWN")))

    def unknown_codes(self, cells: DataFrame) -> DataFrame:
        """Codes that are neither classes nor nodata, in order."""
        known = [*self.labels, self.nodata]
        return cells.where(F.col("value").isNotNull() & ~F.col("value").isin(*known)).select(F.col("value").cast("int").alias("code")).distinct().orderBy("code")


DEMO_SCHEME = ClassScheme("synthetic_demo_v1", DEMO_CLASSES, 255, "synthetic")
COVER_SCHEME = ClassScheme("esa_worldcover_v200", COVER_CLASSES, 0, "observed", "ESA WorldCover 10 m 2021 v200")
SCHEMES = {s.name: s for s in (DEMO_SCHEME, COVER_SCHEME)}


def check_privacy(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, pattern): the field names that may not be carried."""
    return names.select(F.col(column).alias("name"), private_pattern(F.col(column)).alias("pattern")).where("pattern is not null")


def require_private_free(df: DataFrame, context: str) -> None:
    """Raise with every offending property key of a layer."""
    found = check_privacy(df.select(F.explode(F.map_keys("props")).alias("name")).distinct()).select("name").collect()
    if found:
        raise PrivacyError(f"{context}: {sorted(r['name'] for r in found)}")


def stratum_label(lower: Column, upper: Column) -> Column:
    """Half-open bands: 0-14 for [0, 15), 65+ where no upper age is set."""
    return F.when(upper.isNull(), F.concat(lower.cast("string"), F.lit("+"))).otherwise(F.concat_ws("-", lower.cast("string"), (upper - 1).cast("string")))


def overlapping_strata(strata: DataFrame, by: str | None = None) -> DataFrame:
    """Bands that share an age with an earlier one of the same settlement (by), and that one's bounds.

    In order of lower bounds, a band overlaps if it begins before the furthest end so far; the
    earlier band given is the one that reaches there. A band without upper bound has no end.
    """
    own = [by] if by else []
    end = F.coalesce("upper", F.lit(2**31 - 1))
    order = Window.partitionBy(*own).orderBy("lower", end)
    reach = F.max(F.struct(end.alias("end"), F.col("lower"), F.col("upper"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = strata.withColumn("before", reach).where(F.col("lower") < F.col("before.end"))
    return found.select(*own, F.col("before.lower").alias("l1"), F.col("before.upper").alias("u1"), F.col("lower").alias("l2"), F.col("upper").alias("u2"))


def strata_total(strata: Column) -> Column:
    """Sum of the supplied counts; NULL if none is."""
    given = F.filter(strata, lambda s: s["count"].isNotNull())
    return F.when(F.size(given) > 0, F.aggregate(given, F.lit(0).cast("long"), lambda t, s: t + s["count"].cast("long")))


def strata_match(strata: Column, total: Column) -> Column:
    """TRUE or FALSE only where every count and the total are known."""
    known = total.isNotNull() & ~F.exists(strata, lambda s: s["count"].isNull())
    return F.when(known, strata_total(strata) == total)


def facilities(df: DataFrame, kind_column: str, kind_map: dict[str, str], unmapped: str = "error") -> DataFrame:
    """Facility rows with a role for each source tag; unmapped tags raise or become "other"."""
    bad = set(kind_map.values()) - set(FACILITY_KINDS)
    if bad or unmapped not in ("error", "other"):
        raise IngestError(f"unknown roles {sorted(bad)} or rule {unmapped!r}")
    table = F.create_map(*[F.lit(x) for pair in kind_map.items() for x in pair])
    out = df.withColumn("kind", F.try_element_at(table, F.col(kind_column).cast("string")))
    if unmapped == "error":
        wrong = [r[0] for r in out.where("kind is null").select(kind_column).distinct().limit(20).collect()]
        if wrong:
            raise IngestError(f"unmapped facility tags: {wrong}")
    return out.withColumn("kind", F.coalesce("kind", F.lit("other")))


def population_summary(settlements: DataFrame, strata: Column | None = None, total: str = "population_total") -> DataFrame:
    """One row: the known totals' sum, settlements without one, and those whose bands don't add up to it."""
    matches = strata_match(F.col("strata") if strata is None else strata, F.col(total))
    return settlements.agg(F.sum(total).alias("total"), F.count_if(F.col(total).isNull()).alias("n_missing"), F.count_if(~F.coalesce(matches, F.lit(True))).alias("n_mismatch"))


def facilities_summary(rows: DataFrame, capacity: str = "capacity_persons", assessed: str | None = None) -> DataFrame:
    """Facilities of each role, how many state a capacity, and how many are assessed."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count(capacity).alias("with_capacity"), F.count_if(F.col(assessed) if assessed else F.lit(False)).alias("assessed"))


def _prop(key: str) -> Column:
    return F.try_element_at("props", F.lit(key))


def _named(layer: VectorLayer, id_property: str) -> None:
    if not layer.df.where(F.trim(F.coalesce(_prop(id_property), F.lit(""))) == "").isEmpty():
        raise IngestError(f"a feature has no {id_property!r}; a position is no identity")


def _whole(column: str) -> Column:
    """A number's text as a whole number; fractions are cut off."""
    return F.col(column).try_cast("double").cast("bigint")


def _counts(df: DataFrame, columns: list[str], context: str) -> None:
    """Raise where a count is no number or below 0; a missing one stays missing."""
    if columns:
        wrong = [F.col(c).isNotNull() & ~F.coalesce(_whole(c) >= 0, F.lit(False)) for c in columns]
        if not df.where(F.exists(F.array(*wrong), lambda w: w)).isEmpty():
            raise IngestError(f"{context}: a count is negative or no number")


def settlements(
    layer: VectorLayer, *, id_property: str = "settlement_id", name_property: str = "name", total_property: str = "population_total",
    strata: tuple[tuple[str, int, int | None], ...] = (), basis_property: str = "count_basis", date_property: str = "reference_date",
) -> DataFrame:
    """One row for each feature: id, name, point, total, strata and what else it carries.

    strata names (property, lower, upper) of half-open age bands, which may not share an age. A
    missing total or count stays NULL and is never 0. Point features give their own point
    (centroid_kind source_provided); others a representative one (UNKNOWN as to its source).
    Private field names, a missing identity and a count below 0 raise.
    """
    for i, (_, lower, upper) in enumerate(ordered := sorted(strata, key=lambda s: s[1])):
        if upper is not None and upper <= lower or i + 1 < len(ordered) and (upper is None or upper > ordered[i + 1][1]):
            raise IngestError("age bands are empty or share an age")
    require_private_free(layer.df, "population")
    _named(layer, id_property)
    raw = layer.df.withColumns({f"count_{i}": _prop(p) for i, (p, *_) in enumerate(strata)} | {"total": _prop(total_property)})
    _counts(raw, ["total", *[f"count_{i}" for i in range(len(strata))]], "population")
    band = "struct<property:string,lower:int,upper:int,count:bigint>"
    bands = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(lo).alias("lower"), F.lit(hi).cast("int").alias("upper"), _whole(f"count_{i}").alias("count")) for i, (p, lo, hi) in enumerate(strata)]).cast(f"array<{band}>")
    used = [id_property, name_property, total_property, basis_property, date_property, *[p for p, *_ in strata]]
    text = lambda key: F.coalesce(_prop(key), F.lit(UNKNOWN))
    return raw.select(
        _prop(id_property).alias("settlement_id"), text(name_property).alias("name"), "geom", representative_point(F.col("geom.type"), F.col("geom.parts")).alias("point"),
        F.when(F.col("geom.type") == "Point", "source_provided").otherwise(UNKNOWN).alias("centroid_kind"), _whole("total").alias("population_total"), bands.alias("strata"),
        text(basis_property).alias("count_basis"), text(date_property).alias("reference_date"), F.map_filter("props", lambda k, _: ~k.isin(*used)).alias("attributes"),
    )


def facilities_from_layer(
    layer: VectorLayer, kind_map: dict[str, str], *, id_property: str = "facility_id", kind_property: str = "kind", name_property: str = "name",
    capacity_property: str | None = None, status_property: str | None = None, unmapped: str = "error",
) -> DataFrame:
    """One row for each feature: id, role, name, point, state, capacity, source tag and the rest.

    Roles come from kind_map alone. A missing identity or tag, an unknown state and a capacity
    below 0 raise; a missing capacity stays NULL and a missing state is UNKNOWN.
    """
    _named(layer, id_property)
    _named(layer, kind_property)
    nothing = F.lit(None).cast("string")
    raw = layer.df.withColumns({
        "source_kind_tag": _prop(kind_property),
        "capacity": nothing if capacity_property is None else _prop(capacity_property),
        "state": F.coalesce(nothing if status_property is None else _prop(status_property), F.lit(UNKNOWN)),
    })
    _counts(raw, ["capacity"], "facilities")
    if not raw.where(~F.col("state").isin(*FACILITY_STATES)).isEmpty():
        raise IngestError(f"a facility's state is none of {FACILITY_STATES}")
    used = [p for p in (id_property, kind_property, name_property, capacity_property, status_property) if p]
    return facilities(raw, "source_kind_tag", kind_map, unmapped).select(
        _prop(id_property).alias("facility_id"), "kind", F.coalesce(_prop(name_property), F.lit(UNKNOWN)).alias("name"), "geom", representative_point(F.col("geom.type"), F.col("geom.parts")).alias("point"),
        F.col("state").alias("operational_status"), _whole("capacity").alias("capacity_persons"), "source_kind_tag", F.map_filter("props", lambda k, _: ~k.isin(*used)).alias("attributes"),
    )
