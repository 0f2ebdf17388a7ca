"""Text rules as Column expressions: tile names, temporal precision, private field names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IngestError

# Field names that no layer may carry.
PRIVATE_PATTERNS = (
    r"resident.?registration",
    r"\bjumin\b",
    r"\brrn\b",
    r"national.?id",
    r"(^|_)(person|patient|resident|occupant)_(name|id|no|number)($|_)",
    r"(^|_)(first|last|full|given|family)_?name($|_)",
    r"\bdiagnos",
    r"\bdisease\b",
    r"\bicd_?1?0?\b",
    r"\bmedicat",
    r"prescri",
    r"\bdisabilit(y|ies)_(grade|level|type|code)\b",
    r"care.?grade",
    r"\bltci\b",
    r"(^|_)mobility_(status|grade|level|score)($|_)",
    r"\bbedridden\b",
    r"\bwheelchair_user\b",
    r"(^|_)(phone|mobile|tel|telephone|email)($|_)",
    r"(^|_)(address|addr|street_address|dwelling_id|house_?hold_?id)($|_)",
    r"\bnhis\b",
    r"\bmedical_?record",
)


def normalised_field(name: Column) -> Column:
    """Lower case without white space around, every run of other characters than a-z and 0-9 as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s+|\s+$", ""), "[^a-z0-9]+", "_")


def private_pattern(name: Column) -> Column:
    """The first pattern (from 1) that a field name hits, or null."""
    field = normalised_field(name)
    return F.coalesce(*[F.when(field.rlike(p), F.lit(i)) for i, p in enumerate(PRIVATE_PATTERNS, 1)])


def dem_tile_name(lat: Column, lon: Column) -> Column:
    """The tile of one degree whose south-west corner holds the point."""
    lat, lon = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    letter = lambda v, pos, neg: F.when(v >= 0, pos).otherwise(neg)
    return F.concat(F.lit("Copernicus_DSM_COG_10_"), letter(lat, "N", "S"), F.lpad(F.abs(lat).cast("string"), 2, "0"), F.lit("_00_"), letter(lon, "E", "W"), F.lpad(F.abs(lon).cast("string"), 3, "0"), F.lit("_00_DEM"))


def cover_tile_name(lat: Column, lon: Column) -> Column:
    """The tile of three degrees; corners are floored to multiples of 3, below zero too."""
    lat, lon = (F.floor(lat / 3) * 3).cast("int"), (F.floor(lon / 3) * 3).cast("int")
    letter = lambda v, pos, neg: F.when(v >= 0, pos).otherwise(neg)
    return F.concat(letter(lat, "N", "S"), F.lpad(F.abs(lat).cast("string"), 2, "0"), letter(lon, "E", "W"), F.lpad(F.abs(lon).cast("string"), 3, "0"))


# Where the public tiles lie.
DEM_BASE = "https://copernicus-dem-30m.s3.amazonaws.com"
COVER_BASE = "https://esa-worldcover.s3.eu-central-1.amazonaws.com/v200/2021/map/ESA_WorldCover_10m_2021_v200_"


def dem_tile_url(lat: Column, lon: Column) -> Column:
    name = dem_tile_name(lat, lon)
    return F.concat(F.lit(f"{DEM_BASE}/"), name, F.lit("/"), name, F.lit(".tif"))


def cover_tile_url(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit(COVER_BASE), cover_tile_name(lat, lon), F.lit("_Map.tif"))


def nodata_text(value: float | None) -> str:
    """A nodata value in a record; none declared is known, unlike UNKNOWN."""
    return "none_declared" if value is None else "nan" if math.isnan(value) else repr(value)


def nodata_json(value: float | None) -> float | str | None:
    """A nodata value for JSON, which has no NaN."""
    return "nan" if value is not None and math.isnan(value) else value


def nodata_of_json(value: float | str | None) -> float | None:
    if isinstance(value, str):
        if value != "nan":
            raise IngestError(f"a nodata value is a number, null or 'nan', not {value!r}")
        return math.nan
    return value


def unit_text(value: str | None) -> str:
    return "UNKNOWN" if value is None else str(value)


def bbox_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.format_string("%.6f,%.6f,%.6f,%.6f", x0, y0, x1, y1)


def temporal_kind(value: Column) -> Column:
    """How precise a temporal string is, or "invalid"; it is never padded or cast.

    A date and time needs an offset, as a local time read as UTC is hours off.
    """
    text = F.trim(value)
    return (
        F.when(value.isNull() | (text == ""), "invalid")
        .when(text.isin("UNKNOWN", "not_applicable"), text)
        .when(text.rlike(r"^[0-9]{4}$"), "year")
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}$"), "month")
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "day")
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$"), "instant")
        .otherwise("invalid")
    )


def exit_tag(value: Column, accepted: tuple[str, ...] = ("true", "yes", "1", "exit")) -> Column:
    return F.coalesce(F.lower(value).isin(*accepted), F.lit(False))
