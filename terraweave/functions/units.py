"""Units: exact factors, aliases and conversions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnitMismatchError, UnknownUnitError

# Factors to the canonical unit, and spellings that sources use.
LENGTH = {"m": 1.0, "km": 1000.0, "ft": 0.3048}
TIME = {"s": 1.0, "min": 60.0, "h": 3600.0}
AREA = {"m2": 1.0, "ha": 10000.0, "km2": 1000000.0}
SLOPE = ("degree", "radian", "percent")
LENGTH_ALIASES = {
    "m": "m", "metre": "m", "meter": "m", "metres": "m", "meters": "m", "km": "km", "kilometre": "km", "kilometer": "km",
    "ft": "ft", "foot": "ft", "feet": "ft", "international foot": "ft",
}
SLOPE_ALIASES = {
    "deg": "degree", "degree": "degree", "degrees": "degree", "rad": "radian", "radian": "radian", "radians": "radian",
    "percent": "percent", "%": "percent", "percent_rise": "percent",
}


def _scaled(table: dict[str, float], value: Column, src: str, dst: str) -> Column:
    for unit in (src, dst):
        if unit not in table:
            raise UnknownUnitError(f"unknown unit {unit!r}; known: {sorted(table)}")
    return value * F.lit(table[src]) / F.lit(table[dst])


def convert_length(value: Column, src: str, dst: str) -> Column:
    return _scaled(LENGTH, value, src, dst)


def convert_time(value: Column, src: str, dst: str) -> Column:
    return _scaled(TIME, value, src, dst)


def convert_area(value: Column, src: str, dst: str) -> Column:
    return _scaled(AREA, value, src, dst)


def convert_slope(value: Column, src: str, dst: str) -> Column:
    """Slopes are not linear in each other; 90 degrees are a finite, very large percentage."""
    for unit in (src, dst):
        if unit not in SLOPE:
            raise UnknownUnitError(f"unknown slope unit {unit!r}; known: {SLOPE}")
    if src == dst:
        return value
    radians = {"degree": lambda v: F.radians(v), "radian": lambda v: v, "percent": lambda v: F.atan(v / 100.0)}[src](value)
    return {"degree": F.degrees(radians), "radian": radians, "percent": F.tan(radians) * 100.0}[dst]


def _parsed(value: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(value)))


def parse_length_unit(value: Column) -> Column:
    """The canonical unit; null where the spelling is unknown. The US survey foot is no foot."""
    return _parsed(value, LENGTH_ALIASES)


def parse_slope_unit(value: Column) -> Column:
    return _parsed(value, SLOPE_ALIASES)


def length_unit(value: str) -> str:
    """As parse_length_unit, for one string; an unknown one raises."""
    got = LENGTH_ALIASES.get(str(value).strip().lower())
    if got is None:
        raise UnknownUnitError(f"unknown length unit {value!r}; known: {sorted(LENGTH_ALIASES)}")
    return got


def require_same_length_unit(units: Iterable[str], context: str) -> str:
    found = {length_unit(u) for u in units}
    if len(found) != 1:
        raise UnitMismatchError(f"{context}: length units differ or are missing: {sorted(found)}")
    return found.pop()
