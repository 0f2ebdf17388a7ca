"""Coordinate systems: a registry and Transverse Mercator as Column expressions.

KGD2002 and WGS 84 count as one datum. Order is always (x easting, y northing).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CRSError, CRSMismatchError, GeographicCRSError, NonMetreCRSError, UnknownCRSError


@dataclass(frozen=True)
class CRSDef:
    code: str
    name: str
    lat0: float = 0.0
    lon0: float = 0.0
    scale: float = 1.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    inverse_flattening: float = 298.257222101
    geographic: bool = False
    axis_xy: bool = True
    unit: str = "m"
    transformable: bool = True


# Public EPSG parameters.
REGISTRY = {
    c.code: c
    for c in (
        CRSDef("EPSG:4326", "WGS 84", inverse_flattening=298.257223563, geographic=True, axis_xy=False, unit="degree"),
        CRSDef("EPSG:5174", "Korean 1985 / Modified Central Belt", 38.0, 127.0028902777778, 1.0, 200000, 500000, 299.1528128, axis_xy=False, transformable=False),
        CRSDef("EPSG:5179", "KGD2002 / Unified CS", 38.0, 127.5, 0.9996, 1000000, 2000000, axis_xy=False),
        CRSDef("EPSG:5185", "KGD2002 / West Belt 2010", 38.0, 125.0, 1.0, 200000, 600000, axis_xy=False),
        CRSDef("EPSG:5186", "KGD2002 / Central Belt 2010", 38.0, 127.0, 1.0, 200000, 600000, axis_xy=False),
        CRSDef("EPSG:5187", "KGD2002 / East Belt 2010", 38.0, 129.0, 1.0, 200000, 600000, axis_xy=False),
        CRSDef("EPSG:5188", "KGD2002 / East Sea Belt 2010", 38.0, 131.0, 1.0, 200000, 600000, axis_xy=False),
        CRSDef("EPSG:32652", "WGS 84 / UTM zone 52N", 0.0, 129.0, 0.9996, 500000, 0, 298.257223563),
    )
}
KOREAN_NOTES = ("EPSG:5179", "EPSG:5186", "EPSG:5187", "EPSG:5174", "EPSG:32652", "EPSG:4326")
SEMI_MAJOR = 6378137.0


def parse_crs(value: str | CRSDef | None) -> CRSDef | None:
    """None stays None; a code may stand alone or after "name:"; what is unknown raises."""
    if value is None or isinstance(value, CRSDef):
        return value
    text = str(value).strip().removeprefix("name:")
    key = text.upper() if text.upper().startswith("EPSG:") else next((c.code for c in REGISTRY.values() if c.name == text), f"EPSG:{text}")
    if key not in REGISTRY:
        raise UnknownCRSError(f"unknown coordinate system {value!r}")
    return REGISTRY[key]


def crs_text(crs: CRSDef | None) -> str:
    return "UNKNOWN" if crs is None else crs.code


def crs_equal(a, b) -> bool:
    """An unknown system equals nothing, not even another unknown one."""
    a, b = parse_crs(a), parse_crs(b)
    return a is not None and b is not None and a.code == b.code


def require_same_crs(crss, context: str) -> CRSDef:
    found = [parse_crs(c) for c in crss]
    if not found or any(c is None for c in found):
        raise UnknownCRSError(f"{context}: a coordinate system is not declared")
    for c in found[1:]:
        if not crs_equal(found[0], c):
            raise CRSMismatchError(f"{context}: {found[0].code} and {c.code} differ; nothing reprojects implicitly")
    return found[0]


def require_projected_metre(crs, context: str) -> CRSDef:
    crs = require_same_crs([crs], context)
    if crs.geographic:
        raise GeographicCRSError(f"{context}: {crs.code} is geographic")
    if crs.unit != "m":
        raise NonMetreCRSError(f"{context}: {crs.code} is in {crs.unit}")
    return crs


def check_notes() -> list[str]:
    """Codes of the notes that the registry lacks."""
    return [c for c in KOREAN_NOTES if c not in REGISTRY]


def _series(crs: CRSDef):
    f = 1 / crs.inverse_flattening
    n = f / (2 - f)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return radius, alpha, beta, delta, 2 * math.sqrt(n) / (1 + n)


def _arc(crs: CRSDef) -> float:
    radius, alpha, _, _, e = _series(crs)
    s = math.sin(math.radians(crs.lat0))
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    return crs.scale * radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha)))


def _atanh(x):
    return F.lit(0.5) * (F.log1p(x) - F.log1p(-x))


def _let(then, **named: Column) -> Column:
    """then(values), with each value computed once; written out, nested series would grow without bound."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in named.items()])), then)[0]


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def projected(crs: CRSDef, lon: Column, lat: Column) -> Column:
    """Degrees to a struct of easting x and northing y."""
    radius, alpha, _, _, e = _series(crs)

    def last(v):
        xi, eta = v["xi"], v["eta"]
        for j, a in enumerate(alpha, 1):
            xi = xi + a * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta + a * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return _point(crs.false_easting + crs.scale * radius * eta, crs.false_northing + crs.scale * radius * xi - _arc(crs))

    def conformal(v):
        return _let(last, xi=F.atan2(v["t"], F.cos(v["dl"])), eta=_atanh(F.sin(v["dl"]) / F.sqrt(1 + v["t"] * v["t"])))

    def isometric(v):
        return _let(conformal, t=F.sinh(_atanh(v["s"]) - F.lit(e) * _atanh(F.lit(e) * v["s"])), dl=v["dl"])

    return _let(isometric, s=F.sin(F.radians(lat)), dl=F.radians(lon - F.lit(crs.lon0)))


def unprojected(crs: CRSDef, x: Column, y: Column) -> Column:
    """Easting and northing to a struct of degrees, x longitude and y latitude."""
    radius, _, beta, delta, _ = _series(crs)

    def geographic(v):
        lat = v["chi"]
        for j, d in enumerate(delta, 1):
            lat = lat + d * F.sin(2 * j * v["chi"])
        return _point(F.lit(crs.lon0) + v["dlon"], F.degrees(lat))

    def conformal(v):
        return _let(geographic, chi=F.asin(F.sin(v["xi"]) / F.cosh(v["eta"])), dlon=F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"]))))

    def series(v):
        xi, eta = v["xi"], v["eta"]
        for j, b in enumerate(beta, 1):
            xi = xi - b * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta - b * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return _let(conformal, xi=xi, eta=eta)

    return _let(series, xi=(y - crs.false_northing + _arc(crs)) / (crs.scale * radius), eta=(x - crs.false_easting) / (crs.scale * radius))


def project(crs: CRSDef, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to easting and northing."""
    p = projected(crs, lon, lat)
    return p["x"], p["y"]


def unproject(crs: CRSDef, x: Column, y: Column) -> tuple[Column, Column]:
    """Easting and northing to degrees."""
    p = unprojected(crs, x, y)
    return p["x"], p["y"]


def to_degrees(crs, x: float, y: float) -> tuple[float, float]:
    """Longitude and latitude of one place, on the driver; the same series as unprojected."""
    crs = require_same_crs([crs], "degrees")
    if crs.geographic:
        return x, y
    if not crs.transformable:
        raise CRSError(f"no verified transformation from {crs.code}")
    radius, _, beta, delta, _ = _series(crs)
    xi0, eta0 = (y - crs.false_northing + _arc(crs)) / (crs.scale * radius), (x - crs.false_easting) / (crs.scale * radius)
    xi = xi0 - sum(b * math.sin(2 * j * xi0) * math.cosh(2 * j * eta0) for j, b in enumerate(beta, 1))
    eta = eta0 - sum(b * math.cos(2 * j * xi0) * math.sinh(2 * j * eta0) for j, b in enumerate(beta, 1))
    chi = math.asin(math.sin(xi) / math.cosh(eta))
    lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return crs.lon0 + math.degrees(math.atan2(math.sinh(eta), math.cos(xi))), math.degrees(lat)


def transformed(src, dst, x: Column, y: Column) -> Column:
    """A struct of coordinates of src in dst; the same system changes nothing."""
    src, dst = parse_crs(src), parse_crs(dst)
    if src is None or dst is None:
        raise UnknownCRSError("a coordinate system is not declared")
    if src.code == dst.code:
        return _point(x, y)
    if not (src.transformable and dst.transformable):
        raise CRSError(f"no verified transformation between {src.code} and {dst.code}")
    if src.geographic:
        return _point(x, y) if dst.geographic else projected(dst, x, y)
    lonlat = unprojected(src, x, y)
    return lonlat if dst.geographic else _let(lambda v: projected(dst, v["x"], v["y"]), x=lonlat["x"], y=lonlat["y"])


def transform(src, dst, x: Column, y: Column) -> tuple[Column, Column]:
    """Coordinates of src in dst as two columns."""
    p = transformed(src, dst, x, y)
    return p["x"], p["y"]


def meridian_convergence(crs, lon: Column, lat: Column) -> Column:
    """Grid north against true north in degrees, on the sphere of the closed form."""
    crs = parse_crs(crs)
    if crs is None or crs.geographic:
        raise GeographicCRSError("convergence needs a projected system")
    return F.degrees(F.atan(F.tan(F.radians(lon - F.lit(crs.lon0))) * F.sin(F.radians(lat))))
