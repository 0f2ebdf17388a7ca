"""Public tiles and map extracts: their addresses, and fetching them only where that was allowed."""

from __future__ import annotations

import math
import urllib.error
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError, NetworkAccessError
from ..functions import text as T
from ..model import Bounds, Provenance, RasterLayer, VectorLayer
from . import files
from .raster import read_geotiff
from .vector import read_osm_roads

# Fixed value: the public map interface.
OSM_BASE = "https://api.openstreetmap.org/api/0.6/map"


def require_network(allowed: bool, what: str) -> None:
    if not allowed:
        raise NetworkAccessError(f"fetching {what} needs the network, which must be allowed; synthetic fixtures need none")


def tiles(spark: SparkSession, bounds: Bounds, kind: str) -> list[tuple[str, str]]:
    """Names and addresses of the tiles (kind dem or cover) that a box touches, from south-west on."""
    step = {"dem": 1, "cover": 3}[kind]
    west, south, east, north = bounds.to_wgs84()
    corners = [(float(lat), float(lon)) for lat in range(math.floor(south / step) * step, math.ceil(north), step) for lon in range(math.floor(west / step) * step, math.ceil(east), step)]
    name, url = (T.dem_tile_name, T.dem_tile_url) if kind == "dem" else (T.cover_tile_name, T.cover_tile_url)
    lat, lon = F.col("lat"), F.col("lon")
    rows = spark.createDataFrame(corners, "lat double, lon double").select("lat", "lon", name(lat, lon).alias("name"), url(lat, lon).alias("url")).orderBy("lat", "lon")
    return [(r["name"], r["url"]) for r in rows.collect()]


def _download(spark: SparkSession, url: str, path: str, timeout: float) -> None:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            files.write_bytes(spark, path, iter(lambda: answer.read(1 << 20), b""))
    except (urllib.error.URLError, OSError) as e:
        raise IngestError(f"{url}: {e}") from e


def fetch_tile(spark: SparkSession, bounds: Bounds, kind: str, folder: str, record: Provenance, *, allow_network: bool = False, timeout: float = 60.0, **options) -> RasterLayer:
    """The one tile that covers a box, from a folder that may hold it already, else fetched into it.

    A box over several tiles raises, as they are not joined here; so does an absent tile without
    leave to use the network.
    """
    found = tiles(spark, bounds, kind)
    if len(found) != 1:
        raise IngestError(f"the box lies on {len(found)} tiles: {[n for n, _ in found]}")
    (name, url), = found
    path = f"{folder}/{name}.tif"
    if not files.exists(spark, path):
        require_network(allow_network, name)
        _download(spark, url, path, timeout)
    told = record if record.sources else record.with_updates(sources=({"name": name, "url_or_identifier": url},))
    return read_geotiff(spark, path, told, "EPSG:4326", **options)


def fetch_roads(spark: SparkSession, bounds: Bounds, path: str, record: Provenance, *, allow_network: bool = False, timeout: float = 60.0) -> tuple[VectorLayer, object]:
    """Roads of a box from a map extract at path, which is fetched if it is not there; an error never gives an empty map."""
    if not files.exists(spark, path):
        require_network(allow_network, "a map extract")
        box = spark.range(1).select(T.bbox_text(*[F.lit(float(v)) for v in bounds.to_wgs84()])).first()[0]
        _download(spark, f"{OSM_BASE}?bbox={box}", path, timeout)
    return read_osm_roads(spark, path, record)
