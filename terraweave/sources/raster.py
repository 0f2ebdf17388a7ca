"""Rasters as Parquet with a sidecar, and as NumPy archives and plain GeoTIFF for other programs."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError, RasterError
from ..model import Grid, Provenance, RasterLayer
from ..operators.raster import normalised
from ..operators.records import ClassScheme

NPZ_TAG = "npz_raster_v1"
#: Cells that write_npz and write_geotiff take: one file is built on the driver (8 bytes a cell).
FILE_CELLS = 1 << 24


def _text(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def content_hash(df: DataFrame) -> str:
    """A checksum of a table's rows, whatever their order or files."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    one = F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")), F.count("*")
    return ":".join(str(x) for x in df.agg(*one).first())


def row_checksums(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, checksum): SHA-256 of each row's columns as texts, joined by a bar."""
    return df.select(key, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256).alias("checksum"))


def write_raster(layer: RasterLayer, path: str) -> None:
    """Cells sorted by row and col inside files, so that windows skip row groups; a JSON sidecar."""
    layer.df.repartitionByRange("row").sortWithinPartitions("row", "col").write.parquet(f"{path}/cells")
    meta = {"grid": layer.grid.__dict__, "crs": layer.crs.code if layer.crs else None, "kind": layer.kind, "nodata": layer.nodata, "provenance": layer.provenance.to_dict(), "checksum": content_hash(layer.df)}
    spark = layer.df.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_raster(spark: SparkSession, path: str, verify: bool = False) -> RasterLayer:
    meta = _text(spark, f"{path}/meta")
    df = spark.read.parquet(f"{path}/cells")
    if verify and content_hash(df) != meta["checksum"]:
        raise IngestError("the cells don't match their checksum")
    return RasterLayer(df, Grid(**meta["grid"]), meta["crs"], meta["kind"], meta["nodata"], Provenance.from_dict(meta["provenance"]))


def _cells(content: bytes, decode) -> pa.Table:
    values = decode(content)
    if values.ndim != 2 or not values.size:
        raise IngestError("a raster is two-dimensional and not empty")
    rows, cols = np.indices(values.shape)
    return pa.table({"row": rows.ravel().astype(np.int32), "col": cols.ravel().astype(np.int32), "value": values.ravel().astype(np.float64)})


def _read_files(spark: SparkSession, path: str, decode) -> DataFrame:
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _cells(content.as_py(), decode).to_batches(max_chunksize=65536)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row int, col int, value double")


def read_npz(spark: SparkSession, path: str, sidecar: str, provenance: Provenance) -> RasterLayer:
    """An archive's `values` array with its JSON sidecar (format, grid, crs, nodata, kind, checksum).

    Where the sidecar records a checksum, an archive that differs raises when its cells are read.
    """
    meta = _text(spark, sidecar)
    if meta.get("format") != NPZ_TAG:
        raise IngestError("the sidecar names another format")
    recorded = meta.get("checksum")

    def values(content: bytes) -> np.ndarray:
        if recorded is not None and hashlib.sha256(content).hexdigest() != recorded:
            raise IngestError("the archive does not match its sidecar's checksum")
        return np.load(io.BytesIO(content))["values"]

    df = _read_files(spark, path, values)
    return RasterLayer(df.withColumn("value", normalised(F.col("value"), meta.get("nodata"))), Grid(**meta["grid"]), meta["crs"], meta.get("kind", "continuous"), meta.get("nodata"), provenance)


def _tiff_tags(content: bytes, whole: int) -> dict:
    """The tags of a classic TIFF of so many bytes, from its head and, if that holds it, its directory."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise IngestError("not a classic TIFF")
    at, = struct.unpack(order + "I", content[4:8])
    if not 8 <= at < whole:
        raise IngestError("the TIFF's directory lies outside the file")
    count, = struct.unpack(order + "H", content[at : at + 2])
    size = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 11: "f", 8: "h", 9: "i"}
    tags = {"order": order}
    for i in range(count):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in size:
            continue
        width = n * struct.calcsize(size[kind])
        start = at + 10 + 12 * i
        if width > 4:
            start, = struct.unpack(order + "I", content[start : start + 4])
        raw = content[start : start + width]
        tags[tag] = raw.split(b"\0")[0].decode() if kind == 2 else struct.unpack(f"{order}{n}{size[kind]}", raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(277, 1) != 1 and one(284, 1) == 1:
        raise IngestError("bands that alternate by cell are not supported; use planes")
    if one(317, 1) not in (1, 2) or one(259, 1) not in (1, 8, 32946):
        raise IngestError("this compression or predictor of TIFF is not supported")
    return tags


def decode_tiff(content: bytes, band: int = 1) -> tuple[np.ndarray, dict]:
    """One band (from 1) of a classic TIFF in strips or tiles, plain or deflated, and its tags."""
    tags = _tiff_tags(content, len(content))
    one = lambda tag, default: tags.get(tag, (default,))[0]
    rows, cols, bands = tags[257][0], tags[256][0], one(277, 1)
    if not 1 <= band <= bands:
        raise IngestError(f"band {band} of {bands}")
    letter = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    kind = np.dtype(f"{tags['order']}{letter}{tags[258][0] // 8}")
    tiled = 322 in tags
    high, wide = (tags[323][0], tags[322][0]) if tiled else (min(one(278, rows), rows), cols)
    down, across = -(-rows // high), -(-cols // wide)
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    values = np.empty((down * high, across * wide), kind)
    for k in range(down * across):
        i = (band - 1) * down * across + k
        raw = content[starts[i] : starts[i] + sizes[i]]
        raw = zlib.decompress(raw) if one(259, 1) != 1 else raw
        block = np.frombuffer(raw, kind)
        block = block.reshape(-1, wide)
        if one(317, 1) == 2:
            if letter == "f":
                raise IngestError("a horizontal predictor needs whole numbers")
            block = np.cumsum(block, axis=1, dtype=kind)
        r, c = divmod(k, across)
        values[r * high : r * high + len(block), c * wide : (c + 1) * wide] = block
    return values[:rows, :cols], tags


def read_geotiff(spark: SparkSession, path: str, provenance: Provenance, crs, kind: str = "continuous", nodata: float | None = None, band: int = 1) -> RasterLayer:
    """A band of one north-up GeoTIFF; the declared nodata value must not differ from the caller's.

    Only the tags reach the driver; a task that reads the file gives them, and another its cells.
    More than one file under the path is refused, as each has a grid of its own.
    """
    files = spark.read.format("binaryFile").load(path)
    if files.select("path").limit(2).count() != 1:
        raise IngestError("a GeoTIFF is one file")

    def head(batches):
        for batch in batches:
            for content in batch.column("content"):
                tags = _tiff_tags(content.as_py(), len(content.as_py()))
                keep = {str(t): list(tags[t]) if isinstance(tags[t], tuple) else tags[t] for t in (256, 257, 33550, 33922, 34264, 42113) if t in tags}
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(keep)])], ["tags"])

    tags = {int(k): v for k, v in json.loads(files.select("content").mapInArrow(head, "tags string").first()["tags"]).items()}
    if 34264 in tags or 33550 not in tags or 33922 not in tags:
        raise IngestError("a north-up grid is needed")
    declared = float(tags[42113]) if 42113 in tags else None
    if nodata is not None and declared is not None and declared != nodata:
        raise IngestError("the file's nodata value is not the caller's")
    nodata = declared if nodata is None else nodata
    (dx, dy), tie = tags[33550][:2], tags[33922]
    grid = Grid(tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy, tags[257][0], tags[256][0])
    df = _read_files(spark, path, lambda b: decode_tiff(b, band)[0])
    return RasterLayer(df.withColumn("value", normalised(F.col("value"), nodata)), grid, crs, kind, nodata, provenance)


def _array(layer: RasterLayer, limit: int) -> np.ndarray:
    """All cells as float64, NaN where missing; a grid over the limit is refused, never cut."""
    rows, cols = layer.grid.rows, layer.grid.cols
    if rows * cols > limit:
        raise RasterError(f"{rows * cols} cells are too many for one file of {limit}; write_raster has no limit")
    table = layer.df.where("value is not null").select("row", "col", F.col("value").cast("double").alias("value")).toArrow()
    values = np.full((rows, cols), np.nan)
    values[table["row"].to_numpy(), table["col"].to_numpy()] = table["value"].to_numpy()
    return values


def _filled(layer: RasterLayer, values: np.ndarray) -> np.ndarray:
    """Missing cells as the declared nodata value; without one they stay NaN."""
    return values if layer.nodata is None else np.where(np.isnan(values), layer.nodata, values)


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A new file in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        for at in range(0, len(content), 1 << 24):
            out.write(bytearray(content[at : at + (1 << 24)]))
    finally:
        out.close()


def write_npz(layer: RasterLayer, path: str, sidecar: str, limit: int = FILE_CELLS) -> None:
    """An archive with a `values` array and its JSON sidecar, as read_npz takes them."""
    buffer, spark = io.BytesIO(), layer.df.sparkSession
    np.savez_compressed(buffer, values=_filled(layer, _array(layer, limit)))
    meta = {"format": NPZ_TAG, "grid": layer.grid.__dict__, "crs": layer.crs.code if layer.crs else None, "kind": layer.kind, "nodata": layer.nodata, "checksum": hashlib.sha256(buffer.getvalue()).hexdigest()}
    _write_bytes(spark, path, buffer.getvalue())
    _write_bytes(spark, sidecar, json.dumps(meta, sort_keys=True).encode())


def encode_tiff(values: np.ndarray, grid: Grid, nodata: float | None, strip_rows: int = 64) -> bytes:
    """A classic little-endian TIFF of float64 in deflated strips, north-up, with GDAL's nodata tag."""
    strips = [zlib.compress(values[r : r + strip_rows].astype("<f8").tobytes()) for r in range(0, grid.rows, strip_rows)]
    sizes, starts, at = [len(s) for s in strips], [], 8
    for n in sizes:
        starts.append(at)
        at += n
    entries = [
        (256, "I", [grid.cols]), (257, "I", [grid.rows]), (258, "H", [64]), (259, "H", [8]), (262, "H", [1]), (273, "I", starts), (277, "H", [1]),
        (278, "I", [strip_rows]), (279, "I", sizes), (339, "H", [3]), (33550, "d", [grid.x_size, grid.y_size, 0.0]), (33922, "d", [0.0, 0.0, 0.0, grid.x_origin, grid.y_origin, 0.0]),
    ]
    if nodata is not None:
        entries.append((42113, "s", repr(float(nodata)).encode() + b"\0"))
    body, tail = b"".join(strips), b""
    at += at % 2
    after, rows = at + 2 + 12 * len(entries) + 4, []
    for tag, letter, given in entries:
        data = given if letter == "s" else struct.pack(f"<{len(given)}{letter}", *given)
        rows.append(struct.pack("<HHI", tag, {"s": 2, "H": 3, "I": 4, "d": 12}[letter], len(given)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + len(tail))))
        tail += b"" if len(data) <= 4 else data + b"\0" * (len(data) % 2)
    head = struct.pack("<2sHI", b"II", 42, at) + body
    return head.ljust(at, b"\0") + struct.pack("<H", len(entries)) + b"".join(rows) + struct.pack("<I", 0) + tail


def write_geotiff(layer: RasterLayer, path: str, limit: int = FILE_CELLS) -> None:
    """One north-up band of float64; a nodata tag only where the layer declares a value.

    The coordinate system is not written into the file; read_geotiff takes it from the caller.
    """
    _write_bytes(layer.df.sparkSession, path, encode_tiff(_filled(layer, _array(layer, limit)), layer.grid, layer.nodata))


def write_any(layer: RasterLayer, path: str) -> None:
    """By the path's suffix, as read_any and read_raster take it: .npz, .tif or .tiff, or a folder without one."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = last.rsplit(".", 1)[-1].lower() if "." in last else ""
    if suffix == "npz":
        write_npz(layer, path, path[:-4] + ".json")
    elif suffix in ("tif", "tiff"):
        write_geotiff(layer, path)
    elif not suffix:
        write_raster(layer, path)
    else:
        raise RasterError(f"no raster format has the suffix {suffix!r}")


def class_layer(df: DataFrame, grid: Grid, crs, scheme: ClassScheme, provenance: Provenance) -> RasterLayer:
    """Cells of whole class codes as a layer; the nodata code becomes NULL, other codes than the scheme's raise."""
    if dict(df.dtypes)["value"] not in ("tinyint", "smallint", "int", "bigint"):
        raise RasterError("class codes are whole numbers; a fraction comes of averaging them")
    unknown = [r["code"] for r in scheme.unknown_codes(df).limit(20).collect()]
    if unknown:
        raise IngestError(f"codes {unknown} are not in the scheme {scheme.name}")
    return RasterLayer(df.withColumn("value", normalised(F.col("value"), scheme.nodata)), grid, crs, "categorical", scheme.nodata, provenance)


def read_any(spark: SparkSession, path: str, provenance: Provenance, **options) -> RasterLayer:
    """By the path's suffix: .npz (sidecar beside it, .json), .tif or .tiff; others raise."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "npz":
        return read_npz(spark, path, options.get("sidecar", path[:-4] + ".json"), provenance)
    if suffix in ("tif", "tiff"):
        return read_geotiff(spark, path, provenance, **options)
    raise IngestError(f"no raster format has the suffix {suffix!r}")


def read_class_geotiff(spark: SparkSession, path: str, provenance: Provenance, crs, scheme: ClassScheme) -> RasterLayer:
    """A raster of class codes; its nodata value must be the scheme's, its codes the scheme's classes."""
    layer = read_geotiff(spark, path, provenance, crs, "categorical", float(scheme.nodata))
    unknown = [r["code"] for r in scheme.unknown_codes(layer.df).limit(20).collect()]
    if unknown:
        raise IngestError(f"codes {unknown} are not in the scheme {scheme.name}")
    return layer
