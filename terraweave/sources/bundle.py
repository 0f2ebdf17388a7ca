"""Study-area bundles on disk: layers as Parquet, JSON sidecars, a manifest of checksums, a contract."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BundleError
from ..functions.crs import crs_text, parse_crs
from ..model import UNKNOWN, Bounds, Grid, Provenance, RasterLayer, VectorLayer
from ..operators import contract, records, validation
from ..operators.roads import RoadGraph
from ..operators.study import StudyArea, findings
from . import files
from .raster import content_hash

VERSION = "1.2.0"
ALGORITHM = "row_sums_v1"
MANIFEST, CONTRACT = "manifest.json", "bundle_manifest.json"


def _layer_meta(given) -> tuple[DataFrame, Provenance, dict]:
    if isinstance(given, tuple):
        return given[0], given[1], {"kind": "table"}
    crs = given.crs.code if given.crs else None
    if isinstance(given, RasterLayer):
        return given.df, given.provenance, {"kind": "raster", "crs": crs, "grid": given.grid.__dict__, "raster_kind": given.kind, "nodata": given.nodata}
    return given.df, given.provenance, {"kind": "vector", "crs": crs}


def write_bundle(
    spark: SparkSession, path: str, bundle_id: str, layers: dict, overwrite: bool = False, *, tables: dict[str, DataFrame] | None = None, extras: dict[str, dict] | None = None, meta: dict | None = None,
) -> dict:
    """Layers (or pairs of a table and its record), further tables and JSON extras; the manifest comes last.

    Every layer's record gets the checksum of what was written. The manifest holds checksums of
    layers, tables, records and extras, the sources' licences, and what they oblige to. An
    existing bundle is refused unless overwrite.
    """
    if files.exists(spark, path):
        if not overwrite:
            raise BundleError(f"{path} exists")
        files.remove(spark, path)
    entries, sidecars, kept = [], {}, {}
    for name, given in layers.items():
        df, record, own = _layer_meta(given)
        df.write.parquet(f"{path}/layers/{name}")
        record = replace(record, layer_name=name, checksum=content_hash(spark.read.parquet(f"{path}/layers/{name}")), checksum_algorithm=ALGORITHM)
        sidecars[name] = files.write_json(spark, f"{path}/provenance/{name}.provenance.json", record.to_dict())
        entries.append({"name": name, "checksum": record.checksum, "data_class": record.data_class} | own)
        kept[name] = record
    sums = {}
    for name, df in (tables or {}).items():
        df.write.parquet(f"{path}/tables/{name}")
        sums[name] = content_hash(spark.read.parquet(f"{path}/tables/{name}"))
    extra_sums = {key: files.write_json(spark, f"{path}/extras/{key}.json", payload) for key, payload in (extras or {}).items()}
    licences = contract.licences(kept)
    manifest = {
        "version": VERSION, "bundle_id": bundle_id, "layers": entries, "tables": sums, "extras": {key: f"extras/{key}.json" for key in extra_sums}, "extras_checksums_sha256": extra_sums,
        "provenance_checksums_sha256": sidecars, "licences": licences, "obligations": contract.obligations(licences),
    } | (meta or {})
    files.write_json(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest; its absence, other JSON or another version raises."""
    if not files.exists(spark, f"{path}/{MANIFEST}"):
        raise BundleError(f"no {MANIFEST} in {path}")
    try:
        manifest = json.loads(files.read_text(spark, f"{path}/{MANIFEST}"))
        version = manifest.get("version")
    except (ValueError, AttributeError) as e:
        raise BundleError(f"{MANIFEST} can't be read: {e}") from e
    if version != VERSION:
        raise BundleError(f"bundle version {version!r} is not {VERSION}")
    return manifest


def read_records(spark: SparkSession, path: str) -> dict[str, Provenance]:
    """Every sidecar's record; one that names another layer than its file raises."""
    out, end = {}, ".provenance.json"
    for file in files.names_in(spark, f"{path}/provenance"):
        if file.endswith(end) and not file.startswith("."):
            record = Provenance.from_dict(json.loads(files.read_text(spark, f"{path}/provenance/{file}")))
            if record.layer_name != file.removesuffix(end):
                raise BundleError(f"the record in {file} names {record.layer_name!r}")
            out[record.layer_name] = record
    return out


def read_bundle(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict, dict[str, tuple[DataFrame, Provenance | None]]]:
    """The manifest, and each layer's table and record (None without a sidecar); a changed layer raises."""
    manifest, kept, out = read_manifest(spark, path), read_records(spark, path), {}
    for entry in manifest["layers"]:
        name = entry["name"]
        df = spark.read.parquet(f"{path}/layers/{name}")
        if verify and content_hash(df) != entry["checksum"]:
            raise BundleError(f"layer {name!r} does not match its checksum")
        out[name] = (df, kept.get(name))
    return manifest, out


def save_area(spark: SparkSession, path: str, area: StudyArea, overwrite: bool = False, validation_block: dict | None = None) -> dict:
    """A whole study area: its layers, tables, road report and class scheme, and the contract manifest."""
    extras = {}
    if area.qa is not None:
        extras["road_qa"] = area.qa
    if area.scheme is not None:
        extras["class_scheme"] = area.scheme.__dict__ | {"labels": {str(k): v for k, v in area.scheme.labels.items()}}
    b = area.bounds
    meta = {"crs": crs_text(area.crs), "bounds": [b.x_min, b.y_min, b.x_max, b.y_max], "data_class": area.data_class, "absent": area.absent}
    manifest = write_bundle(spark, path, area.id, area.layers(), overwrite, tables=area.tables(), extras=extras, meta=meta)
    files.write_json(spark, f"{path}/{CONTRACT}", contract.build(spark, load_area(spark, path), validation_block))
    return manifest


def load_area(spark: SparkSession, path: str, verify: bool = True) -> StudyArea:
    """The study area as it was saved; a layer without sidecar has a record that knows nothing."""
    manifest, layers = read_bundle(spark, path, verify)
    if "bounds" not in manifest:
        raise BundleError(f"{path} holds layers, but no study area")
    crs = parse_crs(manifest["crs"])
    done: dict = {"id": manifest["bundle_id"], "crs": crs, "bounds": Bounds(*manifest["bounds"], crs), "absent": manifest.get("absent", {})}
    for entry in manifest["layers"]:
        df, record = layers[entry["name"]]
        record = record or Provenance(entry["name"], "observed")
        if entry["kind"] == "raster":
            done[entry["name"]] = RasterLayer(df, Grid(**entry["grid"]), entry["crs"], entry["raster_kind"], entry["nodata"], record)
        else:
            done[entry["name"]] = VectorLayer(df, entry["crs"], record)
    tables = {}
    for name, recorded in manifest["tables"].items():
        tables[name] = spark.read.parquet(f"{path}/tables/{name}")
        if verify and content_hash(tables[name]) != recorded:
            raise BundleError(f"table {name!r} does not match its checksum")
    if "road_nodes" in tables:
        done["graph"] = RoadGraph(tables["road_nodes"], tables["road_edges"], done["roads"].crs)
    done |= {k: tables[k] for k in ("villages", "facility_records") if k in tables}
    extra = lambda key: json.loads(files.read_text(spark, f"{path}/{manifest['extras'][key]}")) if key in manifest["extras"] and files.exists(spark, f"{path}/{manifest['extras'][key]}") else None
    done["qa"] = extra("road_qa")
    if (scheme := extra("class_scheme")) is not None:
        done["scheme"] = records.ClassScheme(**scheme | {"labels": {int(k): v for k, v in scheme["labels"].items()}})
    return StudyArea(**done)


def file_facts(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """One row for each layer, sidecar and extra file: what the manifest records and what is on disk."""
    rows, listed = [], {e["name"]: e["checksum"] for e in manifest["layers"]}
    on_disk = {f.removesuffix(".provenance.json") for f in files.names_in(spark, f"{path}/provenance") if f.endswith(".provenance.json") and not f.startswith(".")}
    kept = {}
    for name in sorted(on_disk):
        kept[name] = json.loads(files.read_text(spark, f"{path}/provenance/{name}.provenance.json"))
    for name, checksum in listed.items():
        recorded = kept.get(name, {}).get("checksum")
        rows.append((name, "layer", True, True, name in on_disk, None if recorded == UNKNOWN else recorded, checksum if name in kept else None))
    sums = manifest.get("provenance_checksums_sha256", {})
    for name in sorted(on_disk | set(sums)):
        actual = files.checksum(spark, f"{path}/provenance/{name}.provenance.json") if name in on_disk else None
        rows.append((name, "sidecar", name in on_disk, name in listed, None, sums.get(name), actual))
    sums = manifest.get("extras_checksums_sha256", {})
    for key, relative in manifest.get("extras", {}).items():
        there = files.exists(spark, f"{path}/{relative}")
        # A file that is absent has no other fault.
        rows.append((key, "extra", there, True, None, sums.get(key) if there else "absent", files.checksum(spark, f"{path}/{relative}") if there else None))
    return spark.createDataFrame(rows, "file string, role string, on_disk boolean, in_manifest boolean, has_sidecar boolean, recorded string, actual string")


def directory_facts(spark: SparkSession, path: str, area: StudyArea | None) -> DataFrame:
    """One row: whether manifest and contract are there, can be read, and agree with the bundle."""
    has = files.exists(spark, f"{path}/{MANIFEST}")
    there = files.exists(spark, f"{path}/{CONTRACT}")
    readable = differs = None
    if there:
        try:
            told = json.loads(files.read_text(spark, f"{path}/{CONTRACT}"))
            readable = told.get("contract_version") == contract.CONTRACT_VERSION
        except (ValueError, AttributeError):
            readable = False
        if readable and area is not None:
            again = json.loads(json.dumps(contract.build(spark, area, told.get("validation"), told.get("created_at"))))
            differs = any(again.get(k) != told.get(k) for k in set(again) | set(told))
    return spark.createDataFrame([(path, has, area is not None, there, readable, differs)], "directory string, has_manifest boolean, manifest_readable boolean, has_contract boolean, contract_readable boolean, contract_differs boolean")


def write_report(spark: SparkSession, path: str, found: DataFrame, overwrite: bool = True) -> dict:
    """Counts, verdict and findings beside a bundle, written after it was validated."""
    verdict = validation.status(found).first().asDict()
    payload = verdict | {"target": path, "findings": [r.asDict() for r in validation.report(found).toLocalIterator()]}
    files.write_json(spark, f"{path}/validation/report.json", payload, overwrite)
    return payload


def validate_directory(spark: SparkSession, path: str) -> DataFrame:
    """All findings over a bundle on disk: what it holds, its files, its contract.

    Without a manifest, or with a bundle that can't be read, that is the only finding.
    """
    area = None
    if files.exists(spark, f"{path}/{MANIFEST}"):
        try:
            area = load_area(spark, path)
        except BundleError:
            area = None
    place = validation.findings(directory_facts(spark, path, area), "directory", "directory")
    if area is None:
        return place.where(F.col("code").isin("BND-010", "BND-011"))
    found = validation.findings(file_facts(spark, path, read_manifest(spark, path)), "files", "file")
    return findings(spark, area).unionByName(found).unionByName(place)

