"""Commands over bundles and fixtures; errors map to exit codes."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, fixtures
from .errors import ConfigError, IngestError, OptionalDependencyError, StudyError
from .model import UNKNOWN, Bounds, Provenance, RasterLayer, VectorLayer
from .operators import contract, records, study, validation
from .plans.staging import staged
from .session import get_session
from .sources.bundle import load_area, read_records, save_area, validate_directory, write_bundle, write_report
from .sources.raster import read_any, read_class_geotiff, read_raster, write_raster
from .sources.vector import read_geojson, read_roads, write_geojson


def _provenance(args) -> Provenance:
    return Provenance(args.name, args.data_class, sources=({"name": args.source, "licence": args.licence},))


def read_config(path: str) -> dict:
    """A JSON or YAML mapping; YAML needs PyYAML."""
    with open(path) as f:
        if not path.endswith((".yaml", ".yml")):
            config = json.load(f)
        else:
            try:
                import yaml
            except ImportError as e:
                raise OptionalDependencyError("YAML configurations need PyYAML; JSON needs nothing") from e
            config = yaml.safe_load(f)
    if not isinstance(config, dict):
        raise ConfigError("a configuration is a mapping")
    return config


#: Keys of a configuration; each of SOURCES is a path, or a mapping with path and what is told of it.
SOURCES = ("dem", "fuels", "roads", "facilities", "population")
KEYS = {"id", "crs", "bounds", "snap_tolerance", "settlement_snap", "exit_property", "buffer_cells", "scheme", "absent", *SOURCES}
SOURCE_KEYS = {"path", "data_class", "source", "licence", "licence_url", "publisher", "value_unit", "surface_model", "temporal_class", "temporal_reference", "valid_from", "valid_to", "crs", "options"}


@dataclass(frozen=True)
class SourceSpec:
    """Where a layer comes from and what its record says; options are arguments of its record builder."""

    path: str
    record: Provenance
    crs: str | None = None
    options: dict | None = None

    @staticmethod
    def of(name: str, given, data_class: str) -> SourceSpec:
        given = {"path": given} if isinstance(given, str) else dict(given)
        if "path" not in given or set(given) - SOURCE_KEYS:
            raise ConfigError(f"{name}: a path is needed, and no other keys than {sorted(SOURCE_KEYS)}")
        source = {k: given[k] for k in ("licence", "licence_url", "publisher") if k in given} | ({"name": given["source"]} if "source" in given else {})
        told = {k: given[k] for k in ("value_unit", "surface_model", "temporal_class", "temporal_reference", "valid_from", "valid_to") if k in given}
        record = Provenance(name, given.get("data_class", data_class), sources=(source,) if source else (), **told)
        return SourceSpec(given["path"], record, given.get("crs"), given.get("options"))

    def raster(self, spark: SparkSession) -> RasterLayer:
        """A raster of this package by its folder, or a file by its suffix; a folder's own record stays unless the specification tells more."""
        if self.path.rsplit(".", 1)[-1].lower() in ("npz", "tif", "tiff"):
            return read_any(spark, self.path, self.record, **({} if self.crs is None else {"crs": self.crs}), **(self.options or {}))
        layer = read_raster(spark, self.path)
        return layer if not self.record.sources else replace(layer, provenance=self.record)

    def vector(self, spark: SparkSession) -> VectorLayer:
        return (read_roads if self.record.layer_name == "roads" else read_geojson)(spark, self.path, self.record, self.crs)


@dataclass(frozen=True)
class StudyAreaConfig:
    """A checked configuration: what is missing, unknown or of another form raises before anything is read."""

    id: str
    crs: str
    bounds: Bounds
    sources: dict[str, SourceSpec]
    scheme: records.ClassScheme | None = None
    rest: dict | None = None

    @staticmethod
    def of(config: dict) -> StudyAreaConfig:
        unknown = set(config) - KEYS
        if unknown or not {"id", "crs", "bounds"} <= set(config):
            raise ConfigError(f"unknown keys {sorted(unknown)}, or id, crs or bounds is missing")
        if not isinstance(config["bounds"], (list, tuple)) or len(config["bounds"]) != 4:
            raise ConfigError("bounds are four numbers")
        scheme = config.get("scheme")
        if isinstance(scheme, str):
            if scheme not in records.SCHEMES:
                raise ConfigError(f"unknown scheme {scheme!r}; known: {sorted(records.SCHEMES)}")
            scheme = records.SCHEMES[scheme]
        elif scheme is not None:
            labels = {int(k): v for k, v in scheme.get("labels", {}).items()}
            scheme = records.ClassScheme(scheme["name"], labels, scheme["nodata"], scheme.get("data_class", "observed"), scheme.get("source", UNKNOWN))
        kind = "synthetic" if "synthetic" in config["id"].lower() else "observed"
        sources = {k: SourceSpec.of(k, config[k], kind) for k in SOURCES if k in config}
        rest = {k: config[k] for k in ("snap_tolerance", "settlement_snap", "exit_property", "buffer_cells", "absent") if k in config}
        return StudyAreaConfig(config["id"], config["crs"], Bounds(*config["bounds"], config["crs"]), sources, scheme, rest)


def build(spark: SparkSession, args) -> dict:
    """A study area from a configuration, written with its contract."""
    config = StudyAreaConfig.of(read_config(args.config))
    given = config.sources
    rasters = {k: given[k].raster(spark) for k in ("dem", "fuels") if k in given}
    vectors = {n: given[k].vector(spark) for k, n in (("roads", "road_lines"), ("facilities", "facilities"), ("population", "population")) if k in given}
    options = {}
    if "population" in given:
        told = dict(given["population"].options or {})
        told["strata"] = tuple(tuple(s) for s in told.get("strata", ()))
        options["settlement_options"] = told
    if "facilities" in given and given["facilities"].options:
        options["facility_options"] = given["facilities"].options
    area = study.build(config.crs, config.bounds, id=config.id, scheme=config.scheme, **rasters, **vectors, **options, **config.rest)
    manifest = save_area(spark, args.out, area, args.overwrite)
    told = write_report(spark, args.out, staged(validate_directory(spark, args.out)))
    return manifest | {"validation": {k: told[k] for k in ("status", "errors", "warnings", "infos")}}


def validate(spark: SparkSession, args) -> dict:
    found = staged(validate_directory(spark, args.path))
    verdict = validation.status(found, args.strict).first().asDict()
    return verdict | {"target": args.path, "findings": [r.asDict() for r in validation.report(found).toLocalIterator()]}


def summarise(spark: SparkSession, args) -> dict:
    return study.describe(load_area(spark, args.path))


def provenance(spark: SparkSession, args) -> dict:
    return {k: p.to_dict() for k, p in read_records(spark, args.path).items()}


def compatibility(spark: SparkSession, args) -> dict:
    return contract.build(spark, load_area(spark, args.path))["compatibility"]


def make_fixtures(spark: SparkSession, args) -> dict:
    names = args.names or sorted(fixtures.RASTERS | fixtures.VECTORS)
    for name in names:
        layer = fixtures.make_fixture(spark, name)
        if isinstance(layer, RasterLayer):
            write_raster(layer, f"{args.out}/{name}")
        elif isinstance(layer, VectorLayer):
            write_geojson(layer, f"{args.out}/{name}.geojson")
        else:
            raise ConfigError(f"{name} is no single layer")
    return {"written": names}


def checked(spark: SparkSession, args) -> Provenance:
    """The caller's record of the file; a checksum that differs raises before anything is written."""
    record = _provenance(args)
    if args.no_checksum:
        return record
    found = [r[0] for r in spark.read.format("binaryFile").load(args.path).select(F.sha2("content", 256)).collect()]
    if found != [args.sha256.lower()]:
        raise IngestError(f"{args.path} has the checksum {found}, not {args.sha256}")
    return replace(record, checksum=args.sha256.lower(), checksum_algorithm="sha256")


def import_vector(spark: SparkSession, args) -> dict:
    layer = read_geojson(spark, args.path, checked(spark, args), args.crs)
    df = layer.df
    if args.command == "import-population":
        df = records.settlements(layer)
    if args.command == "import-facilities":
        wrong = [pair for pair in args.kind if "=" not in pair]
        if wrong:
            raise ConfigError(f"{wrong} are not of the form tag=role")
        df = records.facilities_from_layer(layer, dict(pair.split("=", 1) for pair in args.kind), unmapped=args.unmapped)
    return write_bundle(spark, args.out, args.name, {args.name: (df, layer.provenance)})


def import_fuels(spark: SparkSession, args) -> dict:
    layer = read_class_geotiff(spark, args.path, checked(spark, args), args.crs, records.SCHEMES[args.scheme])
    return write_bundle(spark, args.out, args.name, {args.name: (layer.df, layer.provenance)})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terraweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name, run in (("validate-study-area", validate), ("summarize-study-area", summarise), ("provenance", provenance), ("compatibility", compatibility)):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--strict", action="store_true")
        p.set_defaults(run=run)
    p = commands.add_parser("build-study-area")
    p.add_argument("config")
    p.add_argument("out")
    p.add_argument("--overwrite", action="store_true")
    p.set_defaults(run=build)
    p = commands.add_parser("make-fixtures")
    p.add_argument("out")
    p.add_argument("names", nargs="*")
    p.set_defaults(run=make_fixtures)
    for name in ("import-roads", "import-facilities", "import-population", "import-fuels"):
        p = commands.add_parser(name)
        for word in ("path", "out"):
            p.add_argument(word)
        for word in ("--name", "--data-class", "--source", "--licence"):
            p.add_argument(word, required=True)
        p.add_argument("--crs", required=name == "import-fuels")
        sums = p.add_mutually_exclusive_group(required=True)
        sums.add_argument("--sha256")
        sums.add_argument("--no-checksum", action="store_true")
        if name == "import-facilities":
            p.add_argument("--kind", action="append", default=[], help="tag=role, once for each tag")
            p.add_argument("--unmapped", choices=("error", "other"), default="error")
        if name == "import-fuels":
            p.add_argument("--scheme", choices=sorted(records.SCHEMES), required=True)
        p.set_defaults(run=import_fuels if name == "import-fuels" else import_vector)
    commands.add_parser("list-fixtures").set_defaults(run=lambda spark, args: {"fixtures": sorted(fixtures.FIXTURES)})
    commands.add_parser("version").set_defaults(run=lambda spark, args: {"version": __version__})
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        out = args.run(None if args.command in ("list-fixtures", "version") else get_session(), args)
    except StudyError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.exit_code
    print(json.dumps(out, indent=2, default=str))
    return 1 if out.get("status") == "fail" else 0


if __name__ == "__main__":
    sys.exit(main())
