"""Study areas on disk: every check raised by what is really there, contract and readiness."""

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from terraweave import fixtures
from terraweave.errors import BundleError
from terraweave.model import Bounds, Provenance
from terraweave.operators import contract, facts, records, study, validation, vector
from terraweave.operators.validation import CODES
from terraweave.sources.bundle import directory_facts, file_facts, load_area, read_manifest, save_area, validate_directory

BOX = Bounds(226030, 477030, 226390, 477390, fixtures.CRS)
STRATA = (("pop_0_14", 0, 15), ("pop_15_64", 15, 65), ("pop_65_plus", 65, None))
KINDS = {"responder_base": "responder_base", "shelter": "shelter"}
WHOLE = {
    "value_unit": "m", "resolution_unit": "m", "vertical_datum": "not_applicable", "original_crs": "EPSG:5187", "sources": ({"name": "closed form", "licence": "none needed"},),
}


def told(layer, **more):
    return replace(layer, provenance=replace(layer.provenance, **(WHOLE | more)))


def make(spark, **options):
    given = {
        "id": "plane_synthetic", "dem": told(fixtures.integration_dem(spark)), "fuels": told(fixtures.half_and_half(spark)), "scheme": records.DEMO_SCHEME, "road_lines": told(fixtures.integration_roads(spark)),
        "population": told(fixtures.integration_villages(spark)), "facilities": told(fixtures.integration_facilities(spark)), "exit_property": "exit", "settlement_options": {"strata": STRATA}, "facility_options": {"kind_map": KINDS},
    }
    return study.build(fixtures.CRS, BOX, **(given | options))


def codes(df):
    return {r.code for r in df.select("code").distinct().collect()}


@pytest.fixture(scope="module")
def area(spark):
    return make(spark)


@pytest.fixture(scope="module")
def saved(spark, area, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bundle") / "b")
    save_area(spark, path, area)
    return path


def test_a_sound_area_has_no_error(spark, saved):
    found = validate_directory(spark, saved)
    assert found.where("severity = 'ERROR'").count() == 0, found.where("severity = 'ERROR'").collect()
    assert codes(found) >= {"PRV-005", "BND-006", "CRS-004", "FAC-001", "RD-005"} and validation.status(found).first()["status"] == "pass_with_warnings"


def test_built_and_read_areas_are_alike(spark, area, saved):
    back = load_area(spark, saved)
    rows = lambda a: sorted(study.summary(a).collect())
    assert rows(back) == rows(area) and back.qa == json.loads(json.dumps(area.qa)) and back.scheme == area.scheme and back.dem.grid == area.dem.grid
    assert {r.code for r in study.findings(spark, back).collect()} <= {r.code for r in study.findings(spark, area).collect()}
    told_ = study.describe(back)
    assert told_["population"]["total"] == 40 and told_["facilities"] == {"responder_base": 1, "shelter": 1} and told_["roads"]["graph"]["total_length_m"] == 480


def test_the_integration_network_is_known(area):
    qa = area.qa
    assert qa["graph"] == {"nodes": 4, "edges": 3, "total_length_m": 480.0, "length_unit": "m", "directed": False}
    assert qa["egress"]["critical_links"] == 1 and qa["egress"]["settlements"]["unmatched"]["count"] == 0 and qa["egress"]["exits"]["clip_boundary_warning"]


def test_layer_checks_are_raised_by_layers(spark, area):
    plane = fixtures.integration_dem(spark)
    raised = set()

    def check(**layers):
        found = codes(validation.findings(facts.layer_facts(spark, layers), "layer", "layer"))
        raised.update(found)
        return found

    assert "CRS-001" in check(a=replace(plane, crs=None))
    assert "CRS-002" in check(a=replace(plane, crs="EPSG:4326"))
    assert "CRS-004" in check(a=plane)
    assert "CRS-003" in check(a=replace(plane, crs=replace(plane.crs, unit="ft")))
    assert "CRS-005" in check(a=plane, b=replace(plane, crs="EPSG:5186"))
    assert "RAS-001" in check(a=replace(plane, nodata=None))
    whole = replace(plane, df=plane.df.withColumn("value", F.col("value").cast("int")), nodata=None)
    assert validation.findings(facts.layer_facts(spark, {"a": whole}), "layer", "layer").where("code = 'RAS-001'").first()["severity"] == "ERROR"
    assert "RAS-002" in check(a=replace(plane, df=plane.df.withColumn("value", F.lit(None).cast("double"))))
    assert "RAS-003" in check(a=fixtures.plane(spark, 15, 15, missing=F.col("row") < 4))
    assert "RAS-004" in check(a=plane)
    g = plane.grid
    assert "RAS-005" in check(a=replace(plane, grid=replace(g, y_size=31.0)))
    assert "RAS-006" in check(a=plane, b=replace(plane, grid=replace(g, x_size=60.0, y_size=60.0)))
    assert "RAS-007" in check(a=plane, b=replace(plane, grid=replace(g, x_origin=g.x_origin + 15)))
    other = replace(plane, crs="EPSG:5186", grid=replace(g, x_size=60.0, x_origin=g.x_origin + 15))
    assert not {"RAS-006", "RAS-007"} & check(a=plane, b=other)
    record = lambda **f: replace(plane, provenance=replace(plane.provenance, **f))
    assert {"PRV-001", "PRV-002", "PRV-005", "PRV-008"} <= check(a=plane)
    # Derived layers need a source too, and "not applicable" is no reference time of what changes.
    assert "PRV-003" in check(a=record(sources=(), data_class="derived", parents=("p",)))
    assert "PRV-007" in check(a=record(temporal_class="retrospective", temporal_reference="not_applicable")) and "PRV-006" in raised
    assert "PRV-009" in check(a=record(surface_model="dsm")) and "PRV-010" in check(a=record(valid_from="UNKNOWN"))
    loose = plane.provenance
    object.__setattr__(forged := replace(loose, data_class="derived", parents=("p",)), "parents", ())
    assert "PRV-004" in check(a=replace(plane, provenance=forged))
    roads_ = fixtures.integration_roads(spark)
    assert "VEC-001" in check(a=replace(roads_, df=roads_.df.limit(0)))
    mixed = replace(roads_, df=roads_.df.unionByName(fixtures.integration_facilities(spark).df))
    assert "VEC-002" in check(a=mixed)
    bow = spark.createDataFrame([(0, ("Polygon", [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]), {})], fixtures.VECTOR)
    assert "VEC-003" in check(a=replace(roads_, df=bow))
    assert raised >= {c for c in CODES if c[:3] in ("CRS", "RAS", "PRV", "VEC")}


def test_record_and_road_checks_are_raised_by_records(spark):
    people = codes(validation.findings(facts.population_facts(records.settlements(fixtures.villages(spark), strata=STRATA)), "population", "settlement_id"))
    assert people == {"POP-001", "POP-002", "POP-003", "POP-004"}
    given = records.facilities_from_layer(fixtures.facilities(spark), {k: k for k in records.FACILITY_KINDS}, capacity_property="capacity_persons", status_property="operational_status")
    assert codes(validation.findings(facts.facility_facts(given), "facilities", "layer")) == {"FAC-001", "FAC-002", "FAC-003"}
    assert facts.facility_facts(given.limit(0)).count() == 0
    wide = Bounds(226000, 477000, 226900, 477900, fixtures.CRS)
    far = fixtures.points(spark, (226320, 477340, {"settlement_id": "near"}), (229000, 479900, {"settlement_id": "far"}))
    places = records.settlements(far, strata=()).select(F.col("settlement_id").alias("place_id"), "point.x", "point.y")
    from terraweave.operators import roads

    graph = roads.build_graph(fixtures.disconnected_network(spark))
    report = roads.report(graph, roads.assess(graph, wide, places, 60.0), 60.0)
    found = codes(validation.findings(facts.road_facts(spark, report), "roads", "layer"))
    assert found >= {"RD-001", "RD-002", "RD-005", "RD-006", "RD-007"} and report["crossings_without_node"]["count"] == 1 and report["connectivity"]["component_count"] == 3
    inner = roads.build_graph(fixtures.single_exit_network(spark))
    stem = fixtures.points(spark, (226600, 477300, {"settlement_id": "end"}))
    places = records.settlements(stem, strata=()).select(F.col("settlement_id").alias("place_id"), "point.x", "point.y")
    wide = Bounds(220000, 470000, 230000, 480000, fixtures.CRS)
    tagged = lambda exit_property: roads.report(inner, roads.assess(inner, None, places, 60.0, exit_property), 60.0)
    assert "RD-004" in codes(validation.findings(facts.road_facts(spark, tagged("none")), "roads", "layer"))
    one = fixtures.lines(spark, [(0, 0), (50, 0)], [(50, 0), (90, 0)])
    g = roads.build_graph(one)
    places = spark.createDataFrame([("p", 50.0, 0.0)], "place_id string, x double, y double")
    single = roads.report(g, roads.assess(g, Bounds(-2, -500, 5000, 5000, fixtures.CRS), places, 10.0))
    assert "RD-003" in codes(validation.findings(facts.road_facts(spark, single), "roads", "layer"))


def test_bundle_checks_are_raised_by_areas(spark, area):
    def check(**changes):
        return codes(validation.findings(facts.bundle_facts(spark, replace(area, **changes)), "bundle", "bundle_id"))

    nothing = dict.fromkeys(("dem", "slope", "aspect", "fuels", "roads", "population", "facilities"))
    assert codes(study.findings(spark, replace(area, **nothing))) == {"BND-001"}
    assert area.slope.df.where("value is null").count() == 52 and area.slope.grid.rows == 14
    assert "BND-002" in check(bounds=BOX.grown(500))
    assert "BND-003" in check(slope=replace(area.slope, df=area.dem.df))
    assert "BND-004" in check(fuels=replace(area.fuels, kind="continuous"))
    assert "BND-005" in check(scheme=None) and "BND-006" in check()
    assert "BND-007" in check(id="plane") and "BND-007" not in check(id="Plane_SYNTHETIC")
    assert "BND-008" in check(fuels=replace(area.fuels, df=area.fuels.df.withColumn("value", F.col("value") + 50)))
    assert "BND-009" in check(fuels=replace(area.fuels, nodata=0.0))
    private = area.population.df.withColumn("props", F.map_concat("props", F.create_map(F.lit("phone"), F.lit("x"))))
    assert "POP-005" in check(population=replace(area.population, df=private))


def test_directory_checks_are_raised_by_files(spark, saved, tmp_path):
    area = load_area(spark, saved)

    import shutil

    def broken(name, change):
        path = str(tmp_path / name)
        shutil.copytree(saved, path)
        for folder, _, names in os.walk(path):
            for n in names:
                if n.endswith(".crc"):
                    os.remove(os.path.join(folder, n))
        change(path)
        if name < "d":
            return codes(validate_directory(spark, path))
        if name < "k":
            return codes(validation.findings(file_facts(spark, path, read_manifest(spark, path)), "files", "file"))
        return codes(validation.findings(directory_facts(spark, path, area), "directory", "directory"))

    def edit(relative, **fields):
        def run(path):
            text = json.load(open(f"{path}/{relative}"))
            for k, v in fields.items():
                text = {a: b for a, b in text.items() if a != k} if v is None else text | {k: v}
            json.dump(text, open(f"{path}/{relative}", "w"))

        return run

    assert broken("a", lambda p: os.remove(f"{p}/manifest.json")) == {"BND-010"}
    assert broken("b", edit("manifest.json", version="0")) == {"BND-011"}
    assert broken("c", lambda p: open(f"{p}/manifest.json", "w").write("{")) == {"BND-011"}
    orphan = lambda p: (shutil.copy(f"{p}/provenance/dem.provenance.json", f"{p}/provenance/x.provenance.json"), edit("provenance/x.provenance.json", layer_name="x")(p))
    assert "BND-012" in broken("d", orphan)
    assert {"BND-013", "BND-019"} <= broken("e", lambda p: os.remove(f"{p}/provenance/dem.provenance.json"))
    assert {"BND-014", "BND-020"} <= broken("f", edit("provenance/dem.provenance.json", checksum="UNKNOWN"))
    assert {"BND-015", "BND-020"} <= broken("g", edit("provenance/dem.provenance.json", checksum="0"))
    assert "BND-016" in broken("h", lambda p: os.remove(f"{p}/extras/road_qa.json"))
    assert "BND-017" in broken("i", edit("manifest.json", extras_checksums_sha256={}))
    assert "BND-018" in broken("j", edit("extras/class_scheme.json", source="other"))
    assert "BND-021" in broken("k", lambda p: os.remove(f"{p}/bundle_manifest.json"))
    assert "BND-022" in broken("l", edit("bundle_manifest.json", contract_version="0"))
    assert "BND-023" in broken("m", edit("bundle_manifest.json", canonical_grid={"status": "MISMATCHED"}))


def test_readiness_follows_tags_and_grids(spark, area):
    ready = contract.build(spark, replace(area, fuels=area.fuels))["compatibility"]
    assert ready["OSSE"]["status"] == "READY" and ready["ASSISTED_DISPATCH"]["status"] == "READY"
    shifted = replace(area.fuels, grid=area.fuels.grid.offset(0, 1, (area.fuels.grid.rows, area.fuels.grid.cols)))
    other = contract.build(spark, replace(area, fuels=shifted))
    assert other["canonical_grid"]["status"] == "MISMATCHED" and other["compatibility"]["OSSE"]["status"] == "READY_WITH_LIMITATIONS" and other["compatibility"]["ASSISTED_DISPATCH"]["status"] == "READY"
    assert contract.build(spark, replace(area, scheme=None))["compatibility"]["OSSE"] == {"status": "INCOMPLETE", "missing": "fuels"}
    unknown = replace(area.roads, provenance=replace(area.roads.provenance, sources=({"name": "s", "licence": "UNKNOWN"},)))
    assert contract.build(spark, replace(area, roads=unknown))["compatibility"]["ASSISTED_DISPATCH"]["status"] == "READY_WITH_LIMITATIONS"
    told_ = contract.build(spark, replace(area, population=None, absent={"population": "not public"}))
    assert told_["slots"]["population"] == {"status": "ABSENT", "reason": "not public"} and told_["slots"]["roads"]["graph"]["edges"] == 3


def test_licences_travel(spark, tmp_path):
    source = {"name": "map", "licence": "Open Data, Attribution needed"}
    layer = replace(fixtures.integration_roads(spark), provenance=Provenance("roads", "observed", sources=(source, {"name": "own", "licence": "none"})))
    area = study.StudyArea(id="x", crs=layer.crs, bounds=BOX, roads=layer)
    save_area(spark, str(tmp_path / "b"), area)
    manifest = read_manifest(spark, str(tmp_path / "b"))
    assert len(manifest["licences"]) == 2 and manifest["obligations"] == ["map: Open Data, Attribution needed"]
    with pytest.raises(BundleError):
        save_area(spark, str(tmp_path / "b"), area)
    save_area(spark, str(tmp_path / "b"), area, overwrite=True)


def test_a_settlement_polygon_around_the_box_stays(spark):
    around = fixtures.squares(spark, (226000, 477000, 900.0, {"settlement_id": "s"}))
    assert vector.clip_features(around, BOX).df.count() == 1


def test_boxes():
    box = lambda *numbers: Bounds(*numbers, "EPSG:5187")
    assert box(0, 0, 100, 100).covers(box(1, 1, 100, 99)) and not box(0, 0, 100, 100).covers(box(1, 1, 101, 99))
    assert box(0, 0, 4, 4).meet(box(4, 0, 9, 9)) is None and box(0, 0, 4, 4).meet(box(2, 1, 9, 3)).box() == (2, 1, 4, 3)
    west, south, east, north = box(226000, 477000, 226400, 477400).to_wgs84()
    assert 129 < west < east < 130 and 36 < south < north < 38
