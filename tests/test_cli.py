"""Commands from end to end."""

import hashlib
import json

import numpy as np
import pytest

from terraweave.cli import main, read_config
from terraweave.model import Grid
from terraweave.sources.raster import encode_tiff


def said(capsys, *words):
    """Exit code and JSON of one command."""
    capsys.readouterr()
    code = main([str(w) for w in words])
    out = capsys.readouterr().out
    return code, json.loads(out) if out else None


@pytest.fixture(scope="module")
def study_area(spark, tmp_path_factory):
    """A configuration over written fixtures, and the folder of its bundle."""
    base = tmp_path_factory.mktemp("cli")
    names = ("integration_fixture_dem", "integration_fixture_fuels", "integration_fixture_roads", "integration_fixture_villages", "integration_fixture_facilities")
    assert main(["make-fixtures", str(base), *names]) == 0
    known = {"source": "closed form", "licence": "none needed", "value_unit": "m", "valid_from": "not_applicable", "valid_to": "not_applicable"}
    config = {
        "id": "plane_synthetic", "crs": "EPSG:5187", "bounds": [226030, 477030, 226390, 477390], "scheme": "synthetic_demo_v1", "exit_property": "exit",
        "dem": {"path": f"{base}/{names[0]}", **known}, "fuels": {"path": f"{base}/{names[1]}", **known}, "roads": {"path": f"{base}/{names[2]}.geojson", **known},
        "population": {"path": f"{base}/{names[3]}.geojson", **known, "options": {"strata": [["pop_0_14", 0, 15], ["pop_15_64", 15, 65], ["pop_65_plus", 65, None]]}},
        "facilities": {"path": f"{base}/{names[4]}.geojson", **known, "options": {"kind_map": {"responder_base": "responder_base", "shelter": "shelter"}}},
    }
    (base / "c.json").write_text(json.dumps(config))
    assert main(["build-study-area", str(base / "c.json"), str(base / "bundle")]) == 0
    return base


#: Command, expected exit code, and what its answer must hold.
COMMANDS = (
    ("summarize-study-area", 0, lambda out: out["layers"]["slope"]["rows"] == 196 and out["population"]["total"] == 40 and out["terrain"]["slope_max"] == pytest.approx(5.710593, abs=1e-5)),
    ("validate-study-area", 0, lambda out: out["errors"] == 0 or {f["code"] for f in out["findings"] if f["severity"] == "ERROR"} == {"PRV-001"}),
    ("compatibility", 0, lambda out: set(out) == {"FORECAST_VALUE", "OSSE", "ASSISTED_DISPATCH"} and all(r["missing"] == "" for r in out.values())),
    ("provenance", 0, lambda out: out["slope"]["parents"] and out["dem"]["sources"][0]["licence"] == "none needed"),
)


@pytest.mark.parametrize("command,code,holds", COMMANDS, ids=[c[0] for c in COMMANDS])
def test_commands_over_one_bundle(study_area, capsys, command, code, holds):
    got, out = said(capsys, command, study_area / "bundle")
    assert got == code and holds(out), out


def test_a_bundle_of_wrong_parts_fails(study_area, tmp_path, capsys):
    config = json.loads((study_area / "c.json").read_text())
    config |= {"id": "plain", "dem": config["dem"]["path"], "scheme": None}
    (tmp_path / "c.json").write_text(json.dumps({k: v for k, v in config.items() if v is not None}))
    assert said(capsys, "build-study-area", tmp_path / "c.json", tmp_path / "b")[0] == 0
    code, out = said(capsys, "validate-study-area", tmp_path / "b")
    assert code == 1 and {"BND-005", "BND-007"} <= {f["code"] for f in out["findings"]}
    assert said(capsys, "compatibility", tmp_path / "b")[1]["OSSE"]["status"] == "INCOMPLETE"
    assert said(capsys, "build-study-area", tmp_path / "c.json", tmp_path / "b")[0] not in (0, 2)


def test_exit_codes(tmp_path, capsys):
    assert main(["version"]) == 0 and main(["list-fixtures"]) == 0 and main(["nonsense"]) == 2
    (tmp_path / "bad.json").write_text('{"id": "x", "odd": 1}')
    assert main(["build-study-area", str(tmp_path / "bad.json"), str(tmp_path / "o")]) == 2
    (tmp_path / "list.json").write_text("[1]")
    assert main(["build-study-area", str(tmp_path / "list.json"), str(tmp_path / "o")]) == 2


def test_yaml_configurations(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("id: x\nbounds: [1, 2, 3, 4]\n")
    assert read_config(str(tmp_path / "c.yaml")) == {"id": "x", "bounds": [1, 2, 3, 4]}


def test_imports_verify_before_they_write(spark, tmp_path, capsys):
    content = json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:5187"}}, "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"facility_id": "f", "kind": "school"}}]})
    (tmp_path / "f.geojson").write_text(content)
    named = ["--name", "n", "--data-class", "observed", "--source", "s", "--licence", "l"]
    facilities = ["import-facilities", str(tmp_path / "f.geojson"), str(tmp_path / "out"), *named, "--kind", "school=shelter"]
    assert main(facilities) == 2
    assert main([*facilities, "--sha256", "0" * 64]) not in (0, 2) and not (tmp_path / "out").exists()
    assert main([*facilities, "--sha256", hashlib.sha256(content.encode()).hexdigest()]) == 0
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "out/layers/n")).collect()] == ["shelter"]
    (tmp_path / "c.tif").write_bytes(encode_tiff(np.array([[1.0, 2.0], [255.0, 6.0]]), Grid(0.0, 0.0, 30.0, 30.0, 2, 2), 255.0))
    fuels = ["import-fuels", str(tmp_path / "c.tif"), str(tmp_path / "fuels"), *named, "--crs", "EPSG:5187", "--no-checksum", "--scheme"]
    assert main([*fuels, "synthetic_demo_v1"]) == 0 and main([*fuels, "esa_worldcover_v200"]) != 0
    assert spark.read.parquet(str(tmp_path / "fuels/layers/n")).where("value is null").count() == 1
