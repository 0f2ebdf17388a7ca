"""What the validation checks must find, written out in SQL apart from the rules that the library runs.

Each line gives a code, its severity and when it is raised, by the meaning of the check and not by
the library's predicate: distances on a circle for grids, sets of words for records.
"""

from __future__ import annotations

from .operators.validation import RULES

EXPECTED = {
    "layer": """
CRS-001 ERROR crs IN ('UNKNOWN')
CRS-002 ERROR CASE WHEN crs = 'UNKNOWN' THEN false ELSE geographic END
CRS-003 ERROR crs != 'UNKNOWN' AND axis_unit NOT IN ('m') AND geographic = false
CRS-004 INFO CASE WHEN crs = 'UNKNOWN' THEN false ELSE northing_first END
CRS-005 ERROR crs NOT IN ('UNKNOWN', ref_crs)
RAS-001 WARNING data_kind = 'raster' AND nodata_declared = false AND integer_cells = false
RAS-001 ERROR data_kind = 'raster' AND nodata_declared = false AND integer_cells = true
RAS-002 ERROR data_kind = 'raster' AND NOT (valid_count > 0)
RAS-003 WARNING data_kind = 'raster' AND valid_count > 0 AND valid_count < total_count - total_count / 10.0
RAS-004 INFO data_kind = 'raster' AND nodata_declared AND valid_count > 0 AND total_count - valid_count = 0
RAS-005 WARNING data_kind = 'raster' AND greatest(x_size, y_size) - least(x_size, y_size) > greatest(x_size, y_size) / 1e9
RAS-006 WARNING data_kind = 'raster' AND crs = ref_crs AND crs != 'UNKNOWN' AND greatest(abs(x_size - ref_x_size), abs(y_size - ref_y_size)) > 0.000001
RAS-007 WARNING data_kind = 'raster' AND crs = ref_crs AND crs != 'UNKNOWN' AND greatest(abs(x_size - ref_x_size), abs(y_size - ref_y_size)) <= 0.000001 AND greatest(abs((x_origin - ref_x_origin) / x_size - round((x_origin - ref_x_origin) / x_size)) * x_size, abs((y_origin - ref_y_origin) / y_size - round((y_origin - ref_y_origin) / y_size)) * y_size) > 0.000001
PRV-001 ERROR n_unknown_blocking >= 1
PRV-002 WARNING n_unknown_other >= 1
PRV-003 ERROR NOT (n_sources >= 1)
PRV-004 ERROR data_class IN ('derived') AND NOT (n_parents >= 1)
PRV-005 INFO data_class IN ('synthetic')
PRV-006 INFO temporal_class IN ('retrospective')
PRV-007 WARNING temporal_class NOT IN ('static') AND (temporal_reference = 'UNKNOWN' OR temporal_reference = 'not_applicable')
PRV-008 WARNING checksum IN ('UNKNOWN')
PRV-009 INFO surface_model IN ('dsm')
PRV-010 WARNING 'UNKNOWN' IN (valid_from, valid_to)
VEC-001 ERROR data_kind = 'vector' AND NOT (n_features > 0)
VEC-002 WARNING data_kind = 'vector' AND n_features > 0 AND n_geometry_types >= 2
VEC-003 ERROR data_kind = 'vector' AND n_features > 0 AND n_invalid >= 1""",
    "population": """
POP-001 WARNING strata_sum < total OR strata_sum > total
POP-002 WARNING total IS NULL
POP-003 WARNING total BETWEEN 1 AND 4
POP-004 WARNING count_basis IN ('UNKNOWN')""",
    "facilities": """
FAC-001 INFO n_unassessed >= 1
FAC-002 WARNING n_status_unknown >= 1
FAC-003 INFO n_without_capacity >= 1""",
    "roads": """
RD-001 WARNING n_components >= 2
RD-002 WARNING n_isolated >= 1
RD-003 INFO n_single_egress >= 1
RD-004 WARNING n_no_egress >= 1
RD-005 INFO n_boundary_exits >= 1
RD-006 WARNING n_unnoded_crossings >= 1
RD-007 WARNING n_unmatched >= 1""",
    "bundle": """
POP-005 ERROR n_private_fields >= 1
BND-001 ERROR NOT (n_layers > 0)
BND-002 WARNING n_layers > 0 AND terrain_covers = false
BND-003 ERROR slope_missing - dem_missing <= 0
BND-004 ERROR has_fuels AND fuels_categorical = false
BND-005 ERROR has_fuels AND fuels_scheme = false
BND-006 INFO n_synthetic >= 1
BND-007 WARNING n_synthetic >= 1 AND strpos(lower(bundle_id), 'synthetic') = 0
BND-008 ERROR n_undefined_codes >= 1
BND-009 ERROR has_fuels AND (fuels_nodata < scheme_nodata OR fuels_nodata > scheme_nodata)""",
    "directory": """
BND-010 ERROR has_manifest = false
BND-011 ERROR has_manifest AND manifest_readable = false
BND-021 WARNING has_contract = false
BND-022 ERROR has_contract AND contract_readable = false
BND-023 ERROR contract_differs = true""",
    "files": """
BND-012 WARNING role = 'sidecar' AND on_disk AND in_manifest = false
BND-013 ERROR role = 'layer' AND in_manifest AND has_sidecar = false
BND-014 WARNING role = 'layer' AND in_manifest AND recorded IS NULL
BND-015 ERROR role = 'layer' AND (recorded < actual OR recorded > actual)
BND-016 WARNING role = 'extra' AND in_manifest AND on_disk = false
BND-017 WARNING role = 'extra' AND in_manifest AND recorded IS NULL
BND-018 ERROR role = 'extra' AND (recorded < actual OR recorded > actual)
BND-019 ERROR role = 'sidecar' AND in_manifest AND on_disk = false
BND-020 ERROR role = 'sidecar' AND (recorded < actual OR recorded > actual)""",
}


def findings_sql(facts: str, table: str, subject: str) -> str:
    """One SQL text of all findings over a relation of facts; only the messages are the library's."""
    told = {(code.rstrip("E"), severity): message.replace("'", "''") for code, (_, severity, _, message) in RULES.items()}
    parts = []
    for line in EXPECTED[table].strip().splitlines():
        code, severity, condition = line.split(" ", 2)
        parts.append(f"SELECT '{code}' AS code, '{severity}' AS severity, CAST({subject} AS VARCHAR) AS layer, '{told[code, severity]}' AS message FROM facts WHERE {condition}")
    return f"WITH facts AS ({facts}) " + " UNION ALL ".join(parts)
