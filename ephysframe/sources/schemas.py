"""Explicit schemas of the domain tables (see FIXTURES.md).

Explicit schemas matter for CSV: an inferred schema can turn an all-digit
colour code into a number and lose its leading zeros.
"""

from pyspark.sql import types as T

S, L, D, B, DT, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PERFORMANCE = _struct(
    ("start_time", D), ("stop_time", D), ("block_index", L), ("rewarded_modality", S),
    ("cross_modal_dprime", D), ("signed_cross_modal_dprime", D), ("same_modal_dprime", D),
    ("nonrewarded_modal_dprime", D), ("vis_intra_dprime", D), ("aud_intra_dprime", D),
    ("session_idx", L), ("date", DT), ("subject_id", L), ("session_id", S), ("id", L),
)

SESSION = _struct(("session_id", S), ("subject_id", L), ("date", DT), ("keywords", T.ArrayType(S)))

UNITS = _struct(
    ("session_id", S), ("electrode_group_name", S), ("unit_id", S), ("location", S), ("structure", S),
    ("ccf_ap", D), ("ccf_dv", D), ("ccf_ml", D), ("isi_violations_ratio", D),
    ("isi_violations_count", D), ("amplitude_cutoff", D), ("presence_ratio", D),
)

ELECTRODE_GROUPS = _struct(("session_id", S), ("name", S), ("location", S))

ELECTRODES = _struct(
    ("session_id", S), ("group_name", S), ("x", D), ("y", D), ("z", D), ("location", S), ("structure", S),
)

STRUCTURE_TREE = _struct(
    ("id", L), ("atlas_id", L), ("name", S), ("acronym", S), ("st_level", L), ("ontology_id", L),
    ("hemisphere_id", L), ("weight", L), ("parent_structure_id", L), ("depth", L), ("graph_id", L),
    ("graph_order", L), ("structure_id_path", S), ("color_hex_triplet", S),
    ("neuro_name_structure_id", L), ("neuro_name_structure_id_path", S), ("failed", S),
    ("sphinx_id", L), ("structure_name_facet", L), ("failed_facet", L), ("safe_name", S),
)

VOXELS = _struct(("ml", T.IntegerType()), ("dv", T.IntegerType()), ("ap", T.IntegerType()), ("structure_id", L))

SESSIONS = _struct(("id", S), ("subject_id", S), ("date", DT), ("platform", S))

ASSETS = _struct(
    ("session_id", S), ("asset_id", S), ("kind", S), ("created", TS), ("failed", B),
    ("sorted_probes", T.ArrayType(S)), ("output", S),
)

COMPUTATIONS = _struct(
    ("name", S), ("capsule_or_pipeline_id", S), ("in_progress", B),
    ("data_assets", T.ArrayType(_struct(("id", S)))),
    ("parameters", T.ArrayType(_struct(("name", S), ("param_name", S), ("value", S)))),
)

PROBES = _struct(
    ("serial_number", S), ("date_installed", DT), ("date_removed", DT), ("issue", S), ("rig", S),
    ("storage_location", S), ("is_destroyed", B),
)

QC_FILES = _struct(("path", S))
