"""The statement model that every frontend emits, its closed domains and version tags."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["path", "region_id"]
SETS = ["definitions", "reads", "mutations", "access_domains", "calls", "resolved_calls", "resolved_indexes", "unresolved_calls", "effects", "control_effects", "roles", "risks", "forbid_cut_before", "forbid_cut_after"]

_TEXTS = T.ArrayType(T.StringType())
CALL_SITE = "struct<name:string,form:string,origin:string,abstraction:string,input_symbols:array<string>,output_symbols:array<string>,is_standalone_statement:boolean,is_only_operation:boolean,resolution_reliability:double>"
CALL_SITE_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "form", "origin", "abstraction")]
    + [T.StructField(n, _TEXTS) for n in ("input_symbols", "output_symbols")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_standalone_statement", "is_only_operation")]
    + [T.StructField("resolution_reliability", T.DoubleType())]
)
STATEMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "region_id")]
    + [T.StructField("idx", T.IntegerType()), T.StructField("kind", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")]
    + [T.StructField(n, _TEXTS) for n in SETS]
    + [T.StructField(n, T.BooleanType()) for n in ("is_compound", "parse_reliable", "call_resolution_available")]
    + [T.StructField("call_sites", T.ArrayType(CALL_SITE_TYPE))]
)

#: Closed domains.
EFFECTS = ("file_read", "file_write", "workspace_read", "workspace_write", "output", "path_mutation", "function_handle", "call_or_index", "unknown")
CONTROL_EFFECTS = ("break", "continue", "return", "throw")
ROLES = ("acquisition", "transformation", "aggregation", "normalization", "shaping", "decision", "output", "control_computation", "unknown")
RISKS = ("parse_error", "dynamic_evaluation", "workspace_injection", "global_state", "persistent_state", "ambiguous_call_or_index", "indirect_call", "external_dependency", "path_dependency")
EDGE_KINDS = ("next", "true", "false", "break", "continue", "return", "back")
COMPLETION_ROLES = ("aggregation", "normalization", "shaping")

VERSIONS = {"raw_facts": "boundary-facts-1", "features": "boundary-features-1", "learned": "boundary-features-learned-1", "energy": "structured-energy-1", "metrics": "segmentation-metrics-1", "artifact": "structured-model-1"}


def checked(df, schema: T.StructType = STATEMENT):
    """A frontend's output in the model's column order; raises if a column is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name not in have:
            raise ValueError(f"frontend output lacks the column {f.name}")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*schema.fieldNames())
