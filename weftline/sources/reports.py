"""Report sinks: analysis as JSON rows and as text."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.features import FEATURES
from weftline.operators.scoring import Config


def json_rows(analysis: DataFrame) -> DataFrame:
    """path, region_id, boundary_index, json: one document a boundary, sets sorted."""
    return analysis.select("path", "region_id", "boundary_index", F.to_json(F.struct(*analysis.columns)).alias("json"))


def write_json(analysis: DataFrame, path: str) -> None:
    analysis.write.mode("overwrite").json(path)


def number(c: Column, form: str = "%.3f") -> Column:
    return F.format_string(form, c)


def listing(analysis: DataFrame) -> DataFrame:
    """path, region_id, boundary_index, line: the boundary table's rows."""
    yes = lambda c: F.when(F.col(c), "YES").otherwise("")
    line = F.format_string("  %-3d %4d|%-4d %6.3f %6.3f %4s %s", "boundary_index", "after_line", "before_line", "score", "prominence", yes("local_peak"), yes("recommended"))
    return analysis.select("path", "region_id", "boundary_index", line.alias("line"))


def explanation(analysis: DataFrame) -> DataFrame:
    """path, region_id, boundary_index, text: why a boundary has its score and fate."""
    dash = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("-")
    feats = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), number(F.col(k))) for k in FEATURES))
    rows = [
        F.concat("region_id", F.lit(" after line "), F.col("after_line").cast("string"), F.lit(", score="), number(F.col("score"))),
        F.concat(F.lit("  local peak: "), F.col("local_peak").cast("string"), F.lit(", prominence="), number(F.col("prominence"))),
        F.concat(F.lit("  rejected by: "), dash("rejection_reasons")), F.concat(F.lit("  features: "), feats),
        *(F.concat(F.lit(f"  {t}: "), dash(c)) for t, c in (("dead", "dead_symbols"), ("born", "born_symbols"), ("cross", "cross_symbols"), ("constraints", "constraints"), ("risks", "risks"), ("completion roles", "completion_roles"), ("completion symbols", "completion_symbols"))),
    ]
    if "left_quality" in analysis.columns:
        rows += [F.concat(F.lit(f"  {s} module quality: "), F.coalesce(number(F.col(f"{s}_quality")), F.lit("-"))) for s in ("left", "right")]
    return analysis.select("path", "region_id", "boundary_index", F.concat_ws("\n", *rows).alias("text"))


POLICY_VERSION = "selection-policy-1"


def load_policy(path: str) -> Config:
    """A selection policy: {schema_version, feature_version, and any fields of Config}."""
    from weftline.schema import VERSIONS

    data = json.loads(Path(path).read_text())
    if (data.pop("schema_version", None), data.pop("feature_version", None)) != (POLICY_VERSION, VERSIONS["features"]):
        raise ValueError("unsupported selection policy")
    if unknown := set(data) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Config(**data)
