"""Continuous boundary features as column expressions over the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schema import KEY


def ratio(part: str, of: str, scale: float = 2.0) -> Column:
    return F.when(F.col(of) > 0, F.least(F.lit(1.0), scale * F.col(part) / F.col(of))).otherwise(0.0)


def jaccard_distance(a: Column, b: Column, empty: float) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1.0 - F.size(F.array_intersect(a, b)) / union).otherwise(empty)


def retention(crossing: str, nearby: str) -> Column:
    return F.when(F.col(nearby) > 0, 1.0 - F.col(crossing) / F.col(nearby)).otherwise(0.5)


def cohesion(edges: str, size: str) -> Column:
    return F.col(edges) / (F.col(edges) + F.greatest(F.lit(1), F.col(size) - 1))


def names(histogram: str) -> Column:
    return F.transform(histogram, lambda x: x["name"])


def hundredths(k: float, c: Column) -> Column:
    """1 + k * c for whole numbers c and a k of two decimals, to the nearest double: taken in whole hundredths, as decimals are.

    In doubles 0.35 * 6 falls short of 2.1, so scores that should tie differ in their last bit, and peaks with them.
    """
    return (100 + round(100 * k) * c) / 100.0


def expressions() -> dict[str, Column]:
    compound = F.col("compound_ends_here")
    followup = F.when(compound, 1.0 / (1.0 + F.col("control_followup_edge_count"))).otherwise(0.5)
    compact = lambda c, k: 1.0 / hundredths(k, F.col(c))
    return {
        "variable_death": ratio("dead_symbol_count", "left_symbol_count"),
        "variable_birth": ratio("born_symbol_count", "right_symbol_count"),
        "interface_compactness": compact("cross_symbol_count", 0.45),
        "dependency_drop": retention("local_cross_dependency_count", "nearby_dependency_count"),
        "medium_dependency_drop": retention("medium_cross_dependency_count", "medium_dependency_count"),
        "vocabulary_shift": jaccard_distance(F.col("left_symbols"), F.col("right_symbols"), 1.0),
        "structural_completion": compound.cast("double") * followup,
        "input_interface_compactness": compact("input_symbol_count", 0.35),
        "output_interface_compactness": compact("output_symbol_count", 0.35),
        "local_cohesion_support": (cohesion("left_internal_data_edge_count", "left_context_size") + cohesion("right_internal_data_edge_count", "right_context_size")) / 2.0,
        "call_set_change": jaccard_distance(F.col("left_calls"), F.col("right_calls"), 0.0),
        "effect_set_change": jaccard_distance(names("left_effect_histogram"), names("right_effect_histogram"), 0.0),
        "control_followup_completion": followup,
        "dependency_target_dispersion": F.when(F.col("cross_dependency_count") > 0, F.col("dependency_target_count") / F.col("cross_dependency_count")).otherwise(1.0),
        "task_completion": (F.col("completion_chain_length") == 0).cast("double"),
        "standalone_call_transition": F.col("standalone_call_transition"),
        "artifact_handoff": F.col("artifact_handoff"),
        "call_setup_completion": 1.0 - F.col("unfinished_call_setup"),
        "call_finalization_completion": 1.0 - F.col("unfinished_call_finalization"),
        "nonprimitive_call_chain": 1.0 - F.col("primitive_call_chain"),
    }


FEATURES = (
    "variable_death",
    "variable_birth",
    "interface_compactness",
    "dependency_drop",
    "medium_dependency_drop",
    "vocabulary_shift",
    "structural_completion",
    "input_interface_compactness",
    "output_interface_compactness",
    "local_cohesion_support",
    "call_set_change",
    "effect_set_change",
    "control_followup_completion",
    "dependency_target_dispersion",
    "task_completion",
    "standalone_call_transition",
    "artifact_handoff",
    "call_setup_completion",
    "call_finalization_completion",
    "nonprimitive_call_chain",
)


def boundary_features(facts: DataFrame) -> DataFrame:
    """Adds the twenty features to the facts."""
    return facts.withColumns(expressions())


def cosine_distance(left: str, right: str, epsilon: float = 1e-8) -> Column:
    """Cosine distance of two (name, count) histograms; 0 if both are empty."""
    square = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + (x["count"] * x["count"]).cast("double"))
    dot = F.aggregate(left, F.lit(0.0), lambda a, x: a + F.aggregate(right, F.lit(0.0), lambda b, y: b + F.when(x["name"] == y["name"], (x["count"] * y["count"]).cast("double")).otherwise(0.0)))
    norm = F.sqrt(square(left)) * F.sqrt(square(right))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), 0.0).otherwise(1.0 - dot / (norm + epsilon))


def features_long(featured: DataFrame) -> DataFrame:
    """key, boundary_index, feature, value."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in FEATURES))
    return featured.select(*KEY, "boundary_index", F.explode(pairs).alias("f")).select(*KEY, "boundary_index", "f.feature", "f.value")


def raw_features() -> dict[str, Column]:
    """The counts behind the features, as doubles."""
    size = lambda c: F.size(c)
    raw = {
        "dead_symbol_count": F.col("dead_symbol_count"),
        "born_symbol_count": F.col("born_symbol_count"),
        "cross_symbol_count": F.col("cross_symbol_count"),
        "input_interface_count": F.col("input_symbol_count"),
        "output_interface_count": F.col("output_symbol_count"),
        "cross_dependency_count": F.col("cross_dependency_count"),
        "local_cross_dependency_count": F.col("local_cross_dependency_count"),
        "nearby_dependency_count": F.col("nearby_dependency_count"),
        "left_internal_edge_count": F.col("left_internal_data_edge_count"),
        "right_internal_edge_count": F.col("right_internal_data_edge_count"),
        "left_call_count": size("left_calls"),
        "right_call_count": size("right_calls"),
        "left_effect_count": size("left_effect_histogram"),
        "right_effect_count": size("right_effect_histogram"),
        "control_followup_edge_count": F.col("control_followup_edge_count"),
        "dependency_target_count": F.col("dependency_target_count"),
        "raw_structural_completion": F.col("compound_ends_here").cast("int"),
        "unfinished_completion_chain": (F.col("completion_chain_length") > 0).cast("int"),
        "unfinished_call_setup": F.col("unfinished_call_setup"),
        "unfinished_call_finalization": F.col("unfinished_call_finalization"),
        "primitive_call_chain": F.col("primitive_call_chain"),
    }
    return {k: c.cast("double") for k, c in raw.items()}
