"""Frontends over the driver's tables: user activity and conversations as statement sequences.

events: a region is a user, in order of (ts, event_id); the symbol is ``k<k mod 12>`` of the JSON property k. Sign-ups and
views define it, clicks and purchases read it, errors mutate it.
conversations: a region is a conversation, a statement a turn; user turns define their words, others read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.schema import CALL_SITE, checked


def _set(*pairs: tuple[Column, Column | str]) -> Column:
    """Sorted distinct values whose condition holds."""
    items = F.array(*(F.when(cond, F.lit(v) if isinstance(v, str) else v) for cond, v in pairs))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))




def _empty() -> Column:
    return F.array().cast("array<string>")


def events_statements(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    is_ = lambda *names: kind.isin(*names)
    s = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 12).cast("string"))
    rows = events.select("user_id", "ts", "event_id", kind, F.col("value"), s.alias("s"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = (F.row_number().over(order) - 1).cast("int")
    line = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("int")
    low, defines, reads, mutates = F.col("value") < 5, is_("signup", "view"), is_("click", "purchase"), is_("error")
    role = F.when(low, "unknown").when(is_("signup"), "acquisition").when(is_("view"), "transformation").when(is_("click"), "aggregation").when(is_("purchase"), "output").when(mutates, "normalization").otherwise("unknown")
    form = F.when(is_("purchase"), "effect_only").when(defines, "direct_assignment").when(mutates, "command").otherwise("condition")
    site = F.struct(
        kind.alias("name"), form.alias("form"), F.when(low, "unresolved").otherwise("user_function").alias("origin"), F.when(is_("view"), "primitive").otherwise("user_function").alias("abstraction"),
        F.when(defines, _empty()).otherwise(F.array("s")).alias("input_symbols"), F.when(defines, F.array("s")).otherwise(_empty()).alias("output_symbols"),
        (form != "condition").alias("is_standalone_statement"), (F.col("value") >= 20).alias("is_only_operation"), F.when(low, 0.65).otherwise(1.0).alias("resolution_reliability"),
    )
    return checked(
        rows.select(
            F.lit("events").alias("path"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("region_id"), idx.alias("idx"), kind.alias("kind"), line.alias("start_line"), line.alias("end_line"),
            _set((defines, F.col("s"))).alias("definitions"), _set((reads, F.col("s"))).alias("reads"), _set((mutates, F.col("s"))).alias("mutations"), _set((reads, F.concat(F.lit("props."), F.col("s")))).alias("access_domains"),
            F.array(kind).alias("calls"), _set((~low, kind)).alias("resolved_calls"), _set((is_("click") & (F.col("value") >= 50), F.col("s"))).alias("resolved_indexes"), _set((low, kind)).alias("unresolved_calls"),
            _set((is_("purchase"), "output"), (is_("signup"), "file_read")).alias("effects"), _set((mutates & (F.col("value") >= 80), "return")).alias("control_effects"), F.array(role).alias("roles"),
            _set((low, "ambiguous_call_or_index"), (mutates & (F.col("value") >= 90), "global_state"), (F.col("value") < 1, "parse_error")).alias("risks"), _empty().alias("forbid_cut_before"), _set((mutates, "error_shared_state")).alias("forbid_cut_after"),
            (is_("view") & (F.col("value") >= 50)).alias("is_compound"), (F.col("value") >= 1).alias("parse_reliable"), F.lit(True).alias("call_resolution_available"), F.array(site).cast(f"array<{CALL_SITE}>").alias("call_sites"),
        )
    )


def conversation_statements(conversations: DataFrame) -> DataFrame:
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")))
    user = F.col("role") == "user"
    none = _empty()
    return checked(
        conversations.select(
            F.lit("conversations").alias("path"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("region_id"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("kind"), F.col("turn").cast("int").alias("start_line"), F.col("turn").cast("int").alias("end_line"),
            F.when(user, words).otherwise(none).alias("definitions"), F.when(user, none).otherwise(words).alias("reads"), none.alias("mutations"), none.alias("access_domains"), F.array("role").alias("calls"), F.array("role").alias("resolved_calls"), none.alias("resolved_indexes"), none.alias("unresolved_calls"),
            none.alias("effects"), none.alias("control_effects"), F.array(F.lit("unknown")).alias("roles"), none.alias("risks"), none.alias("forbid_cut_before"), none.alias("forbid_cut_after"),
            F.lit(False).alias("is_compound"), F.lit(True).alias("parse_reliable"), F.lit(True).alias("call_resolution_available"), F.array().cast(f"array<{CALL_SITE}>").alias("call_sites"),
        )
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return events_statements(spark.read.parquet(path))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return conversation_statements(spark.read.parquet(path))
