"""Project-wide symbol resolution over parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schema import KEY

INDEX = "path string, kind string, primary_name string, local_functions array<string>, calls array<string>, resolved_project_calls array<string>, unresolved_calls array<string>, diagnostics array<string>"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def worker_summary(regions: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """path, functions, has_script, calls, diagnostics, unparsed (and, with facts, counts of doubtful boundaries)."""
    calls = F.array_distinct(F.flatten(F.transform(F.coalesce("statements", F.array().cast(dict(regions.dtypes)["statements"])), lambda s: s["calls"])))
    # a file's regions come in source order from one row of the parser; the first function is the first region that is one
    rows = regions.select("path", "kind", "name", "diagnostics", calls.alias("calls"), F.monotonically_increasing_id().alias("o"))
    functions = F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "function") & F.col("name").isNotNull(), F.struct("o", "name")))), lambda x: x["name"])
    out = rows.groupBy("path").agg(functions.alias("functions"), F.max((F.col("kind") == "script").cast("int")).alias("script"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("calls")))).alias("calls"), F.first("diagnostics").alias("diagnostics"))
    failed = F.exists("diagnostics", lambda d: d.startswith("unparsed"))
    out = out.select("path", "functions", (F.coalesce("script", F.lit(0)) == 1).alias("has_script"), "calls", "diagnostics", failed.alias("unparsed"))
    if facts is None:
        return out
    count = lambda c: F.sum(c.cast("long"))
    doubt = facts.groupBy("path").agg(F.count("*").alias("raw_boundaries"), count(F.col("reliability.parse") < 1).alias("low_parse_confidence"), count(F.col("reliability.dependency") < 1).alias("low_dependency_confidence"), count(F.col("reliability.dynamic_workspace_risk") > 0).alias("dynamic_workspace_boundaries"))
    return out.join(doubt, "path", "left").na.fill(0)


def providers(summary: DataFrame) -> DataFrame:
    """name, paths: the files that can be called by each name; only a file's entry point is visible to others."""
    return summary.groupBy(stem(F.col("path")).alias("name")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def scan(summary: DataFrame) -> DataFrame:
    """The project index, one row for each file. A call that is only local counts as resolved and as unresolved."""
    provided = providers(summary).select(F.col("name").alias("call"), F.lit(True).alias("provided"))
    calls = summary.select("path", "functions", F.explode("calls").alias("call")).join(provided, "call", "left").withColumn("provided", F.coalesce("provided", F.lit(False)))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("call"))))
    sides = calls.groupBy("path").agg(pick(F.col("provided") | F.array_contains("functions", F.col("call"))).alias("resolved"), pick(~F.col("provided")).alias("unresolved"))
    none = F.array().cast("array<string>")
    kind = F.when(F.col("unparsed"), "unparsed").when(F.col("has_script") & (F.size("functions") > 0), "mixed").when(F.col("has_script"), "script").otherwise("function")
    first = F.when(~F.col("has_script"), F.get("functions", F.lit(0)))
    rows = summary.join(sides, "path", "left")
    return rows.select("path", kind.alias("kind"), F.coalesce(first, stem(F.col("path"))).alias("primary_name"), F.col("functions").alias("local_functions"), "calls", F.coalesce("resolved", none).alias("resolved_project_calls"), F.coalesce("unresolved", none).alias("unresolved_calls"), "diagnostics")


def enrich(st: DataFrame, index: DataFrame) -> DataFrame:
    """Statements whose unresolved calls are provided by the project, or local to their file, become resolved."""
    visible = index.select(stem(F.col("path")).alias("call")).distinct().withColumn("by_project", F.lit(True))
    local = index.select("path", F.explode("local_functions").alias("call")).distinct().withColumn("by_file", F.lit(True))
    calls = st.select(*KEY, "idx", F.explode("unresolved_calls").alias("call")).join(visible, "call", "left").join(local, ["path", "call"], "left")
    found = calls.where("by_project or by_file").groupBy(*KEY, "idx").agg(F.collect_set("call").alias("found"))
    rows = st.join(found, [*KEY, "idx"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    open_ = F.array_except("unresolved_calls", "found")
    sites = F.transform("call_sites", lambda c: F.when(F.array_contains("found", c["name"]), c.withField("origin", F.lit("project")).withField("abstraction", F.lit("user_function")).withField("resolution_reliability", F.lit(1.0))).otherwise(c))
    risks = F.when(F.size(open_) == 0, F.array_remove("risks", "ambiguous_call_or_index")).otherwise(F.col("risks"))
    new = {"resolved_calls": F.array_sort(F.array_union("resolved_calls", "found")), "unresolved_calls": open_, "call_sites": sites, "risks": risks, "call_resolution_available": F.lit(True)}
    return rows.withColumns(new).select(*st.columns)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).json(path)
