"""Semantic task graphs: labelled synthetic programs, checked, expanded and rendered as source text.

Tables: tasks (graph_id, ordinal, task_id, role, inputs, outputs, steps, control, tail, module_id), operations (graph_id,
ordinal, op_id, task_id, role, definitions, reads, calls), edges (graph_id, source_op, target_op), boundaries (graph_id,
boundary_id, left_task_id, right_task_id, label).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK = "graph_id string, ordinal int, task_id string, role string, inputs array<string>, outputs array<string>, steps int, control string, tail int, module_id string"
OPERATION = "graph_id string, ordinal int, op_id string, task_id string, role string, definitions array<string>, reads array<string>, calls array<string>"
BOUNDARY = "graph_id string, boundary_id string, left_task_id string, right_task_id string, label string"
CONTROLS = ("none", "if", "ifelse", "for", "while", "nested", "loop_branch")
LABELS = ("cut", "no_cut", "ambiguous")


def violations(tasks: DataFrame, operations: DataFrame, edges: DataFrame, boundaries: DataFrame) -> DataFrame:
    """graph_id, error: everything that keeps a graph from being valid."""
    error = lambda df, text: df.select("graph_id", F.lit(text).alias("error")).distinct()
    twice = lambda df, *cols: df.groupBy("graph_id", *cols).count().where("count > 1")
    ops = operations.select("graph_id", "op_id").distinct()
    ids = tasks.select("graph_id", "task_id").distinct()
    missing = lambda df, col, known, key: df.withColumnRenamed(col, key).join(known, ["graph_id", key], "left_anti")
    parts = [
        error(twice(tasks, "task_id"), "task ids must be unique"), error(twice(operations, "op_id"), "operation ids must be unique"), error(tasks.where("steps < 1 or tail < 0"), "task lengths must be non-negative"), error(tasks.where(~F.col("control").isin(*CONTROLS)), "unsupported control structure"),
        error(missing(edges, "source_op", ops, "op_id").select("graph_id").unionByName(missing(edges, "target_op", ops, "op_id").select("graph_id")), "edge references an unknown operation"),
        error(missing(boundaries, "left_task_id", ids, "task_id").select("graph_id").unionByName(missing(boundaries, "right_task_id", ids, "task_id").select("graph_id")), "boundary references an unknown task"),
        error(twice(boundaries, "left_task_id", "right_task_id"), "a pair of tasks has two boundary truths"), error(boundaries.where(~F.col("label").isin(*LABELS)), "unsupported boundary label"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def boundary_truth(tasks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """graph_id, ordinal, left_task_id, right_task_id, boundary_id, label of each pair of neighbouring tasks, and cut: the
    number of operations before it. A pair without a stated truth is a cut unless both tasks belong to one module.
    """
    w = Window.partitionBy("graph_id").orderBy("ordinal")
    module = F.when(F.coalesce("module_id", F.lit("")) == "", F.col("task_id")).otherwise(F.col("module_id"))
    rows = tasks.withColumn("module", module).select("graph_id", "ordinal", F.col("task_id").alias("left_task_id"), F.lead("task_id").over(w).alias("right_task_id"), (F.col("module") == F.lead("module").over(w)).alias("same"), F.sum(F.col("steps") + F.col("tail")).over(w).cast("int").alias("cut")).where("right_task_id is not null")
    rows = rows.join(boundaries, ["graph_id", "left_task_id", "right_task_id"], "left")
    label = F.coalesce("label", F.when(F.col("same"), "no_cut").otherwise("cut"))
    return rows.select("graph_id", "ordinal", "left_task_id", "right_task_id", F.coalesce("boundary_id", F.concat("left_task_id", F.lit("->"), "right_task_id")).alias("boundary_id"), label.alias("label"), F.col("label").isNotNull().alias("stated"), "cut")


def true_cuts(tasks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """graph_id, cuts: logical positions of task boundaries that aren't labelled otherwise."""
    rows = boundary_truth(tasks, boundaries).where("not stated or label = 'cut'")
    return rows.groupBy("graph_id").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def resolved_operations(tasks: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations as stated or, for graphs without any, each task's chain of steps and completion tail."""
    derived = tasks.join(operations.select("graph_id").distinct(), "graph_id", "left_anti")
    step = F.explode(F.sequence(F.lit(1), F.col("steps") + F.col("tail"))).alias("i")
    rows = derived.select("*", step)
    out = lambda i: F.when(i > F.col("steps"), F.concat("task_id", F.lit(".final"), (i - F.col("steps")).cast("string"))).when(F.size("outputs") > 0, F.get("outputs", F.least(i, F.size("outputs")) - 1)).otherwise(F.col("task_id"))
    i = F.col("i")
    tail = i > F.col("steps")
    rows = rows.select(
        "graph_id", (F.col("ordinal") * 10_000 + i).cast("int").alias("ordinal"), F.concat("task_id", F.when(tail, F.concat(F.lit(".completion"), (i - F.col("steps")).cast("string"))).otherwise(F.concat(F.lit(".op"), i.cast("string")))).alias("op_id"), "task_id",
        F.when(tail, "shaping").otherwise(F.col("role")).alias("role"), F.array(out(i)).alias("definitions"), F.when(i == 1, F.col("inputs")).otherwise(F.array(out(i - 1))).alias("reads"), F.array().cast("array<string>").alias("calls"),
    )
    return operations.unionByName(rows)


def program_id(tasks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """graph_id, semantic_program_id: a hash of the graph's contents without its name."""
    t = tasks.groupBy("graph_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*(c for c in tasks.columns if c != "graph_id"))))).alias("t"))
    b = boundaries.groupBy("graph_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*(c for c in boundaries.columns if c != "graph_id"))))).alias("b"))
    return t.join(b, "graph_id", "left").select("graph_id", F.sha2(F.concat("t", F.coalesce("b", F.lit("[]"))), 256).alias("semantic_program_id"))


#: How an operation of each role reads as source text; {x} is its input.
TEMPLATES = {
    "acquisition": "randn(16, 1)",
    "transformation": "fft({x})",
    "aggregation": "mean({x})",
    "normalization": "({x}) / (norm({x}) + eps)",
    "shaping": "reshape({x}, [], 1)",
    "decision": "({x}) > median({x})",
    "output": "{x}",
}
#: The lines that open and close a task under each control structure; {c} is its condition.
OPENING = {
    "if": ["if any({c}(:))"],
    "ifelse": ["if any({c}(:))"],
    "for": ["for loop_index = 1:2"],
    "while": ["while any({c}(:))"],
    "nested": ["if any({c}(:))", "    if all({c}(:))"],
    "loop_branch": ["for loop_index = 1:2", "    if any({c}(:))"],
}
CLOSING = {"if": ["end"], "ifelse": ["else", "    fallback_value = 0;", "end"], "for": ["end"], "while": ["end"], "nested": ["    end", "end"], "loop_branch": ["    end", "end"]}
INDENT = 4
#: Parts of a task in the order of their lines.
HEAD, BODY, CLOSE, TAIL = range(4)
STYLES = ("vectorized", "descriptive", "reused")


class Renderer(Protocol):
    """Turns task graphs into source texts of one language, a row for each graph; `rendered` is the one for `.m` files."""

    def __call__(self, tasks: DataFrame, operations: DataFrame, boundaries: DataFrame, style: str = ..., seed: int = ...) -> DataFrame: ...


def lookup(table: dict[str, str | list[str]], key: Column) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), value(v))))[key]


def renamed(symbols: DataFrame, style: str, seed: int) -> DataFrame:
    """graph_id, names (map of symbols to identifiers) from graph_id, symbol, place (of first use).

    Identifiers are distinct within a graph: those that would be equal are numbered in order of use, by a suffix that no
    identifier has otherwise.
    """
    used = symbols.groupBy("graph_id", "symbol").agg(F.min("place").alias("place"))
    order = Window.partitionBy("graph_id").orderBy("place", "symbol")
    base = {
        "descriptive": F.concat(F.regexp_replace("symbol", r"\W", "_"), F.lit("_value")),
        "reused": F.concat(F.lit("state_"), F.row_number().over(order).cast("string")),
    }.get(style, F.concat(F.lit("v"), F.lpad(F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "symbol").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(1000)).cast("string"), 3, "0")))
    n = F.row_number().over(Window.partitionBy("graph_id", "base").orderBy("place", "symbol"))
    rows = used.withColumn("base", base).withColumn("name", F.concat("base", F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise("")))
    return rows.groupBy("graph_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "name")))).alias("names"))


def source_lines(tasks: DataFrame, operations: DataFrame, style: str, seed: int) -> DataFrame:
    """graph_id, task (ordinal), part, op (ordinal), op_id, text, names of each line of the graphs' source texts."""
    graph = tasks.select("graph_id", F.col("ordinal").alias("task"), "task_id", "control", F.coalesce(F.get("inputs", F.lit(0)), F.concat("task_id", F.lit("_condition"))).alias("condition"))
    ops = resolved_operations(tasks, operations).withColumnRenamed("ordinal", "op").join(graph, ["graph_id", "task_id"])
    target = F.coalesce(F.get("definitions", F.lit(0)), F.col("op_id"))
    shown = (F.lower("role") == "output") & (F.size("definitions") == 0)
    written = F.when(shown, F.array().cast("array<string>")).otherwise(F.array(target))
    uses = ops.select("graph_id", "task", "op", F.posexplode(F.concat("reads", written)).alias("i", "symbol"))
    conditions = graph.where("control <> 'none'").select("graph_id", "task", F.lit(-1).alias("op"), F.lit(0).alias("i"), F.col("condition").alias("symbol"))
    names = renamed(uses.unionByName(conditions).select("graph_id", "symbol", F.struct("task", "op", "i").alias("place")), style, seed)

    ops, graph = ops.join(names, "graph_id"), graph.join(names, "graph_id")
    ops = ops.withColumn("inputs", F.transform("reads", lambda r: F.col("names")[r])).withColumn("first", F.coalesce(F.get("inputs", F.lit(0)), F.lit(TEMPLATES["acquisition"])))
    joined = F.when(F.size("inputs") < 2, F.col("first")).otherwise(F.array_join(F.transform("inputs", lambda x: F.concat(F.lit("("), x, F.lit(")"))), " + "))
    value = F.when(F.size("calls") > 0, F.concat(F.get("calls", F.lit(0)), F.lit("("), "first", F.lit(")"))).otherwise(F.replace(F.coalesce(lookup(TEMPLATES, F.lower("role")), F.lit("{x} + 1")), F.lit("{x}"), joined))
    text = F.when(shown, F.concat(F.lit("disp("), value, F.lit(");"))).otherwise(F.concat(F.col("names")[target], F.lit(" = "), value, F.lit(";")))
    depth = F.coalesce(F.size(lookup(OPENING, F.col("control"))), F.lit(0))
    last = F.col("op_id").contains(".completion")
    body = ops.select("graph_id", "task", F.when(last, TAIL).otherwise(BODY).alias("part"), "op", "op_id", F.when(last, text).otherwise(F.concat(F.repeat(F.lit(" "), depth * INDENT), text)).alias("text"), "names")
    for part, table in ((HEAD, OPENING), (CLOSE, CLOSING)):
        lines = graph.where("control <> 'none'").select("graph_id", "task", F.lit(part).alias("part"), F.posexplode(lookup(table, F.col("control"))).alias("op", "text"), F.lit(None).cast("string").alias("op_id"), F.col("names")[F.col("condition")].alias("c"), "names")
        body = body.unionByName(lines.withColumn("text", F.replace("text", F.lit("{c}"), "c")).drop("c"))
    return body


def rendered(tasks: DataFrame, operations: DataFrame, boundaries: DataFrame, style: str = "vectorized", seed: int = 0) -> DataFrame:
    """One source text for each graph, with its truth: statement cuts, line ranges of tasks, lines of operations, a trace hash.

    Lines are rows: their numbers, the tasks' ranges and the cuts (logical statements before a task's end; a block counts as
    one) are running sums over a graph's rows. A graph without an operation has no text and no row.
    """
    w = Window.partitionBy("graph_id").orderBy("task", "part", "op")
    lines = source_lines(tasks, operations, style, seed).withColumn("line", F.row_number().over(w))
    counts = F.when(F.col("part") == TAIL, 1).when(F.col("control") == "none", 1).when(F.col("part") == HEAD, F.when(F.col("op") == 0, 1).otherwise(0)).otherwise(0)
    lines = lines.join(tasks.select("graph_id", F.col("ordinal").alias("task"), "control"), ["graph_id", "task"]).withColumn("counts", counts)
    text = lines.groupBy("graph_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("source"), F.first("names").alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("op_id").isNotNull(), F.struct("line", "op_id")))).alias("operations"),
    )
    ranges = lines.groupBy("graph_id", "task").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.sum("counts").alias("counts"))
    ranges = ranges.withColumn("cut", F.sum("counts").over(Window.partitionBy("graph_id").orderBy("task")).cast("int"))
    truth = boundary_truth(tasks, boundaries).select("graph_id", F.col("ordinal").alias("task"), "boundary_id", "label")
    each = ranges.join(truth, ["graph_id", "task"], "left").groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("task", "start", "end", "cut", "boundary_id", "label"))).alias("t"))
    labelled = lambda label: F.transform(F.filter("t", lambda x: x["label"] == label), lambda x: x["cut"])
    listed = lambda c, a, b: F.transform(c, lambda x: F.concat(x[a].cast("string"), F.lit(":"), x[b].cast("string")))
    rows = text.join(each, "graph_id").join(program_id(tasks, boundaries), "graph_id").select(
        "graph_id", F.lit(style).alias("style"), F.concat("source", F.lit("\n")).alias("source"), labelled("cut").alias("true_cuts"), F.transform("t", lambda x: x["start"]).alias("task_start"), F.transform("t", lambda x: x["end"]).alias("task_end"),
        F.transform(F.array_sort(F.map_entries("names")), lambda x: F.concat(x["key"], F.lit("="), x["value"])).alias("symbols"), listed("operations", "op_id", "line").alias("operation_lines"),
        listed(F.filter("t", lambda x: x["boundary_id"].isNotNull()), "boundary_id", "cut").alias("boundary_cuts"), F.array_sort(F.array_distinct(labelled("ambiguous"))).alias("ambiguous"), "semantic_program_id",
    )
    trace = F.sha2(F.concat_ws("|", "semantic_program_id", "style", F.lit(str(seed)), F.array_join("operation_lines", ","), F.array_join("boundary_cuts", ",")), 256)
    return rows.withColumn("trace", trace).drop("semantic_program_id")
