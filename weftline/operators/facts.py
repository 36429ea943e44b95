"""Windowed facts about the boundary between each statement and the next.

Boundary b (0-based) lies after statement b; the left frame is [b - w + 1, b], the right one [b + 1, b + w], both clipped
to the region. Frames are window functions over blocks of a region with the rows that their reach takes from the next
blocks. What edges over a boundary add up to changes only where edges begin and end: it is a running total of changes,
carried from block to block, so neither a long region nor a long edge is one task's work. No range join is needed.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import dependence
from weftline.operators.blocks import BLOCK, OWN, dyadic, running, with_halo
from weftline.operators.spread import lists, spread
from weftline.schema import KEY
from weftline.session import by_key, materialize

STANDALONE = ("direct_assignment", "direct_multi_output", "effect_only", "command")


def distinct(a: Column) -> Column:
    return F.sort_array(F.array_distinct(a))


def histogram(a: Column) -> Column:
    """Sorted (name, count) of a list with repeats; a column, as its expression would be evaluated for each name."""
    return F.transform(distinct(a), lambda x: F.struct(x.alias("name"), F.when(x.isNull(), 0).otherwise(F.size(a) - F.size(F.array_remove(a, x))).alias("count")))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def standalone_calls(sites: str = "call_sites") -> Column:
    return F.filter(sites, lambda c: c["is_standalone_statement"] & c["form"].isin(*STANDALONE))


def module_support(direct: str = "direct") -> Column:
    """Reliability of the one standalone call that is a statement's only operation and may stand for a module, else 0."""
    c = F.get(direct, F.lit(0))
    fits = c["is_only_operation"] & (c["abstraction"] != "primitive") & ((F.size(c["input_symbols"]) > 0) | (F.size(c["output_symbols"]) > 0) | c["form"].isin("effect_only", "command"))
    return F.when((F.size(direct) == 1) & fits, c["resolution_reliability"]).otherwise(0.0)


def with_calls(st: DataFrame) -> DataFrame:
    """Adds direct, support, outs, ins, all_primitive, callsite_reliability per statement."""
    st = st.withColumn("direct", standalone_calls())
    field = lambda name: distinct(F.flatten(F.transform("direct", lambda c: c[name])))
    return st.select(
        "*", module_support().alias("support"), field("output_symbols").alias("outs"), field("input_symbols").alias("ins"),
        ((F.size("direct") > 0) & F.forall("direct", lambda c: c["abstraction"] == "primitive")).alias("all_primitive"), F.array_min(F.transform("call_sites", lambda c: c["resolution_reliability"])).alias("site_min"),
    )


def statement_facts(st: DataFrame, window: int = 4) -> DataFrame:
    """Facts from statement frames alone; one row for each boundary."""
    return frame_facts(st, window).drop(BLOCK)


def frame_facts(st: DataFrame, window: int = 4) -> DataFrame:
    """The facts of statement frames with the block of each boundary, by which the rows are dealt."""
    st = with_halo(st, max(window, 3))
    order = Window.partitionBy(*KEY, BLOCK).orderBy("idx")
    left, right, both = order.rowsBetween(1 - window, 0), order.rowsBetween(1, window), order.rowsBetween(1 - window, window)
    st = with_calls(st).withColumn("symbols", dependence.symbols_of()).withColumn("writes", F.array_union("definitions", "mutations"))
    st = st.withColumn("used_calls", F.when(F.col("call_resolution_available"), F.array_union("resolved_calls", "unresolved_calls")).otherwise(F.col("calls")))
    risk = lambda name: F.array_contains("risks", name)
    has = lambda c: F.size(c) > 0
    kinds = F.array(F.when(has("resolved_calls"), "resolved_call"), F.when(has("unresolved_calls"), "external_or_unresolved_call"), F.when(has("resolved_indexes"), "index_access"), F.when(risk("indirect_call"), "indirect_call"))
    st = st.withColumn("call_kinds", F.filter(kinds, lambda x: x.isNotNull()))
    nxt = lambda c, k=1: F.lead(c, k).over(order)

    cols: dict[str, Column] = {"b": F.col("idx"), "boundary_index": F.col("idx") + 1, "after_line": F.col("end_line"), "before_line": nxt("start_line"), "is_last": nxt("idx").isNull(), "own_": F.col("own_")}
    # a frame's statements are collected once, with all that is told of them
    told = {"symbols": "symbols", "calls": "used_calls", "access_domains": "access_domains", "call_kind_histogram": "call_kinds", "effect_histogram": "effects", "role_histogram": "roles", "writes": "writes"}
    sets, histograms = {}, {}
    for side, w in (("left", left), ("right", right)):
        cols[f"{side}_context_size"] = F.count("*").over(w).cast("int")
        cols[f"{side}_"] = F.collect_list(F.struct(*(F.col(c).alias(n) for n, c in told.items() if side == "left" or n != "writes"))).over(w)
        for name in told:
            if side == "left" or name != "writes":
                (histograms if name.endswith("_histogram") else sets)[f"{side}_{name}"] = F.flatten(F.col(f"{side}_.{name}"))
    # call-site facts look at most three statements ahead
    cols["support"], cols["next_support"] = F.col("support"), nxt("support")
    cols["outs"], cols["next_ins"], cols["own_writes"] = F.col("outs"), nxt("ins"), F.col("writes")
    cols["next_reads"] = F.array_union(nxt("reads"), nxt("mutations"))
    cols["target_ins"] = F.coalesce(*(F.when(nxt("support", k) > 0, nxt("ins", k)) for k in (1, 2, 3)))
    cols["primitive_call_chain"] = F.coalesce(F.col("all_primitive") & nxt("all_primitive"), F.lit(False)).cast("double")
    cols["terminal_control_left"] = F.arrays_overlap("control_effects", F.array(F.lit("return"), F.lit("throw")))
    cols["compound_ends_here"] = F.col("is_compound")
    cols["forbidden"] = F.array_union("forbid_cut_after", F.coalesce(nxt("forbid_cut_before"), empty_strings()))
    cols["adjacent_ok"] = F.col("parse_reliable") & F.coalesce(nxt("parse_reliable"), F.lit(True))
    cols["risks_"], sets["all_risks"] = F.collect_list("risks").over(both), F.flatten("risks_")
    cols["parse"] = F.min(F.col("parse_reliable").cast("double")).over(both)
    cols["n_resolved"] = F.sum(F.size("resolved_calls") + F.size("resolved_indexes")).over(both)
    cols["n_unresolved"] = F.sum(F.size("unresolved_calls")).over(both)
    cols["unknown_role"] = F.max((F.array_contains("roles", "unknown") | (F.size("roles") == 0)).cast("int")).over(both) == 1
    cols["site_min"] = F.coalesce(F.min("site_min").over(both), F.lit(1.0))
    rows = st.select(*KEY, BLOCK, *(c.alias(n) for n, c in cols.items())).where("own_ and not is_last")
    # in two steps: Java doesn't compile methods of over 8,000 bytes, and interprets a whole stage that makes one
    rows = rows.withColumns(histograms).withColumns({n: distinct(c) for n, c in sets.items()} | {n: histogram(F.col(n)) for n in histograms})

    both_on = (F.col("support") > 0) & (F.col("next_support") > 0)
    share = lambda part, of: F.size(part) / F.greatest(F.lit(1), F.size(of))
    any_risk = lambda *names: F.arrays_overlap("all_risks", F.array(*map(F.lit, names)))
    dynamic, alias = any_risk("dynamic_evaluation", "workspace_injection", "global_state", "persistent_state"), any_risk("ambiguous_call_or_index", "indirect_call")
    codes = F.array(
        F.when(F.col("parse") < 1, "parse_error"), F.when(F.col("n_unresolved") > 0, "unresolved_call"), F.when(any_risk("ambiguous_call_or_index"), "ambiguous_call_index"), F.when(any_risk("indirect_call"), "indirect_call"), F.when(dynamic, "dynamic_workspace"),
        F.when(any_risk("external_dependency"), "external_dependency"), F.when(any_risk("path_dependency"), "path_dependency"), F.when(any_risk("global_state", "persistent_state"), "global_persistent_state"), F.when(F.col("unknown_role"), "unknown_role"),
    )
    reliability = F.struct(
        F.col("parse"), F.when(F.col("n_resolved") + F.col("n_unresolved") > 0, F.col("n_resolved") / (F.col("n_resolved") + F.col("n_unresolved"))).otherwise(1.0).alias("call_resolution"),
        (F.col("parse") * F.when(dynamic, 0.35).otherwise(1.0) * F.when(alias, 0.7).otherwise(1.0)).alias("dependency"), (F.col("parse") * F.when(F.col("unknown_role"), 0.7).otherwise(1.0)).alias("role"), F.col("parse").alias("effect"), (F.col("parse") * F.col("site_min")).alias("callsite"),
        dynamic.cast("double").alias("dynamic_workspace_risk"), alias.cast("double").alias("alias_uncertainty"), F.filter(codes, lambda x: x.isNotNull()).alias("reason_codes"),
    )
    return rows.select(
        *KEY, BLOCK, "b", "boundary_index", "after_line", "before_line", *(f"{s}_{n}" for s in ("left", "right") for n in ("context_size", "symbols", "calls", "access_domains", "call_kind_histogram", "effect_histogram", "role_histogram")), "left_writes",
        F.size("left_symbols").alias("left_symbol_count"), F.size("right_symbols").alias("right_symbol_count"),
        F.least("support", "next_support").alias("standalone_call_transition"), F.when(both_on, share(F.array_intersect("outs", "next_ins"), F.array_union("outs", "next_ins"))).otherwise(0.0).alias("artifact_handoff"),
        F.when(F.col("target_ins").isNotNull() & (F.col("support") == 0), share(F.array_intersect("own_writes", "target_ins"), F.col("target_ins"))).otherwise(0.0).alias("unfinished_call_setup"),
        F.when((F.col("support") > 0) & (F.col("next_support") == 0), share(F.array_intersect("outs", "next_reads"), F.col("outs"))).otherwise(0.0).alias("unfinished_call_finalization"),
        "primitive_call_chain", "terminal_control_left", "compound_ends_here",
        distinct(F.concat("forbidden", F.when(F.col("adjacent_ok"), empty_strings()).otherwise(F.array(F.lit("adjacent_parse_error"))))).alias("constraints"), F.filter("all_risks", lambda r: r != "parse_error").alias("risks"), reliability.alias("reliability"),
    )


def span_facts(st: DataFrame) -> DataFrame:
    """key, block_, b, dead_symbols, born_symbols, cross_symbols: whose last use, first use, or both sides lie at the boundary.

    Symbols are dealt to the blocks that they lie in, and only there become rows of boundaries.
    """
    first, last = F.col("first"), F.col("last")
    low, high = F.greatest(first - 1, F.col("from_"), F.lit(0)), F.greatest(F.least(last, F.col("to_")), F.lit(0))
    spans = with_halo(dependence.spans(st), last - first + 1, "last", ahead=0, ends=True).select(*KEY, BLOCK, low.alias("low"), high.alias("high"), "symbol", "first", "last")

    def make(c: dict[str, np.ndarray], b: np.ndarray, starts: np.ndarray, names: pa.Array) -> dict[str, pa.Array]:
        picks = {"dead": b == c["last"], "born": b == c["first"] - 1, "cross": (b >= c["first"]) & (b < c["last"])}
        return {f"{k}_symbols": lists(names, c["rank"], wanted, starts) for k, wanted in picks.items()}

    return spread(spans, make, "dead_symbols array<string>, born_symbols array<string>, cross_symbols array<string>")


#: Sums of 1 / (target - b) over targets far from a run of boundaries are smooth in b: they are taken at these places of the
#: run (Chebyshev points of [0, 1)) and interpolated, to within rounding. LEAF: runs of 2 ** LEAF boundaries and more.
POINTS, LEAF = 20, 4
PLACES = [0.5 - 0.5 * math.cos((2 * q + 1) * math.pi / (2 * POINTS)) for q in range(POINTS)]
PULLS = [(-1) ** q * math.sin((2 * q + 1) * math.pi / (2 * POINTS)) for q in range(POINTS)]


def far_runs() -> Column:
    """(level, node) of the aligned runs between source and target that lie at least their own length before the target,
    each as long as possible; `near` from and to the boundaries that are in none."""
    src, tgt = F.col("source"), F.col("target")

    def bounds(l: Column) -> tuple[Column, Column]:
        run = F.pow(F.lit(2.0), l)
        return F.ceil(src / run).cast("int"), F.floor(tgt / run).cast("int") - 2

    def at(l: Column) -> Column:
        first, last = bounds(l)
        above, below = bounds(l + 1)
        covered = lambda i: (above <= below) & (i >= 2 * above) & (i <= 2 * below + 1)
        # besides what longer runs cover, a level has at most one run before and two after it
        ends = F.array(first, first + 1, first + 2, last - 2, last - 1, last)
        return F.transform(F.array_distinct(F.filter(ends, lambda i: (i >= first) & (i <= last) & ~covered(i))), lambda i: F.struct(l.cast("int").alias("level"), i.alias("node")))

    levels = F.sequence(F.lit(LEAF), F.greatest(F.lit(LEAF), F.floor(F.log2((tgt - src).cast("double"))).cast("int")))
    return F.flatten(F.transform(levels, at))


def waiting(e: DataFrame) -> DataFrame:
    """key, symbol, b, inverse: summed up, the edges of a symbol over a boundary by 1 / (target - b); some rows for each."""
    src, tgt, run = F.col("source"), F.col("target"), 1 << LEAF
    first, last = (F.ceil(src / run) * run).cast("int"), ((F.floor(tgt / run) - 1) * run).cast("int")
    near = F.when(first < last, F.concat(F.when(src < first, F.sequence(src, first - 1)).otherwise(F.array().cast("array<int>")), F.sequence(last, tgt - 1))).otherwise(F.sequence(src, tgt - 1))
    rows = e.select(*KEY, "symbol", "target", F.explode(near).alias("b")).select(*KEY, "symbol", "b", (1.0 / (tgt - F.col("b"))).alias("inverse"))
    runs = e.where(first < last).select(*KEY, "symbol", "target", F.explode(far_runs()).alias("r")).select(*KEY, "symbol", "target", "r.*")
    long = F.pow(F.lit(2.0), F.col("level"))
    runs = runs.groupBy(*KEY, "symbol", "level", "node").agg(*(F.sum(1.0 / (tgt - (F.col("node") + x) * long)).alias(f"v{q}") for q, x in enumerate(PLACES)))
    place = F.explode(F.sequence(F.lit(0), long.cast("int") - 1))
    x = F.col("place") / long
    pull = [w / (x - c) for w, c in zip(PULLS, PLACES)]
    value = sum((p * F.col(f"v{q}") for q, p in enumerate(pull)), F.lit(0.0)) / sum(pull, F.lit(0.0))
    far = runs.withColumn("place", place).select(*KEY, "symbol", (F.col("node") * long + F.col("place")).cast("int").alias("b"), value.alias("inverse"))
    return rows.unionByName(far)


def symbol_loads(e: DataFrame) -> DataFrame:
    """key, b, symbol, k (its edges over the boundary), span (their lengths, summed up), targets (those that count),
    inverse (1 / (target - b), summed up), in some rows for each."""
    sums = {"k": F.lit(1), "span": F.col("target") - F.col("source"), "targets": F.col("leads").cast("int")}
    step = lambda at, sign: F.struct(F.col(at).alias("at"), *((sign * c).cast("bigint").alias(n) for n, c in sums.items()))
    steps = e.select(*KEY, "symbol", F.explode(F.array(step("source", 1), step("target", -1))).alias("s")).select(*KEY, "symbol", "s.*")
    levels = running(steps, [*KEY, "symbol"], "at", list(sums))
    until = F.lead("at").over(Window.partitionBy(*KEY, "symbol").orderBy("at")) - 1
    held = levels.withColumn("until", until).where("k > 0").select(*KEY, "symbol", *sums, F.explode(F.sequence("at", "until")).alias("b"))
    return held.withColumn("inverse", F.lit(0.0)).unionByName(waiting(e), allowMissingColumns=True)


def longest_over(e: DataFrame) -> DataFrame:
    """key, b, dependency_span_max: the longest edge over each boundary that has one, by aligned runs of boundaries."""
    runs = e.select(*KEY, (F.col("target") - F.col("source")).alias("span"), F.explode(dyadic(F.col("source"), F.col("target") - 1)).alias("r"))
    runs = runs.groupBy(*KEY, "r.level", "r.node").agg(F.max("span").alias("span"))
    # a region of n boundaries has at most n in the runs of one level
    at = F.explode(F.expr("sequence(shiftleft(node, level), shiftleft(node + 1, level) - 1)"))
    return runs.select(*KEY, "span", at.alias("b")).groupBy(*KEY, "b").agg(F.max("span").alias("dependency_span_max"))


#: edges up to this long are spread over the boundaries that they lie over
SHORT = 256


LOADS = (
    "cross_dependency_count bigint, nearby_dependency_count bigint, local_cross_dependency_count bigint, left_internal_data_edge_count bigint, right_internal_data_edge_count bigint, medium_dependency_count bigint, medium_cross_dependency_count bigint, dependency_span_mean double, dependency_span_max int, "
    "dependency_target_count bigint, dependency_reuse_mass bigint, control_followup_edge_count bigint, unfinished_work_mass double, input_symbols array<string>"
)


def with_leads(edges: DataFrame) -> DataFrame:
    """key, source, target, symbol, leads: edges that go forward, and whether a target counts by this one, its longest."""
    order = Window.partitionBy(*KEY, "target").orderBy("source", "symbol")
    return edges.where("source < target").select(*KEY, "source", "target", "symbol", (F.row_number().over(order) == 1).alias("leads"))


def loads(e: DataFrame, window: int, medium: int) -> DataFrame:
    """key, block_, b and what the edges (with_leads) around each boundary add up to; boundaries behind a region's last, and
    those of neighbouring blocks, may have rows too.

    A short edge is spread over the boundaries that it lies over or near, within its block. What longer edges add up to
    changes only where they begin and end: these are running totals of such changes, block by block. Rows for each
    boundary and symbol are made for symbols that have a longer edge over it, no more than the sets of symbols hold.
    """
    src, tgt = F.col("source"), F.col("target")
    short = max(SHORT, 2 * medium, 2 * window)
    low, high = F.greatest(F.lit(0), F.col("from_"), F.least(src, tgt - max(medium, window))), F.least(F.col("to_"), F.greatest(tgt - 1, src + max(medium, window) - 1))
    close = with_halo(e.where(tgt - src <= short), short, "target", ends=True).select(*KEY, BLOCK, "symbol", "source", "target", "leads", low.alias("low"), high.alias("high")).where("low <= high")
    far = e.where(tgt - src > short)
    long = symbol_loads(far).unionByName(longest_over(far).withColumnRenamed("dependency_span_max", "longest"), allowMissingColumns=True)
    rows = close.unionByName(with_halo(long, 0, "b").drop(OWN).withColumnsRenamed({"b": "low"}).withColumn("high", F.col("low")), allowMissingColumns=True)
    numbers = [F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in ("source", "target")] + [F.coalesce(F.col(c).cast(k), F.lit(0).cast(k)).alias(c) for c, k in (("leads", "int"), ("k", "bigint"), ("span", "bigint"), ("targets", "bigint"), ("longest", "int"), ("inverse", "double"))]

    def make(c: dict[str, np.ndarray], b: np.ndarray, starts: np.ndarray, names: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        src, tgt, edge = c["source"].astype(np.int64), c["target"].astype(np.int64), c["source"] >= 0
        over = edge & (src <= b) & (b < tgt)
        near, mid = (edge & (b >= tgt - k) & (b <= src + k - 1) for k in (window, medium))
        total = lambda x, at=starts: np.add.reduceat(x.astype(np.int64), at)
        k, span = c["k"] + over, np.where(over, tgt - src, c["span"])
        # by symbol, then by boundary
        change = np.concatenate([[True], c["rank"][1:] != c["rank"][:-1]])
        change[starts] = True
        by = np.flatnonzero(change)
        each, first = total(k, by), np.searchsorted(by, starts)
        weight = (1.0 + each) * np.add.reduceat(np.where(over, 1.0 / np.where(over, tgt - b, 1), c["inverse"]), by)
        count = total(k)
        return {
            "cross_dependency_count": count, "nearby_dependency_count": total(near), "local_cross_dependency_count": total(near & over), "left_internal_data_edge_count": total(near & (tgt <= b)), "right_internal_data_edge_count": total(near & (src > b)),
            "medium_dependency_count": total(mid), "medium_cross_dependency_count": total(mid & over), "dependency_span_mean": np.where(count > 0, total(span) / np.maximum(1, count), 0.0), "dependency_span_max": np.maximum.reduceat(np.where(over, tgt - src, c["longest"]), starts),
            "dependency_target_count": total(np.where(over, c["leads"], c["targets"])), "dependency_reuse_mass": total(each * each, first), "control_followup_edge_count": total(edge & (src == b) & (tgt <= src + min(2, window))), "unfinished_work_mass": np.add.reduceat(weight, first),
            "input_symbols": lists(names, c["rank"][by], each > 0, first),
        }

    return spread(rows.select(*KEY, BLOCK, "low", "high", "symbol", *numbers), make, LOADS)


def edge_facts(edges: DataFrame, sizes: DataFrame, window: int = 4, medium: int = 12) -> DataFrame:
    """key, b and what the def-use edges around each boundary add up to, for all boundaries of regions with edges; sizes: key, n."""
    # read three times below
    e = materialize(with_leads(edges), "edges")
    every = sizes.join(by_key(e.select(*KEY).distinct()), KEY, "left_semi").where("n > 1").select(*KEY, F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("b"))
    rows = with_halo(every, 0, "b").drop(OWN).join(by_key(loads(e, window, medium)), [*KEY, BLOCK, "b"], "left").drop(BLOCK)
    return filled(rows)


COUNTS = ("cross_dependency_count", "nearby_dependency_count", "local_cross_dependency_count", "left_internal_data_edge_count", "right_internal_data_edge_count", "medium_dependency_count", "medium_cross_dependency_count", "dependency_span_max", "dependency_target_count", "dependency_reuse_mass", "control_followup_edge_count")


def filled(rows: DataFrame) -> DataFrame:
    """Facts that no edge, symbol or chain adds anything to, as zeros and empty sets."""
    sets = ("dead_symbols", "born_symbols", "cross_symbols", "input_symbols", "completion_roles", "completion_symbols")
    fill = {c: F.coalesce(c, F.lit(0)) for c in (*COUNTS, "completion_chain_length")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("dependency_span_mean", "unfinished_work_mass")} | {c: F.coalesce(c, empty_strings()) for c in sets}
    return rows.withColumns({c: e for c, e in fill.items() if c in rows.columns})


def sizes(st: DataFrame) -> DataFrame:
    return st.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"))


PARTS = ("spans", "edges", "completion")


def boundary_facts(st: DataFrame, edges: DataFrame | None = None, window: int = 4, medium: int = 12, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One wide row of facts for each boundary. Regions of fewer than two statements have none.

    parts: which of the joined groups of facts are wanted; one that is left out costs nothing and adds no columns.
    """
    on = [*KEY, BLOCK, "b"]
    e = dependence.linear_def_use(st) if edges is None else edges
    if "edges" in parts:
        # read four times below
        e = materialize(with_leads(e), "edges")
    made = {"spans": lambda: span_facts(st), "edges": lambda: loads(e, window, medium), "completion": lambda: with_halo(completion_facts(st, e), 0, "b").drop(OWN)}
    # all sides are dealt by blocks of boundaries, so joins move no rows
    rows = filled(reduce(lambda a, p: a.join(by_key(made[p]()), on, "left"), parts, frame_facts(st, window)).drop(BLOCK))
    if "edges" in parts:
        rows = rows.withColumn("output_symbols", F.array_intersect("input_symbols", "left_writes"))
    counted = [c for c in ("dead_symbols", "born_symbols", "cross_symbols", "input_symbols", "output_symbols") if c in rows.columns]
    return rows.withColumns({f"{c.removesuffix('s')}_count": F.size(c) for c in counted}).drop("left_writes")


def completion_facts(st: DataFrame, edges: DataFrame) -> DataFrame:
    done = dependence.completion(st, edges)
    return done.select(*KEY, F.col("boundary").alias("b"), (F.col("through") - F.col("boundary")).alias("completion_chain_length"), F.col("roles").alias("completion_roles"), F.col("symbols").alias("completion_symbols"))


def canonical(c: Column, kind: str) -> Column:
    """A fact as a text that any engine writes alike: numbers as whole numbers (fractions in millionths), lists joined."""
    if kind == "double":
        c = F.round(c * 1_000_000).cast("bigint")
    elif kind.startswith("array<struct"):
        c = F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))), ",")
    elif kind.startswith("array"):
        c = F.array_join(c, ",")
    return F.coalesce(c.cast("string"), F.lit(""))


def fingerprint(facts: DataFrame) -> DataFrame:
    """key, boundary_index, fingerprint: a hash of the facts without names and lines, equal under renaming of symbols.

    It is the SHA-256 of "name=value" texts in the order of names, joined by "|"; sets of calls and access domains count
    with their sizes only.
    """
    named = {*KEY, "b", "boundary_index", "after_line", "before_line", "reliability"}
    sized = lambda c: c.endswith(("_calls", "_access_domains"))
    kinds = dict(facts.dtypes)
    told = {c: canonical(F.col(c), k) for c, k in kinds.items() if c not in named and not sized(c) and not c.endswith("_symbols")}
    told |= {f"{c}_count": F.size(c).cast("string") for c in kinds if sized(c)}
    told |= {f"reliability.{x.name}": canonical(F.col(f"reliability.{x.name}"), x.dataType.simpleString()) for x in facts.schema["reliability"].dataType.fields}
    text = F.concat_ws("|", *(F.concat(F.lit(f"{k}="), told[k]) for k in sorted(told)))
    return facts.select(*KEY, "boundary_index", F.sha2(text, 256).alias("fingerprint"))
