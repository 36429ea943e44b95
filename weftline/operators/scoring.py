"""Boundary scores, peaks, prominence, rejection and the globally best selection of cuts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import dependence
from weftline.operators.facts import module_support, standalone_calls
from weftline.operators.pieces import map_rows
from weftline.operators.quality import Grid, Sweep
from weftline.schema import KEY

#: The published weights of the fifteen scored features.
WEIGHTS = {
    "variable_death": 0.06572769953051644,
    "variable_birth": 0.06572769953051644,
    "interface_compactness": 0.07511737089201878,
    "dependency_drop": 0.07511737089201878,
    "medium_dependency_drop": 0.056338028169014086,
    "vocabulary_shift": 0.06572769953051644,
    "structural_completion": 0.018779342723004695,
    "input_interface_compactness": 0.06572769953051644,
    "output_interface_compactness": 0.06572769953051644,
    "local_cohesion_support": 0.08450704225352113,
    "call_set_change": 0.056338028169014086,
    "effect_set_change": 0.018779342723004695,
    "control_followup_completion": 0.10328638497652583,
    "dependency_target_dispersion": 0.07042253521126761,
    "task_completion": 0.11267605633802817,
}


@dataclass(frozen=True)
class Config:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    threshold: float = 0.58
    prominence_radius: int = 5
    minimum_prominence: float = 0.055
    boundary_reward_weight: float = 0.85
    cut_penalty: float = 0.03
    module_quality_floor: float = 0.60
    module_deficit_penalty: float = 0.20
    allow_same_line: bool = False


def score(featured: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds score, the weighted mean of the features."""
    total = sum(config.weights.values())
    if total <= 0:
        raise ValueError("feature weights must have a positive sum")
    return featured.withColumn("score", sum((w * F.col(k) for k, w in config.weights.items()), F.lit(0.0)) / total)


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    middle = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, middle)).otherwise((F.get(s, middle - 1) + F.get(s, middle)) / 2)


def peaks(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds local_peak and prominence (score above the median of its neighbours within the radius)."""
    w = Window.partitionBy(*KEY).orderBy("b")
    r = config.prominence_radius
    around = F.concat(F.collect_list("score").over(w.rowsBetween(-r, -1)), F.collect_list("score").over(w.rowsBetween(1, r)))
    rows = scored.withColumn("around", around)
    peak = (F.col("score") >= F.lag("score", 1, -1.0).over(w)) & (F.col("score") >= F.lead("score", 1, -1.0).over(w))
    lift = F.when(F.size("around") > 0, F.greatest(F.lit(0.0), F.col("score") - median(F.col("around")))).otherwise(0.0)
    return rows.withColumn("local_peak", peak).withColumn("prominence", lift).drop("around")


def reject(peaked: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds rejection_reasons (in order) and candidate."""
    peak = F.col("local_peak")
    reasons = F.array(
        F.when(F.size("constraints") > 0, "hard_constraint"),
        F.when(F.lit(not config.allow_same_line) & (F.col("after_line") == F.col("before_line")), "same_line_boundary"),
        F.when(peak & (F.col("score") < config.threshold), "below_score_threshold"),
        F.when(peak & (F.col("prominence") < config.minimum_prominence), "low_prominence"),
    )
    rows = peaked.withColumn("rejection_reasons", F.filter(reasons, lambda x: x.isNotNull()))
    return rows.withColumn("candidate", peak & (F.size("rejection_reasons") == 0))


def interval_value(quality: np.ndarray, length: np.ndarray, total: int, config: Config) -> np.ndarray:
    return quality * length / total - config.module_deficit_penalty * np.maximum(0.0, config.module_quality_floor - quality)


def best_cuts(cuts: list[int], rewards: list[float], value: Callable[[int], np.ndarray]) -> list[int]:
    """The subset of candidate cuts (rising) with the greatest sum of rewards and interval values; none if no subset beats
    the whole region. value(k), asked for in order: of the intervals that end before cut k (k = number of cuts: that end
    the region), by their start: the region's, then each earlier cut. Earlier states win ties.
    """
    best, back = np.zeros(1), [0]
    for k, reward in enumerate(rewards):
        options = best + value(k)
        back.append(int(np.argmax(options)))
        best = np.append(best, options[back[-1]] + reward)
    final = best + value(len(cuts))
    at = 1 + int(np.argmax(final[1:])) if cuts else 0
    if final[at] <= final[0]:
        return []
    out = []
    while at:
        out.append(cuts[at - 1])
        at = back[at]
    return out[::-1]


def chosen_cuts(sweep: Sweep, cuts: list[int], rewards: list[float], config: Config) -> list[int]:
    """best_cuts over the intervals between candidates of a region; sweep: with starts 0 and the cuts."""
    columns = sweep.scored([*(c - 1 for c in cuts), sweep.n - 1])

    def value(k: int) -> np.ndarray:
        e, _, c = next(columns)
        return interval_value(c["score"], e - sweep.starts[: k + 1] + 1, sweep.n, config)

    return best_cuts(cuts, rewards, value)


def grid_input(st: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """key, n, compound, support (arrays by statement), uses, edges: one row for each region, what a Grid needs."""
    if edges is None:
        edges = dependence.linear_def_use(st).withColumn("kind", F.lit("DATA"))
    per = st.withColumn("direct", standalone_calls()).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("idx", "is_compound", module_support().alias("support"), F.array_union(F.array_union("definitions", "reads"), "mutations").alias("symbols")))).alias("rows")
    )
    linked = edges.groupBy(*KEY).agg(F.collect_list(F.struct("source", "target", "kind", "symbol")).alias("edges"))
    return per.join(linked, KEY, "left")


def uses_of(rows) -> list[tuple[int, str]]:
    return [(r["idx"], s) for r in rows for s in r["symbols"]]


def links_of(edges) -> list[tuple[int, int, str, str | None]]:
    return [(e["source"], e["target"], e["kind"], e["symbol"]) for e in (edges if edges is not None else [])]


def grid_of(rows, edges) -> Grid:
    return Grid(len(rows), links_of(edges), uses_of(rows), np.array([r["is_compound"] for r in rows]), np.array([r["support"] for r in rows]))


def sweep_of(rows, edges, starts: list[int]) -> Sweep:
    return Sweep(len(rows), links_of(edges), uses_of(rows), np.array([r["is_compound"] for r in rows]), np.array([r["support"] for r in rows]), starts)


def select(rejected: DataFrame, st: DataFrame, config: Config = Config(), edges: DataFrame | None = None) -> DataFrame:
    """Adds recommended; candidates left out get the reason not_in_global_optimum.

    One region is one task's unit of work: only intervals between candidates are scored, in one sweep over the region.
    """
    cand = rejected.where("candidate").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("boundary_index", "score", "prominence"))).alias("cuts"))
    jobs = cand.join(grid_input(st, edges), KEY)

    def run(r):
        cuts = [c["boundary_index"] for c in r["cuts"]]
        reward = [config.boundary_reward_weight * ((c["score"] - config.threshold) + (c["prominence"] - config.minimum_prominence)) - config.cut_penalty for c in r["cuts"]]
        for c in chosen_cuts(sweep_of(r["rows"], r["edges"], [0, *cuts]), cuts, reward, config):
            yield r["path"], r["region_id"], c

    chosen = map_rows(jobs, run, "path string, region_id string, boundary_index int").withColumn("recommended", F.lit(True))
    rows = rejected.join(chosen, [*KEY, "boundary_index"], "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))
    left_out = F.col("candidate") & ~F.col("recommended")
    return rows.withColumn("rejection_reasons", F.when(left_out, F.concat("rejection_reasons", F.array(F.lit("not_in_global_optimum")))).otherwise(F.col("rejection_reasons")))


def analyze(st: DataFrame, edges: DataFrame | None = None, config: Config = Config(), window: int = 4, medium: int = 12, quality: DataFrame | None = None) -> DataFrame:
    """Facts, features, scores, peaks, rejections and recommendations of every boundary."""
    from weftline.functions.features import boundary_features
    from weftline.operators.facts import boundary_facts

    data = None if edges is None else edges.where("kind = 'DATA'").select(*KEY, "source", "target", "symbol").distinct()
    rows = boundary_features(boundary_facts(st, data, window, medium))
    return select(reject(peaks(score(rows, config), config), config), st, config, quality if quality is not None else edges)
