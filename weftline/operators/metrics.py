"""Boundary matching, roll-ups by stratum, distributions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.pieces import map_rows
from weftline.session import materialize


def match(predicted: list[int], truth: list[int], tolerance: int = 0, ignored: list[int] = ()) -> tuple[int, int, int]:
    """True positives, false positives, misses of one-to-one matching: predictions ascending, each to its nearest free
    truth within the tolerance (ties: the smaller). Repeated truths count once; unmatched predictions near ignored
    positions are no false positives.
    """
    if tolerance < 0:
        raise ValueError("tolerance must be non-negative")
    free, hits, loose = sorted(set(truth)), 0, []
    for p in sorted(predicted):
        near = min(free, key=lambda t: (abs(p - t), t), default=None)
        if near is not None and abs(p - near) <= tolerance:
            free.remove(near)
            hits += 1
        else:
            loose.append(p)
    wrong = sum(all(abs(p - i) > tolerance for i in ignored) for p in loose)
    return hits, wrong, (len(free) if ignored else len(truth) - hits)


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; without predictions (truths) a rate is 1 if there are no truths (predictions) either."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).when(tp + fn > 0, 0.0).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).when(tp + fp > 0, 0.0).otherwise(1.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def matched(samples: DataFrame, tolerance: int = 0, ignored: str | None = None) -> DataFrame:
    """Adds tp, fp, fn to samples with arrays predicted and truth. Without tolerance this is set arithmetic; with it, the
    greedy order of the matching needs one sample at a time.

    ignored: an array column; unmatched predictions within the tolerance of its positions are no false positives.
    """
    near = F.array().cast("array<int>") if ignored is None else F.coalesce(F.col(ignored).cast("array<int>"), F.array().cast("array<int>"))
    if tolerance == 0:
        hits = F.size(F.array_intersect("predicted", "truth"))
        wrong = F.size("predicted") - hits - F.size(F.array_except(F.array_intersect(F.col("predicted").cast("array<int>"), near), F.col("truth").cast("array<int>")))
        missed = F.when(F.size(near) > 0, F.size(F.array_distinct("truth"))).otherwise(F.size("truth")) - hits
        return samples.withColumns({"tp": hits, "fp": wrong, "fn": missed})

    @F.pandas_udf("tp int, fp int, fn int")
    def greedy(p: pd.Series, t: pd.Series, i: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([match(list(a), list(b), tolerance, list(c)) for a, b, c in zip(p, t, i)], columns=["tp", "fp", "fn"])

    return samples.withColumn("m_", greedy("predicted", "truth", near)).select("*", "m_.tp", "m_.fp", "m_.fn").drop("m_")


def micro(counts: DataFrame, *by: str) -> DataFrame:
    """Sums of tp, fp, fn and their rates, over all or by columns."""
    rows = counts.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return rows.select(*by, "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def length_bucket(n: Column) -> Column:
    return F.when(n < 30, "short_lt_30").when(n <= 80, "medium_30_80").otherwise("long_gt_80")


def region_kind(region_id: Column) -> Column:
    return F.when(region_id.startswith("script:"), "script").otherwise("function")


def rollup(samples: DataFrame) -> DataFrame:
    """One row for all samples, each project, region kind and length bucket (GROUPING SETS), and the mean over projects.

    samples: project, region_kind, length_bucket, predicted, truth, nll, violations.
    """
    rows = samples
    for t, name in ((0, "exact"), (1, "tolerance_1"), (2, "tolerance_2")):
        rows = matched(rows, t).withColumnsRenamed({c: f"{c}_{name}" for c in ("tp", "fp", "fn")})
    diff = F.size("predicted") - F.size("truth")
    rows = rows.withColumns({"same": (F.array_sort("predicted") == F.array_sort("truth")).cast("double"), "diff": diff})
    sets = [[], ["project"], ["region_kind"], ["length_bucket"]]
    names = ("exact", "tolerance_1", "tolerance_2")
    sums = [F.sum(f"{c}_{n}").alias(f"{c}_{n}") for n in names for c in ("tp", "fp", "fn")]
    means = [F.avg("nll").alias("structured_nll"), F.avg("same").alias("exact_segmentation_accuracy"), F.avg(F.abs("diff")).alias("average_cut_count_error"), F.avg(F.greatest("diff", F.lit(0))).alias("average_overcut"), F.avg(F.greatest(-F.col("diff"), F.lit(0))).alias("average_undercut"), F.sum("violations").alias("hard_constraint_violations")]
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], "project", "region_kind", "length_bucket").agg(F.count("*").alias("samples"), F.grouping_id().alias("gid"), *sums, *means)
    stratum = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, "project").when(F.col("gid") == 5, "region_kind").otherwise("length_bucket")
    cols = [stratum.alias("stratum"), F.coalesce("project", "region_kind", "length_bucket", F.lit("all")).alias("name"), "samples"]
    for n in names:
        p, r, f = rates(*(F.col(f"{c}_{n}") for c in ("tp", "fp", "fn")))
        cols += [p.alias(f"precision_{n}"), r.alias(f"recall_{n}"), f.alias(f"f1_{n}")]
    out = g.select(*cols, "structured_nll", "exact_segmentation_accuracy", "average_cut_count_error", "average_overcut", "average_undercut", "hard_constraint_violations")
    macro = out.where("stratum = 'project'").agg(F.lit("project_macro").alias("stratum"), F.lit("all").alias("name"), F.count("*").alias("samples"), *(F.avg(c).alias(c) for c in out.columns[3:-1]), F.sum("hard_constraint_violations").alias("hard_constraint_violations"))
    return out.unionByName(macro.where("samples > 0"))


def distribution(values: DataFrame, column: str, *by: str) -> DataFrame:
    """count, minimum, mean, p10, median; percentiles are the value at the half-even rounding of (n - 1) p, no interpolation.

    Values are counted, ranges of distinct values are dealt to tasks, and a value's ranks follow from the counts of the ranges
    before its own, so neither a list of values nor a whole group lies in one task.
    """
    tally = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c_"))
    ranged = materialize(tally.repartitionByRange(*by, column).withColumn("p_", F.spark_partition_id()), "ranges")
    rows = Window.unboundedPreceding
    sizes = ranged.groupBy(*by, "p_").agg(F.sum("c_").alias("t_"))
    # a row for each range: few
    each = Window.partitionBy(*by) if by else Window.partitionBy()
    sizes = sizes.withColumns({"n_": F.sum("t_").over(each), "before_": F.coalesce(F.sum("t_").over(each.orderBy("p_").rowsBetween(rows, -1)), F.lit(0))})
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "p_")]
    joined = ranged.alias("v").join(F.broadcast(sizes).alias("s"), same).select(*(F.col(f"v.{c}") for c in (*by, "p_", column, "c_")), "n_", "before_")
    last = F.col("before_") + F.sum("c_").over(Window.partitionBy(*by, "p_").orderBy(column).rowsBetween(rows, 0)) - 1
    joined = joined.withColumn("last_", last)
    place = lambda p: F.bround((F.col("n_") - 1) * F.lit(p))
    pick = lambda p: F.max(F.when((place(p) <= F.col("last_")) & (place(p) > F.col("last_") - F.col("c_")), F.col(column)))
    return joined.groupBy(*by).agg(F.sum("c_").alias("count"), F.min(column).alias("minimum"), (F.sum(F.col(column) * F.col("c_")) / F.sum("c_")).alias("mean"), pick(0.10).alias("p10"), pick(0.50).alias("median"))


def evaluate(examples: DataFrame, theta, temperature: float = 1.0) -> DataFrame:
    """Samples (sample_id, project, region_kind, length_bucket, predicted, truth, nll, violations) of a model on examples."""
    from weftline.operators import energy as en

    def run(row: dict) -> Iterator[tuple]:
        e, truth = en.Energy(theta, en.region_of(row)), [int(c) for c in row["cuts"]]
        cuts, _ = en.best_segmentation(e.boundary, e.segments)
        loss = en.loss(e, truth, temperature)
        yield row["sample_id"], row["project"], row["region_id"], e.region.n, cuts, truth, loss, sum(not e.legal[c - 1] for c in cuts)

    rows = map_rows(examples, run, "sample_id string, project string, region_id string, n int, predicted array<int>, truth array<int>, nll double, violations int")
    return rows.select("sample_id", "project", region_kind(F.col("region_id")).alias("region_kind"), length_bucket(F.col("n")).alias("length_bucket"), "predicted", "truth", "nll", "violations")
