"""Training of the structured model: an epoch's examples, shuffled and dealt to ranges, pass one short job after another.

Each mini-batch starts from the parameters that the one before left, so an epoch is a chain. A job takes a stretch of the
shuffled examples, reads them in order and returns parameters and optimizer, some ten kilobytes, from which the next one
starts; no task holds more than a few examples, none sees more than a stretch. Making the tasks of a barrier job add up
their gradients after each mini-batch took about a second a step, the interval at which Spark looks for their messages;
a mini-batch of eight takes less in one task. What a step needs that does not depend on the parameters is made ahead by all
tasks (minibatch.py). A lost task starts its stretch anew.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import os
import random
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import energy as en
from weftline.operators import metrics, minibatch
from weftline.operators.blocks import numbered
from weftline.operators.pieces import records
from weftline.schema import KEY, VERSIONS
from weftline.session import by_key, discard, materialize


@dataclass(frozen=True)
class TrainingConfig:
    epochs: int = 50
    batch_size: int = 8
    learning_rate: float = 0.01
    weight_decay: float = 0.001
    random_seed: int = 1729
    early_stopping_patience: int = 10
    minimum_epochs: int = 15
    minimum_validation_improvement: float = 1e-5
    gradient_clip: float = 5.0
    soft_dp_temperature: float = 1.0
    boundary_auxiliary_weight: float = 0.5
    final_boundary_auxiliary_weight: float = 0.5
    final_learning_rate_ratio: float = 1.0
    schedule_epochs: int = 50
    device: str = "cpu"


def batch_gradient(examples: DataFrame, theta: np.ndarray, auxiliary: float, temperature: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of losses and gradients over a table of examples, added up per partition before they reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        losses, grad, n = np.zeros(3), np.zeros(en.SIZE), 0
        for frame in frames:
            for row in frame.to_dict("records"):
                a, b = en.loss_and_gradient(theta, en.region_of(row), [int(c) for c in row["cuts"]], temperature, auxiliary)
                losses, grad, n = losses + a, grad + b, n + 1
        yield pd.DataFrame({"v": [np.concatenate([losses, grad, [n]]).tolist()]})

    parts = [np.array(r.v) for r in examples.mapInPandas(run, "v array<double>").collect()]
    total = sum(parts, np.zeros(en.SIZE + 4))
    return total[:3], total[3:-1], int(total[-1])


class Adam:
    def __init__(self, size: int, decay: float):
        self.m, self.v, self.t, self.decay = np.zeros(size), np.zeros(size), 0, decay

    def step(self, theta: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        g = gradient + self.decay * theta
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return theta - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def cosine(epoch: int, config: TrainingConfig) -> tuple[float, float]:
    """Learning rate and auxiliary weight of an epoch."""
    s = 0.5 * (1 + math.cos(math.pi * min(1.0, (epoch - 1) / max(1, config.schedule_epochs - 1))))
    rate = config.learning_rate * (config.final_learning_rate_ratio + (1 - config.final_learning_rate_ratio) * s)
    return rate, config.final_boundary_auxiliary_weight + (config.boundary_auxiliary_weight - config.final_boundary_auxiliary_weight) * s


def validation(examples: DataFrame, theta: np.ndarray, temperature: float) -> tuple[dict[str, float], DataFrame]:
    """Losses and f1 of a model on examples, without gradients, and the evaluated examples."""
    rows = materialize(metrics.evaluate(examples, theta, temperature), "evaluated")
    legal = examples.select("sample_id", F.greatest(F.lit(1), F.size(F.filter("marks", lambda m: m["legal"]))).alias("legal"))
    loss = rows.join(by_key(legal), "sample_id").agg(F.avg("nll").alias("a"), F.avg(F.col("nll") / F.col("legal")).alias("b"), F.sum(F.size("predicted")).alias("c"), F.sum(F.size("truth")).alias("d")).first()
    f1 = [metrics.micro(metrics.matched(rows, t)).first().f1 for t in (0, 1)]
    return {"structured_nll": loss.a, "normalized_structured_nll": loss.b, "f1_exact": f1[0], "f1_tolerance_1": f1[1], "predicted_cuts": int(loss.c), "truth_cuts": int(loss.d)}, rows


@dataclass
class Selection:
    """The parameters chosen so far: by exact f1, then f1 within 1, then a loss that falls by a stated margin."""

    margin: float
    rank: tuple[float, float, float] | None = None
    epoch: int = 0
    stale: int = 0
    theta: np.ndarray | None = None

    def offer(self, epoch: int, theta: np.ndarray, v: dict[str, float]) -> bool:
        f1, loss = (v["f1_exact"], v["f1_tolerance_1"]), v["normalized_structured_nll"]
        wins = self.rank is None or (f1 > self.rank[:2] if f1 != self.rank[:2] else loss < self.rank[2] - self.margin)
        self.stale = 0 if wins else self.stale + 1
        if wins:
            self.rank, self.epoch, self.theta = (*f1, loss), epoch, theta.copy()
        return wins


#: examples that one job takes in turn
STRETCH = 8192


@functools.lru_cache(maxsize=1)
def turns(n: int, seed: int) -> np.ndarray:
    """When each place comes up in a shuffle of the places 0 to n - 1."""
    order, out = list(range(n)), np.empty(n, np.int64)
    random.Random(seed).shuffle(order)
    out[order] = np.arange(n)
    return out


def one_epoch(fit: DataFrame, n: int, epoch: int, theta: np.ndarray, adam: Adam, config: TrainingConfig) -> tuple[np.ndarray, Adam, np.ndarray]:
    """Parameters and optimizer after an epoch, and its sums of losses; fit: examples, prepared or not, with their place among n."""
    spark, seed = fit.sparkSession, config.random_seed + epoch
    rate, auxiliary = cosine(epoch, config)

    @F.pandas_udf("long")
    def turn(places: pd.Series) -> pd.Series:
        return pd.Series(turns(n, seed)[places.to_numpy()])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = fit if minibatch.KEPT in fit.columns else materialize(minibatch.prepared(fit), "fit")
    # columns that only long regions have are left out where there are none
    more = () if fit.where(F.col(minibatch.KEPT).isNull()).isEmpty() else minibatch.DROPPED
    dealt = materialize(fit.select("cuts", minibatch.KEPT, *more, turn("place").alias("turn")).repartitionByRange(parts, "turn").sortWithinPartitions("turn"), "dealt")
    each, losses = max(1, STRETCH // config.batch_size) * config.batch_size, np.zeros(3)
    for first in range(0, n, each):
        rows = dealt.where((F.col("turn") >= first) & (F.col("turn") < first + each)).coalesce(1).sortWithinPartitions("turn")
        got = np.array(rows.mapInArrow(steps(theta, adam, rate, auxiliary, config), "v array<double>").first().v)
        after = Adam(en.SIZE, adam.decay)
        lost, theta, after.m, after.v = np.split(got, [3, 3 + en.SIZE, 3 + 2 * en.SIZE])
        after.t = adam.t + -(-(min(n, first + each) - first) // config.batch_size)
        adam, losses = after, losses + lost
    discard(dealt)
    return theta, adam, losses


def steps(theta: np.ndarray, adam: Adam, rate: float, auxiliary: float, config: TrainingConfig) -> Callable:
    """A task's work: a step for each mini-batch of the examples it reads, in their order. It holds a few of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, losses = theta, adam, np.zeros(3)
        # glibc keeps up to twice the largest block freed so far for arrays to come, and hands all else back each time
        np.empty(31 << 17)
        examples = records(batches)
        while batch := list(itertools.islice(examples, config.batch_size)):
            total = minibatch.losses_and_gradient(at, batch, config.soft_dp_temperature, auxiliary)
            losses = losses + total[:3]
            at = state.step(at, clipped(total[3:] / len(batch), config.gradient_clip), rate)
        yield pa.RecordBatch.from_pydict({"v": [np.concatenate([losses, at, state.m, state.v]).tolist()]})

    return run


def clipped(gradient: np.ndarray, most: float) -> np.ndarray:
    norm = float(np.sqrt(gradient @ gradient))
    return gradient * min(1.0, most / (norm + 1e-6)) if norm > most else gradient


def train(examples: DataFrame, config: TrainingConfig = TrainingConfig(), theta: np.ndarray | None = None, progress: Callable[[dict], None] | None = None) -> dict:
    """Fits on the split train, selects on validation (Selection); test rows are never read.

    examples: sample_id, project, split, cuts and the columns of energy.region_rows.
    """
    if config.device != "cpu":
        raise RuntimeError(f"device {config.device!r} is not available")
    both = materialize(minibatch.prepared(examples.where(F.col("split").isin("train", "validation")), "train"), "examples")
    fit, held = (both.where(F.col("split") == split).drop(*unwanted) for split, unwanted in (("train", ()), ("validation", [minibatch.KEPT])))
    fit = materialize(numbered(fit, "sample_id", "place"), "fit")
    n = fit.count()
    if not n or not held.count():
        raise ValueError("training needs examples in train and in validation")
    if not fit.select("project").distinct().join(by_key(held.select("project").distinct()), "project", "left_semi").isEmpty():
        raise ValueError("project leakage between train and validation")
    adam, best, history, chosen = Adam(en.SIZE, config.weight_decay), Selection(config.minimum_validation_improvement), [], None
    theta = en.initial(config.random_seed) if theta is None else theta.copy()
    for epoch in range(1, config.epochs + 1):
        rate, auxiliary = cosine(epoch, config)
        theta, adam, losses = one_epoch(fit, n, epoch, theta, adam, config)
        v, rows = validation(held, theta, config.soft_dp_temperature)
        wins = best.offer(epoch, theta, v)
        if wins:
            rows, chosen = chosen, rows
        if rows is not None:
            discard(rows)
        mean = dict(zip(("train_structured_nll", "train_normalized_structured_nll", "train_boundary_auxiliary_loss"), (losses / n).tolist()))
        history.append({"epoch": epoch, "optimizer_updates": adam.t, "learning_rate": rate, "boundary_auxiliary_weight": auxiliary} | mean | {f"validation_{k}": x for k, x in v.items()})
        if progress:
            progress(history[-1] | {"improved": wins, "best_epoch": best.epoch, "stale_epochs": best.stale})
        if epoch >= config.minimum_epochs and best.stale >= config.early_stopping_patience:
            break
    report = [r.asDict() for r in metrics.rollup(chosen).collect()]
    return {
        "schema_version": VERSIONS["artifact"], "feature_version": VERSIONS["learned"], "energy_version": VERSIONS["energy"], "training": asdict(config),
        "selection": {"metric": "validation_f1_exact_then_tolerance_1_then_normalized_nll", "best_epoch": best.epoch, "epochs_completed": len(history), "stopped_early": len(history) < config.epochs, "optimizer_updates": adam.t, "best_value": dict(zip(("f1_exact", "f1_tolerance_1", "normalized_structured_nll"), best.rank))},
        "validation_metrics": report, "history": history, "parameters": {k: np.asarray(v).tolist() for k, v in en.unpack(best.theta).items()}, "test_status": "sealed_not_loaded",
    }


def theta_of(payload: dict) -> np.ndarray:
    return np.concatenate([np.ravel(payload["parameters"][k]).astype(float) for k in en.SHAPES])


def source_commit(folder: str) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, check=True, capture_output=True, text=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def save(payload: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True) + "\n")


def load(path: str) -> dict:
    payload = json.loads(Path(path).read_text())
    if payload.get("schema_version") != VERSIONS["artifact"]:
        raise ValueError("unsupported model schema")
    if payload.get("feature_version") != VERSIONS["learned"]:
        raise ValueError("the model's feature version does not match this engine's")
    return payload


def open_sealed_test(examples: DataFrame, dataset_sha256: str, artifact: str, report: str) -> dict:
    """Evaluates a saved model on the split test, once: a receipt beside the artifact bars a second opening."""
    receipt = artifact + ".test-opened.json"
    if Path(report).exists():
        raise FileExistsError("the report exists already")
    payload = load(artifact)
    if payload.get("dataset", {}).get("dataset_sha256") != dataset_sha256:
        raise ValueError("the dataset changed after model selection")
    claim(receipt)
    try:
        rows = metrics.rollup(metrics.evaluate(examples.where("split = 'test'"), theta_of(payload))).collect()
        result = {"schema_version": "sealed-test-report", "model_artifact_sha256": hashlib.sha256(Path(artifact).read_bytes()).hexdigest(), "dataset_sha256": dataset_sha256, "test_metrics": [r.asDict() for r in rows]}
        save(result, report)
    except BaseException:
        os.unlink(receipt)  # nothing was seen
        raise
    save({"schema_version": "sealed-test-receipt", "model_artifact_sha256": result["model_artifact_sha256"], "report": report, "report_sha256": hashlib.sha256(Path(report).read_bytes()).hexdigest()}, receipt)
    return result


def claim(receipt: str) -> None:
    """Creates a file that must not exist yet, in one step: of several that try at once, one succeeds."""
    try:
        os.close(os.open(receipt, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError:
        raise FileExistsError("the sealed test has been opened for this artifact already") from None


def examples_of(st: DataFrame, truth: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Joins regions with truth (key, sample_id, project, split, cuts); regions without truth are unlabelled and left out."""
    return en.region_rows(st, edges).join(truth.select(*KEY, "sample_id", "project", "split", "cuts"), KEY)
