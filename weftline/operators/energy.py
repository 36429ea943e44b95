"""Structured energies of segmentations, their dynamic programs and gradients, in NumPy, one region at a time.

A parameter vector of 409 numbers holds the boundary model (transforms, weights, reliability baselines, a small
interaction network), the module model and the cut penalty. Boundary scores and the scores of all half-open segments
[i, j) of a region make its energy; segments are scored block by block from a sweep and never held all at once. The hard program finds the best segmentation, the soft one the partition function
with segment and cut probabilities, from which all gradients follow by hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.features import cosine_distance, jaccard_distance, names
from weftline.operators.facts import boundary_facts
from weftline.operators.pieces import arrow_schema, map_rows
from weftline.operators.quality import MODULE_WEIGHTS, Sweep
from weftline.operators.scoring import grid_input, sweep_of
from weftline.operators.segments import Swept, best_segmentation, marginals, partition
from weftline.schema import KEY

LEARNED = (
    "death",
    "birth",
    "symbol_distance",
    "interface",
    "dependency_release",
    "reuse_release",
    "span_release",
    "role_distance",
    "call_distance",
    "effect_distance",
    "completion",
    "compound_completion",
    "access_distance",
    "terminal",
    "call_kind_distance",
    "call_transition",
    "handoff",
    "setup_done",
    "finalization_done",
    "nonprimitive",
)
#: which reliability holds for each learned feature
CHANNEL = ("parse",) * 3 + ("dependency",) * 4 + ("role", "call_resolution", "effect", "dependency", "parse", "parse", "parse", "call_resolution") + ("callsite",) * 5
HIDDEN = 16
SHAPES = {"alpha": (5,), "tau": (), "completion_bias": (), "weights": (20,), "bias": (), "baseline": (20,), "w1": (HIDDEN, 20), "b1": (HIDDEN,), "w2": (HIDDEN,), "module": (6,), "size_scale": (), "orphan_temperature": (), "cut": ()}
_ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES.values()]).tolist()
PLACES = dict(zip(SHAPES, zip([0, *_ENDS], _ENDS)))
SIZE = _ENDS[-1]


def softplus(x):
    return np.logaddexp(0.0, x)


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, float)))


def inverse_softplus(y):
    return np.log(np.expm1(y))


def unpack(theta: np.ndarray) -> dict[str, np.ndarray]:
    return {k: theta[i:j].reshape(SHAPES[k]) for k, (i, j) in PLACES.items()}


def initial(seed: int = 1729) -> np.ndarray:
    rng = np.random.default_rng(seed)
    start = {"alpha": np.full(5, inverse_softplus(1.0)), "tau": inverse_softplus(4.0), "completion_bias": 1.0, "weights": np.full(20, inverse_softplus(0.1)), "module": inverse_softplus(np.array(list(MODULE_WEIGHTS.values()))), "size_scale": inverse_softplus(3.0), "orphan_temperature": inverse_softplus(0.5), "cut": inverse_softplus(0.5)}
    bound = 1 / np.sqrt(20)
    start |= {"w1": rng.uniform(-bound, bound, SHAPES["w1"]), "b1": rng.uniform(-bound, bound, HIDDEN)}
    return np.concatenate([np.ravel(start.get(k, np.zeros(s))) for k, s in SHAPES.items()])


INPUTS = ("dead", "born", "overlap", "interface", "crossing", "reuse", "span", "unfinished", "compound", "role", "calls", "effects", "access", "terminal", "call_kinds", "transition", "handoff", "setup", "finalization", "nonprimitive")


def boundary_inputs(facts: DataFrame) -> DataFrame:
    """key, b, legal, x (INPUTS in order), r (reliability by learned feature) of each boundary, as column expressions."""
    at_least_one = lambda c: F.greatest(F.lit(1), F.col(c))
    overlap = F.least("cross_symbol_count", "left_symbol_count", "right_symbol_count")
    union = F.greatest(F.lit(1), F.col("left_symbol_count") + F.col("right_symbol_count") - overlap)
    x = {
        "dead": F.col("dead_symbol_count") / at_least_one("left_symbol_count"),
        "born": F.col("born_symbol_count") / at_least_one("right_symbol_count"),
        "overlap": overlap / union,
        "interface": F.col("input_symbol_count") + F.col("output_symbol_count"),
        "crossing": F.least(F.lit(1.0), F.col("cross_dependency_count") / at_least_one("nearby_dependency_count")),
        "reuse": F.col("dependency_reuse_mass"),
        "span": F.col("dependency_span_mean"),
        "unfinished": F.col("unfinished_work_mass"),
        "compound": F.col("compound_ends_here").cast("int"),
        "role": cosine_distance("left_role_histogram", "right_role_histogram"),
        "calls": jaccard_distance(F.col("left_calls"), F.col("right_calls"), 0.0),
        "effects": jaccard_distance(names("left_effect_histogram"), names("right_effect_histogram"), 0.0),
        "access": jaccard_distance(F.col("left_access_domains"), F.col("right_access_domains"), 0.0),
        "terminal": F.col("terminal_control_left").cast("int"),
        "call_kinds": cosine_distance("left_call_kind_histogram", "right_call_kind_histogram"),
        "transition": F.col("standalone_call_transition"),
        "handoff": F.col("artifact_handoff"),
        "setup": 1.0 - F.col("unfinished_call_setup"),
        "finalization": 1.0 - F.col("unfinished_call_finalization"),
        "nonprimitive": 1.0 - F.col("primitive_call_chain"),
    }
    legal = (F.size("constraints") == 0) & (F.col("after_line") != F.col("before_line"))
    return facts.select(*KEY, "b", legal.alias("legal"), F.array(*(x[k].cast("double") for k in INPUTS)).alias("x"), F.array(*(F.col(f"reliability.{c}") for c in CHANNEL)).alias("r"))


@dataclass
class Region:
    """What the model sees of one region."""

    x: np.ndarray
    r: np.ndarray
    legal: np.ndarray
    sweep: Sweep

    @property
    def n(self) -> int:
        return self.sweep.n


def features_of(p: dict[str, np.ndarray], x: np.ndarray) -> tuple:
    """Learned features of boundaries with inputs x, one row each, and what gradients need of them."""
    a, tau = softplus(p["alpha"]) + 1e-6, softplus(p["tau"]) + 1e-6
    col = {k: x[:, i] for i, k in enumerate(INPUTS)}
    done = sigmoid(p["completion_bias"] - a[4] * col["unfinished"] / tau)
    f = [1 - np.exp(-a[0] * col["dead"]), 1 - np.exp(-a[1] * col["born"]), 1 - col["overlap"], np.exp(-a[2] * col["interface"]), 1 - col["crossing"], np.exp(-a[3] * col["reuse"]), np.exp(-col["span"] / tau), col["role"], col["calls"], col["effects"], done, col["compound"] * done]
    f += [col[k] for k in ("access", "terminal", "call_kinds", "transition", "handoff", "setup", "finalization", "nonprimitive")]
    return np.stack(f, 1), a, tau, col, done


class Boundaries:
    """Scores of boundaries, of one region or several, under one parameter vector, kept with what gradients need."""

    def __init__(self, theta: np.ndarray, x: np.ndarray, r: np.ndarray, legal: np.ndarray):
        p = unpack(theta)
        self.p, self.r = p, r.reshape(len(x), 20)
        self.features, self.a, self.tau, self.col, self.done = features_of(p, x)
        self.effective = self.r * self.features + (1 - self.r) * sigmoid(p["baseline"])
        self.hidden = np.tanh(self.effective @ p["w1"].T + p["b1"])
        self.contributions = self.effective * softplus(p["weights"])
        value = p["bias"] + self.contributions.sum(1) + self.hidden @ p["w2"]
        self.legal = legal
        self.boundary = np.where(self.legal, value - softplus(p["cut"]), -np.inf)

        self.scale, self.heat = softplus(p["size_scale"]) + 1e-6, softplus(p["orphan_temperature"]) + 1e-6
        self.weights = softplus(p["module"])

    def gradient(self, d_boundary: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """Of a loss with these derivatives by boundary scores and (segment_slopes, summed up) by segment scores."""
        p, col, e = self.p, self.col, self.effective
        g = {k: np.zeros(s) for k, s in SHAPES.items()}
        d = np.where(self.legal, d_boundary, 0.0)
        slope = p["w2"] * (1 - self.hidden**2)
        pre = d[:, None] * slope
        g["cut"], g["bias"], g["weights"] = -d.sum() * sigmoid(p["cut"]), d.sum(), (d @ e) * sigmoid(p["weights"])
        g["w2"], g["w1"], g["b1"] = d @ self.hidden, pre.T @ e, pre.sum(0)
        de = d[:, None] * softplus(p["weights"]) + pre @ p["w1"]
        r, s = self.r, sigmoid(p["baseline"])
        g["baseline"] = (de * (1 - r)).sum(0) * s * (1 - s)
        df = de * r
        bell = self.done * (1 - self.done) * (df[:, 10] + df[:, 11] * col["compound"])
        da = np.array([(df[:, 0] * col["dead"] * np.exp(-self.a[0] * col["dead"])).sum(), (df[:, 1] * col["born"] * np.exp(-self.a[1] * col["born"])).sum(), -(df[:, 3] * col["interface"] * self.features[:, 3]).sum(), -(df[:, 5] * col["reuse"] * self.features[:, 5]).sum(), -(bell * col["unfinished"]).sum() / self.tau])
        g["alpha"] = da * sigmoid(p["alpha"])
        g["tau"] = ((df[:, 6] * self.features[:, 6] * col["span"]).sum() + self.a[4] * (bell * col["unfinished"]).sum()) / self.tau**2 * sigmoid(p["tau"])
        g["completion_bias"] = bell.sum()
        g["module"] = slopes[:6] * sigmoid(p["module"])
        g["size_scale"], g["orphan_temperature"] = slopes[6] * sigmoid(p["size_scale"]), slopes[7] * sigmoid(p["orphan_temperature"])
        return np.concatenate([np.ravel(g[k]) for k in SHAPES])


class Energy(Boundaries):
    """Boundary and segment scores of a region under one parameter vector, kept with what gradients need."""

    def __init__(self, theta: np.ndarray, region: Region):
        super().__init__(theta, region.x, region.r, region.legal)
        self.region, self.segments = region, Swept(region.sweep, self.score)

    def score(self, first: int, counts: dict[str, np.ndarray]) -> np.ndarray:
        """Scores of a block of segments; what gradients need of it is kept until the next block."""
        sweep, rows, starts = self.region.sweep, *counts["internal"].shape
        ends = np.arange(first, first + rows)
        k = (ends[:, None] - np.arange(starts)[None] + 1).astype(float)
        inside = k >= 1
        k = np.maximum(k, 1.0)
        own = np.where(inside & (k == 1), sweep.support[ends, None], 0.0)
        decay = np.exp(-np.maximum(0, k - 40) / 100)
        size = (1 - np.exp(-k / self.scale)) * decay
        orphan = sigmoid((k - 1.5) / self.heat) * (1 - ((k == 1) & (own == 0)))
        mass = counts["internal"] + 0.35 * counts["control"]
        finished = np.array([1 / (1 + sweep.trailing(e)) if sweep.compound[e] else 1.0 for e in ends])
        parts = (
            mass / (mass + np.maximum(1, k - 1)), 1 / (1 + 0.35 * (counts["inputs"] + counts["outputs"])), np.where(counts["symbols"] > 0, counts["local"] / np.maximum(1, counts["symbols"]), 1.0),
            np.maximum(size, own), np.broadcast_to(finished[:, None], k.shape), np.maximum(orphan, own),
        )
        self.at = (parts, k, own, decay, size, orphan)
        return np.where(inside, sum(w * x for w, x in zip(self.weights, parts)), -np.inf)

    def segment_slopes(self, d: np.ndarray) -> np.ndarray:
        """Sums of derivatives by segment scores over the block scored last: by the six weights, scale and heat."""
        parts, k, own, decay, size, orphan = self.at
        out = [float((d * x).sum()) for x in parts]
        out.append(-(d * self.weights[3] * (size > own) * decay * k / self.scale**2 * np.exp(-k / self.scale)).sum())
        z = sigmoid((k - 1.5) / self.heat)
        out.append(-(d * self.weights[5] * (orphan > own) * z * (1 - z) * (k - 1.5) / self.heat**2).sum())
        return np.array(out)


def segmentation_energy(boundary: np.ndarray, segments: np.ndarray, cuts: list[int]) -> float:
    points = [0, *sorted(cuts), len(segments) - 1]
    return float(sum(segments[i, j] for i, j in zip(points, points[1:])) + sum(boundary[c - 1] for c in cuts))


def log_partition(boundary: np.ndarray, segments, temperature: float = 1.0) -> float:
    return partition(boundary, segments, temperature)[0]


def soft(boundary: np.ndarray, segments: np.ndarray, temperature: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """T times the log partition function, the probability of each cut, and of each segment, for a table of scores."""
    chance = np.zeros(segments.shape)

    def visit(first: int, block: np.ndarray) -> None:
        chance[: block.shape[1], first + 1 : first + 1 + len(block)] = block.T

    z, cut, _ = marginals(boundary, segments, temperature, visit=visit)
    return z, cut, chance


def check_truth(legal: np.ndarray, n: int, cuts: list[int]) -> None:
    if any(c < 1 or c >= n for c in cuts):
        raise ValueError("ground-truth cut lies outside the region")
    if any(not legal[c - 1] for c in cuts):
        raise ValueError("ground-truth cut violates a hard constraint")


def loss(energy: Energy, cuts: list[int], temperature: float = 1.0) -> float:
    """Structured loss without derivatives."""
    check_truth(energy.legal, energy.region.n, cuts)
    z, along = partition(energy.boundary, energy.segments, temperature, [0, *sorted(cuts), energy.region.n])
    return z - along - float(sum(energy.boundary[c - 1] for c in cuts))


def nll(energy: Energy, cuts: list[int], temperature: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Structured loss, its derivatives by boundary scores, and Energy.segment_slopes of those by segment scores."""
    check_truth(energy.legal, energy.region.n, cuts)
    points, slopes = [0, *sorted(cuts), energy.region.n], np.zeros(8)

    def visit(first: int, chance: np.ndarray) -> None:
        nonlocal slopes
        for i, j in zip(points, points[1:]):
            if first < j <= first + len(chance):
                chance[j - 1 - first, i] -= 1
        slopes += energy.segment_slopes(chance)

    z, cut, along = marginals(energy.boundary, energy.segments, temperature, points, visit)
    d_cut = cut.copy()
    for c in cuts:
        d_cut[c - 1] -= 1
    return z - along - float(sum(energy.boundary[c - 1] for c in cuts)), d_cut, slopes


def balanced_bce(energy: Energy, cuts: list[int]) -> tuple[float, np.ndarray]:
    """Mean over the present classes of the mean logistic loss on legal boundaries, and its derivative."""
    d = np.zeros(len(energy.boundary))
    at = np.flatnonzero(energy.legal)
    if not len(at):
        return 0.0, d
    v, t = energy.boundary[at], np.isin(at + 1, cuts)
    classes = [c for c in (t, ~t) if c.any()]
    each = np.where(t, softplus(-v), softplus(v))
    slope = sigmoid(v) - t
    for c in classes:
        d[at[c]] = slope[c] / c.sum() / len(classes)
    return float(np.mean([each[c].mean() for c in classes])), d


def loss_and_gradient(theta: np.ndarray, region: Region, cuts: list[int], temperature: float = 1.0, auxiliary: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(structured loss, loss per legal boundary, balanced loss), gradient of the second plus auxiliary times the third."""
    e = Energy(theta, region)
    loss, d_cut, slopes = nll(e, cuts, temperature)
    if not np.isfinite(loss):
        raise FloatingPointError("non-finite structured loss")
    scale = max(1, int(e.legal.sum()))
    extra, d_extra = balanced_bce(e, cuts)
    return np.array([loss, loss / scale, extra]), e.gradient(d_cut / scale + auxiliary * d_extra, slopes / scale)


def data_edges(edges: DataFrame | None) -> DataFrame | None:
    return None if edges is None else edges.where("kind = 'DATA'").select(*KEY, "source", "target", "symbol").distinct()


def region_rows(st: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """key, rows, edges, marks (b, legal), x and r (those of the marks, one after another): one row for each region, what a
    Region needs."""
    marks = boundary_inputs(boundary_facts(st, data_edges(edges), parts=("spans", "edges"))).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("b", "legal", "x", "r"))).alias("marks"))
    marks = marks.select(*KEY, F.arrays_zip(F.col("marks.b").alias("b"), F.col("marks.legal").alias("legal")).alias("marks"), F.flatten("marks.x").alias("x"), F.flatten("marks.r").alias("r"))
    rows = grid_input(st, edges).join(marks, KEY, "left")
    # so many parts that adaptive execution doesn't put them together: rows are small, the work on each is not
    return rows.repartition(int(st.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def learned_features(st: DataFrame, theta: np.ndarray, edges: DataFrame | None = None) -> DataFrame:
    """key, boundary_index, features of each boundary. A boundary's features follow from its facts: no region is put together."""
    p, schema = unpack(theta), "path string, region_id string, boundary_index int, features array<double>"
    made = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features_of(p, batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(INPUTS)))[0]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * f.shape[1], pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch["path"], batch["region_id"], pa.array(batch["b"].to_numpy() + 1, pa.int32()), listed], schema=made)

    return boundary_inputs(boundary_facts(st, data_edges(edges), parts=("spans", "edges"))).select(*KEY, "b", "x").mapInArrow(run, schema)


def region_of(row) -> Region:
    marks = row["marks"] if row["marks"] is not None else []
    x, r = (np.array([] if row[c] is None else row[c], float).reshape(-1, 20) for c in ("x", "r"))
    return Region(x, r, np.array([m["legal"] for m in marks], bool), sweep_of(row["rows"], row["edges"], list(range(len(row["rows"])))))


def structured_analysis(st: DataFrame, theta: np.ndarray, edges: DataFrame | None = None, temperature: float = 1.0) -> DataFrame:
    """key, boundary_index, energy, probability (of a cut), features, recommended, best_energy, log_partition per boundary."""

    def run(row: dict) -> Iterator[tuple]:
        e = Energy(theta, region_of(row))
        cuts, best = best_segmentation(e.boundary, e.segments)
        z, chance, _ = marginals(e.boundary, e.segments, temperature)
        chosen = set(cuts)
        for i, v in enumerate(e.boundary):
            reason = None if i + 1 in chosen else "hard_constraint" if not e.legal[i] else "not_in_structured_optimum"
            yield row["path"], row["region_id"], i + 1, float(v) if np.isfinite(v) else None, float(chance[i]), e.features[i].tolist(), i + 1 in chosen, reason, best, z

    schema = "path string, region_id string, boundary_index int, energy double, probability double, features array<double>, recommended boolean, reason string, best_energy double, log_partition double"
    return map_rows(region_rows(st, edges), run, schema)
