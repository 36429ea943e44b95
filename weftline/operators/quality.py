"""Quality of statement intervals as modules.

`interval_quality` scores any table of inclusive intervals. `Sweep`, which it uses, goes over one region's statements once
and scores, at any end, the intervals from some starts: memory follows the starts and the edges, not their pairs with
ends. `Grid` holds all intervals of one region at once.
Models take their segments from a sweep too, block by block (segments.py).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.features import hundredths
from weftline.operators import dependence
from weftline.operators.facts import standalone_calls, module_support
from weftline.operators.pieces import arrow_schema, records
from weftline.schema import KEY

#: The weights of the six interval features.
MODULE_WEIGHTS = {
    "internal_cohesion": 0.27,
    "external_compactness": 0.22,
    "symbol_locality": 0.18,
    "size_fitness": 0.14,
    "finalization_completeness": 0.12,
    "orphan_resistance": 0.07,
}


def size_fitness(n: Column) -> Column:
    return F.when(n == 1, 0.0).when(n == 2, 0.5).when(n == 3, 0.75).when(n <= 40, 1.0).otherwise(1.0 / ((1000 + 2 * (n - 40)) / 1000.0))


def windows(st: DataFrame, longest: int | None = None) -> DataFrame:
    """key, start, end: every interval, or every one of at most `longest` statements."""
    n = st.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"))
    rows = st.select(*KEY, F.col("idx").alias("start")).join(n, KEY)
    last = F.col("n") - 1 if longest is None else F.least(F.col("start") + longest - 1, F.col("n") - 1)
    return rows.select(*KEY, "start", F.explode(F.sequence("start", last)).alias("end"))


def adjacent(st: DataFrame, window: int = 4) -> DataFrame:
    """key, split, side, start, end: the intervals of up to `window` statements on both sides of each split."""
    n = st.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"))
    rows = st.select(*KEY, F.col("idx").alias("split")).where("split > 0").join(n, KEY)
    s = F.col("split")
    sides = F.array(F.struct(F.lit("left").alias("side"), F.greatest(F.lit(0), s - window).alias("start"), (s - 1).alias("end")), F.struct(F.lit("right").alias("side"), s.alias("start"), F.least(F.col("n") - 1, s + window - 1).alias("end")))
    return rows.select(*KEY, "split", F.explode(sides).alias("i")).select(*KEY, "split", "i.*")


SCORED = "path string, region_id string, start int, end int, start_line int, end_line int, internal_edge_count long, internal_control_edge_count long, input_count long, output_count long, symbol_count long, local_symbol_count long, trailing_output_count long, existing_call_support double, internal_cohesion double, external_compactness double, symbol_locality double, size_fitness double, finalization_completeness double, orphan_resistance double, score double"


def interval_quality(st: DataFrame, intervals: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """key, start, end, counts, the six features and score of distinct intervals (key, start, end).

    edges: source, target, kind (DATA or CONTROL), symbol; by default the linear def-use edges. Statements are numbered
    from 0 without gaps. A region's intervals are scored in one sweep over it, so their length costs nothing.
    """
    from weftline.operators.scoring import grid_input, sweep_of

    # one long for each interval, by end
    asked = intervals.groupBy(*KEY).agg(F.collect_set(F.shiftleft(F.col("end").cast("long"), 32) + F.col("start")).alias("asked"))
    lines = st.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "start_line", "end_line"))).alias("lines"))
    made = arrow_schema(SCORED)
    counts = {"internal_edge_count": "internal", "internal_control_edge_count": "control", "input_count": "inputs", "output_count": "outputs", "symbol_count": "symbols", "local_symbol_count": "local"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in records(batches):
            ends, starts = np.divmod(np.sort(np.array(r["asked"], np.int64)), 1 << 32)
            begin, finish = (np.array([x[c] for x in r["lines"]]) for c in ("start_line", "end_line"))
            sweep, held, rows = sweep_of(r["rows"], r["edges"], np.unique(starts).tolist()), [], 0
            wanted, first = np.unique(ends, return_index=True)
            for given, (e, m, c) in zip(np.split(starts, first[1:]), sweep.scored(wanted.tolist())):
                at = np.searchsorted(sweep.starts, given)
                told = {k: np.broadcast_to(v, m)[at] for k, v in c.items()}
                held.append(told | {name: told[k] for name, k in counts.items()} | {"start": given, "end": np.full(len(at), e), "start_line": begin[given], "end_line": np.full(len(at), finish[e]), "trailing_output_count": np.full(len(at), sweep.trailing(e))})
                rows += len(at)
                if rows > 50_000 or e == wanted[-1]:
                    cells = {x.name: np.concatenate([h[x.name] for h in held]).astype(x.type.to_pandas_dtype()) for x in made if x.name not in KEY}
                    yield pa.RecordBatch.from_arrays([pa.array(cells[x.name]) if x.name in cells else pa.repeat(r[x.name], rows) for x in made], schema=made)
                    held, rows = [], 0

    return grid_input(st, edges).join(asked, KEY).join(lines, KEY).mapInArrow(run, SCORED)


def adjacent_quality(st: DataFrame, window: int = 4, edges: DataFrame | None = None) -> DataFrame:
    """key, split, left_quality, right_quality: scores of the intervals beside each split."""
    sides = adjacent(st, window)
    scored = sides.join(interval_quality(st, sides, edges).select(*KEY, "start", "end", "score"), [*KEY, "start", "end"])
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("score"))).alias(f"{side}_quality")
    return scored.groupBy(*KEY, "split").agg(pick("left"), pick("right"))


class Grid:
    """All intervals [s, e] of one region: counts and heuristic scores as (n, n) arrays, entries with s > e undefined."""

    def __init__(self, n: int, edges: list[tuple[int, int, str, str | None]], uses: list[tuple[int, str]], compound: np.ndarray, support: np.ndarray):
        self.n = n
        shape = (n + 1, n + 1)
        points = {"DATA": np.zeros(shape), "CONTROL": np.zeros(shape)}
        seen: dict[str, dict[int, int]] = {}
        for i, s in uses:
            seen.setdefault(s, {})[i] = 1
        self.inputs, self.outputs, self.symbols, self.local = (np.zeros((n, n)) for _ in range(4))
        into: dict[str, list[tuple[int, int]]] = {}
        trailing: dict[int, set] = {}
        for a, b, kind, symbol in edges:
            if a <= b:
                points[kind][a, b] += 1
            if kind == "DATA":
                into.setdefault(symbol, []).append((a, b))
                if b > a:
                    trailing.setdefault(a, set()).add(symbol)
        # edges with s <= a and b <= e: sums towards smaller s and larger e
        counted = lambda m: np.cumsum(np.cumsum(m[::-1], 0)[::-1], 1)[:n, :n]
        self.internal, self.control = counted(points["DATA"]), counted(points["CONTROL"])
        cells = np.arange(n)
        for pairs in into.values():
            a, b = np.array(pairs).T
            forward = b > a
            a, b = a[forward], b[forward]
            if not len(a):
                continue
            # by start: the nearest target at or after s whose source lies before s; by end: the last source up to e whose target lies beyond
            first = np.where((a[None] < cells[:, None]) & (b[None] >= cells[:, None]), b[None], n).min(1)
            self.inputs += cells[None] >= first[:, None]
            last = np.where((a[None] <= cells[:, None]) & (b[None] > cells[:, None]), a[None], -1).max(1)
            self.outputs += cells[:, None] <= last[None]
        for places in seen.values():
            at = np.array(sorted(places))
            nxt = np.append(at, n)[np.searchsorted(at, cells)]
            self.symbols += cells[None] >= nxt[:, None]
            self.local += (cells[:, None] <= at[0]) & (cells[None] >= at[-1])
        self.trailing = np.array([len(trailing.get(i, ())) for i in range(n)], float)
        self.compound, self.support = np.asarray(compound, bool), np.asarray(support, float)

    def lengths(self) -> np.ndarray:
        return np.arange(self.n)[None] - np.arange(self.n)[:, None] + 1

    def features(self) -> dict[str, np.ndarray]:
        k = self.lengths()
        one = k == 1
        own = np.where(one, self.support[:, None], 0.0)
        mass = self.internal + 0.35 * self.control
        fit = np.select([k == 1, k == 2, k == 3, k <= 40], [0.0, 0.5, 0.75, 1.0], 1 / ((1000 + 2 * (k - 40.0)) / 1000))
        with np.errstate(divide="ignore", invalid="ignore"):
            return {
                "internal_cohesion": mass / (mass + np.maximum(1, k - 1)),
                "external_compactness": 1 / ((100 + 35 * (self.inputs + self.outputs)) / 100),
                "symbol_locality": np.where(self.symbols > 0, self.local / np.maximum(1, self.symbols), 1.0),
                "size_fitness": np.maximum(fit, own),
                "finalization_completeness": np.where(self.compound, 1 / (1 + self.trailing), 1.0)[None] * np.ones_like(mass),
                "orphan_resistance": np.where(one, own, 1.0),
            }

    def scores(self) -> np.ndarray:
        f = self.features()
        return sum(w * f[k] for k, w in MODULE_WEIGHTS.items())


@dataclass
class State:
    """Where a sweep stands."""

    count: dict[str, np.ndarray]
    met: dict[str, list[tuple[int, int]]] = field(default_factory=dict)  # runs of starts that a symbol already enters
    last: dict[str, int] = field(default_factory=dict)  # last uses
    open: dict[str, list[tuple[int, int]]] = field(default_factory=dict)  # heap by source, the latest first; targets
    reach: dict[str, int] = field(default_factory=dict)  # by symbol: starts up to its latest source whose target lies ahead

    def copy(self) -> State:
        return State({k: v.copy() for k, v in self.count.items()}, dict(self.met), dict(self.last), {k: list(v) for k, v in self.open.items()}, dict(self.reach))


class Sweep:
    """Intervals [s, e] of one region for given starts, with e going up: counts by start are kept as e moves on.

    edges: (source, target, kind, symbol); uses: (statement, symbol). Each edge and each use changes a run of starts.
    """

    def __init__(self, n: int, edges: list[tuple[int, int, str, str | None]], uses: list[tuple[int, str]], compound: np.ndarray, support: np.ndarray, starts: list[int]):
        self.n, self.starts, self.compound, self.support = n, np.asarray(starts), np.asarray(compound, bool), np.asarray(support, float)
        self.every = len(starts) == n  # all statements are starts
        self.into: list[list] = [[] for _ in range(n)]
        self.out: list[list] = [[] for _ in range(n)]
        self.used: list[set] = [set() for _ in range(n)]
        self.span: dict[str, list[int]] = {}
        for a, b, kind, symbol in edges:
            self.into[b].append((a, kind, symbol))
            if kind == "DATA" and b > a:
                self.out[a].append((b, symbol))
        for i, symbol in uses:
            self.used[i].add(symbol)
            span = self.span.setdefault(symbol, [i, i])
            span[0], span[1] = min(span[0], i), max(span[1], i)

    def fresh(self) -> State:
        return State({c: np.zeros(len(self.starts), np.int32) for c in ("internal", "control", "inputs", "outputs", "symbols", "local")})

    def upto(self, i: int) -> int:
        """The number of starts up to statement i."""
        return i + 1 if self.every else int(np.searchsorted(self.starts, i, "right"))

    def step(self, state: State, e: int) -> None:
        """Takes statement e in; the statements before it have been."""
        at, count = self.upto, state.count
        for a, kind, symbol in self.into[e]:
            if a <= e:
                count["internal" if kind == "DATA" else "control"][: at(a)] += 1
            if kind == "DATA" and a < e and at(a) < at(e):
                met = state.met.get(symbol, [])
                low, high = at(a), at(e)
                for i, j in gaps(met, low, high):
                    count["inputs"][i:j] += 1
                state.met[symbol] = joined(met, low, high)
        for b, symbol in self.out[e]:
            heapq.heappush(state.open.setdefault(symbol, []), (-e, b))
        for symbol in {x for _, x in self.out[e]} | {x for _, kind, x in self.into[e] if kind == "DATA" and x in state.open}:
            heap = state.open[symbol]
            while heap and heap[0][1] <= e:
                heapq.heappop(heap)
            now, was = at(-heap[0][0]) if heap else 0, state.reach.get(symbol, 0)
            count["outputs"][min(now, was) : max(now, was)] += 1 if now > was else -1
            state.reach[symbol] = now
        for symbol in self.used[e]:
            count["symbols"][at(state.last.get(symbol, -1)) : at(e)] += 1
            state.last[symbol] = e
            first, last = self.span[symbol]
            if last == e:
                count["local"][: at(first)] += 1

    def columns(self, ends: list[int]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
        """end, number of starts up to it, and by start internal, control, inputs, outputs, symbols, local, for rising ends."""
        state, e = self.fresh(), 0
        for end in ends:
            while e <= end:
                self.step(state, e)
                e += 1
            m = self.upto(end)
            yield end, m, {c: v[:m].astype(float) for c, v in state.count.items()}

    def trailing(self, e: int) -> int:
        return len({x for _, x in self.out[e]})

    def scored(self, ends: list[int]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
        """As columns(), with the six features, the end's own support and score."""
        for e, m, c in self.columns(ends):
            k = (e - self.starts[:m] + 1).astype(float)
            own = np.where(k == 1, self.support[e], 0.0)
            mass = c["internal"] + 0.35 * c["control"]
            fit = np.select([k == 1, k == 2, k == 3, k <= 40], [0.0, 0.5, 0.75, 1.0], 1 / ((1000 + 2 * (k - 40)) / 1000))
            parts = {
                "internal_cohesion": mass / (mass + np.maximum(1, k - 1)),
                "external_compactness": 1 / ((100 + 35 * (c["inputs"] + c["outputs"])) / 100),
                "symbol_locality": np.where(c["symbols"] > 0, c["local"] / np.maximum(1, c["symbols"]), 1.0),
                "size_fitness": np.maximum(fit, own),
                "finalization_completeness": np.full(m, 1 / (1 + self.trailing(e)) if self.compound[e] else 1.0),
                "orphan_resistance": np.where(k == 1, own, 1.0),
            }
            yield e, m, c | parts | {"existing_call_support": own, "score": sum((w * parts[x] for x, w in MODULE_WEIGHTS.items()), np.zeros(m))}


def gaps(runs: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """What sorted, disjoint half-open runs leave of [low, high)."""
    out = []
    for a, b in runs:
        if b > low and a < high:
            if a > low:
                out.append((low, a))
            low = max(low, b)
    return [*out, (low, high)] if low < high else out


def joined(runs: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Sorted, disjoint runs with [low, high) added."""
    apart = [r for r in runs if r[1] < low or r[0] > high]
    touch = [r for r in runs if not (r[1] < low or r[0] > high)]
    return sorted([*apart, (min([low, *(a for a, _ in touch)]), max([high, *(b for _, b in touch)]))])


GRID = "path string, region_id string, start int, end int, internal_edge_count long, input_count long, output_count long, symbol_count long, local_symbol_count long, trailing_output_count long, score double"


def module_grid(regions: DataFrame) -> DataFrame:
    """GRID: every interval of every region, end by end; regions: key, rows, edges (scoring.grid_input).

    The result has n (n + 1) / 2 rows for a region of n statements; a task holds the rows of a few ends at a time.
    """
    counts = {"internal_edge_count": "internal", "input_count": "inputs", "output_count": "outputs", "symbol_count": "symbols", "local_symbol_count": "local"}

    made = arrow_schema(GRID)

    def batch_of(r: dict, sweep: Sweep, held: list[tuple[int, int, dict[str, np.ndarray]]], rows: int) -> pa.RecordBatch:
        ends, sizes, by_end = zip(*held)
        together = lambda k: np.concatenate([c[k] for c in by_end])
        columns = {
            "start": np.concatenate([np.arange(m) for m in sizes]), "end": np.repeat(ends, sizes), **{name: together(k) for name, k in counts.items()},
            "trailing_output_count": np.repeat([sweep.trailing(e) for e in ends], sizes), "score": together("score"),
        }
        cells = [pa.array(columns[x.name].astype(x.type.to_pandas_dtype())) if x.name in columns else pa.repeat(r[x.name], rows) for x in made]
        return pa.RecordBatch.from_arrays(cells, schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftline.operators.scoring import sweep_of

        for r in records(batches):
            every = list(range(len(r["rows"])))
            sweep, held, rows = sweep_of(r["rows"], r["edges"], every), [], 0
            for e, m, c in sweep.scored(every):
                held.append((e, m, c))
                rows += m
                if rows > 50_000 or e == every[-1]:
                    yield batch_of(r, sweep, held, rows)
                    held, rows = [], 0

    return regions.mapInArrow(run, GRID)
