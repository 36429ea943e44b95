"""Losses and gradients of a mini-batch's regions together, in NumPy.

A training step waits for the one before it, so what does not depend on the parameters is done ahead, in tasks: `prepared`
goes over each region's statements once and keeps the counts of all its segments, end by end, as small integers. A step then
scores the segments of a whole mini-batch at once and goes over their ends once forward and once backward, for all regions
together. The programs add up exponentials, brought back to a largest one of 1 every few ends; where scores are too far
apart for that, and in regions of more than `MOST` statements, regions are taken one by one (energy.py).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.operators import energy as en
from weftline.operators.pieces import arrow_schema

#: statements of a region whose segments' counts are kept, regions taken together, rows prepared at a time
MOST, TOGETHER, SLICE = 256, 16, 64
#: ends between two rescalings, and the most that scores may grow from one end to the next (as logarithms)
STRIDE, GROWTH = 16, 20.0
NAMES = ("internal", "control", "links", "symbols", "local")
KINDS = (np.uint8, np.uint16, np.int32)
#: end, start and length of each segment, end by end: a shorter region's are the first of them
END, START = np.tril_indices(MOST)
LENGTH = END - START + 1
#: where the segments of one statement are among these
LONE = np.arange(MOST) * (np.arange(MOST) + 3) // 2


def cells_of(n: int, source: np.ndarray, target: np.ndarray, data: np.ndarray, symbol: np.ndarray, used: np.ndarray, by: np.ndarray) -> np.ndarray:
    """NAMES by segment, end by end: what quality.Sweep counts, from edges (data or control; symbol) and uses (used: symbol, by:
    statement); symbols as small numbers. Each thing counted is a point from which it holds for longer segments."""
    names = 1 + int(max(symbol.max(initial=-1), used.max(initial=-1)))
    points = lambda i, j: np.bincount(i * n + j, minlength=n * n).reshape(n, n)
    later = lambda m: np.cumsum(m, 1)
    earlier = lambda m: np.cumsum(m[::-1], 0)[::-1]
    ahead = source <= target
    internal, control = (earlier(later(points(source[k], target[k]))) if k.any() else np.zeros((n, n), int) for k in (ahead & data, ahead & ~data))
    crossing = data & (source < target)
    edges = list(zip(source[crossing].tolist(), target[crossing].tolist(), symbol[crossing].tolist()))
    # by symbol: the first target from a start on whose source lies before it, the last source up to an end whose target lies behind
    into, out = np.full((names, n), n), np.full((names, n), -1)
    for a, b, x in sorted(edges, key=lambda e: -e[1]):
        into[x, a + 1 : b + 1] = b
    for a, b, x in sorted(edges):
        out[x, a:b] = a
    (x, start), (y, end) = np.nonzero(into < n), np.nonzero(out >= 0)
    links = later(points(start, into[x, start])) + earlier(points(out[y, end], end))
    uses = np.full((names, n), n)
    uses[used, by] = by
    following = np.minimum.accumulate(uses[:, ::-1], 1)[:, ::-1]
    x, start = np.nonzero(following < n)
    symbols = later(points(start, following[x, start]))
    x = np.unique(used)
    local = earlier(later(points(following[x, 0], np.where(uses[x] < n, uses[x], -1).max(1, initial=-1))))
    m = n * (n + 1) // 2
    cells = np.stack([c[START[:m], END[:m]] for c in (internal, control, links, symbols, local)])
    return cells.astype(next(k for k in KINDS if cells.max(initial=0) <= np.iinfo(k).max))


KEPT = "packed"
DROPPED = ("rows", "edges", "marks", "x", "r")
#: statements, bytes without compression
HEAD = struct.Struct("<ii")


def prepared(examples: DataFrame, split: str | None = None) -> DataFrame:
    """Adds KEPT, a Short's arrays as bytes, for regions (of that split, if given) of up to MOST statements; these have nulls
    in DROPPED. Compressed, for all that a step's task reads passes through one core."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in examples.schema), T.StructField(KEPT, T.BinaryType())])
    made = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                wanted = np.ones(b.num_rows, bool) if split is None else pc.fill_null(pc.equal(b["split"], split), False).to_numpy(zero_copy_only=False)
                found = kept(b, wanted)
                still = pa.array([at if f is None else None for at, f in enumerate(found)], pa.int64())
                cells = {c: b[c].take(still) if c in DROPPED else b[c] for c in b.schema.names} | {KEPT: pa.array(found, pa.binary())}
                yield pa.RecordBatch.from_arrays([cells[x.name].cast(x.type) for x in made], schema=made)

    return examples.mapInArrow(run, schema)


def kept(b: pa.RecordBatch, wanted: np.ndarray) -> list[bytes | None]:
    """KEPT of each row that is wanted and short."""

    def listed(c: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return c.flatten(), np.cumsum([0, *pc.fill_null(pc.list_value_length(c), 0).to_pylist()])

    def fields(c: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray]:
        values, ends = listed(c)
        return dict(zip((f.name for f in values.type), values.flatten())), ends

    numbers = lambda c: c.to_numpy(zero_copy_only=False)
    (rows, of), (edges, to), (marks, at), (x, x_at), (r, r_at) = fields(b["rows"]), fields(b["edges"]), fields(b["marks"]), listed(b["x"]), listed(b["r"])
    symbols, uses = listed(rows["symbols"])
    coded = numbers(pc.dictionary_encode(pa.concat_arrays([symbols, edges["symbol"].cast(symbols.type)]), null_encoding="encode").indices)
    used, symbol = coded[: len(symbols)], coded[len(symbols) :]
    compound, support, x, r = numbers(rows["is_compound"]).astype(bool), numbers(rows["support"]).astype(float), numbers(x).astype(float), numbers(r).astype(float)
    source, target, data, legal = numbers(edges["source"]), numbers(edges["target"]), numbers(pc.equal(edges["kind"], "DATA")).astype(bool), numbers(marks["legal"]).astype(bool)
    out: list[bytes | None] = []
    for k, ok in enumerate(wanted):
        n = int(of[k + 1] - of[k])
        if not ok or not 0 < n <= MOST or any(i[k + 1] - i[k] != m * (n - 1) for i, m in ((at, 1), (x_at, 20), (r_at, 20))):
            out.append(None)
            continue
        e, u = slice(to[k], to[k + 1]), slice(uses[of[k]], uses[of[k + 1]])
        by = np.repeat(np.arange(n), np.diff(uses[of[k] : of[k + 1] + 1]))
        small = np.unique(np.concatenate([used[u], symbol[e]]), return_inverse=True)[1]
        by_use, by_edge = small[: len(by)], small[len(by) :]
        a, t = source[e], target[e]
        leaving = np.unique(np.stack([a, by_edge], 1)[data[e] & (t > a)], axis=0)[:, 0]
        finished = np.where(compound[of[k] : of[k + 1]], 1 / (1 + np.bincount(leaving, minlength=n)), 1.0)
        values = finished, support[of[k] : of[k + 1]], x[x_at[k] : x_at[k + 1]], r[r_at[k] : r_at[k + 1]], legal[at[k] : at[k + 1]], cells_of(n, a, t, data[e], by_edge, by_use, by)
        whole = b"".join(v.tobytes() for v in values)
        out.append(HEAD.pack(n, len(whole)) + pa.compress(whole, "zstd", asbytes=True))
    return out


@dataclass
class Short:
    """A region with the counts of all its segments."""

    x: np.ndarray
    r: np.ndarray
    legal: np.ndarray
    finished: np.ndarray
    own: np.ndarray
    counts: np.ndarray
    cuts: list[int]

    @property
    def n(self) -> int:
        return len(self.own)


def short_of(row: dict) -> Short:
    n, size = HEAD.unpack_from(row[KEPT])
    whole = pa.decompress(memoryview(row[KEPT])[HEAD.size :], size, "zstd")
    m, numbers = n - 1, 2 * n + 40 * (n - 1)
    finished, own, x, r = np.split(np.frombuffer(whole, count=numbers), [n, 2 * n, 2 * n + 20 * m])
    wide = (size - 8 * numbers - m) // (len(NAMES) * n * (n + 1) // 2)
    cells = np.frombuffer(whole, next(k for k in KINDS if np.dtype(k).itemsize == wide), offset=8 * numbers + m)
    return Short(x.reshape(m, 20), r.reshape(m, 20), np.frombuffer(whole, bool, m, 8 * numbers), finished, own, cells.reshape(len(NAMES), -1), [int(c) for c in row["cuts"]])


def losses_and_gradient(theta: np.ndarray, rows: list[dict], temperature: float = 1.0, auxiliary: float = 0.5) -> np.ndarray:
    """Sums over prepared rows of the three losses and the gradient of energy.loss_and_gradient, one after another."""
    total, short = np.zeros(3 + en.SIZE), [short_of(r) for r in rows if r[KEPT] is not None]
    for i in range(0, len(short), TOGETHER):
        total = total + of_short(theta, short[i : i + TOGETHER], temperature, auxiliary)
    for r in rows:
        if r[KEPT] is None:
            total = total + np.concatenate(en.loss_and_gradient(theta, en.region_of(r), [int(c) for c in r["cuts"]], temperature, auxiliary))
    return total


def of_short(theta: np.ndarray, regions: list[Short], temperature: float, auxiliary: float) -> np.ndarray:
    regions = sorted(regions, key=lambda s: -s.n)
    n = np.array([s.n for s in regions])
    sizes = n * (n + 1) // 2
    at, ids, longest = np.cumsum(sizes) - sizes, np.arange(len(n)), int(n[0])
    e = en.Boundaries(theta, *(np.concatenate([getattr(s, c) for s in regions]) for c in ("x", "r", "legal")))
    for s, v in zip(regions, np.split(e.legal, np.cumsum(n - 1)[:-1])):
        en.check_truth(v, s.n, s.cuts)
    finished, own = (np.concatenate([getattr(s, c) for s in regions]) for c in ("finished", "own"))

    # scores of segments but for what their ends add
    internal, control, links, symbols, local = np.concatenate([s.counts for s in regions], 1)
    length = np.concatenate([LENGTH[:m] for m in sizes])
    lone = np.concatenate([a + LONE[:m] for a, m in zip(at, n)])
    mass = internal + 0.35 * control if control.any() else internal.astype(float)
    parts = (mass / (mass + np.maximum(1, length - 1)), 1 / (1 + 0.35 * links), np.where(symbols > 0, local / np.maximum(1, symbols), 1.0))
    k = np.arange(1.0, longest + 1)
    decay, z = np.exp(-np.maximum(0, k - 40) / 100), en.sigmoid((k - 1.5) / e.heat)
    size = (1 - np.exp(-k / e.scale)) * decay
    alone = z[0] * (own != 0)
    own_size, own_orphan = np.maximum(size[0], own), np.maximum(alone, own)
    w = e.weights
    by_length = w[3] * size + w[5] * z
    by_length[0] = 0.0
    scores = w[0] * parts[0] + w[1] * parts[1] + w[2] * parts[2] + by_length[length - 1]
    scores[lone] += w[3] * own_size + w[5] * own_orphan

    # what is added where a segment ends: the cut behind it, and its end's own part
    cell = np.repeat(ids, n - 1), np.concatenate([np.arange(1, m) for m in n])
    last = np.repeat(ids, n), np.concatenate([np.arange(1, m + 1) for m in n])
    entry, ending = np.zeros((2, len(n), longest + 1))
    entry[cell], ending[last] = e.boundary, w[4] * finished
    total, cut, chance = marginals(n, at, scores, entry, ending, temperature)

    # less the stated segmentation
    points = [np.array([0, *sorted(s.cuts), s.n]) for s in regions]
    true = np.concatenate([a + p[1:] * (p[1:] - 1) // 2 + p[:-1] for a, p in zip(at, points)])
    of = np.repeat(ids, [len(p) - 1 for p in points])
    behind = np.concatenate([p[1:] for p in points])
    nll = temperature * total - np.bincount(of, scores[true] + ending[of, behind] + entry[of, behind], len(n))
    if not np.isfinite(nll).all():
        raise FloatingPointError("non-finite structured loss")
    chance[true] -= 1
    stated = np.zeros(entry.shape)
    stated[of, behind] = 1.0
    truth = stated[cell]
    scale = np.maximum(1, np.bincount(cell[0], e.legal, len(n)))
    chance /= np.repeat(scale, sizes)
    d_cut = (cut[cell] - truth) / scale[cell[0]]

    # derivatives by what segments are scored with
    each, one = np.bincount(length - 1, chance, longest), chance[lone]
    each[0] = 0.0
    grown, bent = decay * k / e.scale**2 * np.exp(-k / e.scale), z * (1 - z) * (k - 1.5) / e.heat**2
    inner = finished[np.concatenate([np.arange(m - 1) + f for m, f in zip(n, np.cumsum(n) - n)])]
    slopes = [
        *(float(chance @ p) for p in parts), each @ size + one @ own_size, d_cut @ inner, each @ z + one @ own_orphan,
        -w[3] * (each @ grown + one @ (size[0] > own) * grown[0]), -w[5] * (each @ bent + one @ (alone > own) * bent[0]),
    ]
    extra, d_extra = balanced_bce(e, cell[0], truth, len(n))
    gradient = e.gradient(d_cut + auxiliary * d_extra, np.array(slopes))
    return np.concatenate([[nll.sum(), (nll / scale).sum(), extra], gradient])


def balanced_bce(e: en.Boundaries, of: np.ndarray, truth: np.ndarray, regions: int) -> tuple[float, np.ndarray]:
    """The sum over regions of energy.balanced_bce, and its derivative."""
    legal, d = np.flatnonzero(e.legal), np.zeros(len(e.legal))
    v, t, of = e.boundary[legal], truth[legal], of[legal]
    kind = 2 * of + t.astype(int)
    count = np.bincount(kind, minlength=2 * regions)
    classes = (count.reshape(regions, 2) > 0).sum(1)
    share = 1.0 / (count[kind] * classes[of])
    d[legal] = (en.sigmoid(v) - t) * share
    return float(en.softplus(np.where(t > 0, -v, v)) @ share), d


def marginals(n: np.ndarray, at: np.ndarray, scores: np.ndarray, entry: np.ndarray, ending: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By region the log partition function, the probability of each cut, and by segment its own; n falls.

    A segment from i to j scores scores[i, j] + ending[j], a cut at j entry[j].
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    b, longest = len(n), int(n[0])
    behind = entry + ending
    most = np.abs(scores).max() + np.abs(behind[np.isfinite(behind)]).max()
    if not most / temperature + np.log(longest) <= GROWTH:
        return one_by_one(n, at, scores, entry, ending, temperature)
    sizes = n * (n + 1) // 2
    inner, behind = scores / temperature, behind / temperature
    x, e = np.exp(behind), np.exp(inner)
    # by end, then by region; and the other way round, by start, both counted from the regions' ends
    having = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    first = np.concatenate([[0], np.cumsum(having * np.arange(1, longest + 1))])
    onward, back = np.empty((2, first[-1]))
    place = first[END[: sizes[0]]] + START[: sizes[0]]
    for i, (m, c) in enumerate(zip(n, sizes)):
        own = e[at[i] : at[i] + c]
        onward[place[:c] + i * (END[:c] + 1)] = own
        back[first[m - 1 - START[:c]] + i * (m - START[:c]) + (m - 1 - END[:c])] = own
    regions, mirrored = np.arange(b), np.maximum(0, n[:, None] - np.arange(longest + 1))
    ahead = sums_of(onward, first, having, x)
    behind_too = np.take_along_axis(sums_of(back, first, having, np.take_along_axis(x, mirrored, 1)), mirrored, 1)
    total = ahead[regions, n]
    ahead = ahead - total[:, None]
    cut = np.exp(np.where(x > 0, ahead + behind_too - np.where(x > 0, behind, 0.0), -np.inf))
    chance = inner
    for i, c in enumerate(sizes):
        own = chance[at[i] : at[i] + c]
        own += ahead[i].take(START[:c])
        own += behind_too[i, 1:].take(END[:c])
    return total, cut, np.exp(chance, out=chance)


def sums_of(e: np.ndarray, first: np.ndarray, having: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Logarithms of a[0] = x[0], a[j] = x[j] * (the sum of a[i] * e[i, j] over i before j), by region.

    e: blocks of one j, from first[j - 1], of the regions that have it (the first ones), by i.
    """
    out, a, shift = np.empty(x.shape), np.zeros(x.shape), np.zeros(len(x))
    a[:, 0] = x[:, 0]
    with np.errstate(divide="ignore"):
        for low in range(0, len(first), STRIDE):
            high = min(len(first), low + STRIDE)
            for j in range(max(1, low), high):
                h = having[j - 1]
                a[:h, j] = np.vecdot(e[first[j - 1] : first[j]].reshape(h, j), a[:h, :j]) * x[:h, j]
            out[:, low:high] = np.log(a[:, low:high]) + shift[:, None]
            top = a[:, :high].max(1)
            a[:, :high] /= top[:, None]
            shift = shift + np.log(top)
    return out


def one_by_one(n: np.ndarray, at: np.ndarray, scores: np.ndarray, entry: np.ndarray, ending: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As marginals, by logarithms all through."""
    total, cut, chance = np.zeros(len(n)), np.zeros(entry.shape), np.zeros(len(scores))
    for i, m in enumerate(n):
        size, table = m * (m + 1) // 2, np.full((m + 1, m + 1), -np.inf)
        start, end = START[:size], END[:size] + 1
        table[start, end] = scores[at[i] : at[i] + size] + ending[i, end]
        z, cut[i, 1:m], each = en.soft(entry[i, 1:m], table, temperature)
        total[i], chance[at[i] : at[i] + size] = z / temperature, each[start, end]
    return total, cut, chance
