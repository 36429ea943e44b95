"""Scores of all segments of a region, some ends at a time, and the programs over them.

Source.forward() yields (first, block): block[c, s] is the score of statements s to first + c, for the starts s up to the
block's last end (-inf where s lies behind the end); first rises. Source.backward() yields the same blocks from the last to
the first. No source keeps all n (n + 1) / 2 scores: a block has about `CELLS` of them, or one end's if that is more.
`Swept` comes back to a block from a snapshot of its sweep before that block, so its memory follows n to the power 1.5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from weftline.operators.quality import Sweep

CELLS = 1 << 18
Block = tuple[int, np.ndarray]


def width(n: int) -> int:
    """Ends in a block: all of a short region's, and about the root of n in long ones, where snapshots take as much."""
    return max(1, min(n, max(CELLS // max(1, n), math.isqrt(n))))


class Source:
    """Segments that a function scores: f(first, last) gives the block of the ends first to last."""

    def __init__(self, n: int, f: Callable[[int, int], np.ndarray]):
        self.n, self.f = n, f

    def block(self, first: int) -> Block:
        return first, self.f(first, min(self.n, first + width(self.n)) - 1)

    def firsts(self) -> range:
        return range(0, self.n, width(self.n))

    def forward(self) -> Iterator[Block]:
        return map(self.block, self.firsts())

    def backward(self) -> Iterator[Block]:
        return map(self.block, reversed(self.firsts()))


def table(scores: np.ndarray) -> Source:
    """Segments whose scores are given: scores[i, j] is that of the half-open [i, j)."""
    return Source(len(scores) - 1, lambda first, last: np.where(np.arange(last + 1)[None] <= np.arange(first, last + 1)[:, None], scores[: last + 1, first + 1 : last + 2].T, -np.inf))


class Swept:
    """Segments scored from what a sweep counts: score(first, counts) with counts[name][c, s]."""

    def __init__(self, sweep: Sweep, score: Callable[[int, dict[str, np.ndarray]], np.ndarray]):
        self.n, self.sweep, self.score, self.snapshots = sweep.n, sweep, score, {}
        self.held: tuple[int, dict[str, np.ndarray]] = (-1, {})  # the block counted last; a short region's is its only one
        self.scores: np.ndarray | None = None  # its scores, once asked for

    def counts(self, state, first: int) -> dict[str, np.ndarray]:
        last = min(self.n, first + width(self.n))
        out = {k: np.zeros((last - first, last), np.int32) for k in state.count}
        for e in range(first, last):
            self.sweep.step(state, e)
            for k, v in state.count.items():
                out[k][e - first, : e + 1] = v[: e + 1]
        self.held, self.scores = (first, out), None
        return out

    def block(self) -> Block:
        """The block counted last, scored once however often it is gone over."""
        if self.scores is None:
            self.scores = self.score(*self.held)
        return self.held[0], self.scores

    def forward(self) -> Iterator[Block]:
        state = None
        for first in range(0, self.n, width(self.n)):
            if first == 0 == self.held[0]:
                yield self.block()
                continue
            if state is None:
                state = self.snapshots[first].copy() if first in self.snapshots else self.sweep.fresh()
            if first not in self.snapshots:
                self.snapshots[first] = state.copy()
            self.counts(state, first)
            yield self.block()

    def backward(self) -> Iterator[Block]:
        """After forward(). Snapshots stay: it can be called again."""
        for first in reversed(range(0, self.n, width(self.n))):
            if first != self.held[0]:
                self.counts(self.snapshots[first].copy(), first)
            yield self.block()


def as_source(segments):
    return table(segments) if isinstance(segments, np.ndarray) else segments


def best_segmentation(boundary: np.ndarray, segments) -> tuple[list[int], float]:
    """Cuts of the highest energy and that energy; of equals, the earliest predecessor."""
    source = as_source(segments)
    n = source.n
    entry = np.concatenate([[0.0], boundary, [0.0]])
    best, back = np.zeros(n + 1), np.zeros(n + 1, int)
    for first, block in source.forward():
        for c, scores in enumerate(block):
            j = first + c + 1
            options = best[:j] + scores[:j] + entry[:j]
            back[j] = int(np.argmax(options))
            best[j] = options[back[j]]
    cuts, j = [], n
    while j > 0:
        j = back[j]
        if j:
            cuts.append(int(j))
    return cuts[::-1], float(best[n])


def log_sum(v: np.ndarray) -> float:
    top = v.max(initial=-np.inf)
    return float(top if not np.isfinite(top) else top + np.log(np.exp(v - top).sum()))


def log_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.logaddexp(a, b)


def checked(temperature: float) -> float:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return temperature


def ahead_of(source, entry: np.ndarray, temperature: float, path: list[int] | None = None) -> tuple[np.ndarray, float]:
    """The log partition function up to each end, and the scores of the segments between path's points."""
    ahead = np.full(source.n + 1, -np.inf)
    ahead[0], along, starts = 0.0, 0.0, dict(zip((path or [])[1:], path or []))
    for first, block in source.forward():
        for c, scores in enumerate(block):
            j = first + c + 1
            ahead[j] = log_sum(ahead[:j] + scores[:j] / temperature) + entry[j]
            if j in starts:
                along += scores[starts[j]]
    return ahead, float(along)


def partition(boundary: np.ndarray, segments, temperature: float = 1.0, path: list[int] | None = None) -> tuple[float, float]:
    """What marginals returns first and last, in one direction."""
    ahead, along = ahead_of(as_source(segments), np.concatenate([[0.0], boundary, [0.0]]) / checked(temperature), temperature, path)
    return temperature * ahead[-1], along


def marginals(boundary: np.ndarray, segments, temperature: float = 1.0, path: list[int] | None = None, visit: Callable[[int, np.ndarray], None] | None = None) -> tuple[float, np.ndarray, float]:
    """T times the log partition function, the probability of each cut, and the scores of the segments between path's points.

    visit(first, chance) gets the probabilities of a block's segments, from the last block to the first, while the source
    stands at that block.
    """
    source = as_source(segments)
    n = source.n
    entry = np.concatenate([[0.0], boundary, [0.0]]) / checked(temperature)
    ahead, along = ahead_of(source, entry, temperature, path)
    behind = np.full(n + 1, -np.inf)
    behind[n] = 0.0
    total = ahead[n]
    for first, block in source.backward():
        chance = np.zeros(block.shape)
        for c in range(len(block) - 1, -1, -1):
            j = first + c + 1
            onward = block[c, :j] / temperature + (entry[j] + behind[j])
            with np.errstate(invalid="ignore"):
                chance[c, :j] = np.exp(ahead[:j] + onward - total)
            behind[:j] = log_sums(behind[:j], onward)
        np.nan_to_num(chance, copy=False)
        if visit is not None:
            visit(first, chance)
    with np.errstate(invalid="ignore"):
        cut = np.nan_to_num(np.exp(ahead + behind - total)[1:n])
    return temperature * total, cut, along
