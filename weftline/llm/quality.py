"""Quality by co-training two views: a text's content, and its page metadata (lang, source, n_chars).

Each view has a logistic classifier of its own. It starts from labelled documents; in each of `rounds` rounds both score
all unlabelled documents, and every document that a view is sure of (`sure` or above, for either class) is a pseudo-label
in the other view's training set, which is then fitted again. The pseudo-labels of a class weigh together as much as the
labelled documents of that class at most. On labelled documents kept from all rounds, each view's log-odds are calibrated
(Platt) and the calibrated views combined by a second logistic. Every document is then scored as a whole.

Features of all whole texts are measured once and written to the shared folder. A Newton step of both fits is one pass
over that table: tasks add up gradients and second derivatives, which are summed by groups of tasks, so the driver gets
sums whose number grows with the root of the number of tasks. Labelled documents are a bounded sample picked by hash: at
most `labelled` whose crc32(doc_id) mod 5 isn't 0 (a parameter); nothing bounds the unlabelled ones.

Null texts count as empty; empty texts and null metadata are scored by their own features; null doc_ids count as held
out; repeated rows give repeated results, and each counts among the unlabelled (as a labelled document, only one of those
of a doc_id); columns of the metadata that are missing count as null; further columns are ignored; an empty table gives
none. Without labels of both classes every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices
from weftline.llm.toxicity import held_out, logistic
from weftline.llm.words import word_hashes
from weftline.session import materialize

MARKS = np.frombuffer(b"<>{}[]|#@&=_\\/~^*$%+", np.uint8)
STOPS = np.frombuffer(b".?!,;:", np.uint8)
#: numbers of surface features, of hashed words, and of metadata features
SURFACE, WORDS, META = 20, 64, 50


def content(text: str) -> list[float]:
    """Features of a text: its surface, and its words' shares hashed with signs into WORDS places."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    b = np.bincount(raw, minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    k, m = len(words), max(1, len(words))
    tally = Counter(words)
    p = b[b > 0] / max(1, n)
    letters = max(1, int(b[65:91].sum() + b[97:123].sum()))
    h = word_hashes(text)
    hashed = np.bincount((h & np.uint64(WORDS - 1)).astype(np.int64), weights=np.where(h & np.uint64(WORDS), 1.0, -1.0), minlength=WORDS) / m
    return [
        np.log1p(n), np.log1p(k), b[65:91].sum() / letters, b[48:58].sum() / max(1, n), b[33] / m, b[STOPS].sum() / m, b[MARKS].sum() / max(1, n), b[128:].sum() / max(1, n),
        sum(map(len, words)) / m, len(tally) / m, len(tally) / m**0.8, sum(x == y for x, y in zip(words, words[1:])) / m, max(tally.values(), default=0) / m, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(max(map(len, words), default=0)), float(-(p * np.log2(p)).sum()), sum(w[0].isupper() for w in words) / m, b[32] / max(1, n), (b[34] + b[39] + b[40] + b[41]) / m, *hashed,
    ]


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Features of a page's metadata; names are hashed into a fixed number of places."""
    out = [0.0] * META
    out[0] = np.log1p(max(0, n_chars or 0))
    out[1] = float(n_chars is None)
    out[2 + zlib.crc32((lang or "").encode()) % 16] = 1.0
    out[18 + zlib.crc32((source or "").encode()) % 32] = 1.0
    return out


class View:
    """A logistic classifier over scaled features; the squares of the first `squares` take part, and a bias."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, squares: int):
        self.mean, self.spread, self.squares = mean, spread + 1e-6, squares
        self.w = np.zeros(len(mean) + squares + 1)

    def wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([z, z[:, : self.squares] ** 2, np.ones((len(z), 1))])

    def odds(self, wide: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        return np.clip(wide @ (self.w if w is None else w), -30, 30)


def squash(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


def derivatives(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of a logistic: gradient, and minus the matrix of second derivatives."""
    p = squash(np.clip(x @ w, -30, 30))
    return x.T @ (y - p), (x * (p * (1 - p) + 1e-9)[:, None]).T @ x


def step(w: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A Newton step, shortened where it would go far; the bias isn't shrunk."""
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-3
    move = np.linalg.solve(h + np.diag(shrink), g - shrink * w)
    return w + move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    for _ in range(steps):
        new = step(w, *derivatives(x, y, w), ridge)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def pseudo(odds: np.ndarray, sure: float) -> list[np.ndarray]:
    """Places of the rows that a view is sure are bad, and good."""
    edge = np.log(sure / (1 - sure))
    return [np.flatnonzero(odds <= -edge), np.flatnonzero(odds >= edge)]


def sums(wide: list[np.ndarray], views: list[View], teachers: list[np.ndarray], sure: float) -> np.ndarray:
    """For each view and class: number of pseudo-labels, gradient, second derivatives; teachers: both views' last weights."""
    out = []
    for i, view in enumerate(views):
        taught = pseudo(views[1 - i].odds(wide[1 - i], teachers[1 - i]), sure)
        for label, at in enumerate(taught):
            g, h = derivatives(wide[i][at], np.full(len(at), float(label)), view.w)
            out += [[float(len(at))], g, h.ravel()]
    return np.concatenate(out)


def parted(total: np.ndarray, views: list[View]) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """view, class, number, gradient and second derivatives of what sums() put together."""
    at = 0
    for i, view in enumerate(views):
        p = len(view.w)
        for label in (0, 1):
            yield i, label, total[at], total[at + 1 : at + 1 + p], total[at + 1 + p : at + 1 + p + p * p].reshape(p, p)
            at += 1 + p + p * p


def added_up(rows: DataFrame, f, size: int, groups: int) -> np.ndarray:
    """The sum over all batches of the vectors that f makes of a record batch: by task, by group of tasks, at the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in slices(batches, 4096):
            total += f(b)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task % groups]), pa.array([task]), pa.array([total.tobytes()], pa.binary())], names=["g", "task", "v"])

    def together(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("task").to_numpy())
        v = t.column("v")
        return pa.table({"g": t.column("g")[:1], "v": pa.array([sum((np.frombuffer(v[int(i)].as_py()) for i in order), np.zeros(size)).tobytes()], pa.binary())})

    got = rows.mapInArrow(part, "g long, task long, v binary").groupBy("g").applyInArrow(together, "g long, v binary").collect()
    return sum((np.frombuffer(r.v) for r in sorted(got, key=lambda r: r.g)), np.zeros(size))


def matrices(b: pa.RecordBatch) -> list[np.ndarray]:
    """Content and metadata features of measured rows."""
    text = np.array(b.column("t").flatten(), float).reshape(b.num_rows, SURFACE + WORDS)
    meta = np.array([metadata(*r) for r in zip(*(b.column(k).to_pylist() for k in ("lang", "source", "n_chars")))], float).reshape(b.num_rows, META)
    return [text, meta]


def rows_of(docs: DataFrame) -> DataFrame:
    has = set(docs.columns)
    pick = lambda c, t: (F.col(c) if c in has else F.lit(None)).cast(t).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), pick("lang", "string"), pick("source", "string"), pick("n_chars", "long"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_chars and t (content features) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            t = np.array([content(x) for x in b.column("text").to_pylist()], np.float32).reshape(b.num_rows, SURFACE + WORDS)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "lang", "source", "n_chars")), pa.array(list(t), pa.list_(pa.float32()))], names=["doc_id", "lang", "source", "n_chars", "t"])

    return rows_of(docs).mapInArrow(measure, "doc_id long, lang string, source string, n_chars long, t array<float>")


def co_train(free: DataFrame, lab: list[np.ndarray], y: np.ndarray, rounds: int, steps: int, sure: float, groups: int = 8, seed: int = 3) -> dict:
    """Both views, their calibrations and their combination; free: measured rows without a label, lab: features by view."""
    hold = np.random.default_rng(seed).random(len(y)) < 0.3
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold[:] = False
    cal = hold if hold.any() else np.ones(len(y), bool)
    sizes = (SURFACE + WORDS, META)
    moments = added_up(free, lambda b: np.concatenate([[float(b.num_rows)], *(f(x) for x in matrices(b) for f in (lambda v: v.sum(0), lambda v: (v * v).sum(0)))]), 1 + 2 * sum(sizes), groups)
    views, at, n = [], 1, moments[0] + len(y)
    for x, k, squares in zip(lab, sizes, (SURFACE, 1)):
        mean = (moments[at : at + k] + x.sum(0)) / n
        views.append(View(mean, np.sqrt(np.maximum(0, (moments[at + k : at + 2 * k] + (x * x).sum(0)) / n - mean**2)), squares))
        at += 2 * k
    own, truth = [v.wide(x[~hold]) for v, x in zip(views, lab)], y[~hold]
    for v, x in zip(views, own):
        v.w = fit(x, truth, v.w)
    size = sum(2 * (1 + len(v.w) + len(v.w) ** 2) for v in views)
    for _ in range(rounds):
        teachers = [v.w.copy() for v in views]
        for _ in range(steps):
            total = added_up(free, lambda b: sums([v.wide(x) for v, x in zip(views, matrices(b))], views, teachers, sure), size, groups)
            if not any(k for _, _, k, _, _ in parted(total, views)):
                break
            slopes = [list(derivatives(x, truth, v.w)) for v, x in zip(views, own)]
            for i, label, k, g, h in parted(total, views):
                share = min(1.0, (truth == label).sum() / max(1.0, k))
                slopes[i][0], slopes[i][1] = slopes[i][0] + share * g, slopes[i][1] + share * h
            for v, (g, h) in zip(views, slopes):
                v.w = step(v.w, g, h, 1.0)
    odds = [v.odds(v.wide(x[cal])) for v, x in zip(views, lab)]
    platt = [logistic(o[:, None], y[cal]) for o in odds]
    both = np.stack([o * w[0] + w[1] for o, w in zip(odds, platt)], 1)
    return {"views": views, "platt": platt, "join": logistic(both, y[cal])}


def apply(model: dict, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    odds = [v.odds(v.wide(m)) * w[0] + w[1] for v, m, w in zip(model["views"], x, model["platt"])]
    return squash(odds[0]), squash(odds[1]), squash(np.clip(np.stack(odds, 1) @ model["join"][:2] + model["join"][2], -30, 30))


def train(rows: DataFrame, labels: DataFrame, labelled: int = 6000, rounds: int = 5, steps: int = 2, sure: float = 0.97) -> dict | float:
    """Fits on a bounded sample of labelled rows and on all other rows of a measured table."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    features = F.min(F.struct("t", "lang", "source", "n_chars")).alias("x")
    got = rows.join(picked, "doc_id").groupBy("doc_id", "quality").agg(features).select("doc_id", "quality", "x.*").toArrow().sort_by("doc_id")
    y = got.column("quality").to_numpy().astype(float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    lab = [np.concatenate(m) for m in zip(*(matrices(b) for b in got.to_batches()))]
    free = rows.join(picked.select(F.col("doc_id").alias("d_")), F.col("doc_id") == F.col("d_"), "left_anti")
    groups = max(1, int(np.ceil(np.sqrt(rows.rdd.getNumPartitions()))))
    return co_train(free, lab, y, rounds, steps, sure, groups)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (1: good), keep (score >= threshold) of each row."""
    rows = materialize(measured(docs), "measured")
    model = train(rows, labels, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            got = [np.full(b.num_rows, model)] * 3 if isinstance(model, float) else apply(model, matrices(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, got)], names=["doc_id", "text_score", "meta_score", "score"])

    out = rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return out.select("doc_id", held_out(), "text_score", "meta_score", "score", (F.col("score") >= threshold).alias("keep"))
