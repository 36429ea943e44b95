"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Kernel: the gap-weighted subsequence kernel of three symbols over words (front and end marks included), each occurrence
weighing ``DECAY ** span`` for spans of at most SPAN + 1 symbols, normalised by the words' own kernels. Inserted or
repeated characters and gaps lengthen a span instead of breaking the match; runs of one-letter words count as one word.
Landmarks are words of the labelled sentences; K_mm ** -1/2 maps a word into their space (Nyström), where a
squared-hinge SVM is trained by multiple-instance rounds: of a toxic text only its strongest words (the witnesses) are
positive, every word of a clean text is negative. The machine collapses into one weight per symbol triple, so that
scoring evaluates the same kernel expansion without touching the landmarks. A logistic calibration over a text's
strongest words, fitted on labelled texts kept from the SVM, gives the score.

Training reads at most `per_class` labelled texts of each class, picked by hash (a documented bound); scoring reads
every whole text. Null and empty texts are scored too (they have no words); null doc_id counts as held out; repeated
rows give repeated results; further columns are ignored. Without both classes among the labels the score is the share of
toxic labels (0 without labels).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import give_back, slices, texts

SPAN, DECAY, LONGEST = 6, 0.6, 24
PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
SYMBOL = np.full(256, 28, np.int32)
SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
SYMBOL[ord("0") : ord("9") + 1] = 27
START, END = 30, 31
WEIGHT = DECAY ** (np.arange(8) + 1.0)


class Spelling(dict):
    """For str.translate: accents, punctuation and signs outside ASCII fall away, letters of other scripts become letters by
    a hash of their code, so that words of every script keep their pattern of equal and different letters (but for clashes).
    """

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)[0]
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalnum())
        if code < 128:
            out = c
        elif c.isspace():
            out = " "
        else:
            out = "" if kind not in "LN" else plain or chr(97 + (ord(c.lower()[0]) * 2654435761 >> 12) % 26)
        self[code] = out
        return out


SPELLING = Spelling()
LONE = re.compile(r"(?<!\S)(?:\S[ ]){2,}\S(?!\S)")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words in ASCII; spelled-out words (single letters) are joined; long ones become overlapping windows."""
    text = (text if text.isascii() else text.translate(SPELLING)).lower()
    found = set(text.split())
    found |= {m.replace(" ", "") for m in LONE.findall(text)}
    for w in [w for w in found if len(w) > LONGEST]:
        found.remove(w)
        found |= {w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)}
    return found


def terms(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of the (ASCII) words: their places, and rows of sorted terms (triple << 3 | span)."""
    coded = [w.encode("ascii") for w in words]
    lengths = np.array([len(c) for c in coded])
    for n in np.unique(lengths):
        for at in np.array_split(np.flatnonzero(lengths == n), max(1, (lengths == n).sum() // 4096)):
            m = np.full((len(at), n + 2), START, np.int32)
            m[:, -1] = END
            m[:, 1:-1] = SYMBOL[np.frombuffer(b"".join(coded[i] for i in at), np.uint8).reshape(len(at), n)]
            cols = [((m[:, : n + 2 - b] << 10 | m[:, a : n + 2 - b + a] << 5 | m[:, b:]) << 3) | b for a, b in PAIRS if b < n + 2]
            if cols:
                yield at, np.sort(np.concatenate(cols, 1), 1)


def norms(t: np.ndarray) -> np.ndarray:
    """Square roots of the words' own kernels: equal triples add up before squaring."""
    u, v = t >> 3, WEIGHT[t & 7]
    total = (v * v).sum(1)
    for lag in range(1, t.shape[1]):
        same = u[:, lag:] == u[:, :-lag]
        if not same.any():
            break
        total += 2 * (v[:, lag:] * v[:, :-lag] * same).sum(1)
    return np.sqrt(total)


def word_scores(words: list[str], beta: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(words), bias)
    for at, t in terms(words):
        out[at] += (beta[t >> 3] * WEIGHT[t & 7]).sum(1) / norms(t)
    return out


def embed(words: list[str]) -> np.ndarray:
    """Normalised explicit feature vectors, for landmarks and training words (float32)."""
    out = np.zeros((len(words), 1 << 15), np.float32)
    for at, t in terms(words):
        np.add.at(out, (at[:, None], t >> 3), (WEIGHT[t & 7] / norms(t)[:, None]).astype(np.float32))
    return out


def kernel(words: list[str], marks: np.ndarray) -> np.ndarray:
    """Kernel values of words (rows) and embedded landmarks (columns)."""
    by_triple, out = np.ascontiguousarray(marks.T), np.zeros((len(words), len(marks)))
    for at, t in terms(words):
        v = (WEIGHT[t & 7] / norms(t)[:, None]).astype(np.float32)
        for i in range(0, len(at), 64):
            out[at[i : i + 64]] += np.matmul(v[i : i + 64, None, :], by_triple[t[i : i + 64] >> 3])[:, 0]
    return out


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, rounds: int = 20) -> np.ndarray:
    """Squared-hinge SVM by Newton steps on the margin's violators; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        bad = y * (z @ w) < 1
        zb, k = z[bad], weight[bad] * c
        new = np.linalg.solve(np.eye(len(w)) + (zb * k[:, None]).T @ zb, (zb * k[:, None]).T @ y[bad])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bag(scores: np.ndarray) -> list[float]:
    """Of a text: its strongest and second word, how many pass the margin, how many there are."""
    if not len(scores):
        return [-1.5, -1.5, 0.0, 0.0]
    top = np.sort(np.partition(scores, -2)[-2:]) if len(scores) > 1 else np.array([-1.5, scores[0]])
    return [float(np.clip(top[1], -1.5, 1.5)), float(np.clip(top[0], -1.5, 1.5)), float(np.log1p((scores > 0).sum())), float(np.log1p(len(scores)))]


def fit(bags: list[set[str]], y: np.ndarray, landmarks: int = 384, rounds: int = 3, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """beta (weight per triple), bias, calibration weights, from the words of labelled texts."""
    rng = np.random.default_rng(seed)
    hold = rng.random(len(bags)) < 0.3
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        hold[:] = False
    pos, neg = [b for b, v, h in zip(bags, y, hold) if v and not h], [b for b, v, h in zip(bags, y, hold) if not v and not h]
    in_neg: dict[str, int] = {}
    for b in neg:
        for w in b:
            in_neg[w] = in_neg.get(w, 0) + 1
    in_pos: dict[str, int] = {}
    for b in pos:
        for w in b:
            in_pos[w] = in_pos.get(w, 0) + 1
    odds = {w: np.log((n + 0.2) / (len(pos) + 1)) - np.log((in_neg.get(w, 0) + 0.2) / (len(neg) + 1)) for w, n in in_pos.items()}
    clean = sorted(in_neg)
    sample = [clean[i] for i in rng.permutation(len(clean))[:4000]]
    common = sorted(in_neg, key=lambda w: (-in_neg[w], w))[:2000]
    score = {w: odds[w] * (1 if in_pos[w] > 1 else 0.3) for w in in_pos}
    beta, bias, hard = np.zeros(1 << 15), 0.0, []
    for k in range(rounds):
        witness: dict[str, int] = {}
        for b in pos:
            if b:
                ranked = sorted(b, key=lambda w: (-score.get(w, -9), w))
                for w in ranked[:1] + [w for w in ranked[1:6] if score.get(w, -9) >= 0.9 * score.get(ranked[0], -9) and in_neg.get(w, 0) == 0 and in_pos[w] > 1]:
                    witness[w] = witness.get(w, 0) + 1
        first = sorted(witness, key=lambda w: (-witness[w], w))[:2000]
        others = list(dict.fromkeys(w for w in hard + common + sample if w not in witness))[:7000]
        marks = first[: landmarks // 2]
        marks += others[: landmarks - len(marks)]
        lm = embed(marks)
        values, vectors = np.linalg.eigh((lm @ lm.T).astype(float))
        keep = values > 1e-6 * values[-1]
        root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
        z = kernel(first + others, lm) @ root
        target = np.r_[np.ones(len(first)), -np.ones(len(others))]
        weight = np.r_[[np.log1p(witness[w]) for w in first], np.ones(len(others))]
        w = svm(z, target, weight)
        beta, bias = (root @ w[:-1]) @ lm.astype(float), float(w[-1])
        if k + 1 == rounds:
            break
        got = word_scores(list(in_pos), beta, bias)
        score = {w: float(s) + 0.1 * np.clip(odds[w], -5, 5) for w, s in zip(in_pos, got)}
        bad = word_scores(clean, beta, bias)
        hard = [clean[i] for i in np.argsort(-bad, kind="stable")[:1500]]
    use = hold if hold.any() else np.ones(len(bags), bool)
    x = np.array([bag(word_scores(sorted(b), beta, bias)) for b, h in zip(bags, use) if h])
    return beta, bias, logistic(x, y[use].astype(float))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> tuple[np.ndarray, float, np.ndarray] | float:
    """Fits in one task on at most per_class texts of each class whose crc32(doc_id) mod 5 isn't 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    rows = texts(docs).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(r["doc_id"], words_of(r["text"]), r["toxic"]) for b in batches for s in slices([b]) for r in s.to_pylist()]
        got.sort(key=lambda r: r[0])
        y = np.array([r[2] for r in got], int)
        if len(set(y)) < 2:
            fitted, kind = np.array([y.mean() if len(y) else 0.0]), "share"
        else:
            beta, bias, cal = fit([r[1] for r in got], y)
            fitted, kind = np.r_[beta, bias, cal], "svm"
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([fitted.astype("<f8").tobytes()], pa.binary())], names=["kind", "model"])

    found = rows.coalesce(1).mapInArrow(run, "kind string, model binary").collect()
    model = np.frombuffer(found[0].model, "<f8") if found else np.zeros(1)
    return float(model[0]) if len(model) == 1 else (model[: 1 << 15], float(model[1 << 15]), model[(1 << 15) + 1 :])


CACHE: dict[bytes, dict[str, float]] = {}


def score_texts(ts: list[str], model, key: bytes, most: int = 300_000) -> list[float]:
    """Scores of texts; words' scores are kept in a bounded cache for the length of a task."""
    beta, bias, cal = model
    cache = CACHE.setdefault(key, {})
    if len(CACHE) > 1:
        for k in [k for k in CACHE if k != key]:
            del CACHE[k]
    bags = [words_of(t) for t in ts]
    new = list(set().union(*bags).difference(cache)) if bags else []
    if len(cache) + len(new) > most:
        cache.clear()
        new = list(set().union(*bags))
    cache.update(zip(new, word_scores(new, beta, bias).tolist()))
    x = np.array([bag(np.array([cache[w] for w in b])) for b in bags]).reshape(-1, 4)
    return (1 / (1 + np.exp(-np.clip(x @ cal[:-1] + cal[-1], -30, 30)))).tolist()


def score(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    return scored(texts(docs), train(docs, labels, per_class)).select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out() -> F.Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out")


def scored(docs: DataFrame, model) -> DataFrame:
    """Adds `score` to a frame with a text column."""
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    model = (model[0].astype(np.float32), model[1], model[2])
    key = str(hash(model[0].tobytes())).encode()
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            got = score_texts(["" if t is None else t for t in b.column("text").to_pylist()], model, key)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "score"])
        CACHE.clear()
        give_back()

    return docs.mapInArrow(run, schema)
