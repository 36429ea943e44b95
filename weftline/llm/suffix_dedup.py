"""Removal of repeated passages by a sampled suffix array.

Every string of `length` bytes that also starts anywhere else (other texts or the same one, overlaps included) counts as
repeated; strings are judged on the input. Texts count as UTF-8 bytes; matches never cross texts. The same code finds
repeated passages of words: a text is then the sequence of its words' 64-bit hashes, eight bytes each, and strings start
at whole words (UNIT); with `across`, only strings that occur in another document count.

Sorting every suffix would move some 16 bytes for each byte of text. So suffixes are sampled by content: the anchor of a
window of `length` bytes is the leftmost position with the smallest hash of the next symbols among those where `core`
bytes still fit. Equal windows have equal anchors at equal offsets, so each repeated string shows up as suffixes that
start alike at its anchors. The windows of one anchor are a run of offsets [lo, hi] and read one context.

In periodic text equal anchors follow each other in equal steps; a row stands for all of them, so a long run of one byte is
a few rows.

1. Anchors whose `core` leading bytes occur once can't lie in repeated strings and drop out (hash counts).
2. Equal contexts collapse before any sort (pre-aggregation): one of each goes on, with the number of its copies. One
   that occurs twice or more is repeated as a whole.
3. Cores with several contexts: sampled splitters range-partition the suffixes by their leading bytes; a bucket sorts its
   suffixes by multikey quicksort over eight-byte symbols. Suffixes that share a core never fall into two buckets, so no
   match hides at a boundary. The longest common prefix with the neighbours bounds which offsets can be repeated, and
   window hashes within the core's run of suffixes settle them.
4. A core with more than `hot` distinct contexts would be a hot group in one bucket: its windows are split over all tasks
   by their hashes instead, with map-side sums (an exact way, with the same results).

Contexts and windows are told apart by 64-bit hashes within equal cores, texts by their 64-bit hash. Null and empty texts
have no bytes; texts of under `length` bytes lose nothing; repeated rows count as copies of each other (with `across`, as
one document); null doc_ids are kept; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import slices, texts
from weftline.llm.words import FACTORS, mix, powers, word_hashes
from weftline.session import materialize

INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: bytes of a symbol at which strings may start: of a text's bytes, of its words' hashes
BYTES, WORDS = 1, 8


def encoded(text: str, unit: int) -> bytes:
    return text.encode("utf-8", "surrogatepass") if unit == BYTES else word_hashes(text).tobytes()


def anchors(data: bytes, length: int, core: int, unit: int = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text's windows: positions, first and last window start (in bytes) of each."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    m, w = (n - core) // unit + 1, (length - core) // unit + 1
    if unit == BYTES:
        grams = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (m, 8), (1, 1)).view(np.uint64)[:, 0]
    else:
        v = np.frombuffer(data, np.uint64)
        grams = v[:m] * FACTORS[0] + v[1 : m + 1] * FACTORS[1] + v[2 : m + 2] * FACTORS[2]
    cur = ((grams * np.uint64(0x9E3779B97F4A7C15)) ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    cur = (cur & ~np.uint64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < w:
        cur = np.minimum(cur[: len(cur) - (w - span)], cur[w - span :])
    at = (cur & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first] * unit, first * unit, (np.r_[first[1:], len(at)] - 1) * unit


def stretches(pos: np.ndarray, *alike: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where anchors that are alike follow each other in equal steps: the first of each stretch, its step, its number."""
    step = np.diff(pos)
    link = np.ones(len(step), bool)
    for v in alike:
        link &= v[1:] == v[:-1]
    goes_on = link.copy()
    goes_on[1:] &= ~link[:-1] | (step[1:] == step[:-1])
    first = np.flatnonzero(np.r_[True, ~goes_on])
    times = np.diff(np.r_[first, len(pos)])
    return first, np.where(times > 1, np.r_[step, 0][first], 0), times


def anchor_table(docs: DataFrame, length: int, core: int, unit: int) -> DataFrame:
    """tkey, doc_id, pos, lo, hi (window starts less pos), core and ctx (hashes) for the anchors of each row.

    In periodic text (runs of one byte, repeated lines) anchors that are alike follow each other: a row stands for `times`
    of them, at pos, pos + step, ...
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(9)]
            for key, doc, text in zip(b.column("tkey").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = encoded(text, unit)
                pos, lo, hi = anchors(data, length, core, unit)
                if len(pos):
                    hashed = [np.array(v, np.uint64) for v in ([xxhash.xxh3_64_intdigest(data[p : p + core]) for p in pos.tolist()], [xxhash.xxh3_64_intdigest(data[i : j + length], p - i) for p, i, j in zip(pos.tolist(), lo.tolist(), hi.tolist())])]
                    first, step, times = stretches(pos, lo - pos, hi - pos, *hashed)
                    cols[0].append(np.full(len(first), key, np.int64))
                    cols[1] += [doc] * len(first)
                    for c, v in zip(cols[2:], (pos[first], (lo - pos)[first], (hi - pos)[first], step, times, *(h[first].view(np.int64) for h in hashed))):
                        c.append(v)
            if cols[1]:
                whole = [pa.array(np.concatenate(c).astype(t)) for c, t in zip([cols[0], *cols[2:]], ("i8", *["i4"] * 5, "i8", "i8"))]
                yield pa.RecordBatch.from_arrays([whole[0], pa.array(cols[1], pa.int64()), *whole[1:]], names=["tkey", "doc_id", "pos", "lo", "hi", "step", "times", "core", "ctx"])

    return docs.mapInArrow(run, "tkey long, doc_id long, pos int, lo int, hi int, step int, times int, core long, ctx long")


def multikey_quicksort(s: np.ndarray, cutoff: int = 24) -> np.ndarray:
    """Order of the rows of a matrix of symbols: three-way partitions, one symbol deeper for the equal part."""
    order, stack = np.arange(len(s)), [(0, len(s), 0)]
    while stack:
        a, b, depth = stack.pop()
        part = order[a:b]
        if b - a <= 1 or depth >= s.shape[1]:
            continue
        if b - a <= cutoff:
            order[a:b] = part[np.lexsort(s[part, depth : depth + 12].T[::-1])] if depth + 12 >= s.shape[1] else sorted(part, key=lambda i: s[i, depth:].tolist())
            continue
        x = s[part, depth]
        pivot = np.sort(x[[0, len(x) // 2, -1]])[1]
        less, same, more = part[x < pivot], part[x == pivot], part[x > pivot]
        order[a:b] = np.concatenate([less, same, more])
        stack += [(a, a + len(less), depth), (a + len(less), b - len(more), depth + 1), (b - len(more), b, depth)]
    return order


def window_hashes(data: np.ndarray, start: np.ndarray, base: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at `start` of a buffer of strings; base: where each window's own string begins."""
    size = int((start - base).max(initial=0)) + length + 1
    first = np.unique(base)
    ends = np.r_[first[1:], len(data)]
    local = np.arange(len(data)) - np.repeat(first, ends - first) if len(first) else np.zeros(len(data), np.int64)
    p = powers(max(size, int(local.max(initial=0)) + 1))
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[local], dtype=np.uint64)]
    inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, INVERSE, np.uint64)])
    return mix((sums[start + length] - sums[start]) * inverse[start - base])


def runs(offsets: np.ndarray, unit: int = BYTES) -> list[int]:
    """Sorted offsets as from, to (exclusive), from, to, ..."""
    cut = np.flatnonzero(np.diff(offsets) > unit)
    return np.stack([offsets[np.r_[0, cut + 1]], offsets[np.r_[cut, len(offsets) - 1]] + 1], 1).ravel().tolist()


def repeated(h: np.ndarray, owner: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which windows (hashes) have an equal one of another owner, or belong to something that has many."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    o, size = owner[order], np.diff(np.r_[first, len(h)])
    twice = (np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)) | np.logical_or.reduceat(many[order], first)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(twice, size)
    return out


def sort_bucket(rows: pa.Table, length: int, core: int, unit: int = BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """core, ctx and repeated window offsets of the contexts of one bucket that occur once."""
    names = ("core", "ctx", "n", "owner", "lo", "hi")
    c, x, n, who, lo, hi = (rows.column(k).to_numpy() for k in names)
    _, keep = np.unique(np.stack([c, x], 1), axis=0, return_index=True)
    strings = rows.column("s").take(pa.array(keep)).to_pylist()
    c, x, n, who, lo, hi = (v[keep].astype(np.int64) for v in (c, x, n, who, lo, hi))
    width = -(-length // 8) * 8
    m = np.zeros((len(c), width), np.uint8)
    for i, s in enumerate(strings):
        right = np.frombuffer(s, np.uint8)[-lo[i] : -lo[i] + length]
        m[i, : len(right)] = right
    order = multikey_quicksort(m.view(">u8").astype(np.uint64))
    m, c, x, n, who, lo, hi = (v[order] for v in (m, c, x, n, who, lo, hi))
    strings = [strings[i] for i in order]
    differ = m[1:] != m[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), length) if len(m) > 1 else np.zeros(0, np.int64)
    near = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    group = np.r_[0, np.cumsum(lcp < core)]
    last = np.minimum(hi, near - length)
    count = np.maximum(0, (last - lo) // unit + 1)
    sizes = np.bincount(group, weights=count).astype(np.int64)
    total = np.cumsum(sizes)
    chunk = (total - sizes) // 1_000_000
    for k in np.unique(chunk):
        at = np.flatnonzero((chunk[group] == k) & (count > 0))
        if len(at) < 2 or (n[at] > 1).all():
            continue
        lengths = np.array([len(strings[i]) for i in at])
        base = np.r_[0, np.cumsum(lengths)[:-1]]
        data = np.frombuffer(b"".join(strings[i] for i in at), np.uint8)
        own = np.repeat(np.arange(len(at)), count[at])
        offset = (np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(count[at])[:-1]], count[at])) * unit
        h = mix(window_hashes(data, base[own] + offset, base[own], length) + group[at][own].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        found = repeated(h, who[at][own], n[at][own] > 1) & (n[at][own] == 1)
        for i in np.unique(own[found]):
            mine = slice(int(np.searchsorted(own, i)), int(np.searchsorted(own, i, "right")))
            yield int(c[at[i]]), int(x[at[i]]), runs(lo[at[i]] + offset[mine][found[mine]], unit)


STATUS = "core long, ctx long, runs array<int>"


def _status(found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["core", "ctx", "runs"])


def repeated_contexts(contexts: DataFrame, length: int, core: int, hot: int, per_bucket: int, unit: int) -> DataFrame:
    """core, ctx, runs (from, to, ... of repeated window offsets) of contexts (core, ctx, n, owner, lo, hi, c, s)."""
    rows = contexts.where(F.col("c") <= hot)
    buckets = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_bucket))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _status(list(sort_bucket(pa.Table.from_batches(held), length, core, unit)))

    lead = F.expr(f"substring(s, 1 - lo, {core})")
    sorted_out = rows.repartitionByRange(buckets, lead).mapInArrow(sort, STATUS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            for r in b.to_pylist():
                at = np.arange(0, r["hi"] - r["lo"] + 1, unit)
                h = window_hashes(np.frombuffer(r["s"], np.uint8), at, np.zeros(len(at), np.int64), length).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k]] * len(at), pa.int64()) for k in ("core", "ctx", "n", "owner")), pa.array((r["lo"] + at).astype(np.int32)), pa.array(h)], names=["core", "ctx", "n", "owner", "o", "h"])

    spread = contexts.where(F.col("c") > hot).dropDuplicates(["core", "ctx"]).mapInArrow(windows, "core long, ctx long, n long, owner long, o int, h long")
    twice = spread.groupBy("core", "h").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.max("n").alias("k")).where("a <> b or k > 1").select("core", "h")
    counted = spread.where("n = 1").join(twice, ["core", "h"], "left_semi").groupBy("core", "ctx").agg(F.flatten(F.collect_list(F.array(F.col("o"), F.col("o") + 1))).alias("runs"))
    return sorted_out.unionByName(counted)


def repeated_spans(docs: DataFrame, length: int = 400, core: int = 64, hot: int = 8192, per_bucket: int = 20_000, unit: int = BYTES, across: bool = False) -> DataFrame:
    """tkey, spans (array of struct pos, step, times, runs) of the texts that hold repeated strings; docs: doc_id, text, tkey."""
    found = materialize(anchor_table(docs, length, core, unit), "anchors")
    # a string is repeated if it has two owners: any two places, or with `across` any two documents
    owner = F.xxhash64("tkey", "doc_id") if across else F.xxhash64("tkey", "doc_id", "pos")
    several = F.min(owner) != F.max(owner) if across else F.sum("times") > 1
    # written tables on the small sides let Spark split the hot keys of the large sides
    often = materialize(found.groupBy("core").agg(several.alias("k")).where("k").select("core"), "cores")
    found = materialize(found.join(often, "core", "left_semi"), "repeated")
    number = F.when(F.min(owner) != F.max(owner), 2).otherwise(1).cast("long") if across else F.sum("times")
    distinct = materialize(found.groupBy("core", "ctx").agg(number.alias("n"), F.min(F.struct("tkey", "doc_id", "pos", "lo", "hi")).alias("r")), "contexts")
    mixed = distinct.groupBy("core").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("core", "c")
    mixed = materialize(mixed, "mixed")
    asked = distinct.join(mixed, "core").groupBy("r.tkey", "r.doc_id").agg(F.collect_list(F.struct("core", "ctx", "n", "c", "r.pos", "r.lo", "r.hi")).alias("cuts"))
    asked = asked.withColumn("owner", F.xxhash64("tkey", "doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out: dict[str, list] = {k: [] for k in ("core", "ctx", "n", "owner", "c", "lo", "hi", "s")}
            for text, who, cuts in zip(b.column("text").to_pylist(), b.column("owner").to_pylist(), b.column("cuts").to_pylist()):
                data = encoded(text, unit)
                for r in cuts:
                    for k in ("core", "ctx", "n", "c", "lo", "hi"):
                        out[k].append(r[k])
                    # without `across` each context is an owner of its own
                    out["owner"].append(who if across else r["ctx"])
                    out["s"].append(data[r["pos"] + r["lo"] : r["pos"] + r["hi"] + length])
            yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("core", "ctx", "n", "owner", "c")), *(pa.array(out[k], pa.int32()) for k in ("lo", "hi")), pa.array(out["s"], pa.binary())], names=list(out))

    same = [docs["tkey"] == asked["tkey"], docs["doc_id"].eqNullSafe(asked["doc_id"])]
    contexts = docs.join(asked, same).select("text", "owner", "cuts").mapInArrow(cut, "core long, ctx long, n long, owner long, c long, lo int, hi int, s binary")
    contexts = materialize(contexts, "suffixes")
    whole = distinct.where("n > 1").select("core", "ctx", F.array(F.col("r.lo"), F.col("r.hi") + 1).alias("runs"))
    status = whole.unionByName(repeated_contexts(contexts, length, core, hot, per_bucket, unit))
    hits = found.select("tkey", "pos", "step", "times", "core", "ctx").distinct().join(status, ["core", "ctx"])
    return materialize(hits.groupBy("tkey").agg(F.collect_list(F.struct("pos", "step", "times", "runs")).alias("spans")), "spans")


def passages(docs: DataFrame, over: int = 50, **settings) -> DataFrame:
    """tkey, spans (in bytes of word hashes) of the texts with passages of over `over` words that occur in other documents."""
    return repeated_spans(docs, (over + 1) * WORDS, 16 * WORDS, unit=WORDS, across=True, **settings)


def cover(n: int, spans: list[dict] | None, length: int) -> np.ndarray:
    """Maximal removed runs (from, to) of a text of n bytes."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        at = s["pos"] + s["step"] * np.arange(s["times"])
        for i, j in np.array(s["runs"], np.int64).reshape(-1, 2).tolist():
            np.add.at(edge, at + i, 1)
            np.add.at(edge, at + (j - 1 + length), -1)
    inside = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return turn.reshape(-1, 2)


def keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("tkey", F.xxhash64("text"))


def digests(docs: DataFrame, length: int = 400, over: int = 50, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; and n_passages, passage_words.

    The first four speak of strings of `length` bytes that start elsewhere. The last two of passages of over `over` words
    (A-Z lower-cased) that also occur in another document: how many runs of them, of how many words.
    """
    rows = keyed(docs)
    removed = repeated_spans(rows, length, **settings)
    words = passages(rows, over, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            out: list[list] = [[], [], [], [], [], []]
            for text, found, spoken in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("words").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                gone = cover(len(data), found, length)
                kept = data if not len(gone) else b"".join(data[i:j] for i, j in zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(data)]))
                told = word_runs(spoken, over)
                for c, v in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(told), int((told[:, 1] - told[:, 0]).sum()))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"])

    # one small written table, so that Spark can split the hot keys (copies of one text) of the only join
    both = removed.join(words.select("tkey", F.col("spans").alias("words")), "tkey", "full")
    joined = rows.join(materialize(both, "both"), "tkey", "left")
    return joined.select("doc_id", "text", "spans", "words").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long")


def word_runs(spans: list[dict] | None, over: int) -> np.ndarray:
    """Maximal runs of words (from, to) that repeated passages cover."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    length = (over + 1) * WORDS
    end = max(s["pos"] + s["step"] * (s["times"] - 1) + max(s["runs"]) - 1 + length for s in spans)
    return cover(end, spans, length) // WORDS


EDGES = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(data: bytes, gone: np.ndarray) -> bytes:
    """A text without some runs of its words; what stands between the words around a run shrinks to what followed it."""
    if not len(gone):
        return data
    at = [m.span() for m in EDGES.finditer(data)]
    start = [a for a, _ in at] + [len(data)]
    kept, last = [], 0
    for i, j in gone.tolist():
        kept.append(data[last : start[i]])
        last = start[j]
    return b"".join([*kept, data[last:]])


def cleaned(docs: DataFrame, over: int = 50, keep: tuple[str, ...] = (), **settings) -> DataFrame:
    """doc_id, text (and the columns in keep) of each row without the passages of over `over` words that occur in other documents."""
    spans = passages(keyed(docs), over, **settings).withColumnRenamed("tkey", "k")
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep).withColumn("tkey", F.xxhash64("text"))
    rows = carried.join(spans, F.col("tkey") == F.col("k"), "left").select("doc_id", "text", "spans", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            made = [text if found is None else without_words(text.encode("utf-8", "surrogatepass"), word_runs(found, over)).decode("utf-8", "surrogatepass") for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.string()), *(b.column(c) for c in keep)], names=["doc_id", "text", *keep])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(rows.schema[c] for c in keep)]))
