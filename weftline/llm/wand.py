"""Ranked lexical search by variable-block-max WAND over an index in document shards.

Index: every task deals its documents to shards of bounded size and inverts each on its own, so no posting is shuffled. A
shard is one row: document ids and lengths, sorted term hashes, and for each term its postings (documents, counts) in
blocks with the block's highest score part. Block boundaries are those, among all partitions into blocks of up to
`longest` postings, for which the sum of all differences between a block's maximum and its postings, plus `overhead` a
block, is least: a dynamic program along each list, for many lists at once.

Search: queries (the stated query set) are dealt to groups of bounded size, which are sent to all shards. In a shard, the
bounds (weight times block maximum) of all blocks that span a document are added up, those of thin blocks, which span over
four times as many documents as they hold, for the documents that they hold only; a document whose sum is under the
query's current k-th score can't enter and is skipped, and so are blocks that span no other document. The documents of
the highest sums are scored first, which raises the threshold for the rest. A task takes the threshold on from shard to
shard. Sums equal to the threshold are never skipped, so ties come out exactly. Every task returns the k best of each
query; a window over these ranks them.

Terms are maximal runs of letters A-Z (lower-cased), digits and characters above 0x7F. Term scores are whole numbers: w *
((1000000000 tf) div (1000 tf + 12 m)) with m = 75 + (25 n N) div L. Terms are told apart by 64-bit hashes.

Null or empty texts have no terms: as documents they are never found, as queries they find nothing. A null doc_id comes
after all others among equal scores; repeated rows are separate documents (and separate queries, with lists of their own
under one id). Further columns are ignored; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import give_back, slices, texts
from weftline.llm.katz import pack, pack_sorted, unpack, unpack_sorted
from weftline.llm.words import word_hashes
from weftline.session import materialize

#: the byte values that separate terms
BETWEEN = np.zeros(256, bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    BETWEEN[low : high + 1] = True

SHARD = "n_docs int, n_terms int, n_postings int, n_blocks int, ids binary, known binary, lengths binary, terms binary, df binary, docs binary, tf binary, ends binary, maxima binary"
LANES, CELLS = 1 << 14, 1 << 20  # lists and list cells that the dynamic program takes on at once


def terms_of(text: str) -> np.ndarray:
    return word_hashes(text, BETWEEN)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = []
            for t in b.column("text").to_pylist():
                inside = ~BETWEEN[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)]
                n.append(int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum()))
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["n", "l"])

    got = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return got.n or 0, got.l or 0


def parts(tf: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a posting gives for each unit of its term's weight; lengths: the document's terms."""
    whole, rest = divmod(25 * n, total)
    m = 75 + lengths * whole + lengths * rest // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def block_ends(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int, overhead: int) -> np.ndarray:
    """Whether each value ends a block; the lists' blocks have the least sum of (maximum - value) + overhead a block."""
    ends = np.zeros(len(values), bool)
    ends[starts + sizes - 1] = True
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    at = 0
    while at < len(order):
        steps = int(sizes[order[at]])
        lists = order[at : at + min(LANES, max(1, CELLS // steps))]
        at += len(lists)
        _ends_of(values, starts[lists], sizes[lists], min(longest, steps), overhead, ends)
    return ends


def _ends_of(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int, overhead: int, ends: np.ndarray) -> None:
    """Lists by falling size. Slot j % longest stands for the block that starts at j."""
    n, steps = len(starts), int(sizes[0])
    high, paid = np.zeros((n, longest), np.int64), np.full((n, longest), 1 << 60, np.int64)
    paid[:, 0] = 0
    taken = np.zeros((steps, n), np.int32)
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    ages = np.arange(longest)
    for i in range(steps):
        k = int(active[i])
        high[:k, i % longest] = 0
        top = high[:k]
        np.maximum(top, values[starts[:k] + i, None], out=top)
        length = (i - ages) % longest + 1
        cost = top * length
        cost += paid[:k]
        best = cost.argmin(1)
        taken[i, :k] = length[best]
        paid[:k, (i + 1) % longest] = cost[np.arange(k), best] + overhead
    place, lane = sizes - 1, np.arange(n)
    while len(lane):
        ends[starts[lane] + place] = True
        place = place - taken[place, lane]
        lane, place = lane[place >= 0], place[place >= 0]


def shard(ids: list[int | None], words: list[np.ndarray], n: int, total: int, longest: int, overhead: int) -> dict:
    """One row of the index."""
    sizes = np.array([len(w) for w in words], np.int64)
    terms, inverse = np.unique(np.concatenate(words), return_inverse=True)
    keys, tf = np.unique(inverse * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, doc = np.divmod(keys, len(ids))
    df = np.bincount(term, minlength=len(terms))
    starts = np.cumsum(df) - df
    value = parts(tf.astype(np.int64), sizes[doc], n, total)
    ends = block_ends(value, starts, df, longest, overhead)
    first = np.flatnonzero(np.r_[True, ends[:-1]])
    return {
        "n_docs": len(ids), "n_terms": len(terms), "n_postings": len(tf), "n_blocks": len(first), "ids": pack(np.array([i or 0 for i in ids], np.int64)), "known": pack(np.array([i is not None for i in ids], np.uint8)),
        "lengths": pack(sizes.astype(np.uint32)), "terms": pack_sorted(terms), "df": pack(df.astype(np.uint32)), "docs": pack(doc.astype(np.uint32)), "tf": pack(tf.astype(np.uint32)),
        "ends": pack(np.packbits(ends)), "maxima": pack(np.maximum.reduceat(value, first).astype(np.uint32)),
    }


def index(docs: DataFrame, n: int, total: int, docs_each: int = 8192, terms_each: int = 2_000_000, longest: int = 64, overhead: int = 1_000_000) -> DataFrame:
    """Shards of up to docs_each documents and, but for a last document that passes it, terms_each terms."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, words, size = [], [], 0
        for b in slices(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = terms_of(t)
                if len(w):
                    ids.append(i)
                    words.append(w)
                    size += len(w)
                if len(ids) >= docs_each or size >= terms_each:
                    yield shard(ids, words, n, total, longest, overhead)
                    ids, words, size = [], [], 0
        if ids:
            yield shard(ids, words, n, total, longest, overhead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for v in r.values()], names=list(r))

    return docs.select("doc_id", "text").mapInArrow(run, SHARD)


class Group:
    """Some queries: their distinct terms, and each one's places among these with weights."""

    def __init__(self, items: list[tuple[int, int | None, np.ndarray]]):
        self.numbers, self.ids = [x[0] for x in items], [x[1] for x in items]
        self.terms = np.unique(np.concatenate([x[2] for x in items]))
        self.places, self.times = [], []
        for _, _, w in items:
            own, times = np.unique(w, return_counts=True)
            self.places.append(np.searchsorted(self.terms, own))
            self.times.append(times.astype(np.int64))

    def weigh(self, df: dict[int, int], n: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms.view(np.int64).tolist()], np.int64)
        self.weights = [w[p] * t for p, t in zip(self.places, self.times)]


def groups(queries: DataFrame, id_col: str, terms_each: int, items_each: int) -> Iterator[Group]:
    """The query set in groups of bounded size; queries without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([terms_of(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["item", "terms"])

    items, size = [], 0
    for number, r in enumerate(texts(queries, id_col).mapInArrow(run, "item long, terms binary").where("length(terms) > 0").toLocalIterator()):
        items.append((number, r["item"], np.frombuffer(bytes(r["terms"]), np.uint64)))
        size += len(items[-1][2])
        if size >= terms_each or len(items) >= items_each:
            yield Group(items)
            items, size = [], 0
    if items:
        yield Group(items)


def find(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted terms' places among sorted terms, -1 where they don't occur."""
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


def frequencies(indexed: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of a group's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms), np.int64)
        for b in batches:
            for r in b.to_pylist():
                at = find(unpack_sorted(r["terms"], r["n_terms"], "u8"), terms)
                sums[at >= 0] += unpack(r["df"], r["n_terms"], "u4")[at[at >= 0]]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(sums[some])], names=["h", "df"])

    rows = indexed.select("n_terms", "terms", "df").mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    return {r.h: r.df for r in rows.toLocalIterator()}


def runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, last), one range after another."""
    size = last - first
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Shard:
    """A row of the index, unpacked."""

    def __init__(self, r: dict, n: int, total: int):
        self.n_docs, postings = r["n_docs"], r["n_postings"]
        self.ids, self.known = unpack(r["ids"], self.n_docs, "i8"), unpack(r["known"], self.n_docs, "u1").astype(bool)
        self.terms = unpack_sorted(r["terms"], r["n_terms"], "u8")
        df = unpack(r["df"], r["n_terms"], "u4").astype(np.int64)
        self.docs = unpack(r["docs"], postings, "u4").astype(np.int32)
        lengths = unpack(r["lengths"], self.n_docs, "u4").astype(np.int64)
        self.value = parts(unpack(r["tf"], postings, "u4").astype(np.int64), lengths[self.docs], n, total)
        ends = np.unpackbits(unpack(r["ends"], -(-postings // 8), "u1"), count=postings).astype(bool)
        self.after = np.flatnonzero(ends) + 1  # of each block, the posting after it
        self.start = np.r_[0, self.after[:-1]]
        self.maxima = unpack(r["maxima"], r["n_blocks"], "u4").astype(np.int64)
        self.from_doc, self.to_doc = self.docs[self.start], self.docs[self.after - 1] + 1
        self.thin = self.to_doc - self.from_doc > 4 * (self.after - self.start)
        self.block_to = np.searchsorted(self.start, np.cumsum(df))  # of each term, the block after its last
        self.block_from = np.r_[0, self.block_to[:-1]]

    def scores(self, wanted: np.ndarray, blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted documents; blocks that span none of them aren't read."""
        upto = np.r_[0, np.cumsum(wanted)]
        some = upto[self.to_doc[blocks]] > upto[self.from_doc[blocks]]
        blocks, weights = blocks[some], weights[some]
        at = runs(self.start[blocks], self.after[blocks])
        docs, each = self.docs[at], np.repeat(weights, self.after[blocks] - self.start[blocks])
        keep = wanted[docs]
        out = np.zeros(self.n_docs, np.int64)
        np.add.at(out, docs[keep], each[keep] * self.value[at[keep]])
        return out

    def best(self, places: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (and scores) that may be among a query's k best, given its k-th score so far."""
        held = places >= 0
        first, last = self.block_from[places[held]], self.block_to[places[held]]
        blocks, weights = runs(first, last), np.repeat(weights[held], last - first)
        each, thin = weights * self.maxima[blocks], self.thin[blocks]
        bound = np.zeros(self.n_docs + 1, np.int64)
        np.add.at(bound, self.from_doc[blocks[~thin]], each[~thin])
        np.subtract.at(bound, self.to_doc[blocks[~thin]], each[~thin])
        bound = np.cumsum(bound)[:-1]
        start, after = self.start[blocks[thin]], self.after[blocks[thin]]
        np.add.at(bound, self.docs[runs(start, after)], np.repeat(each[thin], after - start))
        live = bound >= max(least, 1)
        if np.count_nonzero(live) > 8 * k:
            top = np.zeros(self.n_docs, bool)
            top[np.argpartition(-bound, 4 * k)[: 4 * k]] = True
            scores = self.scores(top, blocks, weights)
            least = max(least, int(np.partition(scores, -k)[-k]))
            live &= (bound >= max(least, 1)) & ~top
        else:
            scores = np.zeros(self.n_docs, np.int64)
        if live.any():
            scores += self.scores(live, blocks, weights)
        found = np.flatnonzero(scores >= max(least, 1))
        return found, scores[found]


def best_of(indexed: DataFrame, group: Group, n: int, total: int, k: int) -> DataFrame:
    """number (of the query), item_id, doc_id, score: each task's k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        tops = [(none, none, none) for _ in group.numbers]  # -score, whether the id is null, id
        for b in batches:
            for i in range(b.num_rows):
                s = Shard(b.slice(i, 1).to_pylist()[0], n, total)
                at = find(s.terms, group.terms)
                for q, (places, weights) in enumerate(zip(group.places, group.weights)):
                    scores, null, ids = tops[q]
                    found, new = s.best(at[places], weights, k, -int(scores[k - 1]) if len(scores) == k else 0)
                    if len(found):
                        both = np.r_[scores, -new], np.r_[null, (~s.known[found]).astype(np.int64)], np.r_[ids, s.ids[found]]
                        order = np.lexsort(both[::-1])[:k]
                        tops[q] = tuple(x[order] for x in both)
        sizes = [len(x[0]) for x in tops]
        scores, null, ids = (np.concatenate([x[i] for x in tops]) for i in range(3))
        item = pa.array(group.ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(group.numbers, sizes).astype(np.int64)), item, pa.array(ids, mask=null.astype(bool)), pa.array(-scores)], names=["number", "item_id", "doc_id", "score"])
        give_back()

    return indexed.mapInArrow(run, "number long, item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "item_id", k: int = 20, terms_each: int = 1 << 20, items_each: int = 1 << 14) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each row of queries, if their score is above 0."""
    docs = texts(docs)
    n, total = statistics(docs)
    found = docs.sparkSession.createDataFrame([], "number long, item_id long, doc_id long, score long")
    if n:
        indexed = materialize(index(docs, n, total), "index")
        for group in groups(queries, id_col, terms_each, items_each):
            group.weigh(frequencies(indexed, group.terms), n)
            found = found.unionByName(best_of(indexed, group, n, total, k))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of search's result: every document that shares a term with an item is scored.
ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
    g AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
    m AS (SELECT doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM d, g WHERE len(w) > 0),
    q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY 1, 2),
    p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
    w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY 1),
    s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
