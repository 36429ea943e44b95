"""Set-similarity self-join on word shingles by adaptive prefixes with multiple matches.

Every document is a set of shingles, ordered from rare to common. Two sets of a Jaccard similarity of `percent` or more
share at least l of the first n - ceil(n * percent / 100) + l shingles of each, for every l. Each set picks its own l: a
longer prefix costs more to look up but lets a pair through only with as many matches. The estimate weighs the lengths of
the prefix' posting lists against the candidates these can hold with l matches each, times the cost to verify one; both come
from a table of counters by shingle hash, gathered over all documents and of a fixed size. A pair must share as many
shingles as the smaller l of its two sets, then it is verified on the full sets.

Equal sets are one node. Postings are the shingles of a prefix for l = 1; all other shingles are looked up in the prefixes
that pairs bring along. Shingles, and the documents whose sets are wanted, are sifted by bitmaps of a bounded size before
they are shuffled. In each posting list every node is first paired with one node only, the one whose prefix is most
common (unedited texts come before edited copies); verified pairs give components. Then nodes of different components that
share a list are paired, but not with their own component, and not where sizes or the places of the shared shingle in both
orders rule similarity out. So no link between components is lost, and groups of thousands of near copies, of which each is
linked to a central one, take pairs in proportion to their size. Copies are never expanded into pairs.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A text with fewer than `k` words is one shingle; a text without words,
empty or null, has none and no links. Null doc_ids take part (component_id is the smallest non-null doc_id reachable).
Repeated rows share a node; shingles and sets are told apart by 64-bit hashes; further columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import give_back, slices, texts
from weftline.llm.components import components
from weftline.llm.katz import pack, unpack
from weftline.llm.minhash import confirmed, node_of
from weftline.llm.words import shingles, word_hashes
from weftline.session import materialize

BLOCK = 1 << 16  # counters in a row


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, node (hash of the set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(word_hashes(t), k) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())], names=["doc_id", "tkey", "n_shingles", "node"])

    return docs.withColumn("tkey", F.xxhash64("text")).mapInArrow(run, "doc_id long, tkey long, n_shingles long, node long")


def counters(docs: DataFrame, k: int, slots: int) -> np.ndarray:
    """How many documents hold the shingles of each slot (the low bits of their hashes); copies of a text in one batch count once."""
    schema, kind = "block int, counts binary", "u4"

    def rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(v.astype(kind))], pa.binary())], names=["block", "counts"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(slots, np.uint32)
        for b in slices(batches, 2048):
            for t in set(b.column("text").to_pylist()):
                at, c = np.unique(shingles(word_hashes(t), k) & np.uint64(slots - 1), return_counts=True)
                sums[at] += c.astype(np.uint32)
        yield from rows({i: v for i, v in enumerate(sums.reshape(-1, min(BLOCK, slots))) if v.any()})
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, packed in zip(b.column("block").to_pylist(), b.column("counts")):
                v = unpack(packed.as_py(), min(BLOCK, slots), kind)
                sums[i] = sums[i] + v if i in sums else v.astype(np.int64)
        yield from rows({i: np.minimum(v, (1 << 32) - 1) for i, v in sums.items()})

    out = np.zeros((max(1, slots // BLOCK), min(BLOCK, slots)), np.uint32)
    for r in docs.select("text").mapInArrow(tally, schema).repartition(max(1, slots // BLOCK), "block").mapInArrow(merge, schema).toLocalIterator():
        out[r.block] = unpack(bytes(r.counts), out.shape[1], kind)
    return out.ravel()


def estimates(counts: np.ndarray) -> np.ndarray:
    """For each slot eight times the binary logarithm of a posting list's length, in a byte: the count above what the mean slot has."""
    mean, out = counts.mean(), np.zeros(len(counts), np.uint8)
    for i in range(0, len(counts), BLOCK):
        out[i : i + BLOCK] = np.round(8 * np.log2(np.maximum(counts[i : i + BLOCK] - mean, 1.0)))
    return out


def base_length(n: int, percent: int) -> int:
    """The prefix that similar sets share at least one shingle of."""
    return n - -(-n * percent // 100) + 1


def matches(lengths: np.ndarray, n: int, base: int, most: int, unseen: float = 0.1) -> int:
    """The number of matches to require, given the estimated posting lists of a set's shingles in order.

    unseen: what a list is taken to hold of other sets at least, as the counters can't tell short lists apart.
    """
    others = np.cumsum(np.maximum(lengths[: base + most - 1] - 1.0, unseen))
    l = np.arange(1, len(others) - base + 2)
    looked_up = others[base - 1 :]
    # of as many postings, at most an l-th part can be sets with l matches
    return int(np.argmin(looked_up + looked_up / l * n)) + 1


def prefixes(docs: DataFrame, k: int, percent: int, sizes: np.ndarray, most: int) -> DataFrame:
    """node, n, base, l, common (how common its first shingles are), p (its prefix) of each set."""
    mask = np.uint64(len(sizes) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: dict[str, list] = {"node": [], "n": [], "base": [], "l": [], "common": [], "p": []}
            for t in set(b.column("text").to_pylist()):
                s = shingles(word_hashes(t), k)
                if n := len(s):
                    size, base = sizes[s & mask], base_length(n, percent)
                    order = np.lexsort((s, size))
                    l = matches(np.exp2(size[order[: base + most - 1]] / 8.0), n, base, most)
                    for name, v in zip(out, (node_of(s), n, base, l, float(size[order[:base]].mean()), s[order[: base + l - 1]].view(np.int64))):
                        out[name].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], names=list(out))
        give_back()

    return docs.select("text").mapInArrow(run, "node long, n int, base int, l int, common double, p array<long>").dropDuplicates(["node"])


class Sieve:
    """The low bits of a column's hashes, as a bitmap of a bounded size: lets all of them through and few others.

    Rows are sifted before they are shuffled; where the bitmap is full, more pass and exact joins do all the work.
    """

    def __init__(self, rows: DataFrame, column: str, most: int = 1 << 26):
        self.size = min(most, 1 << max(15, (16 * rows.count()).bit_length()))
        self.bits = np.zeros(self.size >> 3, np.uint8)
        place = rows.select(F.col(column).bitwiseAND(F.lit(self.size - 1)).alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
        for r in place.toLocalIterator():
            self.bits[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(bytes(r.bits), np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64(self.size - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def postings(prefix: DataFrame, sieve: Sieve) -> DataFrame:
    """node, n, common, i, h: the shingles of each prefix for one match that pass the sieve, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, lists = b.column("base").to_numpy(), b.column("p")
            offsets = lists.offsets.to_numpy()
            own = np.repeat(np.arange(b.num_rows), base)
            i = np.arange(len(own)) - np.repeat(np.cumsum(base) - base, base)
            h = lists.values.to_numpy()[offsets[own] + i]
            keep = sieve(h)
            own = pa.array(own[keep])
            yield pa.RecordBatch.from_arrays([b.column("node").take(own), b.column("n").take(own), b.column("common").take(own), pa.array(i[keep].astype(np.int32)), pa.array(h[keep])], names=["node", "n", "common", "i", "h"])

    return prefix.select("node", "n", "base", "common", "p").mapInArrow(run, "node long, n int, common double, i int, h long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, s (its whole set) of the wanted nodes (node, own: a row's text and id, hashed)."""
    sieve = Sieve(wanted, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.flatnonzero(sieve(b.column("own").to_numpy()))
            for part in slices([pa.RecordBatch.from_arrays([b.column("text").take(pa.array(keep))], names=["text"])]):
                sets = [shingles(word_hashes(t), k) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "s"])
        give_back()

    rows = docs.select("text", own_row(F.xxhash64("text"), F.col("doc_id")).alias("own")).mapInArrow(run, "node long, s array<long>")
    return rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def own_row(tkey: Column, doc_id: Column) -> Column:
    return F.xxhash64(tkey, doc_id)


def enough(a: str, b: str, percent: int) -> str:
    """SQL: whether two sets of sizes n that share a shingle at places i, and none before, can be similar."""
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and (100 + {percent}) * least({a}.n - {a}.i, {b}.n - {b}.i) >= {percent} * ({a}.n + {b}.n)"


def matched(pairs: DataFrame, prefix: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as the smaller number of matches."""
    side = lambda x, y: prefix.select(F.col("node").alias(x), F.col("p").alias(y), F.col("l").alias(f"l{x}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.where("size(array_intersect(x, y)) >= least(la, lb)").select("a", "b")


def node_components(docs: DataFrame, sigs: DataFrame, percent: int, k: int, slots: int, most: int) -> DataFrame:
    """node, comp of every node that has a link."""
    prefix = materialize(prefixes(docs, k, percent, estimates(counters(docs, k, slots)), most), "prefixes")
    owners = sigs.groupBy("node").agg(F.min(F.struct("tkey", "doc_id")).alias("own")).select("node", own_row(F.col("own.tkey"), F.col("own.doc_id")).alias("own"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(matched(pairs, prefix), "candidates")
        wanted = materialize(owners.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "wanted")
        return materialize(confirmed(pairs, materialize(full_sets(docs, wanted, k), "sets"), percent), "links")

    often = materialize(prefix.select(F.explode(F.slice("p", F.lit(1), F.col("base"))).alias("h")).groupBy("h").count().where("count > 1").select("h"), "often")
    own = postings(prefix, Sieve(often, "h"))
    # a written table on the small side lets Spark split the hot keys of the large side
    lists = own.groupBy("h").agg(F.count("*").alias("c"), F.max(F.struct("common", "node", "n", "i")).alias("first")).where("c > 1").select("h", "first")
    shared = materialize(own.join(materialize(lists, "lists"), "h"), "postings")
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = materialize(shared.alias("own").where(f"own.node <> first.node and {enough('own', 'first', percent)}").select(*ends("first.node", "own.node")).distinct(), "star")
    links = verified(star)
    comp = components(links)

    placed = shared.select("h", "node", "n", "i").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_comp = placed.groupBy("h", "comp").agg(F.count("*").alias("c"))
    # a list's largest component meets the others only, never itself
    mixed = by_comp.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("h", F.col("m.comp").alias("main"))
    placed = materialize(placed.join(materialize(mixed, "mixed"), "h"), "postings")
    l, r = placed.where("comp <> main").alias("l"), placed.alias("r")
    ok = F.expr(f"l.h = r.h and l.comp <> r.comp and (r.comp = r.main or l.node < r.node) and {enough('l', 'r', percent)}")
    more = verified(l.join(r, ok).select(*ends("l.node", "r.node")).distinct().join(star, ["a", "b"], "left_anti"))
    return comp if more.isEmpty() else components(links.unionByName(more))


def similar(docs: DataFrame, percent: int = 90, k: int = 3, slots: int = 1 << 24, most: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; slots: how many counters, a power of 2; most: matches required at most."""
    docs = texts(docs)
    sigs = materialize(signatures(docs, k), "signatures")
    comp = node_components(docs, sigs.where("n_shingles > 0"), percent, k, slots, most)
    placed = sigs.join(comp, "node", "left").withColumn("comp", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")))
    ids = materialize(placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "ids")
    out = placed.join(ids, "comp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


#: DuckDB SQL of similar's result: every pair of documents that share a shingle, and the closure of links.
ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM d),
    x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
    SELECT s.doc_id, CAST(any_value(len(sh)) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id"""
