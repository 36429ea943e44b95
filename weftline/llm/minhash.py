"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

Of every hash permutation both the minimum and the maximum are kept, so `bands` bands of four values need two
permutations each. Sets with i of u shingles in common meet in a band with a chance of (i (i - 1) / (u (u - 1))) ** 2, which
is lower for small sets; sets of under SMALL shingles have half as many bands again. Of two sets at similarity 0.75 a link
to their bucket is missed with a chance of at most 4 in 10 ** 11 (`missed`), whatever their sizes.

Equal shingle sets collapse into one node first. Within a band's bucket every node is compared with the bucket's smallest
node only (a star, no pairs within groups), on full sets. Buckets whose nodes then lie in more than one component may
still hide links, so their nodes are joined on the rarest shingles of each set: two sets of the wanted similarity share
one of the first n - ceil(0.75 n) + 1 shingles under any common order, so no link is lost, and passages that many
documents share sort last and cause no pairs. The order comes from a counter table of fixed size (`slots` counters).
Components are found by label propagation in tables in the shared folder.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A text of fewer than five words is one shingle; a text
without words, empty or null has no shingles and no links. Repeated rows and equal texts share a node; null doc_ids take
part (component_id is the smallest non-null doc_id reachable; kept needs doc_id = component_id). Shingles are compared
as 64-bit hashes. Further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, texts
from weftline.llm.components import components
from weftline.llm.words import mix, shingles, word_hashes
from weftline.session import materialize


SMALL = 48


def bands_of(size: int, bands: int) -> int:
    return bands + bands // 2 if size < SMALL else bands


def missed(both: int, union: int, bands: int) -> float:
    """The chance that sets with so many common shingles, of so many together, share no band."""
    smaller = bands_of(union, bands)  # the larger set has at most `union` shingles
    return (1 - (both * (both - 1) / (union * (union - 1))) ** 2) ** smaller if union > 1 else 0.0


def signature(s: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of a set of shingles."""
    bands = bands_of(len(s), bands)
    n = 2 * bands
    a, c = mix(np.arange(1000, 1000 + n, dtype=np.uint64)) | np.uint64(1), mix(np.arange(5000, 5000 + n, dtype=np.uint64))
    low, high = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    for i in range(0, len(s), 1024):
        h = s[i : i + 1024, None] * a + c
        low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
    values = np.concatenate([low.reshape(bands, 2), high.reshape(bands, 2)], 1)
    weights = mix(np.arange(9000, 9004, dtype=np.uint64)) | np.uint64(1)
    return mix((values * weights).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, bands: int, k: int) -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, node (hash of the set), bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(word_hashes(t), k) for t in b.column("text").to_pylist()]
            keys = [signature(s, bands) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tkey"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "tkey", "n_shingles", "node", "bands"],
            )

    return docs.withColumn("tkey", F.xxhash64("text")).mapInArrow(run, "doc_id long, tkey long, n_shingles long, node long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, s (its whole set) of the wanted rows (tkey, owner: a doc_id with that text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(word_hashes(t), k) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "s"])

    wanted = wanted.select(F.col("tkey").alias("t"), "owner").distinct()
    rows = docs.withColumn("tkey", F.xxhash64("text"))
    rows = rows.join(wanted, (rows["tkey"] == wanted["t"]) & rows["doc_id"].eqNullSafe(wanted["owner"]), "left_semi")
    return rows.select("text").mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.where(F.col("i") * 100 >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """node, comp, n, i, h: the shingles of each set that come first (at place i), rarest (by counter) before common."""
    mask = np.uint64(len(counts) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            first = []
            for s in b.column("s"):
                v = np.asarray(s.values).view(np.uint64)
                take = len(v) - -(-len(v) * percent // 100) + 1
                first.append(v[np.lexsort((v, counts[v & mask]))[:take]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("comp"), b.column("n"), pa.array(first, pa.list_(pa.int64()))], names=["node", "comp", "n", "h"])

    return sets.select("node", "comp", F.size("s").alias("n"), "s").mapInArrow(run, "node long, comp long, n int, h array<long>").select("node", "comp", "n", F.posexplode("h").alias("i", "h"))


def placed_documents(docs: DataFrame, percent: int, k: int, bands: int, slots: int) -> DataFrame:
    """doc_id, tkey, n_shingles, comp (the node that names the component, null without shingles) of each row."""
    sigs = materialize(signatures(docs, bands, k), "signatures")
    reps = sigs.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("tkey", "doc_id")).alias("own"), F.first("bands").alias("bands"))
    rows = reps.select("node", F.col("own.tkey").alias("tkey"), F.col("own.doc_id").alias("owner"), F.explode("bands").alias("key"))
    leaders = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1").select("key", "leader")
    # written tables on the small sides let Spark split the hot keys of the large sides
    leaders = materialize(leaders, "leaders")
    multi = materialize(rows.join(leaders, "key"), "buckets")
    sets = materialize(full_sets(docs, multi, k), "sets")
    star = multi.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirmed(star, sets, percent), "links")
    comp = components(links)

    placed = multi.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_nodes = placed.join(mixed, "key", "left_semi").select("node", "comp").distinct()
    open_sets = materialize(sets.join(open_nodes, "node"), "open")
    slot = F.explode(F.transform("s", lambda x: x.bitwiseAND(F.lit(slots - 1))))
    counts = np.zeros(slots, np.int64)
    for r in open_sets.select(slot.alias("slot")).groupBy("slot").count().toLocalIterator():
        counts[r.slot] = r["count"]
    first = materialize(prefixes(open_sets, counts, percent), "prefixes")
    # a shingle's largest component meets the others only, never itself
    by_comp = first.groupBy("h", "comp").agg(F.count("*").alias("c"))
    shared = by_comp.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("h", F.col("m.comp").alias("main"))
    first = materialize(first.join(shared, "h"), "prefixes")
    l, r = first.where("comp <> main").alias("l"), first.alias("r")
    # at the first shingle that two sets share, what follows in both bounds their intersection
    enough = f"(100 + {percent}) * least(l.n - l.i, r.n - r.i) >= {percent} * (l.n + r.n)"
    ok = F.expr(f"l.h = r.h and l.comp <> r.comp and (r.comp = r.main or l.node < r.node) and 100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) and {enough}")
    pairs = l.join(r, ok).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    more = materialize(confirmed(pairs, sets, percent), "links")
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    return sigs.join(comp, "node", "left").select("doc_id", "tkey", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).alias("comp"))


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, bands: int = 64, slots: int = 1 << 18) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component (the node that names it, null without shingles) of each row."""
    placed = placed_documents(texts(docs), percent, k, bands, slots)
    ids = materialize(placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "ids")
    out = placed.join(ids, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.col("comp").alias("component"))


#: DuckDB SQL of near_duplicates' first four columns: every pair of documents that share a shingle, and their closure.
ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
    x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
    SELECT s.doc_id, any_value(len(sh)) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id"""


def survivors(docs: DataFrame, percent: int = 75, k: int = 5, bands: int = 64, slots: int = 1 << 18) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the one of the smallest doc_id, and every text without words.

    Repeated rows of one doc_id and text are one document, so one of them stays.
    """
    placed = placed_documents(texts(docs), percent, k, bands, slots)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("own")
    best = placed.where("comp is not null").groupBy("comp").agg(first).select(F.col("own.doc_id").alias("d_"), F.col("own.tkey").alias("t_"))
    stay = materialize(best.unionByName(placed.where("comp is null").select(F.col("doc_id").alias("d_"), F.col("tkey").alias("t_")).distinct()), "stay")
    rows = docs.withColumn("k_", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(stay, (F.col("k_") == F.col("t_")) & F.col("doc_id").cast("long").eqNullSafe(F.col("d_")), "left_semi")
    return rows.dropDuplicates(["k_", "doc_id"]).drop("k_")
