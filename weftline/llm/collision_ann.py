"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Every vector is projected on `projections` random directions; each projection is a sorted array. A query looks at the
windows around its own projections, of width proportional to a radius R that grows by `ratio` (virtual rehashing: the
windows only widen, the arrays stay). A vector that lies in the windows of at least `threshold` of the arrays is verified
by its exact distance. The search ends once k + `share` of the vectors (150 at least) are verified and the k-th best lies within the
radius that the windows stand for, or at the latest once twice that many are verified at the end of a widening.

All vectors are indexed: blocks of about `block` vectors (dealt by a hash of vec_id, so that copies of one vector spread)
meet blocks of queries, each pair of blocks in a task of bounded size; every block returns its k best for a query and a
final top-k merges them. Distances are Euclidean in double precision on the original vectors; ties go to the smaller
vec_id. Recall is measured against brute force in the tests (at least 0.9).

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id, take no part.
Vectors of different lengths don't meet. Of repeated rows of one vec_id the smallest vector counts once. Fewer than k
candidates: all are returned. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, projections: int, threshold: float, share: float, ratio: float, seed: int) -> list[tuple[int, int, float]]:
    """Rows (query's place, vec_id, distance) of one block."""
    n, d = x.shape
    a = np.random.default_rng(seed).standard_normal((d, projections)) / np.sqrt(d)
    px, pq = x @ a, q @ a
    order = np.argsort(px, axis=0, kind="stable")
    line = np.take_along_axis(px, order, 0).T
    order = order.T.ravel()
    # the arrays lie one behind another, shifted apart, so that one search finds a window's ends in all of them
    reach = 4 * float(max(np.abs(px).max(), np.abs(pq).max(initial=0.0))) + 1.0
    shift = np.arange(projections) * 4 * reach
    line = (line + shift[:, None]).ravel()
    begin, end = np.arange(projections) * n, (np.arange(projections) + 1) * n
    need, goal = int(np.ceil(threshold * projections)), min(n, k + max(150, int(np.ceil(share * n))))
    first = float(np.median(px.std(axis=0))) * 0.05 + 1e-12
    # a window half as wide as a projected distance of R / sqrt(d) stands for the radius R
    out = []
    for j in range(len(q)):
        own_line = pq[j] + shift
        low = high = np.searchsorted(line, own_line)
        count, checked = np.zeros(n, np.int32), np.zeros(n, bool)
        dist = np.full(n, np.inf)
        half = first
        while True:
            l = np.maximum(np.minimum(np.searchsorted(line, own_line - half, "left"), low), begin)
            h = np.minimum(np.maximum(np.searchsorted(line, own_line + half, "right"), high), end)
            # the windows only widen: what each gained on both sides
            starts, sizes = np.concatenate([l, high]), np.concatenate([low - l, h - high])
            at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            count += np.bincount(order[at], minlength=n).astype(np.int32)
            low, high = l, h
            fresh = np.flatnonzero((count >= need) & ~checked)
            checked[fresh] = True
            dist[fresh] = np.sqrt(((x[fresh] - q[j]) ** 2).sum(1))
            done = int(checked.sum())
            if done >= goal:
                kth = np.partition(dist, min(k, n - 1))[min(k, n - 1)]
                if done >= 2 * goal or kth <= half * np.sqrt(d) or done == n:
                    break
            if done == n:
                break
            half = min(half * ratio, reach)
        best = np.flatnonzero(np.isfinite(dist) & (ids != own[j]))
        best = best[np.lexsort((ids[best], dist[best]))[:k]]
        out += [(j, int(ids[b]), float(dist[b])) for b in best]
    return out


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, projections: int = 100, threshold: float = 0.7, share: float = 0.08, ratio: float = 1.25, block: int = 20_000, query_block: int = 1_000, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query (columns vec_id, embedding)."""
    base, asked = usable(vectors), usable(queries)
    n, m = base.count(), asked.count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-m // query_block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    left = base.select("vec_id", "v", F.size("v").alias("d"), dealt(blocks).alias("b"), every(parts).alias("p"))
    right = asked.select("vec_id", "v", F.size("v").alias("d"), dealt(parts).alias("p"), every(blocks).alias("b"))

    def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("vec_id").to_numpy()
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        order = np.lexsort((*v.T[::-1], ids))
        ids, v = ids[order], v[order]
        keep = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
        return ids[keep], v[keep]

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        found = []
        if l.num_rows and r.num_rows:
            (ids, x), (own, q) = unpack(l), unpack(r)
            found = [(int(own[j]), i, s) for j, i, s in search(x, ids, q, own, k, projections, threshold, share, ratio, seed)]
        cols = list(zip(*found)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    near = left.groupBy("d", "b", "p").cogroup(right.groupBy("d", "b", "p")).applyInArrow(run, RESULT)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
