"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Source i has the integer weight e_i; P is the sum of the weights, its share e_i / P. Its j-th block (from 1) is released
at slot floor((j - 1) P / e_i) and due by slot ceil(j P / e_i). Earliest deadline first (ties: the source's name) fills
one slot after another from the released blocks; as the shares add up to 1, no slot idles and no deadline is missed, so
after any number of slots a source has had its share to within less than one block, for as long as no source has run out.
The schedule repeats every P slots, so one period is simulated (a fold over P slots and the sources, whose numbers are
bounded by parameters) and every row finds its slot by arithmetic. When a source is exhausted its slots fall away and the
others go on in the same order: no row is dropped or repeated. `position` is the row's place in the mixed stream: over
the sources, the rows that go before its slot, in closed form.

Rows of a source are ordered by the MD5 of doc_id (then doc_id). Ranks come from counts over hash ranges (the first hex
digits) and a numbering within each range; there are enough digits for about `each` rows in a range if one source had all
rows. Rows without a doc_id share one MD5 and are dealt over as many ranges of their own.

A null source is a source of its own; null doc_ids are kept (hashed like any value); repeated rows are separate rows, in
any order among themselves; texts are not read; an empty table gives none; further columns are ignored, or carried with
`keep`, under the names of their own where they clash with none of this operator's. More than `most` sources, or weights
that add up to more than `longest`, raise an error.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Target weights of the registered query; sources that aren't named have weight 1.
WEIGHTS = {"src0": 6, "src1": 4, "src2": 4, "src3": 3, "src4": 2, "src5": 2}

PERIOD = """
transform(array(aggregate(transform(s, x -> x.e), 0L, (a, e) -> a + e)), p -> named_struct('p', p, 'slots', aggregate(
    sequence(0L, p - 1L),
    named_struct('had', transform(s, x -> 0L), 'out', cast(array() as array<struct<i: bigint, had: array<bigint>>>)),
    (acc, t) -> transform(array(array_min(transform(s, (x, i) -> if(
            acc.had[i] * p div x.e <= t, named_struct('due', ((acc.had[i] + 1L) * p + x.e - 1L) div x.e, 'i', cast(i as bigint)), null)))),
        pick -> named_struct(
            'had', transform(acc.had, (v, i) -> if(i = pick.i, v + 1L, v)),
            'out', concat(acc.out, array(named_struct('i', pick.i, 'had', acc.had)))))[0],
    acc -> acc.out)))[0]
"""


def named(source: str) -> F.Column:
    """A key that tells null from every name."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def period(counts: DataFrame, weights: dict[str, int], default: int, most: int, longest: int) -> DataFrame:
    """One period's slots: i and key of the source, turn (its blocks before), t, p, e, and before / n / w arrays by source."""
    if any(not isinstance(v, int) or v < 1 for v in [*weights.values(), default]):
        raise ValueError("weights are positive integers")
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("+" + k, v)]) if weights else F.lit(None).cast("map<string,int>")
    rows = counts.select("key", "n", F.coalesce(table[F.col("key")], F.lit(default)).cast("long").alias("e"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("key", "n", "e"))).alias("s"), F.count("*").alias("c"), F.sum("e").alias("total"))
    one = one.where(F.expr(f"if(c > {most} or total > {longest}, raise_error('too many sources, or weights that add up to too much'), c > 0)"))
    one = one.select("s", F.expr(PERIOD).alias("period"))
    slots = one.select("s", "period.p", F.posexplode("period.slots").alias("t", "slot"))
    return slots.select(F.expr("s[slot.i].key").alias("key"), F.expr("slot.had[slot.i]").alias("turn"), F.col("t").cast("long").alias("t"), "p", F.expr("s[slot.i].e").alias("e"), F.col("slot.had").alias("before"), F.expr("transform(s, x -> x.n)").alias("ns"), F.expr("transform(s, x -> x.e)").alias("es"))


def oracle(weights: dict[str, int], default: int = 1) -> str:
    """DuckDB SQL of the mixed stream for blocks of one row: the schedule slot by slot, in a recursive query."""
    table = ", ".join(f"('+{k}', {v})" for k, v in weights.items())
    return f"""WITH RECURSIVE w(key, e) AS (VALUES {table}),
        d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key FROM documents),
        s AS (SELECT key, n, coalesce(e, {default}) AS e, row_number() OVER (ORDER BY key) AS i FROM (SELECT key, count(*) AS n FROM d GROUP BY 1) LEFT JOIN w USING (key)),
        one AS (SELECT list(e ORDER BY i) AS es, list(n ORDER BY i) AS ns, CAST(sum(e) AS BIGINT) AS p FROM s),
        sim(t, pick, had) AS (
            SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(es, lambda x: CAST(0 AS BIGINT)) FROM one
            UNION ALL
            SELECT t + 1, nxt, list_transform(had, lambda v, i: CASE WHEN i = nxt THEN v + 1 ELSE v END) FROM (
                SELECT t, had, p, list_min(list_filter(list_transform(es, lambda e, i: CASE WHEN had[i] * p // e <= t + 1 THEN ((had[i] + 1) * p + e - 1) // e * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS nxt FROM sim, one) WHERE t + 1 < p),
        slots AS (SELECT a.t + 1 AS t, b.pick AS i, a.had AS before, a.had[b.pick] AS turn FROM sim a JOIN sim b ON b.t = a.t + 1),
        r AS (SELECT d.doc_id, d.source, s.i, s.e, row_number() OVER (PARTITION BY key ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS b FROM d JOIN s USING (key))
        SELECT doc_id, source, b AS block, CAST(b // e * p + t AS BIGINT) AS slot, CAST(b * p // e AS BIGINT) AS release, CAST(((b + 1) * p + e - 1) // e AS BIGINT) AS deadline,
            CAST(list_sum(list_transform(es, lambda x, j: least(ns[j], b // e * x + before[j]))) AS BIGINT) AS position FROM r JOIN slots ON slots.i = r.i AND slots.turn = r.b % r.e, one"""


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block_rows: int = 1, each: int = 1024, most: int = 4096, longest: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, block, slot, release, deadline, position of each row (and the columns in `keep`)."""
    keep = keep or []
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), *keep).withColumn("h_", h).withColumn("key", named("source"))
    digits = max(1, math.ceil(math.log(max(1, docs.count()) / each, 16)))
    apart = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(16**digits))).otherwise(0)
    # the ranges of rows without an id lie within their MD5's, so the order by MD5 stays; other rows of its range come first or last
    null = hashlib.md5(b"").hexdigest()
    rows = rows.withColumn("r_", F.struct(F.substring("h_", 1, digits).alias("lead"), F.when(F.col("doc_id").isNull(), 1).when(F.col("h_") > null, 2).otherwise(0).alias("side"), apart.alias("apart")))
    tally = rows.groupBy("key", "r_").count()
    slots = period(tally.groupBy("key").agg(F.sum("count").alias("n")), weights or {}, default, most, longest)
    before = F.sum("count").over(Window.partitionBy("key").orderBy("r_").rowsBetween(Window.unboundedPreceding, -1))
    starts = tally.select("key", "r_", F.coalesce(before, F.lit(0)).alias("start_"))
    rows = rows.withColumn("n_", F.row_number().over(Window.partitionBy("key", "r_").orderBy("h_", "doc_id"))).join(starts, ["key", "r_"])
    rows = rows.withColumn("rank_", F.col("start_") + F.col("n_") - 1).withColumn("b_", F.expr(f"rank_ div {block_rows}"))
    # p rows, bounded by `longest`: a source's turn within the period is its block modulo its weight
    slots = F.broadcast(slots.withColumnRenamed("key", "k_"))
    rows = rows.join(F.broadcast(slots.groupBy("k_").agg(F.first("e").alias("e_"))), F.col("key") == F.col("k_")).drop("k_")
    rows = rows.withColumn("turn_", F.expr("b_ % e_")).join(slots, (F.col("key") == F.col("k_")) & (F.col("turn_") == F.col("turn"))).withColumn("times_", F.expr("b_ div e"))
    ahead = F.expr(f"aggregate(zip_with(zip_with(es, before, (w, had) -> (times_ * w + had) * {block_rows}L), ns, (a, n) -> least(a, n)), 0L, (a, x) -> a + x)")
    return rows.select(
        "doc_id", "source", F.col("b_").alias("block"), (F.col("times_") * F.col("p") + F.col("t")).alias("slot"), F.expr("b_ * p div e").alias("release"), F.expr("((b_ + 1) * p + e - 1) div e").alias("deadline"),
        (ahead + F.expr(f"rank_ % {block_rows}")).alias("position"), *keep,
    )
