"""Document fingerprints from closed syncmers, in DataFrame and SQL functions only.

A k-mer (k characters) is an anchor if the smallest hash among its inner s-mers lies at its first or last place. The
choice depends on the k-mer alone, so anchors survive edits elsewhere and keep their order; of any k - s + 1 neighbouring
k-mers at least one is an anchor. A fingerprint is the `keep` smallest distinct anchor hashes (32 bits, as hex), a
bottom-k sketch over the whole text; likeness is the share of the union's smallest hashes that both hold (the Jaccard
likeness of the anchor sets, exact while a union has at most `keep` anchors). Of a text with the tail replaced only the
k-mers that touch the tail are hashed anew: the head's anchors carry over.

The next document by descending doc_id is found without a global sort: rows are dealt to chunks of `chunk` adjacent ids,
ordered within each, and a chunk's last row gets the first row of the next chunk that has rows.

Texts without anchors (shorter than k, or none chosen) have one anchor, the hash of the whole text; empty and null texts
have none and an empty fingerprint, and two of them have likeness 1. Equal texts have equal fingerprints. Rows without a
doc_id stand outside the order, each followed by the first document (in a table of such rows alone, by the smallest text);
equal ids are ordered by text, repeated rows in any order (they are alike). A single row is its own next. Further columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import texts
from weftline.session import materialize

LAST = -(1 << 62)
#: chunks over which rows without an id are spread at most
SPREAD = 1024


def places(text: str, k: int, s: int) -> str:
    """SQL: an array with, for each k-mer's place, the anchor's hash or null. Text is an SQL expression."""
    w = k - s + 1
    smers = rf"transform(regexp_extract_all({text}, r'(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{s}}}))', 1), x -> xxhash64(x))"
    inner = ", ".join(f"get(h, i + {j})" for j in sorted({*range(0, w, s), w - 1}))
    # the smaller edge against the inner s-mers one by one, the middle first: most k-mers fail early
    middle = sorted(range(1, w - 1), key=lambda j: abs(2 * j - w + 1))
    edge = " and ".join(f"m <= get(h, i + {j})" for j in middle) or "true"
    chosen = f"transform(array(least(get(h, i), get(h, i + {w - 1}))), m -> {edge})[0]"
    anchor = f"transform(sequence(0, size(h) - {w}), i -> if({chosen}, shiftrightunsigned(xxhash64({inner}), 32), null))"
    return f"transform(array({smers}), h -> if(size(h) >= {w}, {anchor}, cast(array() as array<bigint>)))[0]"


def smallest(array: str, keep: int) -> str:
    return f"slice(sort_array(array_distinct(array_compact({array}))), 1, {keep})"


def whole(sketch: str, text: str) -> str:
    """The sketch, or the whole text's hash where there is no anchor."""
    return f"if(size({sketch}) > 0 or {text} = '', {sketch}, array(shiftrightunsigned(xxhash64({text}), 32)))"


def likeness(a: str, b: str, keep: int) -> Column:
    union = f"slice(sort_array(array_union({a}, {b})), 1, {keep})"
    both = f"transform(array({union}), u -> size(array_intersect(array_intersect(u, {a}), {b})) / cast(size(u) as double))[0]"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1.0D, {both})")


def printed(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, x -> lower(lpad(hex(x), 8, '0'))), '')")


def anchors(docs: DataFrame, k: int = 12, s: int = 4) -> DataFrame:
    """doc_id, place (characters from 0), anchor (hash): every closed syncmer, for positional matching."""
    rows = texts(docs).select("doc_id", F.posexplode(F.expr(places("text", k, s))).alias("place", "anchor"))
    return rows.where("anchor is not null")


def chunk_links(ids: DataFrame, fan: int) -> DataFrame:
    """chunk, following: for each chunk number the next lower one that occurs, the lowest followed by the highest."""
    ids = ids.select("chunk", F.floor(F.col("chunk") / fan).alias("super")).distinct()
    inside = ids.withColumn("following", F.lead("chunk").over(Window.partitionBy("super").orderBy(F.desc("chunk"))))
    # one row for each fan * chunk ids: the only global order is over these
    tops = ids.groupBy("super").agg(F.max("chunk").alias("top"))
    order = Window.orderBy(F.desc("super"))
    tops = tops.select("super", F.coalesce(F.lead("top").over(order), F.first("top").over(order)).alias("below"))
    return inside.join(tops, "super").select("chunk", F.coalesce("following", "below").alias("following"))


def fingerprints(docs: DataFrame, k: int = 12, s: int = 4, keep: int = 64, chunk: int = 256, fan: int = 1 << 16) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    base = texts(docs)
    # rows without an id need no neighbour: they are dealt to chunks of their own, at random
    none = base.where("doc_id is null").count()
    spread = max(1, min(SPREAD, none // chunk))
    alone = F.lit(LAST) - F.pmod(F.monotonically_increasing_id(), F.lit(spread))
    base = base.withColumn("chunk", F.when(F.col("doc_id").isNull(), alone).otherwise(F.floor(F.col("doc_id") / chunk)))
    base = base.withColumn("o", F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)))
    sketched = lambda rows, name: rows.withColumn("sk", F.expr(smallest(places("text", k, s), keep))).select(name, F.col("text").alias("top"), F.expr(whole("sk", "text")).alias("top_sk"))
    tops = base.where("doc_id is not null").groupBy("chunk").agg(F.min(F.struct("o", "text")).alias("t")).select(F.col("chunk").alias("following"), F.col("t.text").alias("text"))
    bridge = chunk_links(base.where("doc_id is not null").select("chunk"), fan).join(sketched(tops, "following"), "following").select(F.col("chunk").alias("c"), "top", "top_sk")
    if none:
        # sketched once, then sent to each of those chunks
        first = base.agg(F.min(F.struct("o", "text")).alias("t")).select(F.lit(0).alias("c"), F.col("t.text").alias("text"))
        first = materialize(sketched(first, "c"), "first")
        bridge = bridge.unionByName(first.withColumn("c", F.explode(F.sequence(F.lit(LAST - spread + 1), F.lit(LAST)))))

    n, m = F.length("text"), F.floor(F.length("text") / 3)
    rows = base.withColumn("n", n.cast("int")).withColumn("head", (n - m).cast("int"))
    both = f"transform(array({places('text', k, s)}), a -> named_struct('full', {smallest('a', keep)}, 'head', {smallest(f'slice(a, 1, greatest(0, head - {k - 1}))', keep)}))[0]"
    rows = rows.withColumn("sks", F.expr(both)).select("doc_id", "text", "chunk", "o", "n", "head", F.expr(whole("sks.full", "text")).alias("sk"), F.col("sks.head").alias("sk_head"))
    w = Window.partitionBy("chunk").orderBy("o", "text")
    known = F.col("doc_id").isNotNull()
    rows = rows.withColumn("next", F.when(known, F.lead("text").over(w))).withColumn("next_sk", F.when(known, F.lead("sk").over(w)))
    rows = rows.join(bridge, F.col("chunk") == F.col("c")).withColumn("next_sk", F.expr("if(next is null, top_sk, next_sk)")).withColumn("next", F.coalesce("next", "top"))
    rows = rows.withColumn("tail", F.expr("substring(next, 1, n - head)")).drop("next", "top")
    start = f"greatest(0, head - {k - 1})"
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, head), tail)")).withColumn("seam", F.expr(f"concat(substring(text, {start} + 1, head - {start}), tail)"))
    rows = rows.withColumn("sk_tail", F.expr(smallest(places("seam", k, s), keep)))
    rows = rows.withColumn("sk_edited", F.expr(f"slice(sort_array(array_union(sk_head, sk_tail)), 1, {keep})")).withColumn("sk_edited", F.expr(whole("sk_edited", "edited")))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), printed("sk").alias("fingerprint"), printed("sk_edited").alias("edited_fingerprint"),
        likeness("sk", "sk_edited", keep).alias("near_edited"), likeness("sk", "next_sk", keep).alias("near_next"),
    )
