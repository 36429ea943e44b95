"""Importance resampling towards a target text distribution, over hashed n-gram buckets.

Each task hands its texts, some megabytes at a time, to an in-process DuckDB: SQL splits them into words, unnests these,
builds runs of up to `n` words with window functions and counts them by bucket (the CRC-32 of their UTF-8 bytes, a zlib
function registered with DuckDB, modulo `buckets`). Documents' bucket counts are spilled to Parquet in the shared folder;
Spark merges them into the corpus' counts, scores every document from its own and ranks the scores. Texts are read once.

A bucket's gain is floor(1000 ln of how many times likelier it is in the target, both counts plus one); weight is a
document's sum of gains. score adds floor(1000 g), g a Gumbel draw fixed by the seed and the doc_id, so the highest
scores are a sample without replacement in proportion to exp(weight / 1000). Of the documents with `least` words or more,
`percent` of a hundred are drawn.

The gains and the corpus' counts (one number for each bucket, fixed size) are all that passes through the driver. Ranks
come from a range partitioning by score, numbered range by range. A null or empty text has no features and weight 0. A
null doc_id draws by the word "null" and comes last among equal scores; repeated rows each count, score alike and are
drawn one by one. An empty target or corpus counts as all zeros. Further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import give_back, slices, texts
from weftline.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counting_sql(n: int, buckets: int) -> str:
    """DuckDB SQL: row, n_words, buckets, counts of each row of `batch` (row, text), by row."""
    runs = ["SELECT row, word AS gram FROM words"]
    for k in range(2, n + 1):
        parts = ", ".join(["word", *(f"lead(word, {j}) OVER o" for j in range(1, k))])
        runs.append(f"SELECT row, gram FROM (SELECT row, concat_ws(' ', {parts}) AS gram, lead(word, {k - 1}) OVER o IS NOT NULL AS whole FROM words WINDOW o AS (PARTITION BY row ORDER BY place)) WHERE whole")
    place = ", generate_subscripts(w, 1) AS place" if n > 1 else ""
    return f"""WITH split AS MATERIALIZED (SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM batch),
        words AS MATERIALIZED (SELECT row, unnest(w) AS word{place} FROM split),
        grams AS MATERIALIZED ({" UNION ALL ".join(runs)}),
        codes AS (SELECT gram, crc(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM grams)),
        counted AS (SELECT row, bucket, count(*) AS c FROM grams JOIN codes USING (gram) GROUP BY row, bucket),
        lists AS (SELECT row, list(bucket) AS buckets, list(c) AS counts FROM counted GROUP BY row)
        SELECT row, len(w) AS n_words, buckets, counts FROM split LEFT JOIN lists USING (row) ORDER BY row"""


def crc(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.int64())


def bucket_counts(docs: DataFrame, id_col: str, n: int, buckets: int) -> DataFrame:
    """doc_id, n_words, buckets, counts (two arrays side by side, null without features) of each row."""
    sql = counting_sql(n, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as db:
            db.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
            for b in slices(batches, 2048, 4 << 20):
                db.register("batch", pa.table({"row": pa.array(range(b.num_rows), pa.int32()), "text": b.column("text")}))
                got = db.sql(sql).to_arrow_table().combine_chunks()
                db.unregister("batch")
                counts = [got.column(c).cast(t).combine_chunks() for c, t in (("n_words", pa.int32()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in counts)], names=["doc_id", "n_words", "buckets", "counts"])
        give_back()

    return texts(docs, id_col).mapInArrow(run, "doc_id long, n_words int, buckets array<int>, counts array<int>")


def totals(counted: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: `buckets` numbers at most."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return {r.b: r.c for r in each.groupBy(F.col("x.buckets").alias("b")).agg(F.sum("x.counts").alias("c")).toLocalIterator()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log(float((target.get(b, 0) + 1) * s_all) / float((corpus.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def weight(by_bucket: list[int]) -> Column:
    """The sum of gains over a row's bucket counts."""
    table = F.from_json(F.lit(str(by_bucket)), "array<bigint>")  # folded into one constant
    each = F.zip_with("buckets", "counts", lambda b, c: F.get(table, b) * c)
    return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def gumbel(seed: int) -> Column:
    """floor(1000 g), g = -ln(-ln u), u from the first 32 bits of the SHA-256 of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """rank of each row by falling score, then doc_id; null beyond `drawn`. Ranges are numbered one after another."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = materialize(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    # one row for each range, as many as shuffle partitions
    counts = rows.groupBy("range_").count()
    starts = counts.select("range_", F.coalesce(F.sum("count").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    rows = rows.join(F.broadcast(starts), "range_")
    place = F.col("start_") + F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return rows.withColumn("rank", F.when(place <= drawn, place).cast("long")).drop("range_", "start_")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, target_id: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1, null if not drawn) of each row of docs."""
    counted = materialize(bucket_counts(docs, "doc_id", n, buckets), "buckets")
    by_bucket = gains(totals(counted), totals(bucket_counts(target, target_id, n, buckets)), buckets)
    features = F.coalesce(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    rows = counted.select("doc_id", features.alias("n_features"), weight(by_bucket).alias("weight"), "n_words").withColumn("score", F.col("weight") + gumbel(seed))
    enough = F.col("n_words") >= least
    drawn = counted.where(enough).count() * percent // 100
    out = ("doc_id", "n_features", "weight", "score", "rank")
    return ranked(rows.where(enough), drawn).select(*out).unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*out))


#: DuckDB SQL of resample's result; DuckDB has no CRC-32, so it is folded over the bytes of each distinct word.
ORACLE = f"""WITH crc_table AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS tab FROM range(256) AS r(n)),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
    dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
    bytes AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
    codes AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
        lambda c, v: xor(c // 256, tab[CAST(xor(c % 256, v) AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN codes USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN codes USING (word) GROUP BY 1),
    g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) AS DOUBLE) / CAST((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
    f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN codes USING (word) JOIN g USING (bucket) GROUP BY 1),
    scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f USING (doc_id)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN r USING (doc_id)"""
