"""Streaming extension: boundary analysis of sequences that grow.

A stream of events is windowed by watermark; whenever a sequence has been quiet for `gap`, its session closes, and its
statements are analysed as one region with the batch operators (so results equal a batch run over the same rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import scoring
from weftline.sources.tables import events_statements

EVENT = ("event_id", "ts", "user_id", "event_type", "value", "props")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """user_id, session, rows: closed sessions of a stream of events; events later than the watermark are left out."""
    rows = events.select(*EVENT).withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.collect_list(F.struct(*EVENT)).alias("rows"))


def statements(closed: DataFrame) -> DataFrame:
    """Statements of closed sessions; a region is a user's session."""
    flat = closed.select("session", F.explode("rows").alias("e")).select("e.*", F.unix_seconds(F.col("session.start")).alias("s"))
    # one region for each user and session: the frontend's order and ids hold within it
    rows = flat.withColumn("user_id", F.concat(F.col("user_id").cast("string"), F.lit("@"), F.col("s").cast("string")))
    return events_statements(rows)


def analyze(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "1 hour", late: str = "10 minutes", config: scoring.Config = scoring.Config(), trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that hands the analysed boundaries of each batch of closed sessions to sink(rows, batch_id)."""

    def batch(closed: DataFrame, batch_id: int) -> None:
        sink(scoring.analyze(statements(closed), config=config), batch_id)

    writer = sessions(events, gap, late).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
