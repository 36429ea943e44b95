"""Facts of edges are sized by the edges' compressed files, so no join may choose to send them to all tasks."""

import re

from pyspark.sql import functions as F

from weftline.operators import dependence, facts
from weftline.sources.tables import events_statements


def events(spark, n=3000):
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 40).alias("user_id"), F.element_at(F.array(*map(F.lit, ("view", "click", "error", "purchase"))), (F.hash("id") % 4 + 4) % 4 + 1).alias("event_type"), (F.col("id") * 7 % 100).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 30).alias("props"))
    return events_statements(rows)


def sent(df):
    """The joins that send a side to all tasks, as the query was run in the end."""
    frame = df.select("*")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin.*", plan.split("Initial Plan")[0])


def test_no_group_of_facts_is_sent_to_all_tasks(spark):
    st = events(spark)
    for parts in (("edges",), ("spans",), facts.PARTS):
        df = facts.boundary_facts(st, parts=parts)
        assert sent(df) == [], parts
        assert df.count() == 3000 - 40
    e = facts.edge_facts(dependence.linear_def_use(st), facts.sizes(st))
    assert sent(e) == []
