"""Groups of boundary facts are dealt by the same blocks, so that joining them moves no rows."""

from pyspark.sql import functions as F

from weftline.operators import facts
from weftline.sources.tables import events_statements


def test_groups_of_facts_are_joined_where_they_are(spark):
    rows = [(i, i * 7, i % 3, ["view", "click", "error"][i % 3 - i % 2], 50.0, f'{{"k": {i % 4}}}') for i in range(60)]
    ev = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = facts.boundary_facts(events_statements(ev))
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 30  # 46 when each join and grouping dealt anew
        assert df.count() == 57
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
