"""Any table of intervals, scored by one sweep over each region."""

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import quality, scoring
from weftline.sources.tables import events_statements


def test_intervals_cost_no_rows_for_the_statements_they_cover(spark):
    rng = np.random.default_rng(3)
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, i * 5000, i % 2, kinds[rng.integers(5)], float(rng.random() * 100), f'{{"k": {rng.integers(6)}}}') for i in range(120)]
    ev = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    st = events_statements(ev)
    some = [("user:0", 0, 59), ("user:0", 5, 5), ("user:0", 5, 40), ("user:0", 31, 59), ("user:1", 7, 8), ("user:0", 5, 40)]
    found = quality.interval_quality(st, spark.createDataFrame([("events", *x) for x in some], "path string, region_id string, start int, end int"))
    assert "sequence(start" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.region_id, r.start, r.end): r for r in found.collect()}
    assert set(got) == set(some) and found.count() == len(set(some))
    lines = {(r.region_id, r.idx): (r.start_line, r.end_line) for r in st.collect()}
    for r in scoring.grid_input(st).collect():
        grid = scoring.grid_of(r.rows, r.edges)
        score, features = grid.scores(), grid.features()
        for (region, s, e), x in got.items():
            if region == r.region_id:
                assert x.score == score[s, e] and all(x[k] == v[s, e] for k, v in features.items())
                assert (x.input_count, x.output_count, x.symbol_count, x.local_symbol_count, x.internal_edge_count) == tuple(int(v[s, e]) for v in (grid.inputs, grid.outputs, grid.symbols, grid.local, grid.internal))
                assert (x.start_line, x.end_line) == (lines[region, s][0], lines[region, e][1])
