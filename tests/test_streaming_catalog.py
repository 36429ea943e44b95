import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_closed_sessions_equal_batch_analysis(spark, tmp_path):
    from weftline.operators import scoring
    from weftline.streaming import boundaries

    rows = [(u * 100 + i, f"2024-01-0{1 + s} 0{u}:{i:02d}:00", u, ["signup", "view", "click", "purchase"][(i + u) % 4], 7.0 * i + u, '{"k": %d}' % (i % 5)) for u in range(3) for s in range(2) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    last = spark.createDataFrame([(9999, "2024-02-01 00:00:00", 9, "view", 9.0, '{"k": 1}')], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last.withColumn("ts", F.col("ts") + F.expr("interval 1 day")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    boundaries.analyze(stream, lambda out, n: seen.extend(out.select("region_id", "boundary_index", F.round("score", 9)).collect()), f"{tmp_path}/check").awaitTermination()
    closed = boundaries.sessions(df).collect()
    batch = boundaries.statements(spark.createDataFrame(closed, boundaries.sessions(df).schema))
    want = scoring.analyze(batch).select("region_id", "boundary_index", F.round("score", 9)).collect()
    got = [r for r in seen if not r.region_id.startswith("user:9@")]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 6 * 11


def test_registry_is_consistent():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len([q for q in queries if q.startswith("q_")]) >= 55


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_entry_and_some_oracles(spark):
    import duckdb

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for t in ("events", "conversations", "documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in ("q_features_heuristic", "q_rejections", "q_completion", "q_hard_dp", "q_task_boundaries", "q_policy_gate"):
        mine = queries[name](spark, SF).toPandas()
        theirs = con.execute(oracles[name]).df()
        cols = sorted(mine.columns)
        assert cols == sorted(theirs.columns)
        rows = [sorted(str(tuple(round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in d[cols].astype(object).itertuples(index=False, name=None)) for d in (mine, theirs)]
        assert rows[0] == rows[1], name


def test_written_tables_are_released(spark):
    from weftline import session

    session.release(spark)
    df = session.materialize(spark.range(5), "t")
    path = session._WRITTEN[0]
    assert df.count() == 5 and path.startswith(session.shared_dir(spark)) and os.path.exists(path)
    assert session.release(spark) == 1 and not os.path.exists(path)
    a, b = session.materialize(spark.range(3), "a"), session.materialize(spark.range(4), "b")
    session.discard(a)
    assert not os.path.exists(a.written_to) and b.count() == 4 and session.release(spark) == 1


def test_engine_queries_outlive_missing_libraries():
    """Without what the training-data operators need, the engine's own queries are still there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 60 and out[1] == "False" and int(out[2]) >= 50


def test_no_local_scratch_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from weftline import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)
