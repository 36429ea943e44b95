"""Facts spread over boundaries inside of tasks; plans that Java compiles."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import energy, facts, pieces, segments, spread
from weftline.operators.blocks import BLOCK
from weftline.sources.tables import events_statements


def statements(spark, n=90):
    rng = random.Random(n)
    rows = [(i, i * 7, i % 3, rng.choice(["view", "click", "purchase", "signup", "error"]), rng.random() * 100, f'{{"k": {rng.randrange(5)}}}') for i in range(n)]
    return events_statements(spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("t")).drop("t"))


def test_pieces_keep_every_pair_and_are_small(monkeypatch):
    monkeypatch.setattr(spread, "PAIRS", 8)
    lo = np.array([0, 3, (1 << 32) + 2, (5 << 32) + 1])
    hi = np.array([40, 9, (1 << 32) + 2, (5 << 32) + 30])
    seen = [(int(a), p) for l, h, at in spread.pieces(lo, hi, np.arange(4)) for x, y, a in zip(l, h, at) for p in range(x, y + 1)]
    assert sorted(seen) == sorted((i, p) for i in range(4) for p in range(lo[i], hi[i] + 1))
    assert all((h - l + 1).sum() <= 8 for l, h, _ in spread.pieces(lo, hi, np.arange(4)))


def test_small_pieces_and_batches_change_nothing(spark, monkeypatch):
    st = statements(spark)
    want = sorted(map(str, facts.boundary_facts(st).collect()))
    monkeypatch.setattr(facts, "spread", lambda rows, make, schema: rows.sparkSession.createDataFrame(list(by_hand(rows, make, schema)), f"path string, region_id string, {BLOCK} int, b int, {schema}"))

    def by_hand(rows, make, schema):
        """Each boundary's pairs on their own."""
        held = {}
        for r in rows.collect():
            for b in range(r.low, r.high + 1):
                held.setdefault((r.path, r.region_id, r[BLOCK], b), []).append(r)
        numbers = [c for c in rows.columns if c not in (*spread.AT, "low", "high", "symbol")]
        for at, rs in held.items():
            rs.sort(key=lambda r: r.symbol)
            names = sorted({r.symbol for r in rs})
            cells = make({"rank": np.array([names.index(r.symbol) for r in rs]), **{c: np.array([r[c] for r in rs]) for c in numbers}}, np.full(len(rs), at[3]), np.array([0]), pa.array(names))
            yield (*at, *((v.to_pylist() if isinstance(v, pa.Array) else v.tolist())[0] for v in (cells[x.split()[0]] for x in schema.split(", "))))

    values = lambda rows: [[float(x) if re.fullmatch(r"[\d.e-]+", x) else x for x in re.split(r"[=,\s()\[\]]+", r)] for r in rows]
    got = sorted(map(str, facts.boundary_facts(st).collect()))
    for g, w in zip(values(got), values(want), strict=True):
        assert len(g) == len(w) and all(x == y or x == pytest.approx(y, rel=1e-12) for x, y in zip(g, w))


def test_java_compiles_the_stages_of_frames(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = facts.frame_facts(statements(spark))._jdf.queryExecution().executedPlan()
        text = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000  # longer methods stay interpreted


def test_learned_features_need_no_program_over_regions(spark):
    st, theta = statements(spark), energy.initial()
    alone = energy.learned_features(st, theta)
    assert "MapInArrow" in alone._jdf.queryExecution().executedPlan().toString() and "marks" not in alone._jdf.queryExecution().executedPlan().toString()
    got = {(r.region_id, r.boundary_index): r.features for r in alone.collect()}
    want = {(r.region_id, r.boundary_index): r.features for r in energy.structured_analysis(st, theta).collect()}
    assert set(got) == set(want) and len(got) == 87
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_regions_come_as_arrays_and_blocks_are_scored_once(spark, monkeypatch):
    rows = energy.region_rows(statements(spark)).toArrow().to_batches()
    found = [r for r in pieces.records(rows)]
    assert found and all(isinstance(r[c], np.ndarray) and len(r[c]) == 20 * len(r["marks"]) for r in found for c in ("x", "r"))
    scored = []
    monkeypatch.setattr(energy.Energy, "score", lambda self, first, counts, f=energy.Energy.score: scored.append(first) or f(self, first, counts))
    e = energy.Energy(energy.initial(), energy.region_of(found[0]))
    segments.best_segmentation(e.boundary, e.segments)
    segments.marginals(e.boundary, e.segments)
    assert scored == [0]
    # nulls and empty lists keep their places
    b = pa.RecordBatch.from_pydict({"v": pa.array([[1.0], None, [], [2.0, 3.0]], pa.list_(pa.float64())), "i": [0, 1, 2, 3]})
    assert [None if r["v"] is None else r["v"].tolist() for r in pieces.records([b], rows=3)] == [[1.0], None, [], [2.0, 3.0]]
