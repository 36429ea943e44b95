"""Facts of regions that are cut into blocks: against definitions, and whatever the blocks' size."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from weftline.operators import blocks, dependence, facts
from weftline.sources.tables import events_statements


def edges_of(rng, n, m, symbols=5):
    out = set()
    for _ in range(m):
        a = rng.randrange(n - 1)
        out.add((a, rng.randrange(a + 1, n), f"s{rng.randrange(symbols)}"))
    return sorted(out)


def brute(edges, n, w=4, m=12):
    out = {}
    for b in range(n - 1):
        over = [e for e in edges if e[0] <= b < e[1]]
        near, mid = ([e for e in edges if e[0] >= b - k + 1 and e[1] <= b + k] for k in (w, m))
        k = {}
        for e in over:
            k[e[2]] = k.get(e[2], 0) + 1
        crossing = set(over)
        out[b] = (
            len(over), len(near), sum(e in crossing for e in near), sum(e[1] <= b for e in near), sum(e[0] > b for e in near), len(mid), sum(e in crossing for e in mid), sum(e[1] - e[0] for e in over) / len(over) if over else 0.0,
            max([e[1] - e[0] for e in over], default=0), len({e[1] for e in over}), sum(v * v for v in k.values()), sum(e[0] == b and e[1] <= b + min(2, w) for e in over), sum((1 + k[e[2]]) / (e[1] - b) for e in over), sorted(k),
        )
    return out


@pytest.mark.parametrize("span", [16, 4096])
def test_edge_facts_equal_the_definition(spark, monkeypatch, span):
    monkeypatch.setattr(facts, "running", partial(blocks.running, span=span))
    rng = random.Random(span)
    regions = {"short": (2, [(0, 1, "x")]), "dense": (150, edges_of(rng, 150, 400)), "long": (2500, [*edges_of(rng, 2500, 25), (0, 2499, "s0"), (3, 2400, "s0"), (7, 2499, "s1")])}
    e = spark.createDataFrame([("p", r, *x) for r, (_, es) in regions.items() for x in es], "path string, region_id string, source int, target int, symbol string")
    n = spark.createDataFrame([("p", r, n) for r, (n, _) in regions.items()], "path string, region_id string, n int")
    got = {}
    for row in facts.edge_facts(e, n).collect():
        got.setdefault(row.region_id, {})[row.b] = tuple(row)[3:]
    for r, (size, es) in regions.items():
        want = brute(es, size)
        assert set(got[r]) == set(want)
        for b in want:
            assert got[r][b] == pytest.approx(want[b], rel=1e-12) if not want[b][-1] else got[r][b][-1] == want[b][-1] and got[r][b][:-1] == pytest.approx(want[b][:-1], rel=1e-12)


def test_block_size_changes_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i * 7, i % 3, rng.choice(["view", "click", "purchase", "signup", "error"]), rng.random() * 100, f'{{"k": {rng.randrange(4)}}}') for i in range(240)]
    ev = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    st = events_statements(ev)

    def all_facts():
        return sorted(map(str, facts.boundary_facts(st).collect()))

    want = all_facts()
    monkeypatch.setattr(facts, "with_halo", partial(blocks.with_halo, span=8))
    monkeypatch.setattr(dependence, "with_halo", partial(blocks.with_halo, span=8))
    monkeypatch.setattr(facts, "running", partial(blocks.running, span=8))
    assert all_facts() == want and len(want) == 237


def test_dyadic_runs_make_up_the_range(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a - 1, 40)]
    rows = spark.createDataFrame(pairs, "a int, b int").withColumn("r", blocks.dyadic(F.col("a"), F.col("b"))).collect()
    for row in rows:
        covered = sorted(x for level, node in row.r for x in range(node << level, (node + 1) << level))
        assert covered == list(range(row.a, row.b + 1)) and len(row.r) <= 2 * 6


def test_far_runs_lie_far_from_the_target(spark):
    pairs = [(a, b, "s") for a in range(0, 300, 7) for b in range(a + 1, 700, 13)]
    e = spark.createDataFrame(pairs, "source int, target int, symbol string").withColumn("r", facts.far_runs())
    for row in e.where("target - source > 64").collect():
        covered = [x for level, node in row.r for x in range(node << level, (node + 1) << level)]
        assert len(set(covered)) == len(covered) and all(row.source <= x < row.target for x in covered)
        assert all(row.target - ((node + 1) << level) >= 1 << level for level, node in row.r)
        assert row.target - row.source - len(covered) < 64 and len(row.r) <= 40
