import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import dependence, energy, quality, scoring, segments
from weftline.operators.quality import Grid, Sweep
from weftline.schema import STATEMENT
from weftline.sources.tables import events_statements


def random_region(rng, n):
    edges = [(a, b, k, s if k == "DATA" else None) for a, b, s, k in {(rng.randrange(n), rng.randrange(n), rng.choice("pqr"), rng.choice(["DATA", "DATA", "CONTROL"])) for _ in range(2 * n)} if a <= b]
    uses = [(i, s) for i in range(n) for s in "pqrst" if rng.random() < 0.3]
    return n, edges, uses, np.array([rng.random() < 0.3 for _ in range(n)]), np.array([rng.choice([0.0, 0.65, 1.0]) for _ in range(n)])


def naive(region, s, e):
    n, edges, uses, compound, support = region
    data = [(a, b, y) for a, b, k, y in edges if k == "DATA"]
    inside = sum(s <= a <= b <= e for a, b, _ in data)
    control = sum(s <= a <= b <= e for a, b, k, _ in edges if k == "CONTROL")
    ins = {y for a, b, y in data if a < s <= b <= e}
    outs = {y for a, b, y in data if s <= a <= e < b}
    used = {y for i, y in uses if s <= i <= e}
    local = {y for y in used if all(s <= i <= e for i, z in uses if z == y)}
    k = e - s + 1
    own = support[s] if k == 1 else 0.0
    mass = inside + 0.35 * control
    size = {1: 0.0, 2: 0.5, 3: 0.75}.get(k, 1.0)
    trailing = len({y for a, b, y in data if a == e < b})
    parts = [mass / (mass + max(1, k - 1)), 1 / (1 + 0.35 * (len(ins) + len(outs))), len(local) / len(used) if used else 1.0, max(size, own), 1 / (1 + trailing) if compound[e] else 1.0, own if k == 1 else 1.0]
    return sum(w * p for w, p in zip(quality.MODULE_WEIGHTS.values(), parts))


def test_grid_matches_the_definition():
    rng = random.Random(0)
    for _ in range(60):
        region = random_region(rng, rng.randrange(1, 14))
        got = Grid(*region).scores()
        for s, e in itertools.combinations_with_replacement(range(region[0]), 2):
            assert got[s, e] == pytest.approx(naive(region, s, e), abs=1e-12)


def test_sweep_matches_the_grid():
    rng = random.Random(4)
    for _ in range(200):
        region = random_region(rng, rng.randrange(1, 16))
        n = region[0]
        starts = sorted({0, *rng.sample(range(n), rng.randrange(0, n))})
        ends = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        grid = Grid(*region)
        want = grid.scores()
        sweep = quality.Sweep(*region, starts)
        seen = []
        for e, m, c in sweep.scored(ends):
            seen.append(e)
            at = np.array(starts[:m])
            assert list(at) == [s for s in starts if s <= e] and sweep.trailing(e) == grid.trailing[e]
            for name, whole in (("internal", grid.internal), ("control", grid.control), ("inputs", grid.inputs), ("outputs", grid.outputs), ("symbols", grid.symbols), ("local", grid.local)):
                assert c[name] == pytest.approx(whole[at, e]), name
            assert c["score"] == pytest.approx(want[at, e])
        assert seen == ends


def test_a_long_region_is_selected_in_bounded_memory():
    rng, n = random.Random(6), 100_000
    edges = [(i, min(n - 1, i + rng.randrange(1, 30)), "DATA", f"s{i % 500}") for i in range(n - 1)]
    cuts = list(range(40, n, 40))
    sweep = quality.Sweep(n, edges, [(i, f"s{i % 500}") for i in range(n)], np.arange(n) % 7 == 0, np.zeros(n), [0, *cuts])
    got = scoring.chosen_cuts(sweep, cuts, [rng.uniform(-0.2, 0.5) for _ in cuts], scoring.Config())
    assert got == sorted(set(got)) and set(got) <= set(cuts)


def test_selection_matches_enumeration():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(2, 9)
        cuts = sorted(rng.sample(range(1, n), rng.randrange(0, n)))
        value = np.array([[rng.uniform(-1, 1) for _ in range(n)] for _ in range(n)])
        reward = [rng.uniform(-0.5, 0.5) for _ in cuts]

        def total(sub):
            p = [0, *(cuts[i] for i in sub), n]
            return sum(value[a, b - 1] for a, b in zip(p, p[1:])) + sum(reward[i] for i in sub)

        best = max((total(s) for k in range(1, len(cuts) + 1) for s in itertools.combinations(range(len(cuts)), k)), default=-np.inf)
        points = [0, *cuts]
        got = scoring.best_cuts(cuts, reward, lambda k: value[points[: k + 1], (cuts + [n])[k] - 1])
        if best <= value[0, n - 1]:
            assert got == []
        else:
            assert total([cuts.index(c) for c in got]) == pytest.approx(best)


def segmentations(n):
    return [[i + 1 for i in range(n - 1) if m >> i & 1] for m in range(1 << (n - 1))]


def random_energy(rng, n):
    seg = np.full((n + 1, n + 1), -np.inf)
    for i, j in itertools.combinations(range(n + 1), 2):
        seg[i, j] = rng.uniform(-2, 2)
    bnd = np.array([rng.uniform(-2, 2) if rng.random() < 0.8 else -np.inf for _ in range(n - 1)])
    return bnd, seg


def test_programs_match_enumeration():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 10)
        bnd, seg = random_energy(rng, n)
        each = {tuple(c): energy.segmentation_energy(bnd, seg, c) for c in segmentations(n)}
        cuts, best = energy.best_segmentation(bnd, seg)
        assert best == pytest.approx(max(each.values())) and each[tuple(cuts)] == pytest.approx(best)
        for t in (1.0, 0.7):
            z, chance, pieces = energy.soft(bnd, seg, t)
            v = np.array(list(each.values())) / t
            assert z == pytest.approx(t * segments.log_sum(v))
            p = np.exp(v - segments.log_sum(v))
            for b in range(n - 1):
                assert chance[b] == pytest.approx(sum(x for c, x in zip(each, p) if b + 1 in c), abs=1e-12)
            assert pieces[0].sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        energy.soft(bnd, seg, 0)


def test_worked_example():
    seg = np.full((4, 4), -np.inf)
    for (i, j), v in {(0, 3): 0.1, (0, 1): 0.2, (1, 3): 0.4, (0, 2): -0.1, (2, 3): 0.3, (1, 2): 0.0}.items():
        seg[i, j] = v
    bnd = np.array([0.7, -0.2])
    assert energy.log_partition(bnd, seg) == pytest.approx(math.log(sum(map(math.exp, (0.1, 1.3, 0.0, 1.0)))))
    assert energy.best_segmentation(bnd, seg) == ([1], pytest.approx(1.3))


@pytest.mark.parametrize("n", [1, 10, 100, 400])
def test_long_sequences_stay_finite(n):
    bnd, seg = random_energy(random.Random(n), n + 1)
    z, chance, _ = energy.soft(bnd * 50, np.where(np.isfinite(seg), seg * 50, seg))
    assert np.isfinite(z) and np.all((chance >= 0) & (chance <= 1 + 1e-9))


def model_region(rng, n):
    x = np.abs(np.array([[rng.uniform(0, 1) for _ in range(20)] for _ in range(n - 1)]))
    x[:, [3, 5, 6, 7]] *= 5
    r = np.array([[rng.choice([1.0, 0.7, 0.245]) for _ in range(20)] for _ in range(n - 1)])
    legal = np.array([i != 1 for i in range(n - 1)])
    return energy.Region(x, r, legal, Sweep(*random_region(rng, n), list(range(n))))


def test_gradient_matches_finite_differences():
    rng = random.Random(5)
    region = model_region(rng, 7)
    theta = energy.initial() + 0.1 * np.random.default_rng(0).standard_normal(energy.SIZE)
    assert energy.SIZE == 409

    def loss(t):
        a, _ = energy.loss_and_gradient(t, region, [1, 4], 0.8, 0.5)
        return a[1] + 0.5 * a[2]

    _, g = energy.loss_and_gradient(theta, region, [1, 4], 0.8, 0.5)
    for i in range(energy.SIZE):
        d = np.zeros(energy.SIZE)
        d[i] = 1e-6
        assert g[i] == pytest.approx((loss(theta + d) - loss(theta - d)) / 2e-6, abs=2e-6)
    with pytest.raises(ValueError):
        energy.loss_and_gradient(theta, region, [2])
    with pytest.raises(ValueError):
        energy.loss_and_gradient(theta, region, [7])


def test_features_are_bounded_and_interaction_starts_at_zero():
    e = energy.Energy(energy.initial(), model_region(random.Random(1), 9))
    assert np.all((e.features >= 0) & (e.features <= 1)) and not np.any(e.hidden @ e.p["w2"])


@pytest.fixture(scope="module")
def activity(spark):
    rng = random.Random(3)
    rows = [(i, f"2024-01-{1 + i // 400:02d} {i // 20 % 20:02d}:{i % 60:02d}:00", rng.randrange(12), rng.choice(["signup", "view", "click", "purchase", "error"]), rng.uniform(0, 100), '{"k": %d}' % rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    return events_statements(df).cache()


def test_interval_quality_matches_grids(spark, activity):
    assert activity.schema.fieldNames() == STATEMENT.fieldNames()
    got = {(r.region_id, r.start, r.end): r.score for r in quality.interval_quality(activity, quality.windows(activity, 9)).collect()}
    for row in scoring.grid_input(activity).collect():
        g = scoring.grid_of(row.rows, row.edges).scores()
        for (region, s, e), v in got.items():
            if region == row.region_id:
                assert g[s, e] == pytest.approx(v)


def test_analysis_invariants(activity):
    rows = scoring.analyze(activity).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.recommended and (r.constraints or r.after_line == r.before_line) for r in rows)
    strict = scoring.analyze(activity, config=scoring.Config(cut_penalty=5.0)).where("recommended").count()
    assert strict == 0 <= sum(r.recommended for r in rows)
    with pytest.raises(ValueError):
        scoring.score(activity, scoring.Config(weights={"variable_death": 0.0}))
    assert dependence.linear_def_use(activity).where("source >= target").isEmpty()


def test_structured_analysis_marks_the_best_segmentation(activity):
    rows = energy.structured_analysis(activity, energy.initial()).collect()
    assert all((r.reason is None) == r.recommended for r in rows) and all(r.best_energy <= r.log_partition + 1e-9 for r in rows)
    assert any(r.reason == "hard_constraint" and r.energy is None for r in rows)


def dense(e):
    """All segment scores of an energy as one table, from its blocks."""
    n = e.region.n
    out = np.full((n + 1, n + 1), -np.inf)
    for first, block in e.segments.forward():
        out[: block.shape[1], first + 1 : first + 1 + len(block)] = block.T
    return out


@pytest.mark.parametrize("cells", [1, 40, 1 << 18])
def test_blocks_of_segments_equal_the_table(monkeypatch, cells):
    """Whatever a block holds: the sweep's blocks come back alike, programs equal those over the whole table, gradients too."""
    monkeypatch.setattr(segments, "CELLS", cells)
    rng = random.Random(cells)
    for n in (2, 9, 37):
        region = model_region(rng, n)
        theta = energy.initial() + 0.05 * np.random.default_rng(n).standard_normal(energy.SIZE)
        e = energy.Energy(theta, region)
        forward = {first: block.copy() for first, block in e.segments.forward()}
        assert all(np.array_equal(block, forward.pop(first)) for first, block in e.segments.backward()) and not forward
        table = dense(e)
        assert energy.best_segmentation(e.boundary, e.segments) == energy.best_segmentation(e.boundary, table)
        z, cut, along = segments.marginals(e.boundary, e.segments, 0.9, [0, n])
        z2, cut2, chance = energy.soft(e.boundary, table, 0.9)
        assert z == pytest.approx(z2) and cut == pytest.approx(cut2) and along == pytest.approx(table[0, n])
        assert chance[0].sum() == pytest.approx(1.0) and chance[:, n].sum() == pytest.approx(1.0)
        cuts = [c for c in (1, 5) if c < n]
        losses, slope = energy.loss_and_gradient(theta, region, cuts)
        monkeypatch.setattr(segments, "CELLS", 1 << 18)
        whole = energy.loss_and_gradient(theta, region, cuts)
        monkeypatch.setattr(segments, "CELLS", cells)
        assert losses == pytest.approx(whole[0]) and slope == pytest.approx(whole[1], abs=1e-12)


def test_long_region_in_bounded_memory():
    """Three thousand statements: peak memory far below that of a table of all segments (72 MB)."""
    import tracemalloc

    n = 3000
    rng = random.Random(3)
    edges = [(i, min(n - 1, i + rng.randrange(1, 40)), "DATA", f"s{i % 50}") for i in range(n - 1)]
    sweep = Sweep(n, edges, [(i, f"s{i % 50}") for i in range(n)], np.zeros(n, bool), np.zeros(n), list(range(n)))
    x = np.abs(np.random.default_rng(0).standard_normal((n - 1, 20)))
    region = energy.Region(x, np.ones((n - 1, 20)), np.ones(n - 1, bool), sweep)
    tracemalloc.start()
    losses, slope = energy.loss_and_gradient(energy.initial(), region, [100, 900])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(losses).all() and np.isfinite(slope).all() and peak < 60e6
