import numpy as np

from weftline.llm import collision_ann


def test_recall_order_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 32))
    x = centres[rng.integers(0, 8, 3000)] + 0.6 * rng.standard_normal((3000, 32))
    x[500:520] = x[500]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    bad = [(9001, None, "z"), (9002, [0.0] * 32, "z"), (9003, [None] + [1.0] * 31, "z"), (9004, [float("nan")] * 32, "z"), (9005, [float("inf")] * 32, "z"), (9006, [], "z"), (None, x[0].tolist(), "z"), (7, x[7].tolist(), "z")]
    v = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    got = collision_ann.neighbours(v, v.where("vec_id % 50 = 0"), block=1000, query_block=25).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert r.score == np.sqrt(((x[r.vec_id] - x[r.query_id]) ** 2).sum())
    recall = []
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        recall.append(len(set(want) & {r.vec_id for r in mine}) / 10)
    assert np.mean(recall) >= 0.9
    assert [r.vec_id for r in sorted(by[500], key=lambda r: r.rank)] == list(range(501, 511))


def test_few_candidates(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in collision_ann.neighbours(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert collision_ann.neighbours(v.limit(0), v.limit(0)).count() == 0
