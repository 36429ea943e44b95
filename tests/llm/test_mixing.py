import hashlib
import random

import pytest

from weftline.llm import mixing


def edf(weights, slots):
    """Plain simulation: (slot, source, block), every source endless."""
    p, had, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(slots):
        ready = [(-(-(had[s] + 1) * p // weights[s]), s) for s in sorted(weights) if had[s] * p // weights[s] <= t]
        due, s = min(ready)
        assert due > t
        out.append((t, s, had[s]))
        had[s] += 1
    return out


@pytest.mark.parametrize("block", [1, 3])
def test_matches_the_simulation_and_keeps_every_row(spark, block):
    rng = random.Random(3)
    rows = [(i, rng.choices(["a", "b", "c", "d"], [8, 3, 2, 1])[0], i % 3, "x") for i in range(700)]
    weights = {"a": 5, "b": 3, "zz": 9}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, block int, key string"), weights, default=2, block_rows=block, each=20).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    assert sorted(r.position for r in got) == list(range(700))
    w = {"a": 5, "b": 3, "c": 2, "d": 2}
    plan = {(s, j): t for t, s, j in edf(w, 4000)}
    p = 12
    for r in got:
        assert r.slot == plan[r.source, r.block] and r.release <= r.slot < r.deadline
    assert [r.slot for r in sorted(got, key=lambda r: r.position)] == sorted(r.slot for r in got)
    blocks = sorted({(r.slot, r.source) for r in got})
    last = min(max(t for t, s in blocks if s == x) for x in w)
    had = dict.fromkeys(w, 0)
    for n, (t, s) in enumerate(b for b in blocks if b[0] <= last):
        had[s] += 1
        assert t == n and all(abs(had[x] - (n + 1) * w[x] / p) < 1 for x in w)


def test_many_rows_without_an_id(spark):
    """They are dealt over many ranges, and still lie between the rows of smaller and of larger MD5."""
    rows = [(i, "a") for i in range(300)] + [(None, "a")] * 500 + [(None, "b")] * 50
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = mixing.mix(df, {"a": 2}, each=10).collect()
    assert sorted(r.position for r in got) == list(range(850))
    md5 = lambda i: hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()
    for s in "ab":
        assert [md5(r.doc_id) for r in sorted((r for r in got if r.source == s), key=lambda r: r.block)] == sorted(md5(i) for i, x in rows if x == s)


def test_null_sources_repeated_rows_and_limits(spark):
    schema = "doc_id long, source string"
    got = mixing.mix(spark.createDataFrame([(1, None), (None, "a"), (2, "a"), (2, "a"), (3, "")], schema), {"a": 3}).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3, 4] and len({r.slot for r in got}) == 5
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="too many"):
        mixing.mix(spark.createDataFrame([(1, "a"), (2, "b")], schema), most=1).collect()
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a")], schema), {"a": 0})
