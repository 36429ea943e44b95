"""A mini-batch's losses and gradients, taken together, equal those of its regions one by one."""

import random

import numpy as np
import pytest

from weftline.operators import energy, minibatch, training
from weftline.operators.quality import Sweep

SCHEMA = (
    "sample_id string, rows array<struct<idx:int,is_compound:boolean,support:double,symbols:array<string>>>, edges array<struct<source:int,target:int,kind:string,symbol:string>>,"
    "marks array<struct<b:int,legal:boolean>>, x array<double>, r array<double>, cuts array<int>, split string, place long"
)


def region(rng, i, n, illegal=0.2, edges=True, split="train"):
    names = [f"v{k}" for k in range(1 + n // 6)]
    rows = [(k, rng.random() < 0.4, rng.choice([0.0, 0.0, 0.65, 1.0]), rng.sample(names, rng.randint(0, min(2, len(names))))) for k in range(n)]
    links = [(rng.randrange(n), rng.randrange(n), rng.choice(["DATA", "DATA", "CONTROL"]), rng.choice(names)) for _ in range(2 * n)] if edges else None
    links = links and [(a, b, kind, s if kind == "DATA" else None) for a, b, kind, s in links]
    marks = [(b, rng.random() >= illegal) for b in range(n - 1)]
    x, r = ([rng.random() for _ in range(20 * (n - 1))] for _ in range(2))
    return (f"s{i:03}", rows, links, marks or None, x if marks else None, r if marks else None, [b + 1 for b, legal in marks if legal and rng.random() < 0.3], split, i)


def regions():
    rng = random.Random(7)
    sizes = [1, 2, 3, 9, 30, 61, 16, 17, 33, 5, 1, minibatch.MOST, minibatch.MOST + 1]
    return [region(rng, i, n, illegal=(0.0, 0.2, 1.0)[i % 3], edges=i % 4 != 1) for i, n in enumerate(sizes)]


@pytest.fixture(scope="module")
def examples(spark):
    from weftline.session import ship

    ship(spark)
    return spark.createDataFrame(regions(), SCHEMA)


def close(got, want):
    assert np.abs(got - want).max() <= 1e-10 * max(1.0, np.abs(want).max())


def one_by_one(theta, rows, temperature, auxiliary):
    return sum(np.concatenate(energy.loss_and_gradient(theta, energy.region_of(r), r["cuts"], temperature, auxiliary)) for r in rows)


def test_a_batch_equals_its_regions_one_by_one(examples):
    plain = [r.asDict(True) for r in examples.orderBy("place").collect()]
    made = [r.asDict(True) for r in minibatch.prepared(examples).orderBy("place").collect()]
    assert [r["packed"] is None for r in made] == [len(r["rows"]) > minibatch.MOST for r in plain]
    assert all((r["rows"] is None) == (r["packed"] is not None) for r in made)
    rng = np.random.default_rng(3)
    for theta in (energy.initial(), energy.initial() + rng.normal(0, 0.5, energy.SIZE), energy.initial() + rng.normal(0, 3, energy.SIZE)):
        for temperature in (1.0, 0.01):  # scores lie too far apart for exponentials at the second
            close(minibatch.losses_and_gradient(theta, made, temperature, 0.3), one_by_one(theta, plain, temperature, 0.3))
            for a, b in zip(made, plain):
                close(minibatch.losses_and_gradient(theta, [a], temperature, 0.3), one_by_one(theta, [b], temperature, 0.3))


def test_only_the_split_asked_for_is_prepared(spark):
    rng = random.Random(1)
    rows = [region(rng, i, 6, split=s) for i, s in enumerate(["train", "validation", "test", "train"])]
    made = minibatch.prepared(spark.createDataFrame(rows, SCHEMA), "train").orderBy("place").collect()
    assert [r.packed is not None for r in made] == [True, False, False, True]
    assert [r.rows is not None for r in made] == [False, True, True, False]


def test_counts_wider_than_a_byte():
    n, k = 40, 300
    cells = minibatch.cells_of(n, np.zeros(k, int), np.full(k, 5), np.ones(k, bool), np.zeros(k, int), np.zeros(1, int), np.zeros(1, int))
    assert cells.dtype == np.uint16 and cells.max() == k


def test_stated_cuts_are_checked(examples):
    row = next(r.asDict(True) for r in minibatch.prepared(examples.where("sample_id = 's003'")).collect())
    for cuts in ([0], [9]):
        with pytest.raises(ValueError, match="outside"):
            minibatch.losses_and_gradient(energy.initial(), [row | {"cuts": cuts}])
    hard = next(r.asDict(True) for r in minibatch.prepared(examples.where("sample_id = 's005'")).collect())
    with pytest.raises(ValueError, match="hard constraint"):
        minibatch.losses_and_gradient(energy.initial(), [hard | {"cuts": [1]}])


def test_a_step_counts_no_segments(examples, monkeypatch):
    """What a step waits for is free of work on statements and segments that all tasks can do ahead."""
    rows = minibatch.prepared(examples.where("size(rows) between 2 and 100")).orderBy("place")
    batches = rows.toArrow().to_batches()
    monkeypatch.setattr(Sweep, "step", lambda *_: pytest.fail("a region was swept in a training step"))
    config = training.TrainingConfig(batch_size=4)
    (out,) = training.steps(energy.initial(), training.Adam(energy.SIZE, 0.0), 0.01, 0.5, config)(iter(batches))
    assert np.isfinite(out["v"][0].as_py()).all()
