import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.plans import catalog_more as more
from weftline.sources import corpus

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(u * 100 + i, f"2024-01-01 00:{i:02d}:00", u, ["signup", "view", "click", "purchase"][(i * i + u) % 4], float((7 * i * i + 3 * u) % 50), '{"k": %d}' % (i % 3)) for u, n in ((1, 1), (2, 5), (3, 10)) for i in range(n)]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{d}/events.parquet")
    return d, {f"user:{u}": np.array([r[4] for r in rows if r[2] == u]) for u in (1, 2, 3)}


def test_dynamic_programs_take_whole_sequences(spark, folder):
    d, values = folder
    run = lambda name: entry.queries()[name](spark, d).collect()
    best, total = {r.region_id: r for r in run("q_hard_dp")}, {r.region_id: r.log_partition for r in run("q_log_partition")}
    odds = {(r.region_id, r.boundary): r.probability for r in run("q_marginals")}
    assert set(best) == set(total) == set(values)
    for k, v in values.items():
        b, n = 0.004 * np.abs(np.diff(v)) - 0.3, len(v)
        seg = {(i, j): 0.4 - 0.01 * (v[i:j].max() - v[i:j].min()) - 0.05 * (j - i) for i in range(n) for j in range(i + 1, n + 1)}
        made = {}
        for m in itertools.product((0, 1), repeat=n - 1):
            at = [0, *(i + 1 for i, x in enumerate(m) if x), n]
            made[m] = sum(seg[i, j] for i, j in zip(at, at[1:])) + sum(b[i] for i, x in enumerate(m) if x)
        z = sum(map(math.exp, made.values()))
        assert abs(best[k].energy - max(made.values())) < 2e-6 and abs(total[k] - math.log(z)) < 2e-6
        for i in range(n - 1):
            assert abs(odds[k, i + 1] - sum(math.exp(e) for m, e in made.items() if m[i]) / z) < 2e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_reachability_goes_on_until_nothing_new_is_found(spark):
    after = {}
    for r in more.dependence.linear_def_use(more.events(spark, SF)).collect():
        after.setdefault((r.region_id, r.source), set()).add(r.target)
    want = set()
    for region, source in after:
        stack = [source]
        while stack:
            for x in after.get((region, stack.pop()), ()):
                if (region, source, x) not in want:
                    want.add((region, source, x))
                    stack.append(x)
    assert {(r.region_id, r.source, r.target) for r in entry.queries()["q_reachability"](spark, SF).collect()} == want


def test_module_grid_holds_intervals_of_every_length(spark, tmp_path):
    d, n = str(tmp_path), 45
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1, ["signup", "view", "click", "purchase"][(i * i) % 4], float(i), '{"k": %d}' % (i % 3)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{d}/events.parquet")
    edges = [(r.source, r.target) for r in more.dependence.linear_def_use(more.events(spark, d)).collect()]
    got = {(r.start, r.end): r.internal_edge_count for r in entry.queries()["q_module_grid"](spark, d).collect()}
    assert got == {(s, e): sum(s <= a and b <= e for a, b in edges) for s in range(n) for e in range(s, n)}


def test_a_repeated_sample_id_keeps_each_path_its_cuts(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(151, "a", "en", 4), (150, "a", "en", 3)], "doc_id long, source string, lang string, n_chars long").write.parquet(f"{d}/documents.parquet")
    rows = more.manifest(spark, d)
    assert rows.select("sample_id").distinct().count() == 1
    got = {r.path: r.cuts for r in corpus.truth(rows).collect()}
    assert got == {f"sources/{i}": [k for k in range(1, n % 5 + 2) if (i + k) % 4 < 2] for i, n in ((151, 4), (150, 3))}
