import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import api, cli
from weftline.operators import energy, metrics, semantic, training
from weftline.sources import corpus, reports


def test_matching():
    assert metrics.match([4, 5, 10], [5, 11], 1) == (2, 1, 0)
    assert metrics.match([4], [3, 5], 1) == (1, 0, 1)
    assert metrics.match([1, 9], [1], 0, ignored=[9]) == (1, 0, 0)
    with pytest.raises(ValueError):
        metrics.match([1], [1], -1)


def test_rates_and_rollup(spark):
    rows = [("a", "script", "short_lt_30", [1, 5], [1, 6], 1.0, 0), ("a", "function", "short_lt_30", [], [], 2.0, 0), ("b", "script", "long_gt_80", [3], [], 3.0, 1)]
    df = spark.createDataFrame(rows, "project string, region_kind string, length_bucket string, predicted array<int>, truth array<int>, nll double, violations int")
    got = {(r.stratum, r["name"]): r for r in metrics.rollup(df).collect()}
    assert len(got) == 1 + 2 + 2 + 2 + 1
    o = got["overall", "all"]
    assert (o.samples, o.precision_exact, o.recall_exact, o.precision_tolerance_1, o.hard_constraint_violations) == (3, 1 / 3, 0.5, pytest.approx(2 / 3), 1)
    assert o.exact_segmentation_accuracy == pytest.approx(1 / 3) and o.average_overcut == pytest.approx(1 / 3)
    assert got["project", "b"].precision_exact == 0 and got["project_macro", "all"].samples == 2
    none = metrics.micro(metrics.matched(df.where("project = 'none'"))).first()
    assert none.precision == none.recall == 1.0


def test_ignored_positions_as_a_column(spark):
    cases = [([4, 9], [5], [9]), ([1, 9], [1], [9]), ([1], [1, 2], []), ([], [3], [3]), ([2, 3], [], None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, predicted array<int>, truth array<int>, ignored array<int>")
    for tolerance in (0, 1):
        got = {r.i: (r.tp, r.fp, r.fn) for r in metrics.matched(df, tolerance, "ignored").collect()}
        assert got == {i: metrics.match(p, t, tolerance, g or []) for i, (p, t, g) in enumerate(cases)}


def test_distribution_by_group_with_ties_and_nulls(spark):
    import random
    import statistics

    rng = random.Random(1)
    rows = [(g, float(rng.randrange(9)) if rng.random() < 0.9 else None) for g in ("a", "b", None) for _ in range(300)] + [("c", 1.5)]
    got = {r.g: r for r in metrics.distribution(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", "g").collect()}
    for g in ("a", "b", None, "c"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        r = got[g]
        assert (r["count"], r.minimum, r.p10, r["median"]) == (len(v), v[0], v[round((len(v) - 1) * 0.1)], v[round((len(v) - 1) * 0.5)]) and abs(r.mean - statistics.mean(v)) < 1e-9


def test_distribution_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(i),) for i in range(6)], "x double")
    r = metrics.distribution(df, "x").first()
    assert (r["count"], r.minimum, r.mean, r.p10, r["median"]) == (6, 0.0, 2.5, 0.0, 2.0)


SRC = "a = rand(3, 1);\nb = a + 1;\nc = sum(b);\nd = c / 2;\n"


def record(i, project, split, **change):
    sha = hashlib.sha256(SRC.encode()).hexdigest()
    r = {"sample_id": f"s{i}", "split": split, "relative_path": f"sources/p{i}.m", "source_sha256": sha, "segments": [{"region_id": "script:top-level", "start_line": 1, "end_line": 2}, {"start_line": 3, "end_line": 4}], "boundaries": [{"boundary": b, "after_line": b, "label": "preferred_cut" if b == 2 else "no_cut"} for b in (1, 2, 3)], "provenance": {"project": project, "source_kind": "curated_real_gold", "annotation_status": "user_adjudicated", "source_sha256": sha, "revision": "r1"}}
    return r | change


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sources").mkdir()
    records = [record(i, f"p{i}", ["train", "train", "validation", "test"][i]) for i in range(4)]
    for i in range(4):
        (tmp_path / "sources" / f"p{i}.m").write_text(SRC)
    write(tmp_path, records)
    (tmp_path / "split_projects.json").write_text(json.dumps({"projects": {r["provenance"]["project"]: r["split"] for r in records}}))
    return tmp_path, records


def write(path, records, tail=""):
    (path / "manifest.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records) + tail)


def test_audit_passes_and_finds_faults(spark, folder):
    path, records = folder
    good = api.audit(spark, str(path))
    assert good["passed"] and good["splits"]["train"] == {"files": 2, "projects": 2, "regions": 2, "modules": 4, "cuts": 2} and good["reliability"]["parse"]["count"] == 12
    bad = [records[0], records[0] | {"split": "nope"}, record(1, "p2", "train", source_sha256="00"), records[2] | {"boundaries": records[2]["boundaries"][:1]}, record(9, "p9", "test")]
    (path / "sources" / "extra.m").write_text("x = 1;\n")
    write(path, bad, "not json\n")
    errors = api.audit(spark, str(path))["errors"]
    for want in ("manifest: invalid JSON", "s0: duplicate sample_id", "s0: invalid split", "p2: project split leakage", "s1: record source hash mismatch", "s2:script:top-level: boundary truth is not exhaustive", "s2:script:top-level: segment and cut counts disagree", "s9: source is missing", "sources/extra.m: unreferenced source"):
        assert want in errors


def test_policy(spark, tmp_path):
    base = record(0, "p", "train")["provenance"]
    cases = {
        None: base,
        "no_source_kind": {k: v for k, v in base.items() if k != "source_kind"},
        "forbidden_source_kind": base | {"source_kind": "github_real"},
        "unapproved_source_kind": base | {"source_kind": "generated"},
        "not_reviewed": base | {"annotation_status": "draft"},
        "not_high_confidence": base | {"annotation_status": "expert_accepted", "annotation_confidence": "medium"},
        "no_immutable_provenance": {k: v for k, v in base.items() if k != "revision"},
    }
    write(tmp_path, [record(i, "p", "train", provenance=p) for i, p in enumerate(cases.values())])
    m = corpus.read_manifest(spark, f"{tmp_path}/manifest.jsonl")
    assert [r.rule for r in m.select("sample_id", corpus.policy_violation().alias("rule")).orderBy("sample_id").collect()] == list(cases)
    with pytest.raises(ValueError):
        corpus.require_trainable(m)


def test_training_protocol_and_sealed_test(spark, folder, monkeypatch):
    path, records = folder
    artifact, report = f"{path}/model.json", f"{path}/report.json"
    seen = []
    real = training.examples_of
    monkeypatch.setattr(training, "examples_of", lambda st, truth, edges=None: seen.append({r.split for r in truth.select("split").distinct().collect()}) or real(st, truth, edges))
    config = training.TrainingConfig(epochs=3, minimum_epochs=1)
    done = api.train(spark, str(path), artifact, config)
    assert seen == [{"train", "validation"}] and done["selection"]["epochs_completed"] <= 3 and done["test_status"] == "sealed_not_loaded"
    assert sum(len(energy.np.ravel(v)) for v in done["parameters"].values()) == energy.SIZE
    result = api.open_test(spark, str(path), artifact, report)
    assert {r["stratum"] for r in result["test_metrics"]} == {"overall", "project", "region_kind", "length_bucket", "project_macro"}
    with pytest.raises(FileExistsError):
        api.open_test(spark, str(path), artifact, f"{path}/other.json")
    with pytest.raises(RuntimeError):
        training.train(spark.createDataFrame([], "split string"), training.TrainingConfig(device="cuda"))
    training.save(done | {"schema_version": "old"}, f"{path}/old.json")
    with pytest.raises(ValueError):
        training.load(f"{path}/old.json")
    (path / "split_projects.json").write_text(json.dumps({"projects": {"p0": "test"}}))
    with pytest.raises(ValueError, match="split mismatch"):
        corpus.identity(spark, str(path))
    write(path, [records[0] | {"source_sha256": "00"}])
    with pytest.raises(ValueError, match="hash mismatch"):
        corpus.identity(spark, str(path))


def test_one_of_many_opens_the_sealed_test(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def attempt(_):
        try:
            training.claim(f"{tmp_path}/receipt")
        except FileExistsError:
            return 0
        return 1

    with ThreadPoolExecutor(16) as pool:
        assert sum(pool.map(attempt, range(64))) == 1


def test_hash_tree(spark):
    def tree(leaves, each):
        depth, distinct = 0, sorted({x: leaves.count(x) for x in leaves}.items())
        while len(distinct) > each * 16**depth:
            depth += 1
        nodes = {}
        for x, c in distinct:
            nodes.setdefault(x[:depth], []).append(f"{x}:{c}")
        nodes = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in nodes.items()}
        for d in range(depth - 1, -1, -1):
            up = {}
            for k in sorted(nodes):
                up.setdefault(k[:d], []).append(nodes[k])
            nodes = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in up.items()}
        return nodes[""]

    leaves = [hashlib.sha256(str(i % 150).encode()).hexdigest() for i in range(170)]
    df = spark.createDataFrame([(x,) for x in leaves], "leaf string").repartition(5)
    for each in (1, 8, 1000):
        assert corpus.merkle(df, each) == tree(leaves, each)
    assert corpus.merkle(df.limit(160), 8) != corpus.merkle(df, 8)
    assert corpus.merkle(df.where("false")) == hashlib.sha256(b"").hexdigest()


def test_barrier_epochs_equal_a_plain_loop(spark, folder):
    path, _ = folder
    rows = api.corpus_examples(spark, str(path), ("train", "validation")).cache()
    config = training.TrainingConfig(epochs=2, batch_size=2)
    done = training.train(rows, config)
    held = [(energy.region_of(r.asDict(True)), [int(c) for c in r.cuts]) for r in rows.where("split = 'train'").orderBy("sample_id").collect()]
    theta, adam, best = energy.initial(config.random_seed), training.Adam(energy.SIZE, config.weight_decay), None
    for epoch in (1, 2):
        rate, auxiliary = training.cosine(epoch, config)
        order, losses = list(range(len(held))), 0.0
        random.Random(config.random_seed + epoch).shuffle(order)
        for i in range(0, len(order), 2):
            got = [energy.loss_and_gradient(theta, *held[k], config.soft_dp_temperature, auxiliary) for k in order[i : i + 2]]
            losses += sum(a for a, _ in got)
            theta = adam.step(theta, training.clipped(sum(g for _, g in got) / len(got), config.gradient_clip), rate)
        assert done["history"][epoch - 1]["train_structured_nll"] == pytest.approx(losses[0] / len(held))
        best = theta if done["selection"]["best_epoch"] == epoch else best
    assert training.theta_of(done) == pytest.approx(best)


def test_more_tasks_than_examples(spark, folder):
    """Tasks without examples take part in every step."""
    path, _ = folder
    fit = api.corpus_examples(spark, str(path), ("train", "validation")).where("split = 'train'").limit(1).select("*", F.lit(0).cast("long").alias("place"))
    config = training.TrainingConfig(batch_size=1)
    theta, adam, losses = training.one_epoch(fit, 1, 1, energy.initial(), training.Adam(energy.SIZE, 0.0), config)
    assert adam.t == 1 and losses[0] > 0 and np.any(theta != energy.initial())


def test_an_epoch_is_the_same_in_short_jobs(spark, folder, monkeypatch):
    path, _ = folder
    fit = training.numbered(api.corpus_examples(spark, str(path), ("train", "validation")).drop("split"), "sample_id", "place")
    n, config = fit.count(), training.TrainingConfig(batch_size=1)
    assert n > 1
    run = lambda: training.one_epoch(fit, n, 1, energy.initial(), training.Adam(energy.SIZE, 0.0), config)
    whole = run()
    monkeypatch.setattr(training, "STRETCH", 1)
    short = run()
    assert (whole[0] == short[0]).all() and whole[1].t == short[1].t == n and whole[2] == pytest.approx(short[2])


def graph(spark, control="none"):
    tasks = spark.createDataFrame([("g", 0, "load", "acquisition", [], ["x"], 1, "none", 0, ""), ("g", 1, "clean", "normalization", ["x"], ["y"], 2, control, 1, "m"), ("g", 2, "show", "output", ["y"], [], 1, "none", 0, "m")], semantic.TASK)
    return tasks, spark.createDataFrame([], semantic.OPERATION), spark.createDataFrame([], "graph_id string, source_op string, target_op string"), spark.createDataFrame([("g", "b1", "load", "clean", "cut")], semantic.BOUNDARY)


@pytest.mark.parametrize("style", ["vectorized", "descriptive", "reused"])
def test_rendered_programs_parse_back(spark, style):
    from functools import reduce

    from pyspark.sql import functions as F

    from weftline.sources import mlang

    named = [[t.withColumn("graph_id", F.lit(c)) for t in graph(spark, c)] for c in semantic.CONTROLS]
    tasks, ops, edges, bounds = (reduce(lambda a, b: a.unionByName(b), [g[i] for g in named]) for i in range(4))
    assert semantic.violations(tasks, ops, edges, bounds).isEmpty()
    assert all(r.cuts == [1, 4] for r in semantic.true_cuts(tasks, bounds).collect())
    rows = semantic.rendered(tasks, ops, bounds, style).collect()
    assert len(rows) == len(semantic.CONTROLS)
    for r in rows:
        got = mlang.analyze(r.source)
        assert not got["diagnostics"]
        st = got["regions"][0]["statements"]
        assert r.true_cuts == [1] and len(st) == (5 if r.graph_id == "none" else 4)
        assert st[0]["end_line"] == r.task_end[0] and st[1]["start_line"] == r.task_start[1]
        assert len({x.split("=")[1] for x in r.symbols}) == len(r.symbols)


def test_graph_violations(spark):
    tasks, ops, edges, bounds = graph(spark)
    twice = tasks.unionByName(tasks.where("ordinal = 0"))
    stray = bounds.unionByName(spark.createDataFrame([("g", "b2", "load", "clean", "cut"), ("g", "b3", "load", "none", "maybe")], semantic.BOUNDARY))
    lost = spark.createDataFrame([("g", "a", "b")], edges.schema)
    errors = {r.error for r in semantic.violations(twice.replace("normalization", "x").replace(2, 0, "steps"), ops, lost, stray).collect()}
    assert errors == {"task ids must be unique", "task lengths must be non-negative", "edge references an unknown operation", "boundary references an unknown task", "a pair of tasks has two boundary truths", "unsupported boundary label"}


def test_command_line_and_reports(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build", lambda: spark)
    f = tmp_path / "a.m"
    f.write_text(SRC + "disp(d);\nx = rand(2, 1);\ny = x * 2;\nsave out.mat y\n")
    assert cli.run(["analyze", str(f), "--json", f"{tmp_path}/out"]) == 0
    assert "script:top-level" in capsys.readouterr().out and spark.read.json(f"{tmp_path}/out").count() == 7
    assert cli.run(["explain", str(f), "--after-line", "2"]) == 0
    assert "features: variable_death=" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no legal boundary"):
        cli.run(["explain", str(f), "--after-line", "99"])
    assert cli.run(["project-scan", str(tmp_path), "--json", f"{tmp_path}/index"]) == 0
    assert cli.run(["analyze", str(f), "--project-index", f"{tmp_path}/index", "--threshold", "0.9"]) == 0
    policy = tmp_path / "p.json"
    policy.write_text(json.dumps({"schema_version": reports.POLICY_VERSION, "feature_version": "boundary-features-1", "threshold": 0.4}))
    assert reports.load_policy(str(policy)).threshold == 0.4 and reports.load_policy(str(policy)).module_quality_floor == 0.6
    policy.write_text(json.dumps({"schema_version": "x"}))
    with pytest.raises(ValueError):
        reports.load_policy(str(policy))
