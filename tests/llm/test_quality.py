import random
import zlib

import numpy as np

from weftline.llm import quality


def rows(n=1500):
    rng = random.Random(9)
    syl = ["an", "the", "er", "on", "ti", "or", "ea", "st"]
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choices(syl, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!" if rng.random() < 0.5 else x for x in w)
        out.append((i, text, rng.choice(["en", "de", None]), "clean" if good and rng.random() < 0.8 else rng.choice(["clean", "farm"]), len(text), int(good)))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([(*r[:5], "x") for r in data] + [(9000, None, None, None, None, "x"), (None, "a b", "en", "s", 3, "x")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(r[0], r[5]) for r in data if r[0] % 3] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, labels, labelled=400).collect()}
    assert len(got) == len(data) + 2 and all(0 <= x <= 1 for r in got.values() for x in (r.score, r.text_score, r.meta_score))
    held = [(r[0], r[5]) for r in data if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].keep == bool(y) for i, y in held]) > 0.97
    assert np.mean([(got[i].meta_score > 0.7) == bool(y) for i, y in held]) > 0.6


def test_pseudo_labels_of_all_rows_help_the_other_view(spark, monkeypatch):
    """Against the same model over one batch in memory, and against fits on the few labelled rows alone."""
    rng = np.random.default_rng(0)
    n, few = 3000, 40
    y = rng.integers(0, 2, n).astype(float)
    t = np.zeros((n, quality.SURFACE + quality.WORDS), np.float32)
    t[:, :3] = y[:, None] * 2 + rng.standard_normal((n, 3))
    chars = np.exp(5 + 2 * y + rng.standard_normal(n)).astype(int)
    batch = quality.pa.RecordBatch.from_arrays([quality.pa.array(range(n)), *(quality.pa.array([None] * n, quality.pa.string()) for _ in range(2)), quality.pa.array(chars), quality.pa.array(list(t), quality.pa.list_(quality.pa.float32()))], names=["doc_id", "lang", "source", "n_chars", "t"])
    lab = quality.matrices(batch.slice(0, few))
    free = spark.createDataFrame(batch.slice(few).to_pylist(), "doc_id long, lang string, source string, n_chars long, t array<float>").repartition(5)
    got = quality.co_train(free, lab, y[:few], 5, 2, 0.97)
    monkeypatch.setattr(quality, "added_up", lambda rows, f, size, groups: f(batch.slice(few)))
    want = quality.co_train(None, lab, y[:few], 5, 2, 0.97)
    for a, b in zip(got["views"], want["views"]):
        assert np.allclose(a.w, b.w, atol=1e-6)
    alone = quality.co_train(None, lab, y[:few], 0, 2, 0.97)
    right = lambda m: np.mean((quality.apply(m, quality.matrices(batch.slice(few)))[2] >= 0.5) == y[few:])
    assert right(got) > 0.93 and right(got) >= right(alone) - 0.01


def test_ties_repeated_rows_and_long_texts(spark):
    data = rows(300)
    long = "the an er " * 60_000
    docs = spark.createDataFrame([*(r[:5] for r in data), *(r[:5] for r in data[:50]), (7000, long, "en", "clean", len(long)), (7000, long, "en", "clean", len(long)), (7001, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in data] + [(r[0], r[5]) for r in data[:50]], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.score, r.keep))
    assert len(got) == 353 and all(len(v) == 1 for v in by.values())


def test_missing_columns_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.keep) for r in quality.score(docs, none).collect()] == [(0.5, True)]
    assert quality.score(docs.limit(0), none).count() == 0
