import random

import corpus_pipeline
import pytest
from test_minhash import brute as near
from test_suffix import passages

from weftline.llm import bpe_codec, mixing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    syl = ["an", "the", "er", "on", "ti", "or", "ea", "st"]
    word = lambda: "".join(rng.choices(syl, k=rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(120))
    rows, labels = [], []
    for i in range(260):
        w = [word() for _ in range(rng.randint(5, 90))]
        toxic = rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["nitwit", "blockhead"]))
        text = " ".join(w)
        if i % 20 == 7:
            text += "\n" + passage
        rows.append([i, text, "en", f"src{rng.choice([0, 0, 0, 1, 2])}", len(text)])
        labels.append((i, 1, int(toxic)))
    rows += [[300 + i, rows[i][1], "en", "src0", rows[i][4]] for i in range(5)] + [[400, None, None, None, None], [401, "", "de", "src1", 0]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, {i for i, _, t in labels if t}


def test_stages_one_by_one(spark, tables):
    d, rows, toxic = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, d)
        got.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        out[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = [r for r in rows if r[0] not in toxic and not (300 <= r[0] < 305 and r[0] - 300 in toxic)]
    assert {r.doc_id for r in out["toxicity"]} == {r[0] for r in kept}
    group = near([(r[0], r[1]) for r in kept])
    assert {r.doc_id for r in out["near_duplicates"]} == {i for i, (_, c) in group.items() if i == c}
    before = [(r.doc_id, r.text) for r in out["near_duplicates"]]
    want = {i: w for (i, _), w in zip(before, passages(before, 50))}
    assert any(w[0] for w in want.values())
    assert {r.doc_id: (r.text, r.n_chars) for r in out["repeats"]} == {i: (w[2], len(w[2])) for i, w in want.items()}
    assert sorted(map(str, out["mixing"])) == sorted(map(str, out["repeats"]))
    place = {r.doc_id: r.position for r in mixing.mix(spark.read.parquet(f"{d}/repeats"), mixing.WEIGHTS).collect()}
    import glob

    import pyarrow.parquet as pq

    stream = [i for f in sorted(glob.glob(f"{d}/mixing/*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert [place[i] for i in stream] == list(range(len(stream)))
    text = {r.doc_id: r.text or "" for r in out["mixing"]}
    for r in out["tokens"]:
        assert list(r.ids) == bpe_codec.codec("byte_bpe_50k.tiktoken").encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.round_trip
    assert [r.doc_id for r in sorted(out["tokens"], key=lambda r: (r.part, r.row))] == stream
    assert len(out["tokens"]) == len(text)


def test_run_is_the_stages_put_together(spark, tables):
    d, _, _ = tables
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in spark.read.parquet(f"{d}/tokens").collect()}


def test_stages_take_empty_tables_nulls_and_further_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, tkey string, position int, k string, node int"
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(None, None, None, None, None), (None, "a b c d e f", None, "s", None), (1, "", "en", None, 0), (2, long, "en", "s", 5), (3, long + " end", "en", "s", 5), (3, long + " end", "en", "s", 5)]
    d = str(tmp_path)
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, part in (("none", []), ("some", rows)):
        docs = spark.createDataFrame([(*r, 0.9, "t", 7, "k", 1) for r in part], schema)
        for stage, f in corpus_pipeline.STAGES:
            out = f"{d}/{name}-{stage}"
            f(spark, docs, d).write.parquet(out)
            docs = spark.read.parquet(out)
        got = docs.collect()
        assert len(got) == (4 if part else 0)
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == [-1, -1, 1, 2]


def test_passages_of_51_words_are_cut_and_of_50_are_not(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    other = lambda: " ".join(word(6) for _ in range(40))
    passages = [" ".join(word(k) for _ in range(n)) for n, k in ((51, 5), (51, 1), (50, 5))]
    texts = [(f"{other()} 1", p, f"3 {other()}") if i < 3 else (f"{other()} 2", p, f"4 {other()}") for i, p in enumerate(passages * 2)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["repeats"](spark, docs, "").collect()}
    for i, (a, p, b) in enumerate(texts):
        assert got[i] == (f"{a} {p} {b}" if i % 3 == 2 else f"{a} {b}")
