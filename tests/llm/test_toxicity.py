import random
import zlib

import numpy as np

from weftline.llm import toxicity

INSULTS = ["nitwit", "blockhead", "dolt"]


def rows(n=900):
    rng = random.Random(2)
    syl = ["an", "the", "er", "on", "ti", "or", "ea", "st", "in", "re"]
    out = []
    for i in range(n):
        w = ["".join(rng.choices(syl, k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(rng.randint(1, 2)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(INSULTS))
        out.append((i, " ".join(w), y))
    return out


def test_held_out_accuracy_and_gapped_insults(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data] + [(5000, None, 0.5), (5001, "", 0.5), (5002, "an er dol.t the", 0.5), (5003, "an er ontier the", 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels, per_class=300).collect()}
    assert len(got) == len(data) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values() if r.doc_id is not None and r.doc_id < 5000) == len(held)
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert got[5000].score == got[5001].score < 0.5
    assert got[5002].score > got[5003].score


def test_kernel_is_normalised():
    k = toxicity.kernel(["nitwit", "aaaaaa", "an"], toxicity.embed(["nitwit", "aaaaaa", "an"]))
    assert np.allclose(np.diag(k), 1, atol=1e-4) and k[0, 1] < 0.1


def plain_kernel(a, b):
    """Sum over pairs of equal triples of symbols, each weighing DECAY to the length it spans, normalised."""

    def value(x, y):
        out = 0.0
        for s in triples(x):
            for t in triples(y):
                if s[0] == t[0]:
                    out += toxicity.DECAY ** (s[1] + t[1])
        return out

    def triples(w):
        m = "^" + w + "$"
        return [((m[i], m[j], m[k]), k - i + 1) for i in range(len(m)) for j in range(i + 1, len(m)) for k in range(j + 1, min(len(m), i + toxicity.SPAN + 1))]

    return value(a, b) / np.sqrt(value(a, a) * value(b, b))


def test_kernel_against_its_definition():
    words = ["nitwit", "nit.wit", "nxitwit", "dolt", "doolt", "antler", "banana", "an"]
    got = toxicity.kernel(words, toxicity.embed(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            # characters that are neither letters nor digits are one symbol
            assert abs(got[i, j] - plain_kernel(a, b)) < 1e-4
    assert got[0, 1] > 0.3 > got[0, 5]


def test_words_of_other_scripts_keep_their_pattern():
    words = ["привет", "дурак", "глупец", "你好", "مرحبا", "naïve"]
    spelled = [next(iter(toxicity.words_of(w))) for w in words]
    assert all(w.isascii() and w.isalnum() for w in spelled) and len(set(spelled)) == len(words) and spelled[-1] == "naive"
    assert toxicity.words_of("ДУРАК dur\u200bak 😀") == toxicity.words_of("дурак durak")
    beta = np.random.default_rng(0).standard_normal(1 << 15)
    assert len(set(toxicity.word_scores(spelled, beta, 0.0).round(9))) == len(words)


def test_insults_in_another_script_are_learned(spark):
    swap = {"nitwit": "нитвит", "blockhead": "болван", "dolt": "дурень"}
    data = [(i, " ".join(swap.get(w, w) for w in t.split(" ")), y) for i, t, y in rows(700)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([r[:2] for r in data], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")).collect()}
    held = [(i, y) for i, _, y in data if got[i].held_out]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97


def test_very_long_texts(spark):
    data = rows(400)
    long = "er an the on " * 80_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(7001, long), (7002, long + " nitwit dolt"), (7003, "q" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")).collect()}
    assert got[7002].predicted == 1 and got[7001].predicted == 0 and 0 <= got[7003].score <= 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), none).count() == 0
