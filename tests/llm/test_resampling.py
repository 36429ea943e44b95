import hashlib
import math
import random
import re
import zlib
from collections import Counter

from weftline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    def words(t):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def features(w):
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    corpus, aim = Counter(), Counter()
    for _, t in rows:
        corpus.update(features(words(t)))
    for t in target:
        aim.update(features(words(t)))
    S, T = sum(corpus.values()), sum(aim.values())
    out, ranks = [], []
    for k, (i, t) in enumerate(rows):
        f = features(words(t))
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((corpus[b] + 1) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(t)) >= least:
            ranks.append((-score, i is None, i or 0, k))
    for r, (*_, k) in enumerate(sorted(ranks)[: percent * len(ranks) // 100]):
        out[k][4] = r + 1
    return sorted(map(tuple, out), key=str)


def corpus():
    rng = random.Random(3)
    words = ["Ab", "c9", "naïve", "x-y", "été", "日本", "zz", "QUIT", "a\x00b", "und_er"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(120)]
    rows += [(None, "alpha " * 30), (None, None), (500, None), (501, ""), (502, "--- !!"), (7, rows[7][1]), (7, rows[7][1]), (503, "Long Words " * 60_000)]
    return rows, [" ".join(rng.choices(words[:12], k=25)) for _ in range(9)] + [None, ""]


def test_equals_the_definition(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, counts int, bucket string").repartition(5)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for n, percent in ((1, 10), (3, 50)):
        got = resampling.resample(docs, aim, n=n, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        # repeated rows are alike, so any of them may have either rank
        want = brute(rows, target, n=n, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_many_partitions_give_the_same(spark):
    rows, target = corpus()
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, target[0])], "item_id long, text string")
    assert sorted(map(tuple, resampling.resample(docs.repartition(40), aim).collect()), key=str) == brute(rows, target[:1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(none, aim).collect() == []
    rows = [(1, "one two " * 20), (2, "three")]
    assert sorted(map(tuple, resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), aim, percent=100).collect()), key=str) == brute(rows, [], percent=100)


def test_draws_follow_the_target(spark):
    """Documents with the target's words are drawn first."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["cat", "dog", "fish"] if i % 10 == 0 else ["stone", "sand", "clay", "rock"], k=40))) for i in range(300)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, "cat dog fish cat")], "item_id long, text string"))
    drawn = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(drawn) == 30 and all(i % 10 == 0 for i in drawn)
