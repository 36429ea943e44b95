import math
import random
import re
from collections import Counter

import numpy as np

from weftline.llm import wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(t or "")]


def brute(docs, items, k=20):
    """Every document's score for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        query = Counter(terms(text))
        weights = {t: c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t, c in query.items()}
        scored = []
        for i, b, size in bags:
            m = 100 - 25 + 25 * size * n // total
            score = sum(w * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t, w in weights.items() if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    common, rare = [f"w{i}" for i in range(30)], [f"Rare{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 60)) + rng.choices(rare, k=rng.randint(0, 8)))) for i in range(700)]
    docs += [(None, "w1 w2 Rare7"), (None, None), (800, None), (801, ""), (802, "-- !"), (5, docs[5][1]), (5, docs[5][1]), (803, "w3 rare9 " * 60_000), (804, "naïve 日本 a.b")]
    items = [(i, " ".join(rng.choices(common, k=rng.randint(1, 12)) + rng.choices(rare, k=rng.randint(0, 3)))) for i in range(12)]
    return docs, items + [(50, None), (51, ""), (52, "nowhere"), (None, "Rare7 naïve w1"), (3, items[3][1] + " 日本 B")]


def test_equals_all_scores(spark, monkeypatch):
    docs, items = corpus()
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, score int")
    queries = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int").drop("doc_id")
    want = brute(docs, items)
    plain = wand.index
    for each, longest, parts in ((8192, 64, 1), (16, 3, 4), (100, 8, 7)):
        monkeypatch.setattr(wand, "index", lambda d, n, total: plain(d, n, total, docs_each=each, longest=longest, overhead=50_000))  # noqa: B023
        got = wand.search(rows.repartition(parts), queries, terms_each=40, items_each=5)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_blocks_have_the_least_error():
    """Against every partition of short lists into blocks."""
    rng = random.Random(2)

    def cost(v, cuts):
        edges = [0, *cuts, len(v)]
        return sum((b - a) * max(v[a:b]) + 7 for a, b in zip(edges, edges[1:]))

    for longest in (2, 3, 64):
        lists = [[rng.randint(0, 12) for _ in range(rng.randint(1, 9))] for _ in range(60)]
        sizes = np.array([len(v) for v in lists])
        starts = np.cumsum(sizes) - sizes
        ends = wand.block_ends(np.concatenate(lists).astype(np.int64), starts, sizes, longest, 7)
        for v, s in zip(lists, starts):
            cuts = [i + 1 for i in range(len(v) - 1) if ends[s + i]]
            assert ends[s + len(v) - 1]
            every = [[i + 1 for i in range(len(v) - 1) if m >> i & 1] for m in range(1 << (len(v) - 1))]
            allowed = [c for c in every if all(b - a <= longest for a, b in zip([0, *c], [*c, len(v)]))]
            assert cuts in allowed and cost(v, cuts) == min(cost(v, c) for c in allowed)


def test_blocks_are_skipped():
    rng = random.Random(6)
    words = [wand.terms_of(" ".join(["a"] * rng.randint(1, 3) + ["b"] * (i % 50 == 0) + ["c"] * rng.randint(1, 30))) for i in range(4000)]
    total = sum(map(len, words))
    s = wand.Shard(wand.shard(list(range(4000)), words, 4000, total, 64, 200_000), 4000, total)
    places = wand.find(s.terms, wand.terms_of("a b"))
    read = []
    s.scores = lambda wanted, *rest, f=s.scores: read.append(int(wanted.sum())) or f(wanted, *rest)
    found, scores = s.best(places, np.array([900, 5000]), 20, 0)
    assert len(found) >= 20 and sum(read) < 1000


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    no_items, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert wand.search(none, items).collect() == [] and wand.search(some, no_items).collect() == [] and wand.search(none, no_items).collect() == []
    assert [tuple(r)[:3] for r in wand.search(some, items).collect()] == [(1, 1, 1)]
