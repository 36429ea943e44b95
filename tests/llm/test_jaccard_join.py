import random
import re

import numpy as np

from weftline.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=3, percent=90):
    """id -> (set size, smallest reachable id), comparing every pair."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = " ".join(word() for _ in range(25))
    rows = [None, "", " \t\n", "one", "ONE", "two  Words", "two words", "x " * 5000, "y z " * 70_000]
    # a group of near copies of which most are linked to the unedited text only
    base = [word() for _ in range(120)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = word()
        rows.append(" ".join(own))
    for _ in range(25):
        own = [word() for _ in range(rng.randint(2, 90))]
        for _ in range(rng.randint(1, 5)):
            edited = list(own)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(own))] = word()
            rows.append(" ".join(edited))
        rows.append(passage + " " + " ".join(word() for _ in range(rng.randint(1, 20))))
    chain = [word() for _ in range(150)]
    for i in range(14):
        rows.append(" ".join(chain[i * 3 :] + [word() for _ in range(i * 3)]))
    return list(enumerate(rows))


def test_matches_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, node int, h string").repartition(3)
    for percent, k, slots, most in ((90, 3, 1 << 20, 16), (75, 2, 64, 3)):
        got = jaccard_join.similar(docs, percent, k, slots, most)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, k, percent)


def test_nulls_repeats_and_empty_tables(spark):
    text = "to be or not to be that is the question whether it is nobler in the mind to suffer the slings and arrows"
    rows = [(None, text), (9, text), (9, text), (4, text + " "), (None, "alone by itself"), (None, None), (3, "")]
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    n = len(set(zip(text.split(), text.split()[1:], text.split()[2:])))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, n, 4), (9, n, 4), (9, n, 4), (4, n, 4), (None, 1, None), (None, 0, None), (3, 0, 3)], key=str)
    assert jaccard_join.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_grows_where_lists_are_long():
    rare, common = np.ones(60), np.full(60, 500.0)
    base = jaccard_join.base_length(100, 90)
    assert jaccard_join.matches(rare, 100, base, 8, unseen=0.0) == 1
    assert jaccard_join.matches(common, 100, base, 8) > 1
    # where lists are long behind the first prefix only, it doesn't grow
    assert jaccard_join.matches(np.r_[np.full(base, 1.01), np.full(40, 1e6)], 100, base, 8) == 1
    assert jaccard_join.matches(np.ones(1), 1, jaccard_join.base_length(1, 90), 8) == 1


def test_prefixes_keep_every_similar_pair():
    """Similar sets share as many shingles of their prefixes as the smaller number of matches."""
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(5, 60)
        a = set(rng.sample(range(200), n))
        b = set(a) - set(rng.sample(sorted(a), rng.randint(0, 2))) | set(rng.sample(range(200), rng.randint(0, 2)))
        if 100 * len(a & b) >= 90 * len(a | b):
            la, lb = rng.randint(1, 4), rng.randint(1, 4)
            pa, pb = (set(sorted(s)[: jaccard_join.base_length(len(s), 90) + l - 1]) for s, l in ((a, la), (b, lb)))
            assert len(pa & pb) >= min(la, lb, len(a), len(b))
