import random
import re

from weftline.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """doc -> (set size, smallest reachable id), comparing every pair."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    shared = " ".join(word() for _ in range(30))
    rows = [None, "", "  \n ", "one", "ONE", "two words", "Two  Words", "x " * 4000]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
        rows.append(shared + " " + " ".join(word() for _ in range(rng.randint(5, 20))))
    chain = [word() for _ in range(60)]
    for i in range(12):
        rows.append(" ".join(chain[i * 2 :] + [word() for _ in range(i * 2)]))
    return list(enumerate(rows))


def test_matches_all_pairs(spark):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    t = "a b c d e f g"
    got = minhash.near_duplicates(spark.createDataFrame([(None, t), (4, t), (4, t), (9, t.upper())], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, 4, False), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_chance_of_a_missed_bucket():
    worst = max(minhash.missed(i, u, 64) for u in range(1, 2000) for i in [-(-3 * u // 4)])
    assert 0 < worst < 5e-11 and minhash.missed(3, 4, 64) < 2e-12
    sets = [minhash.shingles(minhash.word_hashes("a b c d e f g" + x)) for x in ("", " h")]
    assert [len(s) for s in sets] == [3, 4]
    assert len(set(minhash.signature(sets[0], 64).tolist()) & set(minhash.signature(sets[1], 64).tolist())) > 5


def test_many_short_texts_with_three_of_four_shingles(spark):
    """8,000 pairs of a text and the same with one word more: all just similar enough, none may be lost."""
    rows = []
    for i in range(8000):
        t = " ".join(f"w{i}x{k}" for k in range(7))
        rows += [(2 * i, t), (2 * i + 1, t + " more")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id <> doc_id - doc_id % 2 or n_shingles <> 3 + doc_id % 2").count() == 0


def test_long_regular_words_are_told_apart(spark):
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    assert len({int(minhash.word_hashes(w)[0]) for w in (morse, other, morse[:1024], other[:1024], "b" * 64, "b" * 65)}) == 6
    assert minhash.word_hashes(morse.upper())[0] == minhash.word_hashes(morse)[0]
    got = minhash.near_duplicates(spark.createDataFrame([(1, morse), (2, other), (3, morse.upper())], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]
