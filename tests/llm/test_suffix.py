import hashlib
import random
import re

import numpy as np
import pytest

from weftline.llm import suffix_dedup


def brute(rows, length):
    """Marks every byte under a string of `length` bytes that starts at two places."""
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for (key, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((key, len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rows, over):
    """Of each row: runs and words under windows of over + 1 words that another document (doc_id and text) has, and what is left."""
    words = [[(m[0].translate(LOWER), *m.span()) for m in WORD.finditer(t or "")] for _, t in rows]
    where = {}
    for row, ws in zip(rows, words):
        for i in range(len(ws) - over):
            where.setdefault(tuple(w for w, _, _ in ws[i : i + over + 1]), set()).add((row[0], row[1]))
    out = []
    for (_, t), ws in zip(rows, words):
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - over):
            if len(where[tuple(w for w, _, _ in ws[i : i + over + 1])]) > 1:
                gone[i : i + over + 1] = True
        starts = [a for _, a, _ in ws] + [len(t or "")]
        lead = (t or "")[: starts[0]]
        out.append((int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), int(gone.sum()), lead + "".join((t or "")[a:b] for a, b, g in zip(starts, starts[1:], gone) if not g)))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passage, wide = text(700), text(2500)
    rows = [None, "", "short", "x" * 399, "x" * 400, "y" * 900, "ab" * 700, text(3000)]
    for _ in range(12):
        i, j = rng.randrange(300), rng.randrange(350, 700)
        rows.append(text(rng.randrange(600)) + passage[i:j] + text(rng.randrange(600)))
    for _ in range(8):
        w = list(wide)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append("".join(w))
    own = text(500)
    return list(enumerate(rows + [own + text(90) + own, rows[7], rows[-1]]))


@pytest.mark.parametrize("settings", [{}, {"hot": 3}, {"per_bucket": 5}])
def test_matches_every_window(spark, settings):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, tkey string")
    got = sorted((tuple(r)[:5] for r in suffix_dedup.digests(docs, 400, **settings).collect()), key=str)
    assert got == brute(rows, 400)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    t = "".join(random.Random(1).choices("abcdef", k=450))
    docs = spark.createDataFrame([(None, t), (1, "p" + t), (2, "w" * 50), (2, "w" * 50)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(docs).collect()) == [(50, 0, 0), (50, 0, 0), (450, 450, 1), (451, 450, 1)]
    assert suffix_dedup.digests(docs.limit(0)).count() == 0


def spoken():
    """Documents that share passages of various lengths, in other case and with other gaps, and some that repeat themselves."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(1, 6)))
    many = lambda n: [word() for _ in range(n)]
    shared, rows = [many(n) for n in (8, 9, 10, 12, 25, 60)], [None, "", " \n", "one two", "x " * 40, "X\tx " * 20]
    for k in range(60):
        out = many(rng.randrange(15))
        for p in rng.sample(shared, rng.randrange(3)):
            i = rng.randrange(4)
            out += [w.upper() if rng.random() < 0.2 else w for w in p[i : i + rng.randrange(5, 60)]] + many(rng.randrange(10))
        rows.append("".join(w + rng.choice([" ", "  ", "\n"]) for w in out))
    own = " ".join(many(30))
    return list(enumerate(rows + [own + " and " + own, rows[10], rows[-1]])) + [(10, rows[10]), (None, "null " + rows[11]), (None, rows[12])]


@pytest.mark.parametrize("settings", [{}, {"hot": 2}, {"per_bucket": 5}])
def test_passages_match_every_window_of_words(spark, settings):
    rows = spoken()
    over = 16
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, tkey string")
    want = passages(rows, over)
    assert sum(w[0] for w in want) > 10
    got = suffix_dedup.digests(docs, over=over, **settings).select("doc_id", "n_passages", "passage_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *w[:2]) for r, w in zip(rows, want)), key=str)
    left = suffix_dedup.cleaned(docs, over, **settings).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(((r[0], w[2]) for r, w in zip(rows, want)), key=str)


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = " ".join("w%d" % rng.randrange(10**6) for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, "a " + long[:5000]), (3, long[-400:])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.digests(docs).collect()}
    assert got[1].n_removed == 5400 and got[1].n_spans == 2 and got[2].n_removed == 5000 and got[3].n_removed == 400
    assert got[1].n_passages == 2 and got[2].n_passages == 1


def test_multikey_quicksort():
    s = np.random.default_rng(0).integers(0, 3, (800, 14)).astype(np.uint64)
    assert s[suffix_dedup.multikey_quicksort(s)].tolist() == sorted(s.tolist())


def test_periodic_texts_take_few_rows(spark):
    """Runs of one byte, short and long periods, and periods that break off: few anchor rows, and the right bytes."""
    rng = random.Random(12)
    line = "".join(rng.choices("abcdefgh ", k=61)) + "\n"
    rows = [(1, "x" * 60_000), (2, "x" * 401), (3, "abc" * 15_000 + "tail"), (4, line * 700), (5, line * 30 + "break" + line * 40), (6, "y" * 401 + "z" + "y" * 500), (None, "q" * 3000), (7, "x" * 500 + line * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.digests(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 400)
    assert suffix_dedup.anchor_table(suffix_dedup.keyed(docs), 400, 64, suffix_dedup.BYTES).count() < 400


def test_stretches_stand_for_all_anchors():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pos = np.cumsum(rng.choice([1, 1, 1, 3, 7], 30))
        kind = np.repeat(rng.integers(0, 3, 10), 3)
        first, step, times = suffix_dedup.stretches(pos, kind)
        told = [(int(pos[f] + s * i), int(kind[f])) for f, s, t in zip(first, step, times) for i in range(t)]
        assert told == list(zip(pos.tolist(), kind.tolist()))
