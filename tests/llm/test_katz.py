import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(6)
    names = ["w%d" % i for i in range(120)]
    follow = {w: rng.choices(names, k=4) for w in names}
    rows = [(0, None), (1, ""), (2, "Unseen wordS only éÉ"), (None, "no key w1 w2")]
    for i in range(3, 260):
        w, out = rng.choice(names), []
        for _ in range(rng.randrange(1, 60)):
            out.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow.get(w, names)) if rng.random() < 0.8 else rng.choice(names) if rng.random() < 0.9 else "r%d" % rng.randrange(9999)
        rows.append((i, " ".join(out)))
    return [*rows, rows[7]]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def model(rows, vocabulary):
    """Plain dictionaries: base probability, and the probability of a word after a word."""
    train = [words(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    total = sum(c.values())
    base = lambda w: (c[w] + 0.5) / (total + 0.5 * (len(c) + 1))
    return train, c, total, base


def chain(train, base, alphabet):
    name = lambda w: w if w in alphabet else None
    low = {w: base(w) for w in alphabet}
    low[None] = 1 - sum(low.values())
    pairs = Counter()
    for t in train:
        for h, w in zip(["</s>", *t], t):
            pairs[name(h), name(w)] += 1
    n = Counter(min(v, katz.KEPT + 2) for v in pairs.values())
    common = (katz.KEPT + 1) * n[katz.KEPT + 1] / n[1]
    d = {}
    for r in range(1, katz.KEPT + 1):
        v = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1
        d[r] = v if 0 < v <= 1 else 1
    by = {}
    for (h, w), k in pairs.items():
        by.setdefault(h, {})[w] = k
    dist = {}
    for h, ws in by.items():
        size = sum(ws.values())
        p = {w: d.get(k, 1) * k / size for w, k in ws.items()}
        rest = 1 - sum(low[w] for w in ws)
        if rest < 1e-12:
            dist[h] = ({w: v / sum(p.values()) for w, v in p.items()}, 0.0)
            continue
        if sum(p.values()) > 1 - 1e-9:
            p = {w: v * size / (size + 0.5) / sum(p.values()) for w, v in p.items()}
        alpha = (1 - sum(p.values())) / rest
        dist[h] = (p, alpha)

    def prob(h, w):
        p, alpha = dist.get(name(h), ({}, 1.0))
        v = p.get(name(w), alpha * low[name(w)])
        return v if w in alphabet else v * base(w) / low[None]

    return prob, dist, low


@pytest.mark.parametrize("vocabulary,tokens_each,sent", [(60, 1_000_000, 65_536), (60, 300, 1_000_000), (65_535, 60, 300), (65_535, 1_000_000, 20), (65_535, 200, 1)])
def test_matches_a_plain_model(spark, monkeypatch, vocabulary, tokens_each, sent):
    """Small tokens_each: most contexts are hot and lie in several parts; sent: which pairs are sent along (all, some, none)."""
    monkeypatch.setattr(katz, "PAIRS_SENT", sent)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = katz.score(docs, vocabulary=vocabulary, tokens_each=tokens_each, words_each=50, rows=37).collect()
    train, c, total, base = model(rows, vocabulary)
    least = min((k for k in c.values() if sum(v >= k for v in c.values()) <= vocabulary), default=None)
    alphabet = {w for w, k in c.items() if least is not None and k >= least}
    assert len(alphabet) <= vocabulary and (vocabulary < len(c) or len(alphabet) == len(c))
    prob, dist, low = chain(train, base, alphabet)
    for p, alpha in dist.values():
        assert abs(sum(p.values()) + alpha * sum(v for w, v in low.items() if w not in p) - 1) < 1e-9
    want = {}
    for i, t in rows:
        ws = words(t)
        want[i] = (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10(base(w)) for w in ws), sum(math.log10(prob(h, w)) for h, w in zip(["</s>", *ws], ws)))
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 1) and r.train_tokens == total
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == w[:2] and np.allclose([r.base_score, r.score], w[2:], rtol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_settings_change_nothing_and_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(7)
    one = {(r.doc_id, round(r.score, 9)) for r in katz.score(docs).collect()}
    assert {(r.doc_id, round(r.score, 9)) for r in katz.score(docs, tokens_each=100, common=20, rows=5).collect()} == one
    assert katz.score(docs.limit(0)).count() == 0


def test_a_context_in_many_parts_and_counts_beyond_32_bits():
    words_ = np.arange(1, 5, dtype=np.uint64)
    alphabet = katz.Alphabet(words_, np.array([1 << 40, 5, 5, 5]), 1 << 41, 4, False, 1 << 32)
    assert list(alphabet.hot) == [1] and len(set(alphabet.route(np.ones(2000, np.uint64), katz.mix(np.arange(2000, dtype=np.uint64))).tolist())) > 200
    rows = [katz.rows_of(key=[0], n=[1], a=[alphabet.pack_runs(words_[:1])], b=[alphabet.pack(words_[1:2])], c=[katz.pack(np.array([3_000_000_000], np.uint32))]) for _ in range(3)]
    made = katz.merged(katz.pa.Table.from_batches(rows), alphabet).to_pylist()[0]
    assert katz.unpack(made["c"], 1, "u8").tolist() == [9_000_000_000]


def test_more_words_than_16_bits_can_tell_apart(spark):
    rows = [(i, " ".join("v%d" % (k % 72_000) for k in range(i * 240, i * 240 + 300))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows]
    train, c, total, base = model(rows, None)
    assert len(c) > 65_536
    prob, _, _ = chain(train, base, set(c))
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ws = words(t)
        assert np.isclose(got[i], sum(math.log10(prob(h, w)) for h, w in zip(["</s>", *ws], ws)), rtol=1e-9)
