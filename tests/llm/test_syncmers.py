import hashlib
import random

from weftline.llm import syncmers


def corpus():
    rng = random.Random(8)
    t = lambda n: "".join(rng.choices("abcdefgh é😀\n", k=n))
    texts = [None, "", "ab", "a", "x" * 500, "y" * 30000] + [t(rng.randrange(1, 900)) for _ in range(60)]
    ids = [3, 5, 9, 1000, 70000, 70001] + rng.sample(range(100, 200000), 60)
    return list(zip(ids, texts)) + [(None, "no key"), (3000, texts[20]), (3000, texts[20])]


def ordered(rows):
    return sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**12)), r[1] or ""))


def test_edits_follow_the_next_document_and_sketches_are_those_of_the_edited_text(spark):
    rows = corpus()
    schema = "doc_id long, text string, n string, chunk int"
    got = syncmers.fingerprints(spark.createDataFrame([(*r, "c", 1) for r in rows], schema), chunk=16, fan=8).collect()
    assert len(got) == len(rows)
    line = ordered([r for r in rows if r[0] is not None])
    want = {}
    # a row without an id is followed by the first document, and follows none
    for r, nxt in [*zip(line, line[1:] + line[:1]), *((r, line[0]) for r in rows if r[0] is None)]:
        text, after = r[1] or "", nxt[1] or ""
        m = len(text) // 3
        want.setdefault(r[0], []).append(text[: len(text) - m] + after[:m])
    for r in got:
        assert r.edited_sha256 in [hashlib.sha256(e.encode()).hexdigest() for e in want[r.doc_id]]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    edited = spark.createDataFrame([(r[0], want[r[0]][0], "c", 1) for r in ordered(rows)], schema)
    again = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(edited, chunk=16, fan=8).collect()}
    assert all(again[r.doc_id] == r.edited_fingerprint for r in got if r.doc_id != 3000)
    by_text = {}
    for r in got:
        key = next(t or "" for i, t in rows if i == r.doc_id)
        assert r.n_chars == len(key) and by_text.setdefault(key, r.fingerprint) == r.fingerprint
    long = [r for r in got if 200 < r.n_chars < 1000 and r.n_chars != 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.35 and sum(r.near_next for r in long) / len(long) < 0.1
    assert len({r.fingerprint for r in long}) >= len(long) - 2


def test_anchors_are_the_closed_syncmers(spark):
    text = corpus()[10][1]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    k, s = 8, 3
    hashed = {x: h for x, h in spark.createDataFrame([(text[i : i + s],) for i in range(len(text) - s + 1)], "x string").selectExpr("x", "xxhash64(x)").collect()}
    h = [hashed[text[i : i + s]] for i in range(len(text) - s + 1)]
    w = k - s + 1
    want = [i for i in range(len(text) - k + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])]
    assert [r.place for r in syncmers.anchors(df, k, s).orderBy("place").collect()] == want and 0 < len(want) < len(text)


def test_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a single text of its own, long enough")], "doc_id long, text string")
    r = syncmers.fingerprints(df).collect()[0]
    assert r.near_next == 1.0 and 0 < r.near_edited < 1
    assert syncmers.fingerprints(df.limit(0)).count() == 0


def test_tables_without_any_id(spark):
    rows = [(None, t) for t in ("some text that is long enough", "another text that is long enough", None, "some text that is long enough")]
    got = syncmers.fingerprints(spark.createDataFrame(rows * 50, "doc_id long, text string")).collect()
    assert len(got) == 200 and all(r.near_next in (0.0, 1.0) for r in got)  # the smallest text, an empty one, follows them all


def test_long_first_document_and_rows_without_ids(spark):
    """The first document is sketched once, however many rows without an id it follows."""
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh ", k=300_000))
    rows = [(90, long), (5, "five " * 40), (None, "none " * 60), (None, "other " * 30)] + [(None, f"many {i} " * 10) for i in range(600)]
    got = {}
    for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), chunk=16).collect():
        got.setdefault(r.doc_id, []).append(r)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + long[: len(t) // 3]).encode()).hexdigest() for i, t in rows if i is None)
    assert sorted(r.edited_sha256 for r in got[None]) == want and len(got[90]) == len(got[5]) == 1
    m = len(long) // 3
    assert got[90][0].edited_sha256 == hashlib.sha256((long[: len(long) - m] + rows[1][1][:m]).encode()).hexdigest()
