"""Language-model scores by a bigram Katz back-off model, learned from and applied to whole texts.

Tokens are a text's words (A-Z lower-cased) and one end mark. Word counts cover every training token; the unigram level
is the base P(w) = (c + 0.5) / (N + 0.5 (V + 1)). The bigram level holds every pair of training words; the distribution is
proper over all words, known or not. A bigram seen r times has probability d_r r / c(h) with Good-Turing discounts
d_r for r <= 5; a bigram not seen has alpha(h) P(w), alpha chosen so that every context adds up to exactly 1. The text
starts in the context of the end mark. A context whose discounts leave nothing gives 0.5 / (c(h) + 0.5) to what it hasn't
seen; Good-Turing values outside (0, 1] (too few counts) count as no discount. With `vocabulary` (none by default) the
bigram level has at most so many words, all those above the smallest count that allows it, and one class of all others;
inside the class a word has its unigram share.

Tables: word counts, dealt by leading bits of the word's hash; bigrams, dealt by leading bits of their route, packed (sorted
contexts and words, counts, the own counts of less common words). A pair's route is its context's hash; of a context seen more than
`tokens_each` / 2 times it also takes leading bits of the word's hash, so hot contexts spread over parts and every part
holds about `tokens_each` tokens; what such a context's pairs add up to is summed over the parts. The number of parts
grows with the tokens. Counts are summed per batch of texts before the shuffle. Scoring sends each batch's pairs and words
to the parts that hold their tables, once each, which send back sums per text. Two bounded tables are sent along, which
saves asking: the `common` most frequent words with their counts, and the pairs that make up more than one in 65,536
of all tokens (fewer than 65,536 of them), so no pair is hot either. Packed words are places among the common, or hashes.

Null and empty texts have the end mark alone; a null doc_id counts as a training row; repeated rows each count and are
scored alike; further columns are ignored; an empty table gives none. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import slices, texts
from weftline.llm.words import mix, word_hashes
from weftline.session import discard, materialize

END = np.uint64(0x5851F42D4C957F2D)
CLASS = np.uint64(0)  # stands for the words outside a bounded vocabulary
KEPT = 5  # counts above it aren't discounted
PAIRS_SENT = 65_536  # pairs of a larger share than one in so many are sent along
ROWS = "kind int, key long, batch long, n int, a binary, b binary, c binary, d binary"
PAIRS = "n int, a binary, b binary, c binary"
CONTEXT = "h long, total double, seen double, low double"
TABLES = f"key long, {PAIRS}, own binary, hot array<struct<h:long,total:double,seen:double,low:double>>, pairs array<struct<h:long,w:long,c:long,own:long,total:double,seen:double,low:double>>"
SUMS = "batch long, kind int, n int, a binary, b binary, c binary"


def pack(v: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    if not len(v):
        return b""
    raw = np.ascontiguousarray(v.astype(v.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(v), -1).T.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def pack_sorted(v: np.ndarray) -> bytes:
    return pack(np.diff(v, prepend=v.dtype.type(0)))


def unpack_sorted(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.cumsum(unpack(data, n, kind), dtype=kind)


def rows_of(**cols) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "n": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()], names=list(cols))


def tokens(text: str) -> np.ndarray:
    return np.append(word_hashes(text), END)


def summed(h: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and the sums of their counts."""
    order = np.lexsort((w, h))
    h, w, counts = h[order], w[order], counts[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]) if len(h) else np.zeros(0, int)
    return h[first], w[first], np.add.reduceat(counts, first) if len(first) else counts


def word_counts(docs: DataFrame) -> DataFrame:
    """w (hash), c over the texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [tokens(t) for s in slices([b]) for t in s.column("text").to_pylist()]
            if parts:
                w, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Alphabet:
    """Counts of the most frequent words; if they are the whole vocabulary, the others are one class.

    Contexts of more than `hot` tokens are dealt out by the words after them too.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, closed: bool, hot: int):
        order = np.argsort(words)
        self.words, self.counts, self.closed = words[order], counts[order].astype(np.int64), closed
        self.base = np.log10(total + 0.5 * (distinct + 1)) if total or distinct else np.log10(0.5)
        self.rest = max(1.0 - ((counts + 0.5) / 10**self.base).sum(), 0.5 / 10**self.base)
        every, often = np.append(self.words, CLASS), np.append(self.counts, total - int(counts.sum()) if closed else 0)
        order = np.argsort(every)
        every, often = every[order], often[order]
        self.hot = every[often > hot]
        self.hot_shift = np.uint64(64) - np.minimum(np.ceil(np.log2(np.maximum(often[often > hot], 1) / hot)), 40).astype(np.uint64)

    def is_hot(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts are hot, and their places among the hot ones."""
        if not len(self.hot):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return self.hot[at] == h, at

    def route(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """64 bits whose leading ones name the part that holds a pair."""
        hot, at = self.is_hot(h)
        out = h.copy()
        out[hot] = mix(h[hot] + (w[hot] >> self.hot_shift[at[hot]]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return out

    def place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are held, and their places."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return self.words[at] == words, at

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are held, and their counts."""
        held, at = self.place(words)
        return held, np.where(held, self.counts[at], 0) if len(self.words) else at

    def pack(self, words: np.ndarray) -> bytes:
        """Words by their places, those that aren't held by their hashes."""
        held, at = self.place(words)
        places = at[held].astype("u2" if len(self.words) <= 1 << 16 else "u4")
        out = [pack(np.packbits(held)), pack_sorted(places), pack_sorted(words[~held])]
        return np.array([held.sum(), len(out[0]), len(out[1])], "<u4").tobytes() + b"".join(out)

    def unpack(self, data: bytes, n: int) -> np.ndarray:
        k, i, j = (int(v) for v in np.frombuffer(data[:12], "<u4"))
        held = np.unpackbits(unpack(data[12 : 12 + i], -(-n // 8), "u1"), count=n).astype(bool)
        out = np.zeros(n, np.uint64)
        out[held] = self.words[unpack_sorted(data[12 + i : 12 + i + j], k, "u2" if len(self.words) <= 1 << 16 else "u4")]
        out[~held] = unpack_sorted(data[12 + i + j :], n - k, "u8")
        return out

    def pack_runs(self, words: np.ndarray) -> bytes:
        """Sorted words that recur, as words and run lengths."""
        own, times = np.unique(words, return_counts=True)
        lead = self.pack(own)
        return np.array([len(own), len(lead)], "<u4").tobytes() + lead + pack(times.astype(np.uint32))

    def unpack_runs(self, data: bytes) -> np.ndarray:
        n, i = (int(v) for v in np.frombuffer(data[:8], "<u4"))
        return np.repeat(self.unpack(data[8 : 8 + i], n), unpack(data[8 + i :], n, "u4").astype(np.int64))

    def names(self, words: np.ndarray) -> np.ndarray:
        """The words as the bigram level knows them."""
        return np.where(self.find(words)[0], words, CLASS) if self.closed else words

    def low(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        p = (counts + 0.5) / 10**self.base
        return np.where(words == CLASS, self.rest, p) if self.closed else p


def pairs_of(names: np.ndarray, inverse: np.ndarray, starts: np.ndarray, end: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order, and each token's pair as two places in them; names: distinct words, starts: each text's first token."""
    every, place = np.unique(np.append(names, end), return_inverse=True)
    w = place[inverse].astype(np.uint64)
    h = np.r_[w[:1], w[:-1]]
    h[starts] = place[-1]
    return every, h << np.uint64(32) | w, w


def unfold(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words[(pairs >> np.uint64(32)).astype(np.int64)], words[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def split(keys: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """Runs of sorted keys by their leading bits."""
    if len(keys):
        top = keys >> keys.dtype.type(shift)
        first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        for i, j in zip(first, np.r_[first[1:], len(top)]):
            yield int(top[i]), slice(int(i), int(j))


def dealt(h: np.ndarray, w: np.ndarray, alphabet: Alphabet, bits: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of sorted pairs by part, and each part's run in it."""
    part = alphabet.route(h, w) >> np.uint64(64 - bits)
    order = np.argsort(part, kind="stable")
    return order, list(split(part[order], 0))


def merged(t: pa.Table, alphabet: Alphabet) -> pa.Table:
    """Adds up a part's rows of packed pairs and counts; hist: counts of counts."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for r in t.to_batches(max_chunksize=64):
        for x in r.to_pylist():
            for out, v in zip(parts, (alphabet.unpack_runs(x["a"]), alphabet.unpack(x["b"], x["n"]), unpack(x["c"], x["n"], "u4"))):
                out.append(v)
    h, w, c = (np.concatenate(parts.pop(0)) for _ in range(3))
    h, w, c = summed(h, w, c.astype(np.int64))
    hist = np.bincount(np.minimum(c, KEPT + 2), minlength=KEPT + 3)
    out = rows_of(key=[t.column("key")[0].as_py()], n=[len(h)], a=[alphabet.pack_runs(h)], b=[alphabet.pack(w)], c=[pack(c.astype(np.uint64))])
    return pa.Table.from_batches([out]).append_column("hist", pa.array([hist.astype(np.int64)], pa.list_(pa.int64())))


def token_arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: its distinct tokens, the place of each token among them, the number of tokens of each text."""
    toks = [tokens(t.as_py()) for t in b.column("text")]
    own, inverse = np.unique(np.concatenate(toks), return_inverse=True)
    return own, inverse.astype(np.int32), np.array([len(t) for t in toks])


def bigram_table(docs: DataFrame, alphabet: Alphabet, bits: int, rows: int) -> DataFrame:
    """key (the part), n, a (contexts), b (words), c (counts), hist (counts of counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            own, inverse, sizes = token_arrays(b)
            words, pairs, _ = pairs_of(alphabet.names(own), inverse, starts_of(sizes), alphabet.names(np.array([END]))[0])
            pairs, c = np.unique(pairs, return_counts=True)
            h, w = unfold(words, pairs)
            order, cut = dealt(h, w, alphabet, bits)
            h, w, c = h[order], w[order], c[order].astype(np.uint32)
            yield rows_of(key=[k for k, _ in cut], n=[s.stop - s.start for _, s in cut], a=[alphabet.pack_runs(h[s]) for _, s in cut], b=[alphabet.pack(w[s]) for _, s in cut], c=[pack(c[s]) for _, s in cut])

    return docs.select("text").mapInArrow(run, f"key long, {PAIRS}").groupBy("key").applyInArrow(lambda t: merged(t, alphabet), f"key long, {PAIRS}, hist array<long>")


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)


def rare_counts(bigrams: DataFrame, held: DataFrame, alphabet: Alphabet, words: int) -> DataFrame:
    """key, n, a, b: in several rows, the words of a part of bigrams that the alphabet lacks, and their counts; held: packed_counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                w = np.unique(alphabet.unpack(r["b"], r["n"]))
                w = w[~alphabet.place(w)[0] & ~(alphabet.closed & (w == CLASS))]
                cut = list(split(w, 64 - words))
                yield rows_of(key=[k for k, _ in cut], batch=[r["key"]] * len(cut), n=[s.stop - s.start for _, s in cut], a=[pack_sorted(w[s]) for _, s in cut])

    def look(l: pa.Table, r: pa.Table) -> pa.Table:
        w, c = unpacked_counts(r.to_pylist())
        out = [(x["batch"], x["n"], x["a"], pack(counted(w, c, unpack_sorted(x["a"], x["n"], "u8")).astype(np.uint64))) for x in l.to_pylist()]
        cols = list(zip(*out)) or [[]] * 4
        return pa.Table.from_batches([rows_of(key=cols[0], n=cols[1], a=cols[2], b=cols[3])])

    asked = bigrams.select("key", "n", "b").mapInArrow(ask, "key long, batch long, n int, a binary")
    return asked.groupBy("key").cogroup(held.groupBy("key")).applyInArrow(look, "key long, n int, a binary, b binary")


def unpacked_counts(tables: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return (unpack_sorted(tables[0]["a"], tables[0]["n"], "u8"), unpack(tables[0]["b"], tables[0]["n"], "u8")) if tables else (np.zeros(0, np.uint64),) * 2


def counted(w: np.ndarray, c: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of the asked words by a table of sorted words; 0 for others."""
    if not len(w):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(w, asked), len(w) - 1)
    return np.where(w[at] == asked, c[at].astype(np.int64), 0)


def discounts(n: np.ndarray) -> np.ndarray:
    """d_r for r = 0..KEPT + 1 from counts of counts (Katz's form of Good-Turing)."""
    d = np.ones(KEPT + 2)
    if n[1]:
        common = (KEPT + 1) * n[KEPT + 1] / n[1]
        for r in range(1, KEPT + 1):
            if n[r] and common < 1:
                v = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = v if 0 < v <= 1 else 1.0
    return d


class Sums:
    """By context: how often it occurs, what its seen pairs have after discounts, and what their words have at the base."""

    def __init__(self, contexts: np.ndarray, total: np.ndarray, seen: np.ndarray, low: np.ndarray):
        order = np.argsort(contexts)
        self.contexts, self.total, self.seen, self.low = contexts[order], total[order], seen[order], low[order]
        full = self.low > 1 - 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            self.scale = np.where(full, 1 / self.seen, np.where(self.seen > 1 - 1e-9, self.total / (self.total + 0.5) / self.seen, 1.0))
        rest = np.log10(np.maximum(1 - self.seen * self.scale, 1e-300)) - np.log10(np.maximum(1 - self.low, 1e-300))
        self.log_alpha = np.where(full, -300.0, rest)

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts are here, and where."""
        if not len(self.contexts):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
        return self.contexts[at] == h, at


def sums_of(h: np.ndarray, w: np.ndarray, counts: np.ndarray, own: np.ndarray, alphabet: Alphabet, d: np.ndarray, total: np.ndarray | None = None) -> Sums:
    """Of sorted pairs; own: the words' counts; total: the contexts' counts, where their other pairs lie elsewhere."""
    contexts, first = np.unique(h, return_index=True)
    per = lambda v: np.add.reduceat(v.astype(float), first) if len(first) else np.zeros(0)
    total = per(counts) if total is None else total
    return Sums(contexts, total, per(d[np.minimum(counts, KEPT + 1)] * counts) / np.maximum(total, 1e-300), per(alphabet.low(w, own.astype(float))))


def gains(c: np.ndarray, low: np.ndarray, total: np.ndarray, scale: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What seen pairs add to their words' base log probabilities."""
    return np.log10(d[np.minimum(c, KEPT + 1)] * c / total * scale) - np.log10(low)


def tables_of(t: pa.Table, rare: pa.Table, alphabet: Alphabet, d: np.ndarray, often: float) -> pa.Table:
    """TABLES: a part with the counts of its words that the alphabet lacks, the sums of its hot contexts' pairs, and its pairs of over `often` tokens."""
    out: list[dict] = []
    for r in t.to_pylist():
        h, w, c = alphabet.unpack_runs(r["a"]), alphabet.unpack(r["b"], r["n"]), unpack(r["c"], r["n"], "u8").astype(np.int64)
        own = alphabet.find(w)[1]
        if rare.num_rows:
            v, k = (np.concatenate(z) for z in zip(*((unpack_sorted(x["a"], x["n"], "u8"), unpack(x["b"], x["n"], "u8")) for x in rare.to_pylist())))
            order = np.argsort(v)
            own = own + counted(v[order], k[order], w)
        s = sums_of(h, w, c, own, alphabet, d)
        hot = np.flatnonzero(alphabet.is_hot(s.contexts)[0])
        # of a hot context the sums are parts of a whole: seen goes on as a mass, not as a share
        many = np.flatnonzero(c > often)
        at = s.place(h[many])[1]
        struct = lambda names, cols: [dict(zip(names, x)) for x in zip(*(v.tolist() for v in cols))]
        out.append({
            "key": r["key"], "n": r["n"], "a": r["a"], "b": r["b"], "c": r["c"], "own": pack(own[~alphabet.place(w)[0]].astype(np.uint64)),
            "hot": struct(("h", "total", "seen", "low"), (s.contexts[hot].view(np.int64), s.total[hot], (s.seen * s.total)[hot], s.low[hot])),
            "pairs": struct(("h", "w", "c", "own", "total", "seen", "low"), (h[many].view(np.int64), w[many].view(np.int64), c[many], own[many], s.total[at], (s.seen * s.total)[at], s.low[at])),
        })
    number = lambda *names: [pa.field(x, pa.int64() if x in ("h", "w", "c", "own") else pa.float64()) for x in names]
    fields = [("key", pa.int64()), ("n", pa.int32()), *((x, pa.binary()) for x in ("a", "b", "c", "own")), ("hot", pa.list_(pa.struct(number("h", "total", "seen", "low")))), ("pairs", pa.list_(pa.struct(number("h", "w", "c", "own", "total", "seen", "low"))))]
    return pa.Table.from_pylist(out, pa.schema(fields))


class Sent:
    """Gains of the few pairs that are sent along."""

    def __init__(self, h: np.ndarray, w: np.ndarray, gain: np.ndarray):
        key = mix(h) + w
        order = np.argsort(key)
        self.key, self.h, self.w, self.gain = key[order], h[order], w[order], gain[order]

    def find(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.key, mix(h) + w), len(self.key) - 1)
        met = (self.h[at] == h) & (self.w[at] == w)
        return met, np.where(met, self.gain[at], 0.0)


class Part:
    """What one part's pairs add to the words' base log probabilities; hot: sums of the contexts that lie in many parts."""

    def __init__(self, h: np.ndarray, w: np.ndarray, counts: np.ndarray, own: np.ndarray, alphabet: Alphabet, d: np.ndarray, hot: Sums):
        self.hot, self.sums = hot, sums_of(h, w, counts, own, alphabet, d)
        at = self.sums.place(h)[1]
        is_hot, place = hot.place(h)
        pick = lambda name: np.where(is_hot, getattr(hot, name)[place], getattr(self.sums, name)[at]) if len(hot.contexts) else getattr(self.sums, name)[at]
        self.gain = gains(counts, alphabet.low(w, own.astype(float)), pick("total"), pick("scale"), d)
        self.words, j = np.unique(w, return_inverse=True)
        self.pairs = at.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64)

    def score(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        is_hot, place = self.hot.place(h)
        out = np.where(is_hot, self.hot.log_alpha[place], 0.0) if len(self.hot.contexts) else np.zeros(len(h))
        if not len(self.pairs):
            return out
        met, i = self.sums.place(h)
        out = np.where(met & ~is_hot, self.sums.log_alpha[i], out)
        j = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        pairs = i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(met & (self.words[j] == w) & (self.pairs[at] == pairs), self.gain[at], out)


def requests(docs: DataFrame, alphabet: Alphabet, sent: Sent, bits: int, words: int, rows: int) -> DataFrame:
    """Rows of three kinds: 0 a batch's texts, 1 its pairs for one part, 2 its less common words for one part of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            own, inverse, sizes = token_arrays(b)
            n = len(sizes)
            doc = np.repeat(np.arange(n, dtype=np.uint16), sizes)
            batch = int(np.random.default_rng().integers(0, 1 << 62))
            held, count = alphabet.find(own)
            known = np.bincount(doc, weights=held[inverse], minlength=n)
            base = np.bincount(doc, weights=np.where(held, np.log10(count + 0.5), 0.0)[inverse], minlength=n)
            null = np.array([x is None or x != x for x in ids], np.uint8)
            every, pairs, _ = pairs_of(alphabet.names(own), inverse, starts_of(sizes), alphabet.names(np.array([END]))[0])
            order = np.argsort(pairs, kind="stable")
            of = doc[order]
            pairs, first, times = np.unique(pairs[order], return_index=True, return_counts=True)
            h, w = unfold(every, pairs)
            met, gain = sent.find(h, w)
            gained = np.bincount(of, weights=np.repeat(gain, times), minlength=n)
            out = [(0, batch, n, np.where(null, 0, ids).astype("<i8").tobytes() + null.tobytes(), sizes.astype("<i8").tobytes(), base.tobytes() + known.tobytes() + gained.tobytes(), None)]
            of, h, w, times = of[np.repeat(~met, times)], h[~met], w[~met], times[~met]
            out += [(1, *x) for x in asked(h, w, times, of, *dealt(h, w, alphabet, bits), alphabet)]
            rare = np.flatnonzero(~held[inverse])
            rare = rare[np.argsort(inverse[rare], kind="stable")]
            of = doc[rare]
            at, first, times = np.unique(inverse[rare], return_index=True, return_counts=True)
            to = np.r_[first, len(of)]
            out += [(2, k, s.stop - s.start, pack_sorted(own[at][s]), None, pack(times[s].astype(np.uint32)), pack(of[to[s.start] : to[s.stop]])) for k, s in split(own[at], 64 - words)]
            cols = list(zip(*out))
            yield rows_of(kind=cols[0], key=cols[1], batch=[batch] * len(out), n=cols[2], a=cols[3], b=cols[4], c=cols[5], d=cols[6])

    return docs.mapInArrow(run, ROWS)


def asked(h: np.ndarray, w: np.ndarray, times: np.ndarray, of: np.ndarray, order: np.ndarray, cut: list[tuple[int, slice]], alphabet: Alphabet) -> Iterator[tuple]:
    """key, n, contexts, words, times and texts of a batch's pairs for each part; of: the texts that hold a pair, pair by pair."""
    begin = np.r_[0, np.cumsum(times)]
    for k, s in cut:
        at = order[s]
        each = times[at]
        texts_ = of[np.repeat(begin[at] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())]
        yield k, len(at), alphabet.pack_runs(h[at]), alphabet.pack(w[at]), pack(each.astype(np.uint32)), pack(texts_)


def answers(asked: pa.Table, held: pa.Table, alphabet: Alphabet, d: np.ndarray, hot: Sums) -> Iterator[pa.RecordBatch]:
    """Sums per text: of kind 1 what the bigrams add; of kind 2 log counts, and how many words are known."""
    if not asked.num_rows:
        return
    kind, tables = asked.column("kind")[0].as_py(), held.to_pylist()
    if kind == 1:
        h, w, counts, own = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in tables:
            h, w, counts = alphabet.unpack_runs(t["a"]), alphabet.unpack(t["b"], t["n"]), unpack(t["c"], t["n"], "u8").astype(np.int64)
            held_, own = alphabet.find(w)
            own[~held_] = unpack(t["own"], int((~held_).sum()), "u8")
        part = Part(h, w, counts, own, alphabet, d, hot)
    elif kind == 2:
        w, c = unpacked_counts(tables)
    for some in asked.to_batches(max_chunksize=64):
        for r in some.to_pylist():
            if kind == 0:
                yield rows_of(batch=[r["batch"]], kind=[0], n=[r["n"]], a=[r["a"]], b=[r["b"]], c=[r["c"]])
                continue
            times = unpack(r["c"], r["n"], "u4").astype(np.int64)
            doc = unpack(r["d"], int(times.sum()), "u2")
            if kind == 1:
                value, known = part.score(alphabet.unpack_runs(r["a"]), alphabet.unpack(r["b"], r["n"])), None
            else:
                count = counted(w, c, unpack_sorted(r["a"], r["n"], "u8"))
                value, known = np.log10(count + 0.5), np.repeat(count > 0, times)
            present = np.unique(doc)
            total = np.bincount(doc, weights=np.repeat(value, times))[present]
            extra = None if known is None else pack(np.bincount(doc, weights=known)[present].astype(np.uint32))
            yield rows_of(batch=[r["batch"]], kind=[kind], n=[len(present)], a=[present.astype("<u2").tobytes()], b=[total.astype("<f8").tobytes()], c=[extra])


def packed_counts(counts: DataFrame, words: int) -> DataFrame:
    """The counts table by leading bits of the word's hash: key, n, a (words), b (counts)."""

    def run(t: pa.Table) -> pa.Table:
        w, c = t.column("w").to_numpy().view(np.uint64), t.column("c").to_numpy()
        order = np.argsort(w)
        return pa.Table.from_batches([rows_of(key=[int(w[0] >> np.uint64(64 - words))], n=[len(w)], a=[pack_sorted(w[order])], b=[pack(c[order].astype(np.uint64))])])

    return counts.withColumn("key", F.shiftrightunsigned("w", 64 - words)).groupBy("key").applyInArrow(run, "key long, n int, a binary, b binary")


def finish(t: pa.Table) -> pa.Table:
    """The texts of a batch with all that came back for them; base_score lacks the tokens' common denominator."""
    rows = t.to_pylist()
    head = next(r for r in rows if r["kind"] == 0)
    n = head["n"]
    ids, null = np.frombuffer(head["a"][: 8 * n], "<i8"), np.frombuffer(head["a"][8 * n :], np.uint8).astype(bool)
    sizes = np.frombuffer(head["b"], "<i8")
    base, known, score = np.frombuffer(head["c"], "<f8").reshape(3, n).copy()
    for r in rows:
        if r["kind"]:
            at, v = np.frombuffer(r["a"], "<u2"), np.frombuffer(r["b"], "<f8")
            if r["kind"] == 1:
                score[at] += v
            else:
                base[at] += v
                known[at] += unpack(r["c"], r["n"], "u4")
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known.round().astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score)})


def sums_collected(rows: DataFrame) -> Sums:
    """Sums over parts, of a bounded number of contexts, at the driver."""
    got = rows.groupBy("h").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"), F.sum("low").alias("low")).toPandas()
    total = got["total"].to_numpy(float)
    return Sums(got["h"].to_numpy(np.int64).view(np.uint64), total, got["seen"].to_numpy(float) / np.maximum(total, 1e-300), got["low"].to_numpy(float))


def score(docs: DataFrame, vocabulary: int | None = None, words_each: int = 100_000, tokens_each: int = 2_000_000, common: int = 262_143, rows: int = 2048) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows: texts in a batch."""
    docs = texts(docs)
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out")
    training = docs.where(~fold)
    counts = materialize(word_counts(training), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    most = common if vocabulary is None else vocabulary
    # the words above the smallest count that leaves at most `most` of them: so many rows of 16 bytes reach the driver
    tally = counts.groupBy("c").agg(F.count("*").alias("k")).withColumn("above", F.sum("k").over(Window.orderBy(F.desc("c"))))
    least = tally.where(F.col("above") <= most).agg(F.min("c")).first()[0]
    top = counts.where(F.col("c") >= (least if least is not None else (1 << 62))).toPandas()
    alphabet = Alphabet(top["w"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), total, distinct, vocabulary is not None, max(1, tokens_each // 2))
    bits = max(4, int(np.ceil(np.log2(max(1, total) / tokens_each))))
    bigrams = materialize(bigram_table(training, alphabet, bits, rows), "bigrams")
    n = np.zeros(KEPT + 3)
    for r in bigrams.select(F.posexplode("hist").alias("r", "v")).groupBy("r").agg(F.sum("v").alias("v")).collect():
        n[r.r] = r.v
    d = discounts(n)
    words = max(4, int(np.ceil(np.log2(max(1, distinct) / words_each)))) if distinct else 4
    packed = materialize(packed_counts(counts, words), "packed")
    rare = rare_counts(bigrams, packed, alphabet, words)
    often = total / PAIRS_SENT
    tables = bigrams.drop("hist").groupBy("key").cogroup(rare.groupBy("key")).applyInArrow(lambda l, r: tables_of(l, r, alphabet, d, often), TABLES)
    tables = materialize(tables, "tables")
    discard(bigrams)
    hot = sums_collected(tables.select(F.explode("hot").alias("x")).select("x.*"))
    pairs = tables.select(F.explode("pairs").alias("x")).select("x.*").toPandas()
    h, w, c, own = (pairs[k].to_numpy(np.int64) for k in ("h", "w", "c", "own"))
    h, w = h.view(np.uint64), w.view(np.uint64)
    mine = Sums(h, *(pairs[k].to_numpy(float) / (pairs["total"].to_numpy(float) if k == "seen" else 1.0) for k in ("total", "seen", "low")))
    at, (is_hot, place) = np.searchsorted(mine.contexts, h), hot.place(h)
    pick = lambda name: np.where(is_hot, getattr(hot, name)[place], getattr(mine, name)[at]) if len(hot.contexts) else getattr(mine, name)[at]
    sent = Sent(h, w, gains(c, alphabet.low(w, own.astype(float)), pick("total"), pick("scale"), d))
    none = F.lit(None).cast("binary").alias("own")
    held = tables.select(F.lit(1).alias("kind"), "key", "n", "a", "b", "c", "own").unionByName(packed.select(F.lit(2).alias("kind"), "key", "n", "a", "b", none.alias("c"), none))
    # written once: batches get random names, and what a lost executor had sent must not be made anew under others
    asking = materialize(requests(docs, alphabet, sent, bits, words, rows), "requests")

    def answer(l: pa.Table, r: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(answers(l, r, alphabet, d, hot)) or [rows_of(batch=[], kind=[], n=[], a=[], b=[], c=[])])

    sums = asking.groupBy("kind", "key").cogroup(held.groupBy("kind", "key")).applyInArrow(answer, SUMS)
    out = sums.groupBy("batch").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = out.withColumn("base_score", F.col("base_score") - F.col("n_tokens") * F.lit(float(alphabet.base))).withColumn("score", F.col("score") + F.col("base_score"))
    return out.select("doc_id", fold, "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
