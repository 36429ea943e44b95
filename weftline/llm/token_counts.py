"""Token counts by byte-pair merging over a heap and a doubly linked list, without making identifiers.

A text is a chain of symbols (characters; a space is the piece mark, one is put in front). The adjacent pair whose joined
piece has the lowest rank (highest score; ties: leftmost) is popped from a heap and merged until none is left. The count
is the initial symbols minus the merges, plus, where the model falls back to bytes, the further bytes of each character
that is no piece. No piece spans a non-mark followed by a mark, nor any character that only occurs alone, so runs
between such positions merge on their own; counts of short runs are kept in a bounded cache per worker.

Nulls and empty texts have 0 tokens; repeated rows give repeated results; an empty table gives none; further columns are
ignored; texts are never truncated.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts, texts

MARK = "▁"


class Merger:
    """Counts the tokens of a text under one sentencepiece BPE model."""

    def __init__(self, path: str, cache_rows: int = 1_000_000, cache_chars: int = 32):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece holds a mark after another character; runs can't be cut there")
        if sp.encode("a  b ") != sp.encode("a  b ", add_bos=False, add_eos=False) or sp.encode_as_pieces("a")[0][0] != MARK:
            raise ValueError("models without the front mark aren't supported")
        #: line breaks and tabs of no longer piece stand alone
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        self.runs = re.compile(f"[{alone}]| *[^ {alone}]+| +").findall if alone else re.compile(" *[^ ]+| +").findall
        self.cache: dict[str, int] = {}
        self.cache_rows, self.cache_chars = cache_rows, cache_chars

    def run(self, s: str) -> int:
        """Tokens of one run, by heap and linked list."""
        n = len(s)
        rank = self.rank
        sym = list(s)
        if n == 1:
            return 1 if s in rank else len(s.encode())
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i] + sym[i + 1]) for i in range(n - 1) if (r := rank.get(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = sym[i]
            if not left or (j := nxt[i]) >= n or len(left) + len(sym[j]) != len(piece) or left + sym[j] != piece:
                continue
            sym[i], sym[j] = piece, ""
            merges += 1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank.get(joined := piece + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, joined))
            if (h := prv[i]) >= 0 and (r := rank.get(joined := sym[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, joined))
        return n - merges + sum(len(x.encode()) - 1 for x in sym if len(x) == 1 and x not in rank)

    def count(self, text: str) -> int:
        if not text:
            return 0
        cache, longest, total = self.cache, self.cache_chars, 0
        for s in self.runs((" " + text).replace(MARK, " ")):
            n = cache.get(s)
            if n is None:
                n = self.run(s.replace(" ", MARK))
                if len(s) <= longest:
                    if len(cache) >= self.cache_rows:
                        cache.clear()
                    cache[s] = n
            total += n
        return total


@lru_cache(maxsize=2)
def merger(model: str) -> Merger:
    import public_tokenizers

    return Merger(model if "/" in model else public_tokenizers.path(model))


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row."""

    def run(ts: list[str]) -> dict[str, list]:
        count = merger(model).count
        return {"n_bytes": [len(t.encode()) for t in ts], "n_tokens": [count(t) for t in ts]}

    return map_texts(texts(docs), run, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
