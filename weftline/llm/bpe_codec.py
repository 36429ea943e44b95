"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts of over `chunk` characters are split before encoding at safe boundaries: positions after a printable ASCII
character and before a space or line feed. No match of the pre-splitting pattern can cross such a position and no
look-ahead before it sees past it, so the pieces' ids put together are the whole text's ids. Decoding joins raw bytes, so
it needs no valid UTF-8 at token borders.

Nulls count as empty texts (0 tokens, hash of nothing); repeated rows give repeated results; an empty table gives none;
further columns are ignored. A text without a safe boundary is encoded as one piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts, texts

SAFE = re.compile(r"[!-~](?=[ \n])")


@lru_cache(maxsize=4)
def codec(ranks: str, pattern: str | None = None):
    """The library's encoding for a rank file: a path, or the name of one of the installed vocabularies."""
    import public_tokenizers
    import tiktoken

    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def safe_chunks(text: str, chunk: int) -> list[str]:
    """Pieces of at least `chunk` characters, cut only at safe boundaries."""
    out, start = [], 0
    while len(text) - start > chunk and (m := SAFE.search(text, start + chunk - 1)):
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


def encode(text: str, ranks: str = "byte_bpe_50k.tiktoken", chunk: int = 1 << 15) -> list[int]:
    enc = codec(ranks)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    return [i for part in safe_chunks(text, chunk) for i in enc.encode_ordinary(part)]


def decode(ids: list[int], ranks: str = "byte_bpe_50k.tiktoken") -> bytes:
    return codec(ranks).decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", chunk: int = 1 << 15) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of each row."""

    def run(ts: list[str]) -> dict[str, list]:
        ids = [encode(t, ranks, chunk) for t in ts]
        return {"ids": ids, "decoded": [decode(x, ranks) for x in ids]}

    return map_texts(texts(docs), run, "ids array<int>, decoded binary", 256)


def tokenized(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", chunk: int = 1 << 15, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256, round_trip (the text's bytes come back), columns in keep of each row."""

    def run(ts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": [], "round_trip": []}
        for t in ts:
            ids = np.array(encode(t, ranks, chunk), dtype="<u4")
            back = decode(ids.tolist(), ranks)
            for k, v in (("n_tokens", len(ids)), ("ids", ids.astype(np.int32)), ("ids_sha256", hashlib.sha256(ids.tobytes()).hexdigest()), ("decoded_sha256", hashlib.sha256(back).hexdigest()), ("round_trip", back == t.encode("utf-8", "surrogatepass"))):
                out[k].append(v)
        return out

    return map_texts(texts(docs, keep=keep), run, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean", 256)


def digests(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", chunk: int = 1 << 15) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian uint32 ids), decoded_sha256 (bytes after the round trip)."""

    def run(ts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in ts:
            ids = encode(t, ranks, chunk)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode(ids, ranks)).hexdigest())
        return out

    return map_texts(texts(docs), run, "n_tokens long, ids_sha256 string, decoded_sha256 string", 256)


def decoded_matches(codes: DataFrame, docs: DataFrame) -> DataFrame:
    """Round-trip check: doc_id and whether the decoded bytes hash to the text's own bytes."""
    own = texts(docs).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("own"))
    return codes.join(own, "doc_id").select("doc_id", (F.col("decoded_sha256") == F.col("own")).alias("same"))
