import hashlib

import numpy as np
import pytest

from weftline.llm import bpe_codec, token_counts

TEXTS = [None, "", " ", "a  b   c ", "▁x ▁▁y", "<s> hi </s>", "日本語 \x00 é​", "a\n\n  b\t c\r\n", "x" * 3000, "😀😀 ab don't", "tail   ", "word " * 20000, "dup", "dup"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no key", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_codec_matches_the_library_and_round_trips(docs):
    enc = bpe_codec.codec("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in bpe_codec.digests(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert all(r.same for r in bpe_codec.decoded_matches(bpe_codec.digests(docs), docs).collect())


def test_safe_chunks_change_nothing():
    t = "It's a test,  of\n\n cuts. " * 300
    assert bpe_codec.encode(t, chunk=7) == bpe_codec.codec("byte_bpe_50k.tiktoken").encode_ordinary(t)
    assert "".join(bpe_codec.safe_chunks(t, 7)) == t and len(bpe_codec.safe_chunks(t, 7)) > 100


def test_counts_match_the_library(docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(sp.encode(t or "")), len((t or "").encode()))
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.digests(none).count() == 0 and token_counts.token_counts(none).count() == 0
