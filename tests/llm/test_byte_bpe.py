"""Byte-level BPE against the tiktoken library and exact round trips."""

from __future__ import annotations

import random
import sys

import numpy as np
import pytest
import regex
import tiktoken

import public_tokenizers
from tracewell.llm import byte_bpe
from tracewell.llm.queries import RANKS, op12_byte_bpe

WORD = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(RANKS))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def held(spark, ranks, encoding, texts, ids=None, **options):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], "doc_id long, text string, ids string, block int").repartition(3)
    out = byte_bpe.decode(byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, **options), ranks).collect()
    told = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in out)
    want = [encoding.encode_ordinary(t or "") for t in texts]
    assert told == sorted((i is None, i, len(w), w, (t or "").encode()) for i, t, w in zip(range(len(texts)) if ids is None else ids, texts, want, strict=True))


def random_text(rng, n):
    pieces = ["'s", "'re", "'", " ", "  ", "\n", "\t ", "word", "Straße", "12", "٣", "日本語", "é", " ", " ", "!?", "<|endoftext|>", "😀", "\x00", "\x1c", "ab'll", "​", "٠x", "a" * 60]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_encoding_is_tiktoken(spark, ranks, encoding):
    rng = random.Random(4)
    texts = [random_text(rng, rng.randrange(1, 200)) for _ in range(60)] + [None, "", " ", "\n\n ", "same text", "same text", "x" * 50_000, "long " * 40_000, " " * 9000 + "y"]
    held(spark, ranks, encoding, texts)


def test_small_blocks_null_and_repeated_ids(spark, ranks, encoding):
    rng = random.Random(5)
    texts = [random_text(rng, 50) for _ in range(20)] + [None, "", ""]
    held(spark, ranks, encoding, texts, block_bytes=200)
    held(spark, ranks, encoding, ["a b", "a b", None, "c"], [1, 1, 2, 2])
    held(spark, ranks, encoding, ["a b"], [None])


def test_empty_table(spark, ranks, encoding):
    held(spark, ranks, encoding, [])


def test_windows_cut_like_the_whole_text():
    rng = random.Random(6)
    for window in (1, 2, 3, 7, 50):
        for _ in range(60):
            text = random_text(rng, 30)
            assert [w for part in byte_bpe.pre_tokens(WORD, text, window) for w in part] == WORD.findall(text)


def test_every_character_is_cut_as_tiktoken_does(encoding):
    """Between letters, digits and spaces the class of a character decides the cuts; all are tried."""
    whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=encoding._mergeable_ranks, special_tokens={})
    wrong = []
    for c in map(chr, range(sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) < 0xE000:
            text = f"a{c}a 1{c}1 !{c}! {c} "
            if encoding.encode_ordinary(text) != [t for part in byte_bpe.pre_tokens(WORD, text) for w in part for t in whole.encode_ordinary(w)]:
                wrong.append(ord(c))
    assert wrong == []


def test_decode_null_and_unknown(spark, ranks):
    df = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(np.array([0, 5], "<u4").tobytes()))], "doc_id long, ids binary")
    by_rank = {v: k for k, v in ranks.items()}
    assert {r["doc_id"]: r["decoded"] and bytes(r["decoded"]) for r in byte_bpe.decode(df, ranks).collect()} == {1: None, 2: bytearray(), 3: by_rank[0] + by_rank[5]}
    with pytest.raises(Exception, match="no token has the id"):
        byte_bpe.decode(spark.createDataFrame([(bytearray(np.array([999_999], "<u4").tobytes()),)], "ids binary"), {b"a": 0, b"b": 999_999 + 1}).collect()


def test_query_over_the_table(spark, encoding):
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op12_byte_bpe(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        text = docs[r["doc_id"]] or ""
        ids = encoding.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
