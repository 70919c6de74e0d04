"""Word hashes made without words, and comparisons that equal hashes of different windows don't mislead."""

from __future__ import annotations

import random

import numpy as np

from tracewell.llm import _common, substring_dedup
from tracewell.llm._common import hashed_words


def test_hashed_words_are_the_words_between_white_space(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ab \t\n\x0b\x0c\r\xc3\xa9\x1c\x85", k=rng.randrange(60))) for _ in range(300)] + [b"", b" ", b"x" * 5000 + b" y"]
    whole = None
    for part in (2_000_000, 50):
        monkeypatch.setattr(_common, "CHUNK_BYTES", part)
        counts, h, first, end = hashed_words(texts)
        words = [t.split() for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        flat, at, seen = [w for ws in words for w in ws], 0, {}
        for t, ws in zip(texts, words, strict=True):
            for w in ws:
                assert t[first[at] : end[at]] == w and seen.setdefault(int(h[at]), w) == w
                at += 1
        assert len(set(seen.values())) == len(set(flat)) == len(seen)
        assert whole is None or (whole == h).all()
        whole = h
    assert hashed_words([])[0].tolist() == [] and len(hashed_words([b""])[1]) == 0


def test_windows_of_equal_hash_and_other_check_differ():
    v, c = np.array([7, 5, 7, 7, 5, 7], dtype=np.uint64), np.array([1, 1, 2, 1, 1, 2], dtype=np.uint32)
    order, new = substring_dedup._groups(v, c)
    first = np.empty(6, dtype=bool)
    first[order] = new
    assert first.tolist() == [True, True, True, False, False, False]


def test_passages_whose_hashes_collide_are_kept(spark, monkeypatch):
    # all windows of a text get the hash of its first word: only the checks tell them apart
    real = substring_dedup.rolling
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "ab"] + [" ".join(f"a{i}" for i in range(30))]
    table = substring_dedup.pa.table({"__id": [0, 1, 2], "__text": [t.encode() for t in texts]})
    made = list(substring_dedup._documents(table))
    (_, _, starts, h, _, _), = made
    monkeypatch.setattr(substring_dedup, "rolling", lambda x, width: np.full(max(0, len(x) - width + 1), 9, dtype=np.uint64) if x is h else real(x, width))
    take, v, c = substring_dedup._around(np.array([9], dtype=np.uint64), starts, h, 10, 20, np.uint64(0))
    assert len(take) == 33 and set(v.tolist()) == {9}
    order, new = substring_dedup._groups(v, c)
    first = np.empty(33, dtype=bool)
    first[order] = new
    assert first[:22].all() and not first[22:].any()
