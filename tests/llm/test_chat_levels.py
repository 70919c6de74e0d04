"""Levels of calls against longest paths found one by one, and the number of rounds that long chains take."""

from __future__ import annotations

import random

import pytest

from tracewell.llm import chat

SCHEMA = "conv_id long, call_id string, needs array<string>"


def _brute(rows):
    """Level of each call by walking its needs; None where a need is missing or leads round in a circle."""
    needs = {}
    for conv, call, wanted in rows:
        needs.setdefault((conv, call), set()).update((conv, n) for n in wanted or () if n is not None)
    out, walking = {}, set()

    def level(c):
        if c not in needs or c in walking:
            return None
        if c not in out:
            walking.add(c)
            below = [level(n) for n in sorted(needs[c])]
            walking.discard(c)
            if None in below and c in walking:
                return None
            out[c] = None if None in below else max((b + 1 for b in below), default=0)
        return out[c]

    def reaches_circle(c, seen=()):
        return c in seen or any(reaches_circle(n, (*seen, c)) for n in needs.get(c, ()))

    return {c: v for c in needs if not reaches_circle(c) and (v := level(c)) is not None}


@pytest.mark.parametrize("seed", range(4))
def test_levels_are_longest_paths(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(6):
        n = rng.randint(1, 14)
        for i in range(n):
            later = rng.random() < 0.08
            wanted = [str(rng.randrange(n) if later else rng.randrange(i)) for _ in range(rng.choice([0, 1, 1, 2, 3])) if i or later]
            rows.append((conv, str(i), wanted + ["gone"] if rng.random() < 0.04 else wanted))
    rows += [(9, "a", ["b"]), (9, "b", ["c"]), (9, "c", ["a"]), (9, "d", ["a"]), (9, "e", ["e"]), (9, "f", None), (9, "g", [None, "f"]), (9, "g", ["f"])]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat._levels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute(rows)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    merged = chat._merged
    monkeypatch.setattr(chat, "_merged", lambda *a: rounds.append(1) or merged(*a))
    rows = [(1, str(i), [str(i - 1)] if i else []) for i in range(1000)]
    got = {int(r["call_id"]): r["level"] for r in chat._levels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i for i in range(1000)} and len(rounds) <= 12


def test_exchanges_need_the_result_before(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (1, 5, "user", "e"), (1, 7, "user", "no result before"), (2, 2, "assistant", "no call"), (2, 3, "user", "f"), (3, None, "user", "g"), (None, 1, "user", None), (1, 3, "user", "c")]
    tools = {"reply": {"properties": {"text": {"type": "string"}}, "required": ["text"]}}
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.linked(chat.exchanges_as_calls(messages), tools, chat.exchange_needs(messages)).collect()
    step = {(r["conv_id"], r["turn"]): r["step"] for r in out}
    assert [step[1, t] for t in (0, 1, 2, 3, 4, 5, 7)] == [None, 0, 1, 2, 3, 4, 0] and step[2, 2] is None and step[2, 3] == 0 and len(out) == len(rows)
    text = "long " * 400_000
    one = chat.linked(chat.exchanges_as_calls(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")), tools).first()
    assert text in one["json"] and one["error"] is None
