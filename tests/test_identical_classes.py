"""Members that are the same again, against plain passes over all members; later passes follow what merged."""

from __future__ import annotations

import random

import pytest

from tracewell.operators import fold

MEMBERS = "key string, place long, keep boolean, host string, path string, name string, cmd string, user string, sha256 string, parent string"


def brute(members, via, passes=5):
    rep = {m[0]: m[0] for m in members}
    for _ in range(passes):
        said = {}
        for key, kind, other in via:
            said.setdefault(key, set()).add((kind, rep.get(other, other)))
        classes = {}
        for m in members:
            same = m[0] if m[2] else (m[3], m[5], m[7], m[8], rep.get(m[9], m[9] or ""), frozenset(said.get(m[0], ())))
            classes.setdefault(same, []).append(m)
        new = {m[0]: min(c, key=lambda x: (x[1], x[0]))[0] for c in classes.values() for m in c}
        if new == rep:
            break
        rep = new
    return rep


def drawn(n, seed):
    """Parents stand anywhere before or among no members at all; places repeat; a few represent themselves."""
    rng = random.Random(seed)
    rows = [(f"m{i}", rng.randrange(n), rng.random() < 0.05, rng.choice("hi"), None, rng.choice("ab"), None, rng.choice(["u", None]), None, rng.choice([None, "", "x", "y", *[f"m{rng.randrange(i)}" for _ in range(8) if i]])) for i in range(n)]
    via = [(r[0], "spawned", r[9]) for r in rows if r[9]] + [(f"m{rng.randrange(n)}", rng.choice(["wrote", "read"]), rng.choice([f"m{rng.randrange(n // 20)}", "k1", "k2"])) for _ in range(n // 8)]
    return rows, via


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("passes", [2, 5])
def test_classes_are_those_of_plain_passes(spark, seed, passes):
    rows, via = drawn(240, seed)
    got = fold.identical_members(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame(via, "key string, type string, other string"), passes)
    expected = brute(rows, via, passes)
    assert {r["key"]: r["rep"] for r in got.collect()} == expected
    assert len({*expected.values()}) < len(rows)


def test_later_passes_follow_what_merged(spark, monkeypatch):
    rows = [(f"m{u}-{i}", 100 * i + u, False, "h", None, "a", None, None, None, f"m{u}-{i - 1}" if i else None) for u in range(4) for i in range(50)]
    sizes, plain = [], fold.stored

    def counted(df):
        df = plain(df)
        sizes.append(df.count())
        return df

    monkeypatch.setattr(fold, "stored", counted)
    got = fold.identical_members(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame([(r[0], "spawned", r[9]) for r in rows if r[9]], "key string, type string, other string"), 3)
    assert {r["key"]: r["rep"] for r in got.collect()} == brute(rows, [(r[0], "spawned", r[9]) for r in rows if r[9]], 3)
    assert sum(n >= len(rows) for n in sizes) <= 1 and sum(sizes) < 1.5 * len(rows)
