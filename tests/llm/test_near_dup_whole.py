"""Near-duplicates: every link of texts that share a bucket is found, and buckets hold links of all kinds of edits."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from tracewell.llm import near_dup

DOC = "doc_id long, text string"


def brute_force(texts):
    """The least number of each text's class, by comparing all pairs."""
    words = [t.lower().split() for t in texts]
    head = list(range(len(texts)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = words[i], words[j]
        if near_dup.banded_distance(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is not None:
            x, y = sorted((root(i), root(j)))
            head[y] = x
    return [root(i) for i in range(len(texts))]


def test_members_of_different_classes_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 7)
    rng = random.Random(2)
    rows = [(b, b * 1000 + i, rng.choice([b * 1000, b * 1000, b * 1000 + i]), 9) for b, size in enumerate([3, 7, 40, 90]) for i in range(size)] + [(9, 9000 + i, 9000, 9) for i in range(30)] + [(10, 10000 + i, 10000 + i, 9) for i in range(30)]
    met, tiles = set(), defaultdict(list)
    for r in near_dup._tiles(spark.createDataFrame(rows, "bucket long, node long, comp long, n_words long")).collect():
        tiles[r["tile"]].append((r["node"], r["comp"]))
    for members in tiles.values():
        assert len({n for n, _ in members}) == len(members)
        met |= {tuple(sorted((a, b))) for (a, ca), (b, cb) in combinations(members, 2) if ca != cb}
    assert met == {tuple(sorted((a, b))) for (x, a, ca, _), (y, b, cb, _) in combinations(rows, 2) if x == y and ca != cb}
    assert max(map(len, tiles.values())) < 50


def near_dup_roots(n, pairs):
    head = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            head[i] = head[j] = min(head[i], head[j])
    return head


def test_bound_rules_out_no_link():
    rng = random.Random(8)
    texts = [[rng.randrange(12) for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    texts += [[rng.randrange(12) if rng.random() < 0.15 else w for w in t] for t in texts]
    n = np.array([len(t) for t in texts])
    h = near_dup.hashed_words([" ".join(map(str, t)).encode() for t in texts])[1]
    made = list(near_dup._possible(np.arange(len(texts)), n, near_dup._bags(h, n), 0.8))
    found = {(i, j) for i, js, _ in made for j in js.tolist()}
    links = {(i, j) for i, j in combinations(range(len(texts)), 2) if near_dup.banded_distance(texts[i], texts[j], int(0.2 * max(n[i], n[j]) + 1e-9)) is not None}
    assert links and links <= found and len(found) < 80 * 79 // 2
    bags = [Counter(t) for t in texts]
    assert {(i, int(j)): int(b) for i, js, bounds in made for j, b in zip(js, bounds, strict=True)} == {(i, j): max((bags[i] - bags[j]).total(), (bags[j] - bags[i]).total()) for i, j in found}
    forest = near_dup._forest(iter(made), np.arange(len(texts)))
    joined = lambda pairs: near_dup_roots(len(texts), pairs)
    assert len(forest) < len(texts) and set(forest) <= found and joined(forest) == joined(found)


def test_classes_are_brute_force_for_all_kinds_of_edits(spark):
    rng = random.Random(4)
    new = lambda: f"x{rng.randrange(10**9)}"
    texts = []
    for n in (5, 8, 15, 30, 60, 120):
        for kind in range(6):
            t = [f"w{rng.randrange(5000)}" for _ in range(n)]
            d, u = n // 5, list(t)
            if kind == 0:
                u = u[d:]
            elif kind == 1:
                u = u[: n // 2 - d // 2] + u[n // 2 - d // 2 + d :]
            elif kind == 2:
                u[n // 2] = new()
            elif kind == 3:
                for _ in range(n // 4):
                    u.insert(rng.randrange(len(u) + 1), new())
            else:
                for i in rng.sample(range(n), d):
                    u[i] = new()
            texts += [" ".join(t), " ".join(u)]
    # variants that are mostly linked through few others
    base = [f"b{i}" for i in range(60)]
    for _ in range(150):
        v = list(base)
        for i in rng.sample(range(60), 7):
            v[i] = new()
        texts.append(" ".join(v))
    expected = brute_force(texts)
    out = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert [out[i] for i in range(len(texts))] == expected
    assert sum(expected[2 * i] == expected[2 * i + 1] for i in range(36)) == 36 and set(expected[72:]) == {72}
