"""The six link queries cover every event, not one day: brute force over a small table of 30 days."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tracewell.plans.driver_queries import QUERIES

KINDS = ("click", "error", "purchase", "signup", "view")
ZERO = datetime(2024, 1, 1)
SKEW = 2_000_000


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for n in range(150):
        t = 30 * 86_400_000_000 * n // 150 + rng.randrange(1_000_000)
        user, key = (rng.choice((3, 8, 15, 40, 74)), rng.randrange(12)) if n % 3 else (rng.choice((8, 75, 90, 200)), rng.randrange(8, 30))
        rows.append((n, t, user, rng.choice(KINDS), key))
    folder = str(tmp_path_factory.mktemp("events"))
    told = [(n, ZERO + timedelta(microseconds=t), u, kind, json.dumps({"k": k}), 1.0) for n, t, u, kind, k in rows]
    spark.createDataFrame(told, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string, value double").write.parquet(f"{folder}/events.parquet")
    zero = int((ZERO - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    links = defaultdict(list)
    for n, t, u, kind, k in rows:
        links[f"user:{u}", f"k:{k}"].append((t + zero, n, kind))
    return folder, {pair: sorted(seen) for pair, seen in links.items()}


def user(node):
    return int(node.split(":")[1])


def rows_of(spark, folder, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect())


def reached(links, members):
    found = {}
    for (f, g), seen in links.items():
        for node, other in ((f, g), (g, f)):
            if node in members and other not in members and seen[-1][0] >= members[node] - SKEW:
                at = max(seen[0][0], members[node])
                found[other] = min(at, found.get(other, at))
    return found


def test_link_merge_and_links_by_type_cover_all_days(spark, table):
    folder, links = table
    expected = sorted((f, g, s[0][0], s[0][0], s[-1][0], len(s), s[0][2], ",".join(str(n) for _, n, _ in s[:3])) for (f, g), s in links.items())
    assert rows_of(spark, folder, "link_merge", "src", "dst", "t", "act", "last", "n", "detail", "evidence") == expected
    assert rows_of(spark, folder, "links_by_type", "type", "n_links", "n_seen") == [("contacted", len(links), 150)]


def test_prevalence_and_exclusive_cover_all_days(spark, table):
    folder, links = table
    by_key = defaultdict(set)
    for f, g in links:
        by_key[g].add(user(f))
    assert rows_of(spark, folder, "prevalence", "node", "seen_with", "outside") == sorted((g, len(u), sum(x >= 20 for x in u)) for g, u in by_key.items())
    exclusive = rows_of(spark, folder, "exclusive", "node")
    assert exclusive == sorted((g,) for g, u in by_key.items() if max(u) < 75) and 0 < len(exclusive) < len(by_key)


def test_rounds_and_frontier_cover_all_days(spark, table):
    folder, links = table
    members = {"user:8": min(s[0][0] for (f, _), s in links.items() if f == "user:8")}
    rounds = {"user:8": 0}
    for n in range(1, 7):
        new = reached(links, members)
        members |= new
        rounds |= dict.fromkeys(new, n)
    assert rows_of(spark, folder, "rounds_bfs", "key", "since", "round") == sorted((k, members[k], rounds[k]) for k in members)
    assert max(rounds.values()) > 1
    first = {}
    for (f, _), s in links.items():
        if user(f) < 10:
            first[f] = min(s[0][0], first.get(f, s[0][0]))
    assert rows_of(spark, folder, "frontier_join", "key", "since") == sorted(reached(links, first).items())
