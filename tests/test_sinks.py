"""Report tables and the streaming ingest."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

import golden
from tracewell.plans.report import Report, findings
from tracewell.sources import sinks
from tracewell.streaming.ingest import stream_records, write_events

ROW = "time string, host string, process string, entity string, member string, kind string, detail string, event_id string, count long, until string, every_s double"


def test_rows_for_people(spark):
    rows = spark.createDataFrame(
        [("2026-01-01T00:00:00Z", "h", "a.exe", None, "m1", "network", "203.0.113.9:443", "1", 5, "2026-01-01T01:00:00Z", 60.0), ("2026-01-01T00:00:01Z", "h", "a.exe", None, "m2", "process_start", "a.exe -x", "2", None, None, None), ("2026-01-01T00:00:02Z", "h", None, "u", "m3", "inject", "b.exe", "3", None, None, None)], ROW
    )
    table = sinks.evidence_table(rows).collect()
    assert table[0]["type"] == "ip" and table[0]["level"] == "easy" and table[0]["repeats"] == "×5 until 2026-01-01T01:00:00Z, every 60.0 s"
    assert table[1]["command_line"] == "a.exe -x" and table[1]["indicator"] == "a.exe"
    assert [r["event_id"] for r in sinks.narrative_rows(rows, 2).collect()] == ["2", "3"]
    members = spark.createDataFrame([("m1",), ("m2",)], "key string")
    assert {r["member"]: r["origin"] for r in sinks.origin(rows, members, "m1").collect()} == {"m1": "seed", "m2": "related", "m3": "context"}
    assert sinks.telemetry_lines(rows, 60).select("chunk").distinct().count() == 3


def test_chain_truth_and_answers(spark):
    members = spark.createDataFrame([("s", 0), ("a", 1), ("b", 2), ("c", 3)], "key string, place long")
    via = spark.createDataFrame([("a", "s"), ("b", "a"), ("b", "c"), ("c", "s")], "key string, other string")
    assert sorted((r["key"], r["parent"], r["depth"]) for r in sinks.chain(members, via).collect()) == [("a", "s", 1), ("b", "a", 2), ("c", "s", 1), ("s", None, 0)]
    found, truth = spark.createDataFrame([("A", 1, 0), ("x", 2, 0)], "name string, pid int, start long"), spark.createDataFrame([("a", 1, 4_000_000), ("b", 1, 0)], "name string, pid int, start long")
    r = sinks.ground_truth(found, truth).first()
    assert (r["hits"], r["found"], r["truth"], r["precision"], r["missed"]) == (1, 2, 2, 0.5, 1)
    a, b = spark.createDataFrame([("k", 0.79), ("l", 0.2)], "key string, probability double"), spark.createDataFrame([("k", 0.81), ("l", 0.3)], "key string, probability double")
    assert sinks.batching_difference(a, b).first()["flips"] == 1
    m = spark.createDataFrame([(1, "Execution", "T1059"), (1, "Nonsense", "T1059"), (1, "Impact", "1059")], "row int, tactic string, technique string")
    assert sinks.valid_mappings(m).count() == 1


def test_streaming_ingest_is_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text(golden.as_ndjson() + "{torn\n")
    q = write_events(stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(300)
    events = spark.read.parquet(str(tmp_path / "out"))
    assert events.count() == len(golden.ndjson()) and events.where("kind = 'process_start'").select(F.min("proc.name")).first()[0] == "chrome.exe"


def read_aloud(tree):
    """(key, depth, nth) of every member, by recursion without the stack."""
    under = {}
    for key, place, parent in tree:
        under.setdefault(parent, []).append((place, key))
    out, stack = [], [(key, 0) for _, key in sorted(under.get(None, []), reverse=True)]
    while stack:
        key, depth = stack.pop()
        out.append((key, depth, len(out)))
        stack += [(k, depth + 1) for _, k in sorted(under.get(key, []), reverse=True)]
    return out


@pytest.mark.parametrize("shape", ["random", "star", "roots", "empty"])
def test_reading_order_is_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(sinks, "SIBLINGS", 7)
    rng = random.Random(shape)
    pick = {"random": lambda i: f"k{rng.randrange(i)}" if i and rng.random() < 0.95 else None, "star": lambda i: "k0" if i else None, "roots": lambda i: None, "empty": lambda i: None}[shape]
    tree = [(f"k{i}", rng.randrange(50) if shape != "random" else i, pick(i)) for i in range(0 if shape == "empty" else 80)]
    out = sinks.reading_order(spark.createDataFrame(tree, "key string, place long, parent string")).collect()
    assert sorted((r["key"], r["depth"], r["nth"]) for r in out) == sorted(read_aloud(tree))


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    tables = []
    keep = sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda df: tables.append(1) or keep(df))
    tree = [(f"k{i}", i, f"k{i - 1}" if i else None) for i in range(1000)]
    out = sinks.reading_order(spark.createDataFrame(tree, "key string, place long, parent string")).collect()
    assert {(r["key"], r["depth"], r["nth"]) for r in out} == {(f"k{i}", i, i) for i in range(1000)}
    assert len(tables) - 2 <= 12


def test_findings(spark):
    incident = spark.createDataFrame([("p", "process", (2,)), ("u", "user", None)], "key string, type string, repeats struct<count:int>")
    counters = {"candidates_asked": 3, "rounds": 1, "near_threshold": 0, "timeline_rows": 2, "timeline_events": 9, "stopped": None}
    row = findings(Report(incident, incident, incident, counters)).first()
    assert row["line"] == "3 members: 2 processes and 1 account, host, address or domain · 3 candidates asked over 1 round · 2 timeline rows from 9 events"
    assert findings(Report(incident.limit(0), incident, incident, counters | {"stopped": "cap", "near_threshold": 1})).first()["line"].startswith("0 members: 0 processes and 0 accounts")


def test_chunks_hold_whole_lines_within_the_budget(spark):
    rng = random.Random(8)
    times = [f"2026-01-{rng.randint(1, 2):02d}T00:{rng.randint(0, 3):02d}:{rng.randint(0, 59):02d}Z" for _ in range(400)] + [None, None]
    rows = [(t, "h", "a.exe", None, "m", "inject", "x" * rng.choice([0, 1, 5, 20, 90, 300]), str(i), None, None, None) for i, t in enumerate(times)]
    out = [r.asDict() for r in sinks.telemetry_lines(spark.createDataFrame(rows, ROW), 200).collect()]
    assert sorted(r["event_id"] for r in out) == sorted(str(i) for i in range(len(rows)))
    chunks = {}
    for r in sorted(out, key=lambda r: (r["day"] or "", times[int(r["event_id"])] or "", r["event_id"])):
        chunks.setdefault(r["day"], []).append((r["chunk"], len(r["line"]) + 1))
    for told in chunks.values():
        assert [c for c, _ in told] == sorted(c for c, _ in told)
        for chunk in {c for c, _ in told}:
            sizes = [n for c, n in told if c == chunk]
            assert sum(sizes) <= 200 or len(sizes) == 1
    assert sinks.telemetry_lines(spark.createDataFrame([], ROW)).count() == 0
