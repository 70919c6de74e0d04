"""Operators on small frames: duplicates, writers, runs, identical members, identity."""

from __future__ import annotations

import random


from tracewell.operators.dedup import numbered, without_duplicates
from tracewell.operators.fold import folded_runs, identical_members
from tracewell.operators.identity import resolve_references, start_keys
from tracewell.operators.links import handle_starts, last_writer, merged, next_start

S = 1_000_000


def test_duplicates_count_by_file(spark):
    rows = [(0, 1, "a"), (0, 2, "a"), (1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 1, "a"), (2, 2, None), (1, 4, None)]
    out = without_duplicates(spark.createDataFrame(rows, "file int, line long, k string"), ["k"])
    assert sorted((r["file"], r["line"]) for r in out.collect()) == [(0, 1), (0, 2), (1, 3), (1, 4)]


def test_numbered_is_the_order(spark):
    rows = [(f, n) for f in range(3) for n in random.Random(f).sample(range(5000), 400)]
    out = numbered(spark.createDataFrame(rows, "file int, line long").repartition(5), block=700).orderBy("seq").collect()
    assert [(r["file"], r["line"]) for r in out] == sorted(rows) and [r["seq"] for r in out] == list(range(1200))


def test_last_writer_is_brute_force(spark):
    rng = random.Random(1)
    writes = [(rng.choice("pq"), rng.choice([None, *range(30)]), i, rng.choice("abc")) for i in range(80)]
    reads = [(rng.choice("pq"), rng.randrange(30), 1000 + i, rng.choice("abc")) for i in range(60)]
    schema = "path string, t long, seq long, key string"
    out = {r["seq"]: (r["w_key"], r["w_seq"]) for r in last_writer(spark.createDataFrame(writes, schema), spark.createDataFrame(reads, schema), look_ahead=2).collect()}
    for path, t, seq, key in reads:
        near = sorted((w for w in writes if w[0] == path and w[3] != key and w[1] is not None), key=lambda w: (w[1], w[2]))
        before, after = [w for w in near if w[1] <= t], [w for w in near if t < w[1] <= t + 2]
        best = before[-1] if before else after[0] if after else None
        assert out.get(seq) == (best and (best[3], best[2]))


def test_next_start_is_brute_force(spark):
    rng = random.Random(2)
    regs = [(rng.choice("pq"), rng.choice([None, *(S * x for x in range(30))]), i, rng.choice("abc")) for i in range(60)]
    starts = [(rng.choice("pq"), S * rng.randrange(30), f"{rng.choice('abc')}") for _ in range(25)]
    out = {r["seq"]: (r["s_t"], r["s_key"]) for r in next_start(spark.createDataFrame(regs, "path string, t long, seq long, key string"), spark.createDataFrame(starts, "path string, t long, key string")).collect()}
    for path, t, seq, key in regs:
        fit = sorted((s[1], s[2]) for s in starts if s[0] == path and s[2] != key and (t is None or s[1] >= t - 2 * S))
        assert out.get(seq) == (fit[0] if fit else None)


def test_handles_meet_starts(spark):
    h = spark.createDataFrame([("p", 100 * S, 1, "a"), ("p", 60 * S, 2, "a"), ("p", None, 3, "a"), ("p", 104 * S, 4, "c")], "opened string, t long, seq long, key string")
    s = spark.createDataFrame([("p", 102 * S, "c"), ("p", None, "d")], "parent string, start long, child string")
    assert [(r["seq"], r["child"]) for r in handle_starts(h, s).collect()] == [(1, "c")]


def test_links_merge(spark):
    rows = [("x", "a", "b", 5, 5, 9, "late", 1), ("x", "a", "b", 3, 1, 7, None, 1), ("x", "a", "b", None, None, 8, "untimed", 1), ("x", "a", "b", 3, 2, 7, "again", 1), ("x", "a", "a", 1, 1, 1, "self", 1), ("x", "a", "b", 9, 9, 10, "d", 1)]
    (r,) = merged(spark.createDataFrame(rows, "type string, from string, to string, t long, act long, seq long, detail string, phase int")).collect()
    assert (r["t"], r["last"], r["count"], r["detail"], r["evidence"]) == (3, 9, 5, "again", [7, 9, 10])


def test_runs(spark):
    beacon = [("b", 60 * S * i, i) for i in range(121)] + [("b", 60 * S * 120 + 8 * 3600 * S + 60 * S * i, 200 + i) for i in range(10)]
    hourly = [("h", 5400 * S * i, 400 + i) for i in range(8)] + [("h", None, 500)]
    out = folded_runs(spark.createDataFrame(beacon + hourly, "k string, t long, seq long"), ["k"]).orderBy("k", "run").collect()
    assert [(r["k"], r["count"], r["every_s"]) for r in out] == [("b", 121, 60.0), ("b", 10, 60.0), ("h", 9, 5400.0)]


def test_identical_members_fold_through_their_parents(spark):
    rows = [("a1", 1, False, "h", r"c:\t\is-ab12cd.tmp\x.exe", "x.exe", "x.exe 11", "u", None, "root"), ("a2", 2, False, "h", r"c:\t\is-zz99yy.tmp\x.exe", "x.exe", "x.exe 12", "u", None, "root"), ("b1", 3, False, "h", r"c:\y.exe", "y.exe", "y", "u", None, "a1"), ("b2", 4, False, "h", r"c:\y.exe", "y.exe", "y", "u", None, "a2"), ("root", 0, True, "h", r"c:\x.exe", "x.exe", "x.exe 11", "u", None, None)]
    members = spark.createDataFrame(rows, "key string, place int, keep boolean, host string, path string, name string, cmd string, user string, sha256 string, parent string")
    via = spark.createDataFrame([("a1", "spawned", "root"), ("a2", "spawned", "root"), ("b1", "spawned", "a1"), ("b2", "spawned", "a2")], "key string, type string, other string")
    assert {r["key"]: r["rep"] for r in identical_members(members, via).collect()} == {"a1": "a1", "a2": "a1", "b1": "b1", "b2": "b1", "root": "root"}


REFS = "seq long, role int, guid string, base string, t long, space string, kind string, host string, pid long, image string"


def resolve(spark, *rows):
    refs = spark.createDataFrame([(*r, "h", 5, r[3]) for r in rows], REFS)
    return {(r["seq"], r["role"]): r["key"] for r in resolve_references(refs, start_keys(refs)).collect()}


def test_pid_reuse_and_twins(spark):
    got = resolve(spark, (1, 0, None, "a.exe", 0, "0|security", "process_start"), (2, 0, None, "b.exe", 3600 * S, "0|security", "process_start"), (3, 0, "G2", "b.exe", 3600 * S + 1000, "0|sysmon", "process_start"), (4, 0, None, "a.exe", 10 * S, "0|security", "network"), (5, 0, None, None, 4000 * S, "0|security", "network"))
    assert got == {(1, 0): "p:h:5:0", (2, 0): "g:h:G2", (3, 0): "g:h:G2", (4, 0): "p:h:5:0", (5, 0): "g:h:G2"}


def test_late_guid_joins_if_the_image_agrees(spark):
    start = (1, 0, None, "a.exe", 0, "0|security", "process_start")
    assert resolve(spark, start, (2, 0, "G", "a.exe", 5 * S, "0|sysmon", "image_load"))[2, 0] == "p:h:5:0"
    assert resolve(spark, start, (2, 0, "G", "z.exe", 5 * S, "0|sysmon", "image_load"))[2, 0] == "g:h:G"


def test_lives_end_and_begin_unseen(spark):
    got = resolve(spark, (1, 0, None, None, 10 * S, "0|e", "network"), (2, 0, None, None, 20 * S, "0|e", "process_end"), (3, 0, None, None, 60 * S, "0|e", "network"), (4, 0, None, None, 61 * S, "0|e", "network"))
    assert got[1, 0] == got[2, 0] == "p:h:5:10000000" and got[3, 0] == got[4, 0] == "p:h:5:60000000"


def test_guids_of_two_sources_are_one_process(spark):
    got = resolve(
        spark, (1, 0, "G1", "a.exe", 0, "0|sysmon", "process_start"), (2, 0, "E1", "a.exe", S, "1|edr", "process_start"), (3, 0, "E1", None, 9 * S, "1|edr", "network"), (4, 0, "G9", "a.exe", S, "0|sysmon", "process_start"),
        (5, 0, "E2", "b.exe", 100 * S, "1|edr", "network"), (6, 0, "E3", "b.exe", 101 * S, "1|edr", "network"), (7, 0, "G5", "b.exe", 102 * S, "0|sysmon", "network"), (8, 0, None, None, None, "2|x", "network"),
    )
    assert got[2, 0] == got[3, 0] == got[1, 0] == "g:h:G1" and got[4, 0] == "g:h:G9"
    # without a start: another GUID of the same source is another process, one of another source is the same
    assert got[5, 0] == "g:h:E2" and got[6, 0] == "g:h:E3" and got[7, 0] == "g:h:E3"
    assert got[8, 0] == "g:h:E3"


def test_a_pid_alone_takes_the_life_that_begins_unseen(spark):
    got = resolve(spark, (1, 0, None, None, 0, "0|a", "network"), (2, 0, "G", "a.exe", 50 * S, "1|b", "network"), (3, 0, "G", "a.exe", 60 * S, "1|b", "process_end"), (4, 0, None, None, 90 * S, "0|a", "network"), (5, 2, "P", None, 90 * S, "1|b", "parent"))
    assert got[1, 0] == got[2, 0] == got[3, 0] == "g:h:G" and got[4, 0] == got[5, 2] == "g:h:P"
