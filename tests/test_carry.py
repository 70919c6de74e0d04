"""Values handed from bucket to bucket equal those of one window a key; one hot key is spread over buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from tracewell.operators import carry
from tracewell.operators.fold import folded_runs, with_runs, with_upper_median
from tracewell.operators.links import last_writer, next_start

MINUTE = 60_000_000


def drawn(n, seed, span, untimed=0.1):
    """Half of the rows have one key; times repeat."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "a", None]), None if rng.random() < untimed else rng.randrange(span) * 500_000, rng.choice("xyz"), rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(carry, "WIDTH", 2_000_000)
    monkeypatch.setattr(carry, "IDS", 20)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_carried_is_one_window(spark, narrow, descending, inclusive):
    df = spark.createDataFrame(drawn(400, 1, 120), "seq long, key string, t long, who string, v int")
    at = F.coalesce("t", F.lit(2**62))
    order = [at.desc(), F.col("seq").desc()] if descending else [at, F.col("seq")]
    bucket = carry.bucket_of(F.col("t"), F.col("seq"))
    frame = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = df.withColumns({"last": F.last("v", ignorenulls=True).over(frame), "sum": F.coalesce(F.sum("v").over(frame), F.lit(0))})
    mine = carry.carried(df, ["key"], order, bucket, last={"last": F.col("v")}, total={"sum": F.col("v")}, inclusive=inclusive, descending=descending)
    assert sorted(map(repr, mine.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    assert df.where("key = 'hot'").select(bucket).distinct().count() > 20


def brute_writer(writes, reads, look_ahead):
    out = []
    for rs, rp, rt, rk in reads:
        last = 2**62
        at = lambda t: last if t is None else t
        if look_ahead:
            past = [w for w in writes if w[1] == rp and w[3] != rk and at(w[2]) <= at(rt)]
        else:
            past = [w for w in writes if w[1] == rp and w[3] != rk and (at(w[2]), w[0]) < (at(rt), rs)]
        soon = [w for w in writes if w[1] == rp and w[3] != rk and look_ahead and w[2] is not None and rt is not None and rt < w[2] <= rt + look_ahead]
        if past:
            w = max(past, key=lambda w: (at(w[2]), w[0]))
        elif soon:
            w = min(soon, key=lambda w: (w[2], w[0]))
        else:
            continue
        out.append((rs, w[3], w[2], w[0]))
    return sorted(out)


@pytest.mark.parametrize("look_ahead", [0, 2_000_000])
def test_last_writer_with_a_hot_path(spark, narrow, look_ahead):
    rows = [r[:4] for r in drawn(300, 3, 100) if r[1]]
    writes, reads = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    kind = "seq long, path string, t long, key string"
    out = last_writer(spark.createDataFrame(writes, kind), spark.createDataFrame(reads, kind), look_ahead=look_ahead)
    assert sorted((r["seq"], r["w_key"], r["w_t"], r["w_seq"]) for r in out.collect()) == brute_writer(writes, reads, look_ahead)


def test_next_start_with_a_hot_path(spark, narrow):
    rows = [r[:4] for r in drawn(300, 4, 100) if r[1]]
    made, starts = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2 and r[2] is not None]
    kind = "seq long, path string, t long, key string"
    out = next_start(spark.createDataFrame(made, kind), spark.createDataFrame(starts, kind).drop("seq"))
    expected = []
    for s, p, t, k in made:
        later = [x for x in starts if x[1] == p and x[3] != k and (t is None or x[2] >= t - 2_000_000)]
        if later:
            x = min(later, key=lambda x: (x[2], x[3]))
            expected.append((s, x[3], x[2]))
    assert sorted((r["seq"], r["s_key"], r["s_t"]) for r in out.collect()) == sorted(expected)


def test_upper_median_is_sorted_middle(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([0, 1, 7, 7, rng.randrange(10**6), rng.randrange(10**12), 2**50 - 1, 2**50])) for _ in range(500)]
    out = {r["k"]: (r["n"], r["m"]) for r in with_upper_median(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", "m").collect()}
    of = {k: sorted(v for x, v in rows if x == k) for k in {k for k, _ in rows}}
    assert out == {k: (len(v), v[len(v) // 2]) for k, v in of.items()}


def brute_runs(rows, quiet):
    """key -> rows in order with their run."""
    out = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        gaps = [b[2] - a[2] if a[2] is not None and b[2] is not None else None for a, b in zip(own, own[1:], strict=False)]
        known = sorted(g for g in gaps if g is not None)
        most = max(quiet, 3 * known[len(known) // 2] if len(known) >= 4 else 0)
        run, told = 0, [(own[0], 0)] if own else []
        for r, g in zip(own[1:], gaps, strict=True):
            run += g is not None and g > most
            told.append((r, run))
        out[key] = told
    return out


def test_runs_with_a_hot_key(spark, narrow):
    rows = drawn(300, 6, 400)
    df = spark.createDataFrame(rows, "seq long, key string, t long, who string, v int")
    expected = brute_runs(rows, 1_000_000)
    assert sorted((r["seq"], r["run"]) for r in with_runs(df, ["key"], quiet=1_000_000).collect()) == sorted((r[0], run) for told in expected.values() for r, run in told)
    folded = {(r["key"], r["run"]): r for r in folded_runs(df, ["key"], detail="who").collect()}
    runs = brute_runs(rows, 3_600_000_000)
    for key, told in runs.items():
        for run in {n for _, n in told}:
            own = [r for r, n in told if n == run]
            times = [r[2] for r in own if r[2] is not None]
            gaps = sorted(b - a for a, b in zip(times, times[1:], strict=False))
            f = folded[key, run]
            assert (f["count"], f["first_t"], f["last_t"], f["first_seq"], f["last_seq"], f["variants"]) == (len(own), min(times), max(times), own[0][0], own[-1][0], len({r[3] for r in own}))
            assert f["every_s"] == (None if len(gaps) < 2 else (gaps[len(gaps) // 2] / 100_000 + 0.5) // 1 / 10)
