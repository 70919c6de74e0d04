"""Carried rows are shuffled once and joined with nothing; columns of any name stand beside; ends by GUID end lives near sights."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tracewell.operators import carry
from tracewell.operators.identity import resolve_references, start_keys

S = 1_000_000
REFS = "seq long, role int, guid string, base string, t long, space string, kind string, host string, pid long, image string"


def test_carried_rows_meet_no_join(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i * 20 * S, i % 2, i if i % 5 == 0 else None) for i in range(60)], "seq long, key string, __at long, __o int, v long")
    order = [F.col("__at"), F.col("seq")]
    mine = carry.carried(df, ["key"], order, carry.bucket_of(F.col("__at")), last={"last": F.col("v")}, total={"sum": F.col("v")})
    frame = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns({"last": F.last("v", ignorenulls=True).over(frame), "sum": F.coalesce(F.sum("v").over(frame), F.lit(0))})
    assert sorted(map(repr, mine.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    assert "Join" not in mine._jdf.queryExecution().optimizedPlan().toString()


def test_an_end_without_a_pid_ends_a_life_near_a_sight(spark):
    rows = [(1, 0, "A", "a.exe", 0, "0|a", "process_start"), (2, 0, "A", "a.exe", 10 * S, "0|a", "process_end"), (3, 0, "B", "a.exe", 5 * S, "1|b", "network"), (4, 0, "C", "a.exe", 30 * S, "1|b", "network")]
    refs = spark.createDataFrame([(*r, "h", None if r[0] == 2 else 5, r[3]) for r in rows], REFS)
    got = {r["seq"]: r["key"] for r in resolve_references(refs, start_keys(refs)).collect()}
    assert got == {1: "g:h:A", 2: "g:h:A", 3: "g:h:A", 4: "g:h:C"}
