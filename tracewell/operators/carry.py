"""What earlier rows of a key hand on to later ones, without one task for a key.

A key's rows are cut into buckets of time. Windows run within buckets only; each bucket is summed up in one row, a scan over a
key's summaries says with what each bucket begins, and a join hands that to its rows. So a key that holds a third of all rows
is spread over as many tasks as it has buckets, and only summaries, at most one for each minute, meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Microseconds of a bucket; of rows without a time, ids of a bucket.
WIDTH, IDS = 60_000_000, 65_536
_UNTIMED = 2**45
BUCKET = "__bucket"
_NTH = "__nth"


def bucket_of(t: Column, seq: Column | None = None) -> Column:
    """A number that rises with (t, seq), untimed rows last."""
    late = F.lit(_UNTIMED) if seq is None else F.lit(_UNTIMED) + F.floor(seq / IDS)
    return F.coalesce(F.floor(t / WIDTH), late).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _handed(rows: DataFrame, entries: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``rows`` with what their buckets begin with."""
    by = [*key, BUCKET]
    entries = entries.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], *names)
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & _same(k, f"__k{i}")
    return rows.join(entries, same).drop(*[f"__k{i}" for i in range(len(by))])


def carried(rows: DataFrame, key: Sequence[str], order: Sequence[Column], bucket: Column, last: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None, inclusive: bool = True, descending: bool = False) -> DataFrame:
    """``rows`` with, over the rows of their key so far in ``order``, the last value that isn't null, or the sum.

    ``bucket`` never falls along ``order``, or never rises if ``descending``. ``inclusive``: the row itself counts.
    """
    last, total = dict(last or {}), dict(total or {})
    values = {f"__v_{n}": c for n, c in (last | total).items()}
    rows = rows.withColumns({BUCKET: bucket, **values})
    within = Window.partitionBy(BUCKET, *key).orderBy(*order)  # buckets differ where keys may be few: sorted by them first
    # Only rows that have something to hand on are summed up.
    ends = rows.where(reduce(or_, [F.col(f"__v_{n}").isNotNull() for n in last] + [F.coalesce(F.col(f"__v_{n}") != 0, F.lit(False)) for n in total]))
    if last:
        whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = ends.withColumns({f"__v_{n}": F.last(f"__v_{n}", ignorenulls=True).over(whole) for n in last})
    ends = ends.groupBy(BUCKET, *key).agg(*[F.first(f"__v_{n}").alias(f"__v_{n}") for n in last], *[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in total])
    # A mark that begins each bucket, then what the bucket hands on.
    marks = rows.select(*key, BUCKET).distinct().withColumn(_NTH, F.lit(0)).unionByName(ends.withColumn(_NTH, F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy(F.col(BUCKET).desc() if descending else F.col(BUCKET), _NTH).rowsBetween(Window.unboundedPreceding, -1)
    entries = marks.withColumns({f"__v_{n}": F.last(f"__v_{n}", ignorenulls=True).over(before) for n in last} | {f"__v_{n}": F.sum(f"__v_{n}").over(before) for n in total})
    entries = entries.where(f"{_NTH} = 0").where(reduce(or_, [F.col(v).isNotNull() for v in values]))
    # What a bucket begins with stands before its rows, so these are shuffled and sorted once and joined with nothing.
    out = rows.withColumn(_NTH, F.lit(1)).unionByName(entries, allowMissingColumns=True)
    so_far = Window.partitionBy(BUCKET, *key).orderBy(_NTH, *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = out.withColumns({f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(so_far) for n in last} | {f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(so_far), F.lit(0)) for n in total})
    out = out.where(f"{_NTH} = 1").withColumns({n: F.col(f"__l_{n}") for n in (*last, *total)})
    return out.drop(BUCKET, _NTH, *values, *[f"__l_{n}" for n in (*last, *total)])


def nearest_other(rows: DataFrame, key: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, who: str, name: str, descending: bool = False) -> DataFrame:
    """``rows`` with the last earlier ``value`` (a struct with a field ``who``, or null) of their key that isn't of their own ``who``.

    The last value and the last one of somebody else are enough to know; of a bucket both are handed on.
    """
    rows = rows.withColumns({BUCKET: bucket, "__v": value})
    within = Window.partitionBy(*key, BUCKET).orderBy(*order)
    earlier, so_far, whole = (within.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0, Window.unboundedFollowing))

    def told(frame: DataFrame, earlier, so_far) -> DataFrame:
        """The last value before a row, and the last one before it of somebody else than that."""
        frame = frame.withColumn("__last", F.last("__v", ignorenulls=True).over(earlier))
        turned = F.when(F.col("__v").isNotNull() & (F.col(f"__last.{who}") != F.col(f"__v.{who}")), F.col("__last"))
        return frame.withColumn("__turned", turned).withColumn("__other", F.last("__turned", ignorenulls=True).over(so_far)).drop("__turned")

    ends = rows.withColumn("__end", F.last("__v", ignorenulls=True).over(whole))
    ends = ends.withColumn("__else", F.last(F.when(F.col(f"__v.{who}") != F.col(f"__end.{who}"), F.col("__v")), ignorenulls=True).over(whole))
    ends = ends.groupBy(*key, BUCKET).agg(F.first("__end").alias("__end"), F.first("__else").alias("__else"))
    # A mark that begins the bucket, then what it hands on.
    marks = ends.select(*key, BUCKET, F.posexplode(F.array(F.lit(None).cast(ends.schema["__end"].dataType), F.col("__else"), F.col("__end"))).alias("__at", "__v"))
    over = Window.partitionBy(*key).orderBy(F.col(BUCKET).desc() if descending else F.col(BUCKET), "__at")
    entries = told(marks, over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, 0)).where("__at = 0")
    entries = entries.select(*key, BUCKET, F.col("__last").alias("__entry"), F.col("__other").alias("__entry_other"))
    out = _handed(told(rows, earlier, so_far), entries, key, ["__entry", "__entry_other"])
    choices = [F.when(F.col(f"{c}.{who}") != F.col(who), F.col(c)) for c in ("__last", "__other", "__entry", "__entry_other")]
    return out.withColumn(name, F.coalesce(*choices)).drop(BUCKET, "__v", "__last", "__other", "__entry", "__entry_other")
