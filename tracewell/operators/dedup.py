"""Duplicates across overlapping exports, and the order of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def identity() -> Column:
    """What makes two records the same event, whichever export they came from; nulls equal nulls."""
    parts = [
        "t", "host", "kind", F.coalesce("proc.guid", F.col("proc.pid").cast("string"), F.lower("proc.path")), F.coalesce("target.guid", F.col("target.pid").cast("string")), F.coalesce("parent.guid", F.col("parent.pid").cast("string")),
        F.lower("file_path"), "access", "net.ip", "net.port", "net.domain", "reg.key", "reg.value", "pipe", "launches", "account", "src.ip", "src.port", "http.url", "logon_type",
    ]
    return F.sha2(F.to_json(F.array(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x00")) for p in parts])), 256)


def without_duplicates(rows: DataFrame, key: list[str], file: str = "file", order: list[str] | None = None) -> DataFrame:
    """Within a file every row counts; a later file's n-th copy goes if an earlier file had n or more.

    The n-th copy is numbered in ``order``. Copies of one key are met by window functions, which need their rows together:
    keys are identities of events down to the microsecond, so few rows share one. Null keys equal each other.
    """
    order = order or ["line"]
    nth = Window.partitionBy(*key, file).orderBy(*order)
    earlier = Window.partitionBy(*key).orderBy(file).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__n", F.row_number().over(nth))
    return rows.withColumn("__before", F.max("__n").over(earlier)).where(F.col("__n") > F.coalesce("__before", F.lit(0))).drop("__n", "__before")


def numbered(rows: DataFrame, file: str = "file", line: str = "line", name: str = "seq", block: int = 100_000) -> DataFrame:
    """``rows`` with their position from 0 by (file, line).

    Rows are counted and sorted in blocks of lines, and blocks are offset by the rows before them, so no task holds a file.
    """
    rows = rows.withColumn("__b", F.floor(F.col(line) / block))
    sizes = rows.groupBy(file, "__b").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(F.lit(0)).orderBy(file, "__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(F.col(file).alias("__f"), F.col("__b").alias("__d"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(file, "__b").orderBy(line)))
    rows = rows.join(offset, (F.col(file) == F.col("__f")) & (F.col("__b") == F.col("__d")))
    return rows.withColumn(name, (F.col("__o") + F.col("__n") - 1).cast("long")).drop("__b", "__n", "__f", "__d", "__o")


def combined(events: DataFrame) -> DataFrame:
    """All inputs' events without duplicates, with ``seq`` in input order."""
    rows = without_duplicates(events.withColumn("__id", identity()), ["__id"]).drop("__id")
    return numbered(rows)
