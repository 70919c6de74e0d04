"""Folding of repeated activity: runs of the same thing, and members that are the same process again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.text import variable
from tracewell.operators.carry import bucket_of, carried
from tracewell.operators.tables import stored

#: Repeats further apart than this, and than three usual intervals, begin a new run.
QUIET = 3_600_000_000
_NEVER = 2**62


def upper_median(values: Column) -> Column:
    """The upper of the middle values of an array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def _same(key: list[str]) -> Column:
    """Rows and a table whose key columns are __k0, __k1, ... agree, nulls too."""
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return same


def _beside(rows: DataFrame, told: DataFrame, key: list[str], *names: str) -> DataFrame:
    """``rows`` with the columns ``names`` that ``told`` has for their key."""
    told = told.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *names)
    return rows.join(told, _same(key), "left").drop(*[f"__k{i}" for i in range(len(key))])


def _size(value: Column) -> Column:
    """A number that rises with ``value``: its octave and 1024 steps within, so that no bucket is wide for its values."""
    v = F.greatest(F.abs(value.cast("double")), F.lit(1.0))
    octave = F.floor(F.log2(v))
    return (F.signum(value.cast("double")) * (octave * 1024 + F.floor(v / F.pow(F.lit(2.0), octave) * 1024))).cast("long")


def with_upper_median(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Rows of ``key``, n and the upper median of ``value``, by rank: equal values are counted first, then counts are summed
    along the values in buckets, so no key is one task and nothing is gathered into one value."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("__c"))
    counts = carried(counts, key, [F.col(value)], _size(F.col(value)), total={"__upto": F.col("__c")})
    sizes = counts.groupBy(*key).agg(F.sum("__c").alias("n"))
    middle = F.floor(F.col("n") / 2)
    counts = _beside(counts, sizes, key, "n")
    return counts.where((F.col("__upto") > middle) & (F.col("__upto") - F.col("__c") <= middle)).select(*key, "n", F.col(value).alias(name))


def _with_gaps(rows: DataFrame, key: list[str], t: str, order: str) -> DataFrame:
    """``rows`` with ``__gap``, the time since the key's row before."""
    rows = carried(rows, key, [F.col(t).asc_nulls_last(), F.col(order)], bucket_of(F.col(t), F.col(order)), last={"__before": F.col(t)}, inclusive=False)
    return rows.withColumn("__gap", F.col(t) - F.col("__before")).drop("__before")


def _with_runs(rows: DataFrame, key: list[str], t: str, order: str, quiet: int) -> DataFrame:
    """with_runs() with ``__gap``, which is null where a run begins."""
    rows = stored(_with_gaps(rows, key, t, order))  # read for the usual gaps and for the runs
    usual = with_upper_median(rows.where("__gap is not null"), key, "__gap", "__usual").where("n >= 4")
    rows = _beside(rows, usual, key, "__usual")
    new = F.coalesce(F.col("__gap") > F.greatest(F.lit(quiet), F.coalesce(F.col("__usual") * 3, F.lit(0))), F.lit(False))
    rows = rows.withColumn("__new", new).withColumn("__gap", F.when(~F.col("__new"), F.col("__gap")))
    rows = carried(rows, key, [F.col(t).asc_nulls_last(), F.col(order)], bucket_of(F.col(t), F.col(order)), total={"run": F.col("__new").cast("long")})
    return rows.drop("__usual", "__new")


def with_runs(rows: DataFrame, key: list[str], t: str = "t", order: str = "seq", quiet: int = QUIET) -> DataFrame:
    """``rows`` with ``run`` (0, 1, ... within ``key`` by time): a run goes on while each repeat comes soon enough.

    Soon enough: within ``quiet``, or within three times the key's upper median gap if it has four gaps or more. Untimed
    rows come last and go on with the last run.
    """
    return _with_runs(rows, key, t, order, quiet).drop("__gap")


def folded_runs(rows: DataFrame, key: list[str], t: str = "t", order: str = "seq", detail: str | None = None, split: bool = True) -> DataFrame:
    """Each run as key, run, count, first_t, last_t, first_seq, last_seq, every_s (tenths of a second), variants.

    Without ``split``, ``key`` names the runs already.
    """
    rows = stored(_with_runs(rows, key, t, order, QUIET) if split else _with_gaps(rows, key, t, order))
    by = [*key, "run"] if split else key
    place = F.struct(F.coalesce(F.col(t), F.lit(_NEVER)), order)
    what = [F.count("*").alias("count"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.min_by(order, place).alias("first_seq"), F.max_by(order, place).alias("last_seq")]
    if detail:
        what.append((F.count_distinct(detail) + F.max(F.when(F.col(detail).isNull(), 1).otherwise(0))).alias("variants"))
    out = rows.groupBy(*by).agg(*what)
    usual = with_upper_median(rows.where("__gap is not null"), by, "__gap", "__u").where("n >= 2")
    return _beside(out, usual.withColumn("every_s", F.floor(F.col("__u") / 100_000 + 0.5) / 10), by, "every_s")


def identical_members(members: DataFrame, via: DataFrame, passes: int = 5) -> DataFrame:
    """Key, rep: the earliest of the members that are the same process again.

    ``members``: key, place (their order), keep (represents itself), host, path, name, cmd, user, sha256, parent; ``via``: key,
    type, other. Members are compared through the representatives of what links them, so passes repeat until
    nothing changes. Classes only ever merge: after the first pass one member a class is compared, and only where its parent or a
    link stands for a class that has just grown, as no other can be like it. So what later passes shuffle follows what merged.
    """
    path = F.lower(F.coalesce("path", "name", F.lit("")))
    folder = F.regexp_replace(path, r"[^\\/]*$", "")
    rep = members.select("key", F.col("key").alias("rep")).where("false")  # of those that another one stands for
    new = None
    for _ in range(passes):
        rows, links = members.where("not coalesce(keep, false)"), via
        if new is not None:
            heads = new.select("rep").distinct()
            grown = stored(rep.join(heads, "rep", "left_semi").select(F.col("key").alias("other")).unionByName(heads.select(F.col("rep").alias("other"))))
            touched = via.join(grown, "other").select("key").unionByName(members.join(grown, F.col("parent") == F.col("other")).select("key"))
            touched = stored(touched.distinct().join(rep, "key", "left_anti"))
            rows, links = rows.join(touched, "key", "left_semi"), links.join(touched, "key", "left_semi")
        named = rep.select(F.col("key").alias("other"), F.col("rep").alias("other_rep"))
        links = links.join(named, "other", "left").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(">", "type", F.coalesce("other_rep", "other")))), ",").alias("via"))
        rows = rows.join(links, "key", "left").join(named.withColumnsRenamed({"other": "parent", "other_rep": "parent_rep"}), "parent", "left")
        same = F.to_json(F.struct("host", variable(folder).alias("folder"), F.regexp_extract(path, r"[^\\/]*$", 0).alias("file"), variable(F.col("cmd")).alias("cmd"), "user", "sha256", F.coalesce("parent_rep", "parent", F.lit("")).alias("parent"), "via"))
        rows = stored(rows.select("key", "place", F.unhex(F.substring(F.sha2(same, 256), 1, 32)).alias("same")))
        alike = stored(rows.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"))
        if alike.isEmpty():
            break
        first = stored(rows.join(alike, "same", "left_semi").groupBy("same").agg(F.min_by("key", F.struct("place", "key")).alias("rep")))
        new = stored(rows.join(first, "same").where("key <> rep").select("key", "rep"))
        rep = stored(rep.join(new.select(F.col("key").alias("rep"), F.col("rep").alias("now")), "rep", "left").select("key", F.coalesce("now", "rep").alias("rep")).unionByName(new))
    return members.select("key").join(rep, "key", "left").select("key", F.coalesce("rep", "key").alias("rep"))
