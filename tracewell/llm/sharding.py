"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard for which a hash of (key, shard), bent by the shard's weight, is largest. Only the
key and the list of shards decide, so each executor computes it alone, and a shard that is added takes records
only into itself.

Slots within a shard are numbered through ranges of the key's hash: ranges are counted and their offsets summed,
then each range is numbered by itself. No task holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges of the key's hash within a shard, in hexadecimal digits: 16**3.
RANGE_DIGITS = 3


def _draw(key: Column, shard: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The index of the shard that wins ``key``; shard i wins a share in proportion to ``weights[i]``.

    The score -w / ln(u) has that property for u even in (0, 1). Equal scores go to the larger index. A shard of weight
    0 wins nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: at least one must be above 0, none below")
    scores = [F.struct((F.lit(-float(w)) / F.log(_draw(key, i))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    ``size``: UTF-8 bytes of the text plus 1; ``text_crc32``: of those bytes; ``law``: "key"; ``shard``: see
    rendezvous(); ``slot``: 0, 1, ... in the shard; ``grown_shard``: the shard under ``grown``, by default one more shard
    of mean weight.

    Null text counts as empty. A null id is a key of its own, "null", so such rows share a shard. Rows that share an id
    share a shard and get slots of their own, in the order of their texts' hashes. Columns of these names that docs
    has are replaced; all other columns stay.
    """
    weights = list(weights)
    grown = [*weights, sum(weights) / len(weights)] if grown is None else list(grown)
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text, key = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.drop(*own).withColumns({
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": F.crc32(text),
        "law": F.lit("key"),
        "shard": rendezvous(key, weights),
        "grown_shard": rendezvous(key, grown),
        "__order": F.md5(key),
    })
    rows = rows.withColumn("__range", F.conv(F.substring("__order", 1, RANGE_DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("shard").orderBy("__range")) - F.col("__n"))
    before = before.select(F.col("shard").alias("__shard"), F.col("__range").alias("__r"), "__before")
    within = Window.partitionBy("shard", "__range").orderBy("__order", "text_crc32", "size")
    rows = rows.withColumn("__nth", F.row_number().over(within))
    rows = rows.join(before, (F.col("shard") == F.col("__shard")) & (F.col("__range") == F.col("__r")))
    rows = rows.withColumn("slot", (F.col("__before") + F.col("__nth") - 1).cast("long"))
    return rows.select(*[c for c in docs.columns if c not in own], *own)
