"""Structured Streaming ingest: NDJSON files that arrive become canonical events.

Reading and normalising look at one record at a time, so they are the same projection on a stream. What needs all
records (duplicates, identity, links) runs over the table that the stream writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.text import present
from tracewell.operators.normalize import classify, to_events
from tracewell.operators.tables import stored


def stream_records(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw records of NDJSON files in ``folder``. Lines aren't numbered: the id is the record's own, or one made of its content.

    Lines that are no JSON objects are left out; a stream doesn't end for one torn line.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    v = F.try_parse_json("value")
    lines = lines.where(F.schema_of_variant(v).startswith("OBJECT"))
    own = F.coalesce(*[present(F.try_variant_get(v, p, "string")) for p in ("$.id", "$._id", "$._source.id", "$.event.id")])
    inner = F.try_variant_get(v, "$._source", "variant")
    nested = F.when(F.schema_of_variant(inner).startswith("OBJECT"), F.to_json(inner)).otherwise(F.col("value"))
    null = F.lit(None).cast("map<string,string>")
    return lines.select(F.lit(0).alias("file"), F.lit(0).cast("long").alias("line"), F.coalesce(own, F.concat(F.lit("sha-"), F.substring(F.sha2("value", 256), 1, 16))).alias("id"), own.isNull().alias("line_id"), nested.alias("nested"), null.alias("flat"), null.alias("names"))


def write_events(records: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write canonical events of a stream of raw records as Parquet, in folders by batch and kind; later reads prune by kind.

    A batch is classified, stored and normalised like any other input, as one plan over all fields would be too large. A
    batch that is run again after a failure replaces what it had written.
    """

    def batch(rows: DataFrame, number: int) -> None:
        to_events(stored(classify(rows))).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    out = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
