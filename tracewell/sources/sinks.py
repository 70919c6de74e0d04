"""Sinks: reports as JSON, tables of rows, indicators and the narrative's rows."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.text import basename
from tracewell.operators.carry import carried
from tracewell.operators.tables import stored

#: Places of a bucket of siblings.
SIBLINGS = 10_000
#: Members of a block along (place, key); members of BLOCK places in a row are sorted together.
BLOCK = 100_000

# Rungs of the pyramid of pain and the tactics of a mapping.
LEVELS = {"hash": "trivial", "ip": "easy", "domain": "simple", "artifact": "annoying", "tool": "challenging"}
TACTICS = (
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
)


def write_report(report, path: str) -> None:
    """Incident, rejected and timeline as JSON lines in folders of ``path``, counters beside them."""
    for name in ("incident", "rejected", "timeline"):
        getattr(report, name).write.mode("overwrite").json(f"{path}/{name}")
    spark = report.incident.sparkSession
    spark.createDataFrame([(json.dumps(report.counters),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/counters")


def near_misses(rejected: DataFrame, least: float = 0.5, limit: int = 100) -> DataFrame:
    """F16."""
    return rejected.where(F.col("probability") >= least).orderBy(F.desc("probability"), "key").limit(limit)


def origin(rows: DataFrame, members: DataFrame, seed: str) -> DataFrame:
    """Timeline rows with ``origin``: seed, related or context."""
    known = members.select(F.col("key").alias("member"), F.lit(True).alias("__in")).distinct()
    label = F.when(F.col("member") == seed, "seed").when(F.col("__in"), "related").otherwise("context")
    return rows.join(known, "member", "left").withColumn("origin", label).drop("__in")


def repeat_text() -> Column:
    """×N until T, every S."""
    every = F.when(F.col("every_s").isNotNull(), F.concat(F.lit(", every "), F.col("every_s").cast("string"), F.lit(" s"))).otherwise("")
    return F.when(F.col("count") > 1, F.concat(F.lit("×"), F.col("count").cast("string"), F.coalesce(F.concat(F.lit(" until "), "until"), F.lit("")), every))


def indicator() -> Column:
    """The artifact of a row, its type and how hard it is to change."""
    kind = F.col("kind")
    address = F.col("detail").rlike(r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$")
    type_ = (
        F.when(kind.isin("network") & address, "ip").when(kind.isin("network", "dns"), "domain").when(kind.isin("process_start", "inject", "image_load"), "tool")
        .when(kind.isin("file_create", "file_delete", "registry_set", "pipe_create", "pipe_connect", "service_install", "task_create"), "artifact")
    )
    level = F.lit(None).cast("string")
    for k, v in LEVELS.items():
        level = F.when(type_ == k, v).otherwise(level)
    value = F.when(kind == "process_start", F.col("process")).when(kind.isin("file_create", "image_load"), basename(F.col("detail"))).otherwise(F.col("detail"))
    return F.when(type_.isNotNull(), F.struct(value.alias("value"), type_.alias("type"), level.alias("level")))


def evidence_table(rows: DataFrame, limit: int = 3000) -> DataFrame:
    """One projected row for each timeline row."""
    i = indicator()
    command = F.when(F.col("kind") == "process_start", F.col("detail"))
    return rows.select("time", "host", F.coalesce("process", "entity").alias("title"), "kind", command.alias("command_line"), i["value"].alias("indicator"), i["type"].alias("type"), i["level"].alias("level"), repeat_text().alias("repeats")).orderBy(F.col("time").asc_nulls_last()).limit(limit)


def narrative_rows(rows: DataFrame, most: int = 60) -> DataFrame:
    """The ``most`` weightiest rows, in the order of time again."""
    weight = F.when(F.col("kind").isin("inject", "tamper"), 5).when(F.col("kind").isin("service_install", "task_create", "registry_set"), 4).when(F.col("kind") == "process_start", 3).when(F.col("kind").isin("network", "dns", "logon"), 2).when(F.col("kind") == "file_create", 1).otherwise(0)
    top = rows.withColumn("__w", weight).orderBy(F.desc("__w"), F.col("time").asc_nulls_last(), "event_id").limit(most)
    return top.drop("__w").orderBy(F.col("time").asc_nulls_last(), "event_id")


def valid_mappings(rows: DataFrame, most: int = 3) -> DataFrame:
    """Rows (row, tactic, technique) that name a known tactic and a well-formed technique, at most three a row."""
    good = rows.where(F.col("tactic").isin(*TACTICS) & F.col("technique").rlike(r"^T\d{4}(\.\d{3})?$")).distinct()
    nth = F.row_number().over(Window.partitionBy("row").orderBy("technique", "tactic"))
    return good.withColumn("__n", nth).where(F.col("__n") <= most).drop("__n")


def chain(members: DataFrame, via: DataFrame) -> DataFrame:
    """Each member under the first member that links it: key, parent, depth, nth (its place when the tree is read aloud).

    ``members``: key, place (order of joining); ``via``: key, other. Roots and what stands under one member are read in order
    of place and key.
    """
    first = via.join(members.select(F.col("key").alias("other"), F.col("place").alias("other_place")), "other").join(members, "key").where("other_place < place")
    parent = members.join(first.groupBy("key").agg(F.min_by("other", F.struct("other_place", "other")).alias("parent")), "key", "left").select("key", "place", "parent")
    return reading_order(stored(parent)).select("key", "parent", "depth", "nth")


def reading_order(tree: DataFrame) -> DataFrame:
    """``tree`` (key, place, parent) with depth and nth, with work in proportion to its size, however deep it is.

    A parent has an earlier place, so along (place, key) members are cut into blocks, and no way up to a root enters a block
    twice. Sums along ways within a block are one loop of a task. What is left is a tree of the members whose parent is in
    another block (tops), no deeper than there are blocks; on it ways are doubled.
    """
    part = F.floor(F.col("place") / BLOCK)
    at = F.row_number().over(Window.partitionBy("__part").orderBy("place", "key")) - 1
    rows = tree.withColumn("__part", part).withColumn("__at", at).select("key", "place", "parent", (F.col("__part") * 2**20 + F.floor(F.col("__at") / BLOCK)).cast("long").alias("block"), (F.col("__at") % BLOCK).cast("int").alias("i"))
    rows = stored(rows)
    up = rows.select(F.col("key").alias("parent"), F.col("block").alias("up_block"), F.col("i").alias("up_i"))
    # Whose parent isn't an earlier member of the block is a top, so that trees whose places don't rise are read too.
    near = (F.col("up_block") == F.col("block")) & (F.col("up_i") < F.col("i"))
    rows = stored(rows.join(up, "parent", "left").select("key", "place", "parent", "block", "i", F.when(near, F.col("up_i")).otherwise(-1).alias("up"), F.lit(1).cast("long").alias("size")))

    # Sizes: of each top what is below it in its block, then what hangs below that in other blocks.
    below = stored(_in_blocks(rows, "size", down=True))
    node = below.select(F.col("key").alias("parent"), F.col("top").alias("over"))
    tops = stored(below.where("up < 0").join(node, "parent", "left").select("key", "parent", F.col("sum").alias("own"), "over"))
    whole = _below(tops.select("key", "own", "over"))
    hung = tops.where("parent is not null").join(whole, "key").groupBy(F.col("parent").alias("key")).agg(F.sum("total").alias("hung"))
    rows = rows.join(hung, "key", "left").withColumn("size", F.col("size") + F.coalesce("hung", F.lit(0))).drop("hung")
    sized = stored(_in_blocks(rows, "size", down=True).select("key", "place", "parent", "block", "i", "up", F.col("sum").alias("size")))

    # Steps from a parent to a member when read aloud: itself and all that its earlier siblings hold.
    sibling = F.floor(F.col("place") / SIBLINGS).cast("long")
    steps = carried(sized, ["parent"], [F.col("place"), F.col("key")], sibling, total={"step": F.col("size")}, inclusive=False).withColumn("step", F.col("step") + 1)
    ways = stored(_in_blocks(steps, "step", down=False))
    node = ways.select(F.col("key").alias("parent"), F.col("top").alias("over"), F.col("sum").alias("steps"), F.col("ups").alias("ups"))
    tops = ways.where("up < 0 and parent is not null").select("key", "parent").join(node, "parent").select("key", "over", "steps", "ups")
    entered = _above(stored(tops)).select(F.col("key").alias("top"), F.col("steps").alias("__steps"), F.col("ups").alias("__ups"))
    out = ways.join(entered, "top", "left")
    return out.select("key", "place", "parent", (F.col("ups") + F.coalesce("__ups", F.lit(0)) - 1).alias("depth"), (F.col("sum") + F.coalesce("__steps", F.lit(0)) - 1).alias("nth"))


def _in_blocks(rows: DataFrame, value: str, down: bool) -> DataFrame:
    """``rows`` with sums of ``value`` within their block: over all below a member or, if not ``down``, along its way to its top;
    ``top`` (the last member of that way) and ``ups`` (the members on it)."""
    schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("parent", pa.string()), ("up", pa.int32()), ("block", pa.int64()), ("i", pa.int32()), ("top", pa.string()), ("sum", pa.int64()), ("ups", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        keys, ups, sums = block.column("key").to_pylist(), block.column("up").to_pylist(), block.column(value).to_pylist()
        tops, n = list(keys), [1] * len(keys)
        for i, up in enumerate(ups):
            if up >= 0:
                tops[i], n[i] = tops[up], n[up] + 1
                if not down:
                    sums[i] += sums[up]
        if down:
            for i in range(len(ups) - 1, -1, -1):
                if ups[i] >= 0:
                    sums[ups[i]] += sums[i]
        made = [pa.array(tops, type=pa.string()), pa.array(sums, type=pa.int64()), pa.array(n, type=pa.int64())]
        return pa.table([*(block.column(c).cast(schema.field(c).type) for c in schema.names[:6]), *made], schema=schema)

    told = rows.select("key", F.col("place").cast("long").alias("place"), "parent", F.col("up").cast("int").alias("up"), "block", "i", F.col(value).cast("long").alias(value))
    kind = "key string, place long, parent string, up int, block long, i int, top string, sum long, ups long"
    return told.groupBy("block").applyInArrow(run, kind)


def _below(tops: DataFrame) -> DataFrame:
    """key, total: ``own`` of all of ``tops`` (key, own, over) that are below each or itself, in rounds that look twice as far."""
    tops = tops.select("key", F.col("own").alias("total"), "over")
    while not tops.where("over is not null").isEmpty():
        from_below = tops.where("over is not null").groupBy(F.col("over").alias("key")).agg(F.sum("total").alias("more"))
        ahead = tops.select(F.col("key").alias("over"), F.col("over").alias("beyond"))
        tops = stored(tops.join(from_below, "key", "left").join(ahead, "over", "left").select("key", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), F.col("beyond").alias("over")))
    return tops.select("key", "total")


def _above(tops: DataFrame) -> DataFrame:
    """``tops`` (key, over, steps, ups) with sums of steps and ups of all on their way up, in rounds that look twice as far."""
    while not tops.where("over is not null").isEmpty():
        ahead = tops.select(F.col("key").alias("over"), F.col("over").alias("beyond"), F.col("steps").alias("more"), F.col("ups").alias("higher"))
        tops = stored(tops.join(ahead, "over", "left").select("key", F.col("beyond").alias("over"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("ups") + F.coalesce("higher", F.lit(0))).alias("ups")))
    return tops


def telemetry_lines(events: DataFrame, budget: int = 100_000) -> DataFrame:
    """Readable lines of starts, injections, handles, executable writes, autostarts and installs, cut into chunks.

    ``chunk`` rises along (time, event_id) within a day. Lines are whole and the lines of a chunk have at most ``budget``
    characters, each with its line break; a line of over half of that stands alone, even if it is longer. Characters so far
    are summed up by minutes, so a busy day is spread over its minutes.
    """
    line = F.concat_ws(" ", "time", "host", "kind", F.coalesce("process", "entity"), "detail")
    rows = events.select("event_id", "time", line.alias("line"), F.substring("time", 1, 10).alias("day"))
    rows = rows.withColumn("size", F.char_length("line").cast("long") + 1)
    alone = F.col("size") > budget // 2
    longest = rows.where(~alone).groupBy(F.col("day").alias("__day")).agg(F.max("size").alias("longest"))
    rows = carried(rows, ["day"], [F.col(c).asc() for c in ("time", "event_id", "line")], F.substring("time", 1, 16), total={"before": F.when(alone, 0).otherwise(F.col("size")), "n_alone": alone.cast("long")}, inclusive=False)
    rows = rows.join(longest, F.col("day").eqNullSafe(F.col("__day")), "left")
    # Lines that begin within such a width end within the budget; a line that stands alone takes a number, and the next lines a new one.
    width = budget - F.coalesce("longest", F.lit(0))
    return rows.select("day", (F.floor(F.col("before") / width) + 2 * F.col("n_alone") + alone.cast("long")).alias("chunk"), "event_id", "line")


def batching_difference(alone: DataFrame, batched: DataFrame, threshold: float = 0.8) -> DataFrame:
    """How answers to the same candidates (key, probability) differ: n, most, mean, flips over the threshold."""
    both = alone.select("key", F.col("probability").alias("a")).join(batched.select("key", F.col("probability").alias("b")), "key")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("n"), F.max(gap).alias("most"), F.avg(gap).alias("mean"), F.count_if((F.col("a") >= threshold) != (F.col("b") >= threshold)).alias("flips"))


def ground_truth(found: DataFrame, truth: DataFrame, tolerance: int = 5_000_000) -> DataFrame:
    """Hits, precision and misses of found (name, pid, start) against truth by name, PID and start."""
    t = truth.select(F.lower("name").alias("n"), F.col("pid").alias("p"), F.col("start").alias("s")).distinct()
    f = found.select(F.lower("name").alias("name"), "pid", "start").distinct()
    match = f.join(t, (f.name == t.n) & (f.pid == t.p) & (F.abs(f.start - t.s) <= tolerance), "left")
    hits = match.where("n is not null").select("n", "p", "s").distinct()
    return hits.agg(F.count("*").alias("hits")).join(f.agg(F.count("*").alias("found"))).join(t.agg(F.count("*").alias("truth"))).select("hits", "found", "truth", (F.col("hits") / F.col("found")).alias("precision"), (F.col("truth") - F.col("hits")).alias("missed"))
