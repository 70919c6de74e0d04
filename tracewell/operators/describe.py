"""What is known of candidates, as the JSON that a judge reads: summaries, activity, prevalence, links in words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.masks import hexadecimal, injection_capable
from tracewell.functions.net import is_internal
from tracewell.functions.text import clip, executable, persistence_key
from tracewell.functions.times import SKEW, relative

SAMPLES = 5
_NEVER = 2**62
# How a link reads from the candidate's side (as the link's target, as its source).
PHRASES = {
    "spawned": ("started this process", "started this process"),
    "injected": ("injected code into this process", "injected code into this process"),
    "opened_for_injection": ("opened this process with injection-capable access", "opened this process with injection-capable access"),
    "dropped_and_ran": ("wrote the file this process was started from", "wrote the file this process was started from"),
    "dropped_and_loaded": ("wrote a DLL this process loaded", "wrote a DLL this process loaded"),
    "pipe": ("shares a named pipe with this candidate", "shares a named pipe with this candidate"),
    "persisted_and_ran": ("registered persistence that later started this process", "registered persistence that later started this process"),
    "contacted": ("contacted this candidate", "was contacted by this candidate"),
    "logged_on": ("logged on to this candidate", "is a host this account logged on to"),
    "logon_from": ("logged on to this candidate", "received a logon from this candidate"),
    "used_account": ("logged on using this account", "is an account this candidate logged on as"),
    "failed_logon": ("tried and failed to log on as this account", "is an account this candidate failed to log on as"),
    "requested": ("sent web requests to this candidate", "received web requests from this candidate"),
}
# How a relation reads from one of its ends (as source, as target), and what node types are called.
RELATIONS = {
    "contacted": ("contacted", "contacted by"), "logged_on": ("logged on to", "logons by accounts"), "logon_from": ("logged on to", "logons from"), "used_account": ("logged on as", "logons from"),
    "failed_logon": ("failed to log on as", "failed logons from"), "requested": ("sent web requests to", "web requests from"), "pipe": ("shares a named pipe with", "shares a named pipe with"),
}
TYPE_NAMES = {"process": "process", "host": "host", "user": "account", "ip": "IP address", "domain": "domain"}
PLURALS = {"process": "processes", "host": "hosts", "user": "accounts", "ip": "addresses", "domain": "domains"}


def _choose(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def link_text(type_: Column, candidate_is_target: Column) -> Column:
    """P38."""
    return F.when(candidate_is_target, _choose(type_, {k: v[0] for k, v in PHRASES.items()})).otherwise(_choose(type_, {k: v[1] for k, v in PHRASES.items()}))


def relation(type_: Column, as_source: Column) -> Column:
    """P39."""
    return F.when(as_source, _choose(type_, {k: v[0] for k, v in RELATIONS.items()})).otherwise(_choose(type_, {k: v[1] for k, v in RELATIONS.items()}))


def node_label() -> Column:
    """Name (pid) of a process, else the name."""
    return F.when(F.col("type") == "process", F.concat(F.coalesce("name", F.lit("?")), F.lit(" ("), F.coalesce(F.col("pid").cast("string"), F.lit("?")), F.lit(")"))).otherwise(F.coalesce("name", "key"))


def contact() -> Column:
    """Where a connection went."""
    return F.nullif(F.concat_ws(":", F.coalesce("net.domain", "net.ip"), F.col("net.port").cast("string")), F.lit(""))


@dataclass
class Picture:
    """What descriptions draw on: all events, nodes and links, and the seed's origin in time and host."""

    events: DataFrame  # with actor
    nodes: DataFrame
    touching: DataFrame
    entity_events: DataFrame
    origin: int | None
    seed_host: str

    @property
    def zero(self) -> Column:
        return F.lit(self.origin).cast("long")


def summaries(keys: DataFrame, members: DataFrame, p: Picture) -> DataFrame:
    """``key``, ``summary`` and ``what`` (the summary without PID and times) of ``keys`` (key)."""
    nodes = p.nodes.join(keys.select("key").distinct(), "key", "left_semi")
    names = p.nodes.select(F.col("key").alias("parent"), F.col("name").alias("parent_name"))
    process = nodes.where("type = 'process'").join(names, "parent", "left")
    fixed = [F.lit("process").alias("type"), F.col("name"), F.col("path"), clip(F.col("cmd"), 600).alias("command_line")]
    more = [F.col("user"), F.col("sha256"), F.when(F.col("host") != p.seed_host, F.col("host")).alias("host")]
    first = F.coalesce(relative(F.col("first_seen"), p.zero), F.lit("unknown"))
    started = F.when(F.col("start").isNotNull(), relative(F.col("start"), p.zero)).otherwise(F.concat(F.lit("before the logs (first seen "), first, F.lit(")")))
    process = process.select("key", F.to_json(F.struct(*fixed, F.col("pid"), *more, started.alias("started"), relative(F.col("end"), p.zero).alias("ended"), F.col("parent_name").alias("parent"))).alias("summary"), F.to_json(F.struct(*fixed, *more, F.col("parent_name").alias("parent"))).alias("what"))

    entity = nodes.where("type <> 'process'")
    near = p.touching.join(entity.select(F.col("key").alias("node")), "node", "left_semi").select("node", "other").distinct().join(p.nodes.select(F.col("key").alias("other"), F.col("type").alias("kind")), "other")
    near = near.join(members.select(F.col("key").alias("other"), F.lit(1).alias("member")), "other", "left")
    counts = near.groupBy("node").pivot("kind", list(PLURALS)).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("member").isNull()).alias("out"))
    seen = F.struct(*[F.col(f"{t}_all").alias(PLURALS[t]) for t in sorted(PLURALS)])
    outside = F.struct(*[F.when(F.col(f"{t}_out") > 0, F.col(f"{t}_out")).alias(PLURALS[t]) for t in sorted(PLURALS)])
    none = F.coalesce(*[F.when(F.col(f"{t}_out") > 0, F.lit(1)) for t in PLURALS]).isNull()
    took = p.entity_events.join(entity.select("key"), "key", "left_semi").join(p.events.select("seq", "t"), "seq").groupBy("key").agg(F.count("*").alias("events"), F.max("t").alias("last"))
    entity = entity.join(counts.withColumnRenamed("node", "key"), "key", "left").join(took, "key", "left")
    scope = F.when(F.col("type") == "ip", F.when(is_internal(F.col("name")), "internal").otherwise("external"))
    fixed = [_choose(F.col("type"), TYPE_NAMES).alias("type"), F.col("name"), scope.alias("scope")]
    tail = [F.coalesce("events", F.lit(0)).alias("events"), seen.alias("seen_with"), F.when(none, F.parse_json(F.lit('"none"'))).otherwise(F.parse_json(F.to_json(outside))).alias("seen_outside_incident")]
    entity = entity.select("key", F.to_json(F.struct(*fixed, relative(F.col("first_seen"), p.zero).alias("first_seen"), relative(F.col("last"), p.zero).alias("last_seen"), *tail)).alias("summary"), F.to_json(F.struct(*fixed, *tail)).alias("what"))
    return process.unionByName(entity)


def _top(rows: DataFrame, k: Column | int) -> DataFrame:
    """The first k distinct values of each (key, list), in the order of ``o``, as arrays."""
    rows = rows.where("value is not null and value <> ''").groupBy("key", "list", "value").agg(F.min("o").alias("o"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("key", "list").orderBy("o", "value"))).where(F.col("n") <= k)
    return rows.groupBy("key", "list").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))


def activities(keys: DataFrame, p: Picture) -> DataFrame:
    """``key``, ``activity`` and ``did`` (without ``since``) of ``keys`` (key, since: null for all time)."""
    own = p.events.withColumnRenamed("actor", "key").join(keys, "key")
    own = own.where(F.col("since").isNull() | F.col("t").isNull() | (F.col("t") >= F.col("since") - SKEW))
    place = lambda important: F.struct((~important).alias("i"), F.coalesce("t", F.lit(_NEVER)).alias("t"), "seq")
    of = lambda kinds, name, value, important=F.lit(True): own.where(F.col("kind").isin(*kinds)).select("key", F.lit(name).alias("list"), value.alias("value"), place(F.coalesce(important, F.lit(False))).alias("o"))
    registry = F.concat(F.col("reg.key"), F.lit(" = "), F.coalesce(clip(F.col("reg.value"), 160), F.lit("")))
    peeked = F.concat(F.coalesce("target.name", "target.path", F.lit("a process")), F.lit(" ("), hexadecimal(F.col("access")), F.lit(")"))
    lists = of(("file_create",), "wrote", F.col("file_path"), executable(F.col("file_path")))
    for more in (
        of(("network",), "network", contact()), of(("dns",), "dns", F.col("net.domain")), of(("registry_set",), "registry", registry, persistence_key(F.col("reg.key"))),
        of(("pipe_create", "pipe_connect"), "pipes", F.col("pipe")), of(("process_access",), "accessed", F.when(~injection_capable(F.col("access")), peeked)),
    ):
        lists = lists.unionByName(more)
    out = p.touching.where(F.col("from") == F.col("node")).join(keys.withColumnRenamed("key", "node"), "node")
    out = out.where(F.col("since").isNull() | F.col("act").isNull() | (F.col("act") >= F.col("since") - SKEW)).join(p.nodes.select(F.col("key").alias("to"), F.col("name").alias("to_name"), F.col("pid").alias("to_pid"), F.col("start").alias("to_start")), "to")
    order = F.struct(F.lit(False).alias("i"), F.coalesce("t", F.lit(_NEVER)).alias("t"), F.coalesce("to_pid", F.lit(0)).alias("seq"))
    for type_, name, value in (("spawned", "children", F.col("to_name")), ("injected", "injected_into", F.col("to_name")), ("opened_for_injection", "opened", F.concat("to_name", F.lit(" ("), "detail", F.lit(")")))):
        lists = lists.unionByName(out.where(F.col("type") == type_).select(F.col("node").alias("key"), F.lit(name).alias("list"), value.alias("value"), order.alias("o")))
    top = _top(lists, F.when(F.col("list").isin("registry", "pipes"), 3).otherwise(SAMPLES))
    names = ("children", "wrote", "network", "dns", "registry", "injected_into", "opened", "accessed", "pipes")
    made = top.groupBy("key").pivot("list", list(names)).agg(F.first("values"))
    counts = own.groupBy("key").agg(F.count_if(F.col("kind") == "file_create").alias("write_count"))
    children = out.where("type = 'spawned'").groupBy(F.col("node").alias("key")).agg(F.count("*").alias("child_count"))
    process = keys.join(p.nodes.where("type = 'process'").select("key"), "key").join(made, "key", "left").join(counts, "key", "left").join(children, "key", "left")
    fields = []
    for n in names:
        fields.append(F.col(n))
        if n == "children":
            fields.append(F.coalesce("child_count", F.lit(0)).alias("child_count"))
        if n == "wrote":
            fields.append(F.coalesce("write_count", F.lit(0)).alias("write_count"))
    since = relative(F.col("since"), p.zero).alias("since")
    process = process.select("key", F.to_json(F.struct(*fields, since)).alias("activity"), F.to_json(F.struct(*fields)).alias("did"))

    dealt = p.touching.join(keys.withColumnRenamed("key", "node"), "node").where(F.col("since").isNull() | F.col("t").isNull() | (F.col("t") >= F.col("since") - SKEW))
    label = F.concat(_choose(F.col("type"), TYPE_NAMES), F.lit(" "), node_label())
    others = p.nodes.select(F.col("key").alias("other"), label.alias("label"))
    dealt = dealt.withColumn("relation", relation(F.col("type"), F.col("from") == F.col("node"))).where("relation is not null").join(others, "other")
    dealt = dealt.groupBy("node", "relation", "label").agg(F.min(F.struct(F.coalesce("t", F.lit(_NEVER)).alias("t"), "label")).alias("o"))
    dealt = dealt.withColumn("n", F.row_number().over(Window.partitionBy("node", "relation").orderBy("o")))
    dealt = dealt.groupBy("node", "relation").agg(F.count("*").alias("count"), F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= SAMPLES, F.struct("n", "label")))), lambda x: x["label"]).alias("examples"))
    dealt = dealt.groupBy(F.col("node").alias("key")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", F.struct("count", "examples"))))).alias("relations"))
    entity = keys.join(p.nodes.where("type <> 'process'").select("key"), "key").join(dealt, "key", "left")
    entity = entity.select("key", F.to_json(F.struct("relations", since)).alias("activity"), F.to_json(F.struct("relations")).alias("did"))
    return process.unionByName(entity)
