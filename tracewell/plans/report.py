"""What an investigation found: members, rejected candidates, a timeline, counters, and what a later run needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.masks import CREATE_PROCESS, has, hexadecimal, injection_capable
from tracewell.functions.text import same_detail
from tracewell.functions.times import SKEW, iso, relative
from tracewell.operators import describe
from tracewell.operators.fold import folded_runs, identical_members, with_runs
from tracewell.operators.tables import stored
from tracewell.plans.investigate import Investigation

#: How long after an incident process reaches into another one that one's activity is shown, and how much of it.
AFTER, NOTES = 300_000_000, 8
#: Records of others kept for each entity in the context.
OUTSIDE = 50
_NEVER = 2**62


@dataclass
class Report:
    incident: DataFrame
    rejected: DataFrame
    timeline: DataFrame
    counters: dict
    context: DataFrame | None = None


def detail() -> Column:
    """One readable string for an event."""
    kind = F.col("kind")
    join = lambda *c: F.nullif(F.concat_ws(" ", *c), F.lit(""))
    aimed = join(F.coalesce("target.name", "target.path"), F.col("api"), hexadecimal(F.col("access")), F.when(F.col("target_suspended"), "(created suspended)"), F.when(F.size("behaviors") > 0, F.concat(F.lit("("), F.array_join("behaviors", ", "), F.lit(")"))))
    flow = F.concat(F.when(F.col("src.ip").isNotNull() & F.col("proc.pid").isNull() & F.col("proc.guid").isNull(), F.concat("src.ip", F.lit(" → "))).otherwise(""), F.coalesce(describe.contact(), F.lit("")))
    came = F.coalesce("src.ip", "src.host")
    return (
        F.when(kind == "process_start", F.coalesce("proc.cmd", "proc.path")).when(kind.isin("inject", "process_access"), aimed).when(kind == "tamper", F.col("tampering"))
        .when(kind.isin("file_create", "file_delete", "file_time", "image_load"), F.col("file_path")).when(kind == "network", flow).when(kind == "dns", F.col("net.domain"))
        .when(kind == "registry_set", F.concat("reg.key", F.lit(" = "), F.coalesce("reg.value", F.lit("")))).when(kind.isin("pipe_create", "pipe_connect"), F.col("pipe"))
        .when(kind.isin("service_install", "task_create"), F.col("launches")).when(kind.isin("logon", "logon_failed"), join(F.col("account"), F.concat(F.lit("from "), came), F.concat(F.lit("type "), F.col("logon_type"))))
        .when(kind == "http_request", join(F.col("src.ip"), F.col("http.method"), F.col("http.url"), F.col("http.status").cast("string")))
    )


def member_rows(keys: DataFrame, loaded, found: Investigation, keep: DataFrame) -> DataFrame:
    """One row for each distinct member of ``keys`` (key, since), identical ones folded into ``repeats``."""
    nodes = loaded.nodes.join(keys, "key").withColumn("place", F.struct(F.coalesce(F.when(F.col("type") == "process", F.coalesce("start", "first_seen")).otherwise(F.coalesce("since", "first_seen")), F.lit(_NEVER)).alias("at"), F.col("key").alias("k")))
    links = found.via()
    via = links.select("key", "type", "other")
    kept = nodes.join(keep.withColumn("__keep", F.lit(True)), "key", "left")
    rep = identical_members(kept.select("key", "place", ((F.col("type") != "process") | F.coalesce("__keep", F.lit(False))).alias("keep"), "host", "path", "name", "cmd", "user", "sha256", "parent"), via.join(keys.select("key"), "key", "left_semi"))
    rows = nodes.join(rep, "key").join(found.decisions.drop("joined_at"), "key", "left")
    labels = loaded.nodes.select(F.col("key").alias("other"), F.when(F.col("type") == "process", describe.node_label()).otherwise(F.concat("name", F.lit(" ("), "type", F.lit(")"))).alias("label"))
    said = links.join(keys.select("key"), "key", "left_semi").join(labels, "other", "left")
    said = said.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("type").alias("link"), F.col("label").alias("from"), F.col("other").alias("from_key"), iso(F.col("t")).alias("at"), "detail"))), lambda v: v.dropFields("n")).alias("via"))
    starts = loaded.events.select(F.col("seq").alias("first_start"), F.col("id").alias("start_event"))
    rows = rows.join(said, "key", "left").join(starts, "first_start", "left")
    head = rows.where("key = rep")
    others = rows.where("key <> rep").select(F.col("rep").alias("key"), F.struct("place", F.col("key").alias("key"), "pid", iso(F.col("start")).alias("start"), "probability", "path", F.col("cmd").alias("command_line")).alias("o"))
    others = others.groupBy("key").agg(F.transform(F.sort_array(F.collect_list("o")), lambda o: o.dropFields("place")).alias("others"))
    head = head.join(others, "key", "left")
    last = F.array_max(F.transform("others", lambda o: o["start"]))
    repeats = F.when(F.size("others") > 0, F.struct((F.size("others") + 1).alias("count"), last.alias("last_start"), "others"))
    return head.select(
        "place", "type", "name", "pid", "host", "path", F.col("cmd").alias("command_line"), "user", "sha256", iso(F.col("start")).alias("start"), F.when(F.col("type") != "process", iso(F.col("first_seen"))).alias("first_seen"), iso(F.col("end")).alias("end"),
        "key", F.when(F.col("n_starts") > 0, F.col("start_event")).alias("start_event"), iso(F.col("since")).alias("joined_incident"), "round", "probability", "threshold", "request", "review", "group_size", "basis", "via", repeats.alias("repeats"),
    ).orderBy("place").drop("place")


def unfolded(rows: DataFrame) -> DataFrame:
    """Key, head (the row's key), probability: every member that rows stand for."""
    heads = rows.select("key", F.col("key").alias("head"), "probability")
    return heads.union(rows.where("repeats is not null").select(F.col("key").alias("head"), F.explode("repeats.others").alias("o")).select("o.key", "head", "o.probability"))


def follow_ups(events: DataFrame, loaded, members: DataFrame) -> DataFrame:
    """Seq, target, target_after: what an outside process did within AFTER of an incident process reaching into it."""
    reach = events.where(F.col("kind").isin("inject", "process_access") & F.col("t").isNotNull())
    reach = reach.where((F.col("kind") == "inject") | (injection_capable(F.col("access")) | has(F.col("access"), CREATE_PROCESS)))
    reach = reach.select("seq", "t").join(loaded.target.withColumnRenamed("key", "to"), "seq").join(members.select(F.col("key").alias("to")), "to", "left_anti")
    outside = loaded.nodes.select(F.col("key").alias("to"), F.concat(F.coalesce("name", F.lit("a process")), F.lit(" ("), F.coalesce(F.col("pid").cast("string"), F.lit("?")), F.lit(")")).alias("target"))
    reach = stored(reach.join(outside, "to"))
    started = F.concat(F.lit("started "), F.coalesce("name", F.lit("a process")), F.coalesce(F.concat(F.lit(": "), F.substring("cmd", 1, 200)), F.lit("")))
    child = loaded.nodes.where("start is not null").select(F.col("parent").alias("to"), F.col("start").alias("at"), F.lit(0).alias("rank"), F.col("first_start").alias("s"), started.alias("note"))
    verbs = {"network": "connected to ", "dns": "looked up ", "file_create": "wrote ", "inject": "injected into ", "process_access": "opened ", "registry_set": "set "}
    verb = F.lit(None).cast("string")
    for k, v in verbs.items():
        verb = F.when((F.col("kind") == k) & (F.lit(k != "process_access") | F.coalesce(injection_capable(F.col("access")), F.lit(False))), v).otherwise(verb)
    did = loaded.acted.where("t is not null").select(F.col("actor").alias("to"), F.col("t").alias("at"), F.lit(1).alias("rank"), F.col("seq").alias("s"), F.concat(verb, detail()).alias("note"))
    notes = child.unionByName(did).where("note is not null").join(reach.select("to").distinct(), "to", "left_semi")
    width = F.lit(AFTER)
    hit = reach.withColumn("b", F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1))).join(notes.withColumn("b", F.floor(F.col("at") / width)), ["to", "b"]).where((F.col("at") > F.col("t")) & (F.col("at") <= F.col("t") + AFTER))
    first = hit.groupBy("seq", "note").agg(F.min(F.struct("rank", "at", "s")).alias("o"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("o"))).where(F.col("n") <= NOTES)
    first = first.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "note"))), lambda x: x["note"]).alias("target_after"))
    return reach.select("seq", "target").dropDuplicates(["seq"]).join(first, "seq", "left")


def timeline(loaded, found: Investigation, seed: str, reps: DataFrame) -> DataFrame:
    """The incident's events in time order, repeats of one activity folded into one row."""
    members = found.members
    origin = loaded.nodes.where(F.col("key") == seed).select(F.coalesce("start", "first_seen").alias("o")).first()["o"]
    acted = loaded.acted
    mine = acted.join(members.select(F.col("key").alias("actor"), "since"), "actor").where((F.col("actor") == seed) | F.col("since").isNull() | F.col("t").isNull() | (F.col("t") >= F.col("since") - SKEW))
    owned = loaded.entity_events.join(members.select("key", "since", "place"), "key").join(loaded.nodes.select("key", "name", "type", "first_seen"), "key")
    first = F.struct(F.coalesce("since", "first_seen", F.lit(_NEVER)).alias("at"), "key")
    owned = owned.groupBy("seq").agg(F.min_by(F.struct(F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("entity"), F.col("key").alias("entity_key")), first).alias("e")).select("seq", "e.*")
    other = acted.join(owned, "seq").join(members.select(F.col("key").alias("actor")), "actor", "left_anti")
    shown = mine.drop("since").withColumn("entity", F.lit(None).cast("string")).withColumn("entity_key", F.lit(None).cast("string")).unionByName(other)
    shown = shown.withColumn("detail", detail()).join(reps.select(F.col("key").alias("actor"), F.col("head").alias("rep")), "actor", "left")
    by = F.when(F.col("entity").isNull(), F.coalesce("rep", "actor")).otherwise(F.concat_ws("|", "entity", F.coalesce("actor", F.lit(""))))
    shown = shown.withColumns({"by": by, "same": same_detail(F.col("kind"), F.col("detail"))})
    key = ["host", "by", "kind", "same"]
    shown = stored(with_runs(shown.select("seq", "t", "id", "file", "line", "source", "actor", "entity", "entity_key", "detail", *key), key))
    once = F.col("kind").isin("process_start", "process_end")
    # A process starts and ends once, however many sources recorded it.
    nth = F.row_number().over(Window.partitionBy(*key, "run", "actor").orderBy(F.col("t").asc_nulls_last(), "seq"))
    counted = shown.withColumn("n", nth).where(~once | (F.col("n") == 1))
    runs = folded_runs(counted, [*key, "run"], split=False)
    variants = shown.groupBy(*key, "run").agg((F.count_distinct("detail") + F.max(F.when(F.col("detail").isNull(), 1).otherwise(0))).alias("variants"))
    equal = F.lit(True)
    for k in (*key, "run"):
        equal = equal & F.col(f"r.{k}").eqNullSafe(F.col(f"v.{k}"))
    runs = runs.alias("r").join(variants.alias("v"), equal).select("r.*", "v.variants")
    head = shown.select("seq", "id", "file", "line", "source", "actor", "entity", "entity_key", F.col("t").alias("at"), "detail")
    last = shown.select(F.col("seq").alias("last_seq"), F.col("id").alias("last_id"))
    rows = runs.join(head, runs.first_seq == head.seq).join(last, "last_seq").join(follow_ups(acted.join(shown.select("seq"), "seq", "left_semi"), loaded, members), "seq", "left")
    who = loaded.nodes.select(F.col("key").alias("actor"), F.col("name").alias("process"), "pid")
    rows = rows.join(who, "actor", "left")
    many, process, zero = F.col("count") > 1, F.col("entity").isNull(), F.lit(origin).cast("long")
    place = F.struct(F.coalesce("at", F.lit(_NEVER)).alias("t"), "seq")
    return rows.select(
        place.alias("place"), iso(F.col("at")).alias("time"), relative(F.col("at"), zero).alias("since_seed"), "host", F.when(process, F.col("process")).alias("process"), F.when(process, F.col("pid")).alias("pid"), "entity",
        F.when(process, F.col("actor")).otherwise(F.col("entity_key")).alias("member"), "kind", "detail", F.col("id").alias("event_id"), F.col("file").alias("input"), "line", "source", F.when(many, F.col("count")).alias("count"),
        F.when(many, iso(F.col("last_t"))).alias("until"), F.when(many, relative(F.col("last_t"), zero)).alias("until_since_seed"), F.when(many, F.col("every_s")).alias("every_s"), F.when(many, F.col("last_id")).alias("last_event_id"),
        F.when(many & (F.col("variants") > 1), F.col("variants")).alias("variants"), "target", "target_after",
    ).orderBy("place").drop("place")


def context_records(loaded, found: Investigation) -> DataFrame:
    """Input, line of the records that rebuild the incident: members' own, and for each entity those with members and
    the OUTSIDE earliest others."""
    mine = loaded.acted.join(found.members.select(F.col("key").alias("actor")), "actor", "left_semi").select("file", "line")
    entities = found.members.select("key").union(found.decisions.select("key")).distinct()
    near = loaded.entity_events.join(entities, "key", "left_semi").join(loaded.acted.select("seq", "t", "file", "line", "actor"), "seq")
    near = near.join(found.members.select(F.col("key").alias("actor"), F.lit(1).alias("member")), "actor", "left")
    others = near.where("member is null").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("t", F.lit(0)), "seq"))).where(F.col("n") <= OUTSIDE)
    return mine.union(near.where("member = 1").select("file", "line")).union(others.select("file", "line")).distinct().select(F.col("file").alias("input"), "line").orderBy("input", "line")


def report(loaded, found: Investigation, seed: str, confirmed: tuple[str, ...] = (), context: bool = False) -> Report:
    """A18 and all rows."""
    spark = loaded.nodes.sparkSession
    keep = spark.createDataFrame([(k,) for k in (seed, *confirmed)], "key string")
    incident = stored(member_rows(found.members.select("key", "since"), loaded, found, keep))
    no = found.decisions.where("not related").select("key", F.lit(None).cast("long").alias("since"))
    rejected = stored(member_rows(no, loaded, found, keep.limit(0)))
    rows = stored(timeline(loaded, found, seed, unfolded(incident)))
    one = lambda df: df.collect()[0]
    types = {r["type"]: r["count"] for r in loaded.links.groupBy("type").count().collect()}
    near = one(found.decisions.agg(F.count_if("review").alias("n"), F.count_distinct(F.when(F.col("review"), F.concat_ws("|", "request", F.col("probability").cast("string")))).alias("answers")))
    shown = one(rows.agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"), F.count("*").alias("rows")))
    counters = {
        "events": loaded.acted.count(), "processes": loaded.nodes.where("type = 'process'").count(), "entities": loaded.nodes.where("type <> 'process'").count(), "links": sum(types.values()), "links_by_type": types,
        "timeline_events": shown["n"] or 0, "timeline_rows": shown["rows"], "rounds": found.rounds, "candidates_asked": found.history.count(), "near_threshold": near["answers"], "near_threshold_candidates": near["n"], "stopped": found.stopped,
    }
    return Report(incident.orderBy(F.coalesce("start", "joined_incident", "first_seen"), "key"), rejected, rows.orderBy(F.col("time").asc_nulls_last(), "input", "line"), counters, context_records(loaded, found) if context else None)


def findings(found: Report) -> DataFrame:
    """One row on what was found, with a ``line`` that says it: members, processes and others among them, candidates
    asked about, rounds, answers near the threshold, rows of the timeline and the events that they stand for, why it ended early."""
    c = found.counters
    told = {k: c[k] for k in ("candidates_asked", "rounds", "near_threshold", "timeline_rows", "timeline_events")}
    stands_for = F.coalesce(F.col("repeats.count"), F.lit(1)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    row = found.incident.agg(total(stands_for).alias("members"), total(F.when(F.col("type") == "process", stands_for)).alias("processes"))
    row = row.select("members", "processes", (F.col("members") - F.col("processes")).alias("others"), *[F.lit(v).cast("long").alias(k) for k, v in told.items()], F.lit(c["stopped"]).cast("string").alias("stopped"))
    number = lambda name, one, many: F.concat(F.col(name).cast("string"), F.when(F.col(name) == 1, f" {one}").otherwise(f" {many}"))
    parts = [
        F.concat(number("members", "member", "members"), F.lit(": "), number("processes", "process", "processes"), F.lit(" and "), number("others", "account, host, address or domain", "accounts, hosts, addresses or domains")),
        F.concat(number("candidates_asked", "candidate asked", "candidates asked"), F.lit(" over "), number("rounds", "round", "rounds")),
        F.when(F.col("near_threshold") > 0, number("near_threshold", "answer to review", "answers to review")),
        F.concat(number("timeline_rows", "timeline row", "timeline rows"), F.lit(" from "), number("timeline_events", "event", "events")),
        F.concat(F.lit("stopped early: "), "stopped"),
    ]
    return row.withColumn("line", F.concat_ws(" · ", *parts))
