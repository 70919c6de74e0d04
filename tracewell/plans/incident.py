"""The whole analysis: load inputs, find a seed, investigate, report."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tracewell.functions.text import canonical_host, canonical_user, guid
from tracewell.operators.dedup import combined
from tracewell.operators.describe import Picture
from tracewell.operators.entities import entity_observations
from tracewell.operators.identity import resolve_processes
from tracewell.operators.links import merged, process_observations, touching
from tracewell.operators.normalize import classify, read_statistics, to_events
from tracewell.operators.tables import stored
from tracewell.plans.investigate import Investigation, Options, investigate
from tracewell.plans.learn import Learner, apply_mappings, check_parents, learn, profiles, schema_summaries
from tracewell.plans.questions import JudgedLearner, judged_summaries
from tracewell.plans.report import Report, report
from tracewell.sources.readers import Input, read_inputs


class SeedError(LookupError):
    """No seed matches, with the reason."""


@dataclass
class Loaded:
    """Everything after linking. ``acted``: events with their actor; ``entity_events``: key, seq."""

    events: DataFrame
    acted: DataFrame
    nodes: DataFrame
    actor: DataFrame
    target: DataFrame
    entity_events: DataFrame
    links: DataFrame
    touching: DataFrame
    statistics: dict = field(default_factory=dict)
    duplicates: int = 0
    inputs: list[dict] = field(default_factory=list)
    schemas: list[dict] = field(default_factory=list)


def assemble(events: DataFrame) -> Loaded:
    """Deduplicate, resolve processes, link; each result is stored once, as several operators read it."""
    rows = stored(combined(events))
    processes = resolve_processes(rows)
    entities = entity_observations(rows, processes.actor)
    seen = stored(process_observations(rows, processes).unionByName(entities.observations))
    found = seen.where("type = 'injected'").groupBy("from", "to").agg(F.min_by("detail", "seq").alias("d"))
    how = F.regexp_extract("d", r"^(.*?)(?: \(([^()]*)\))?$", 1)
    found = found.select("from", "to", F.split(how, r" \+ ").alias("steps"), F.filter(F.split(F.regexp_extract("d", r"^(.*?)(?: \(([^()]*)\))?$", 2), ", "), lambda x: x != "").alias("techniques")).withColumn("type", F.lit("injected"))
    links = stored(merged(seen).join(found, ["type", "from", "to"], "left"))
    nodes = stored(processes.nodes.unionByName(entities.nodes))
    acted = stored(rows.join(processes.actor.withColumnRenamed("key", "actor"), "seq", "left"))
    return Loaded(rows, acted, nodes, processes.actor, processes.target, stored(entities.events), links, stored(touching(links)))


def load(spark: SparkSession, sources: list[Input | str], learner: Learner | JudgedLearner | None = None) -> Loaded:
    """Read all inputs; records of unknown schemas are learned by ``learner``, or left out without one."""
    read, made = Observation("read"), Observation("made")
    classified = stored(classify(read_inputs(spark, sources)).observe(read, F.count(F.lit(1)).alias("records"), F.count_if("unknown").alias("unknown")))
    each = [F.count_if(F.col("file") == k).alias(f"kept_{k}") for k in range(len(sources))]
    known = stored(to_events(classified).observe(made, F.count(F.lit(1)).alias("kept"), F.count_if(F.col("t").isNull()).alias("untimed"), *each))
    statistics = read_statistics(read.get, made.get, classified)
    events, schemas = known, []
    unknown = classified.where("unknown").select("file", "line", "id", "line_id", "nested", "flat", "names")
    if statistics["unknown"] and learner is not None:
        if isinstance(learner, JudgedLearner):
            mappings = learner.mappings(unknown)
            learned = stored(apply_mappings(unknown, mappings))
            schemas = judged_summaries(mappings, learned)
        else:
            groups = profiles(unknown)
            mappings = learn(groups, learner)
            learned = stored(apply_mappings(unknown, mappings))
            schemas = schema_summaries(groups, mappings, learned)
        events = known.unionByName(learned)
    loaded = assemble(events)
    loaded.statistics, loaded.schemas = statistics, check_parents(schemas, loaded)
    loaded.duplicates = events.count() - loaded.events.count()
    loaded.inputs = [{"path": s.path if isinstance(s, Input) else s, "records": statistics["by_input"].get(k, 0), "kept": made.get[f"kept_{k}"]} for k, s in enumerate(sources)]
    return loaded


def find_seed(loaded: Loaded, selector: str) -> tuple[str, str | None]:
    """The key that ``selector`` names, and a note: an event's id, name:, guid:, ip:, domain:, user: or host:."""
    spark = loaded.nodes.sparkSession
    value = lambda f, v: spark.range(1).select(f(F.lit(v)).alias("v")).first()["v"]
    m = re.match(r"(ip|domain|user|host):(.+)\Z", selector, re.I | re.S)
    if m:
        kind = m[1].lower()
        name = value(canonical_user, m[2]) if kind == "user" else value(canonical_host, m[2]) if kind == "host" else m[2].strip().lower()
        key = f"{kind}:{name or ''}"
        if loaded.nodes.where(F.col("key") == key).isEmpty():
            raise SeedError(f"no {'account' if kind == 'user' else kind} {name} in the input")
        return key, None
    if selector.startswith("name:"):
        found = loaded.nodes.where("n_starts > 0").where(F.lower("name") == selector[5:].lower())
        first = found.orderBy(F.col("start").asc_nulls_last(), "key").first()
        if first is None:
            raise SeedError(f"no process start named {selector[5:]} in the input")
        n = found.count()
        return first["key"], f"{n} starts of {first['name']}; using the earliest" if n > 1 else None
    if selector.startswith("guid:"):
        first = loaded.acted.where(F.col("proc.guid") == guid(F.lit(selector[5:]))).where("actor is not null").orderBy("seq").first()
        if first is None:
            raise SeedError(f"no process with GUID {selector[5:]} in the input")
        return first["actor"], None
    first = loaded.acted.where(F.col("id") == selector).orderBy(F.col("kind") != "process_start", "seq").first()
    if first is None:
        raise SeedError(f"no event with ID {selector}; use an event ID, name:<image> or guid:<GUID>")
    if first["actor"] is None:
        raise SeedError(f"event {selector} names no process; seed with ip:, user:, host: or domain: instead")
    return first["actor"], None


def picture(loaded: Loaded, seed: str) -> Picture:
    s = loaded.nodes.where(F.col("key") == seed).select("host", F.coalesce("start", "first_seen").alias("at")).first()
    return Picture(loaded.acted, loaded.nodes, loaded.touching, loaded.entity_events, s["at"], s["host"])


def analyze(loaded: Loaded, seed: str, options: Options | None = None, context: bool = False) -> tuple[Report, Investigation]:
    options = options or Options()
    found = investigate(picture(loaded, seed), seed, options)
    return report(loaded, found, seed, options.confirmed, context), found


def source_counts(classified: DataFrame, top: int = 15) -> DataFrame:
    """The sources with most records."""
    return classified.where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").limit(top)


def seed_listing(loaded: Loaded) -> DataFrame:
    """Every started process by its start."""
    return loaded.nodes.where("n_starts > 0").select("key", "name", "pid", "host", "start", F.substring("cmd", 1, 300).alias("command")).orderBy(F.col("start").asc_nulls_last(), "key")


def search_seeds(listing: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """rows with ``text`` in any column, whatever the case."""
    hit = F.lit(False)
    for c in listing.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return listing.where(hit).limit(limit)


def load_summary(loaded: Loaded) -> dict:
    """S20."""
    types = {r["type"]: r["count"] for r in loaded.nodes.groupBy("type").count().collect()}
    top = sorted(loaded.statistics.get("by_source", {}).items(), key=lambda kv: (-kv[1], kv[0]))[:8]
    return {"processes": types.pop("process", 0), "entities": types, "links": loaded.links.count(), "sources": top}
