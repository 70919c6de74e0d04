"""From a seed outwards, round by round: what links reach is scored, and what scores high enough joins."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.functions.text import clip
from tracewell.functions.times import SKEW, relative
from tracewell.operators import describe
from tracewell.operators.describe import Picture
from tracewell.operators.links import conclusive, undirected
from tracewell.operators.tables import stored
from tracewell.plans.judge import Scorer, UnusableAnswer, stand_in

_NEVER = 2**62
DECISION = "key string, round int, group_size long, probability double, related boolean, threshold double, review boolean, request string, basis string, joined_at long"
LINK = "key string, round int, n int, type string, from string, to string, t long, detail string"
SUMMARY = "key string, n long, bits long, mix decimal(38,0), since long, joined_at long, ran boolean, persisted boolean, direct boolean"
MEMBER = "key string, since long, round int, place long"


@dataclass
class Options:
    """``threshold`` for processes, ``entity_threshold`` for what only the incident touches, ``margin`` of review."""

    context: str = ""
    threshold: float = 0.8
    entity_threshold: float = 0.5
    margin: float = 0.05
    max_rounds: int = 20
    max_questions: int = 2000
    group: bool = True
    scorer: Scorer = stand_in
    confirmed: tuple[str, ...] = ()
    on_round: Callable[[int, DataFrame], None] | None = None


@dataclass
class Investigation:
    """``members``: key, since, round, place (join order); ``decisions``: the last for each candidate; ``history``: all.

    ``links``: what each candidate was decided by: key, round, n (their order), type, from, to, t, detail.
    """

    members: DataFrame
    decisions: DataFrame
    history: DataFrame
    links: DataFrame
    rounds: int
    stopped: str | None = None
    states: list[dict] = field(default_factory=list)

    def via(self) -> DataFrame:
        """The links of each candidate's last decision, and ``other``, what it is linked with."""
        return last_links(self.links, self.decisions)


def last_links(links: DataFrame, decisions: DataFrame) -> DataFrame:
    other = F.when(F.col("from") == F.col("key"), F.col("to")).otherwise(F.col("from"))
    return links.join(decisions.select("key", "round"), ["key", "round"]).withColumn("other", other)


def frontier(members: DataFrame, touching: DataFrame) -> DataFrame:
    """Links from members to others that act once the member has joined, less a clock's difference."""
    m = members.select(F.col("key").alias("node"), "since")
    links = touching.join(m, "node")
    act = F.when(undirected(F.col("type")), F.col("last")).when(F.col("from") == F.col("node"), F.col("act")).otherwise(F.col("t"))
    links = links.where(F.col("since").isNull() | act.isNull() | (act >= F.col("since") - SKEW))
    return links.join(m.select(F.col("node").alias("other")), "other", "left_anti")


def reachable(touching: DataFrame, members: DataFrame, max_rounds: int = 20) -> DataFrame:
    """G1 without a scorer: everything that is reached joins; key, since, round.

    since is the earliest of max(link's time, the other side's since) (G4); members of a round are met in the next (G5).
    """
    members = stored(members)
    for n in range(1, max_rounds + 1):
        new = stored(joined(frontier(members, touching)).withColumn("round", F.lit(n)))
        if new.isEmpty():
            break
        members = stored(members.unionByName(new))
    return members


def joined(links: DataFrame) -> DataFrame:
    """When each ``other`` joins by its links; a null time on either side leaves the link's own."""
    at = F.when(F.col("t").isNull() | F.col("since").isNull(), F.col("t")).otherwise(F.greatest("t", "since"))
    return links.groupBy(F.col("other").alias("key")).agg(F.min(at).alias("since"))


def _with_place(nodes: DataFrame) -> DataFrame:
    return nodes.select("key", F.concat_ws("|", F.lower(F.coalesce("name", F.lit(""))), F.coalesce(F.col("pid").cast("string"), F.lit("")), F.coalesce("start", "first_seen").cast("string")).alias("told"))


def candidates(links: DataFrame) -> DataFrame:
    """What is known of each ``other`` of frontier() rows, in values that merge: nothing of a candidate is gathered.

    n, bits and mix are the signature of its set of links; since: the earliest link; joined_at: when it would join; ran,
    persisted: it was dropped and ran, registered and ran; direct: code was injected into it, conclusively.
    """
    triple = F.concat_ws("|", "type", "from", "to")
    to = F.col("to") == F.col("other")
    at = F.when(F.col("t").isNull() | F.col("since").isNull(), F.col("t")).otherwise(F.greatest("t", "since"))
    aimed = lambda t: F.coalesce(F.bool_or((F.col("type") == t) & to), F.lit(False))
    return links.groupBy(F.col("other").alias("key")).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(triple)).alias("bits"), F.sum(F.xxhash64(F.lit("mix"), triple).cast("decimal(38,0)")).cast("decimal(38,0)").alias("mix"), F.min("t").alias("since"), F.min(at).alias("joined_at"),
        aimed("dropped_and_ran").alias("ran"), aimed("persisted_and_ran").alias("persisted"), F.coalesce(F.bool_or((F.col("type") == "injected") & to & conclusive(F.col("steps"), F.col("techniques"))), F.lit(False)).alias("direct"),
    )


def merged_candidates(known: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries of candidates() with those of further links."""
    merge = {"n": F.sum, "bits": F.bit_xor, "mix": F.sum, "since": F.min, "joined_at": F.min, "ran": F.bool_or, "persisted": F.bool_or, "direct": F.bool_or}
    return known.unionByName(new).groupBy("key").agg(*[f(c).cast("decimal(38,0)").alias(c) if c == "mix" else f(c).alias(c) for c, f in merge.items()])


def investigate(p: Picture, seed: str, options: Options) -> Investigation:
    """G1-G6. Members are appended; ``since`` of a member is never revised, and a rejected key is asked again only with other links.

    A round follows only links of those who came in the round before: what is known of a candidate is merged with its new
    links. Links themselves are read again only for the candidates of the round.
    """
    spark = p.nodes.sparkSession
    told = stored(_with_place(p.nodes))
    first = p.nodes.where(F.col("key").isin(seed, *options.confirmed)).select("key", F.coalesce("start", "first_seen").alias("since"), F.lit(0).alias("round"), F.when(F.col("key") == seed, 0).otherwise(1).cast("long").alias("place"))
    members = came = stored(first)
    decisions = history = spark.createDataFrame([], DECISION)
    decided_by = spark.createDataFrame([], LINK)
    known = spark.createDataFrame([], SUMMARY)
    asked = spark.createDataFrame([], "key string, n long, bits long, mix decimal(38,0)")
    number, stopped = 0, None
    known_nodes = p.nodes.select("key", F.col("type").alias("node_type"))
    while number < options.max_rounds:
        fresh = stored(candidates(frontier(came, p.touching).join(members.select(F.col("key").alias("other")), "other", "left_anti")).join(known_nodes.select("key"), "key", "left_semi"))
        known = stored(merged_candidates(known, fresh))
        pending = known.join(fresh.select("key"), "key", "left_semi").join(asked, ["key", "n", "bits", "mix"], "left_anti")
        alone = p.touching.join(fresh.select(F.col("key").alias("node")), "node", "left_semi").join(members.select(F.col("key").alias("other")), "other", "left_anti").select(F.col("node").alias("key")).distinct().withColumn("shared", F.lit(True))
        pending = stored(with_thresholds(pending.join(known_nodes, "key").join(alone, "key", "left"), options))
        if pending.isEmpty():
            break
        links = stored(_shown(frontier(members, p.touching.join(pending.select(F.col("key").alias("other")), "other", "left_semi")), told))
        questions = pending.where("not direct")
        groups, grouped = _groups(questions, links, members, p, options)
        n = groups.count()
        if n > options.max_questions:
            stopped = f"round {number + 1} would ask {n} questions about {pending.count()} candidates (limit {options.max_questions})"
            break
        number += 1
        if options.on_round:
            options.on_round(number, groups)
        state = {"context": options.context, "seed": {"key": seed}, "members": []}
        if options.scorer is not stand_in:
            state = _state(p, seed, members, last_links(decided_by, decisions), groups, options)
        answers = stored(options.scorer(groups, state)) if n else spark.createDataFrame([], "group string, probability double, request string")
        if not answers.where("probability is null or isnan(probability) or probability < 0 or probability > 1").isEmpty() or answers.count() != n:
            raise UnusableAnswer("an answer is no probability between 0 and 1; no decision was assumed")
        sizes = grouped.groupBy("group").agg(F.count("*").alias("group_size"))
        scored = questions.join(grouped, "key").join(sizes, "group").join(answers, "group")
        columns = ["key", "n", "bits", "mix", "joined_at", "threshold"]
        made = scored.select(*columns, "group_size", "probability", (F.col("probability") >= F.col("threshold")).alias("related"), (F.abs(F.col("probability") - F.col("threshold")) < options.margin).alias("review"), "request", F.lit(None).cast("string").alias("basis"))
        sure = pending.where("direct").select(*columns, F.lit(1).cast("long").alias("group_size"), F.lit(1.0).alias("probability"), F.lit(True).alias("related"), F.lit(False).alias("review"), F.lit("").alias("request"), F.lit("injection").alias("basis"))
        new = stored(sure.unionByName(made).withColumn("round", F.lit(number)))
        decided = new.select("key", "round", "group_size", "probability", "related", "threshold", "review", "request", "basis", "joined_at")
        history = stored(history.unionByName(decided))
        decisions = stored(decisions.join(new.select("key"), "key", "left_anti").unionByName(decided))
        decided_by = stored(decided_by.unionByName(links.select("key", F.lit(number).alias("round"), "n", "type", "from", "to", "t", "detail")))
        asked = stored(asked.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "n", "bits", "mix")))
        place = F.row_number().over(Window.partitionBy("round").orderBy(F.col("basis").isNull(), "first", "key")) + number * 1_000_000
        came = new.where("related").join(links.where("n = 1").select("key", F.col("o").alias("first")), "key")
        came = stored(came.select("key", F.col("joined_at").alias("since"), "round", place.cast("long").alias("place")))
        if came.isEmpty():
            break
        members = stored(members.unionByName(came))
    if not stopped and number >= options.max_rounds:
        stopped = f"stopped after {options.max_rounds} rounds"
    return Investigation(members, decisions, history, decided_by, number, stopped)


def with_thresholds(pending: DataFrame, options: Options) -> DataFrame:
    """What only the incident touches, and processes that it dropped and registered, need less to join.

    ``pending``: key, node_type, ran, persisted, and ``shared``, true where an outsider touches it.
    """
    lenient = F.when(F.col("node_type") == "process", F.col("ran") & F.col("persisted")).otherwise(F.col("shared").isNull())
    return pending.withColumn("threshold", F.when(lenient, min(options.threshold, options.entity_threshold)).otherwise(options.threshold))


def _shown(links: DataFrame, told: DataFrame) -> DataFrame:
    """Links of candidates (``key``) in the order in which they are shown: ``n`` from 1, by ``o``."""
    links = links.join(told.select(F.col("key").alias("from"), F.col("told").alias("from_told")), "from").join(told.select(F.col("key").alias("to"), F.col("told").alias("to_told")), "to")
    order = F.struct(F.coalesce("t", F.lit(_NEVER)).alias("at"), "type", "from_told", "to_told", "from", "to")
    rows = links.select(F.col("other").alias("key"), order.alias("o"), "type", "from", "to", "t", "last", "count", "detail", F.col("node").alias("source"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("o")))


def _groups(questions: DataFrame, links: DataFrame, members: DataFrame, p: Picture, options: Options) -> tuple[DataFrame, DataFrame]:
    """One row a question, and key to group: candidates that read the same but for PIDs and times share one.

    Links are compared by hashes of their text and order; they are gathered for the candidate that a group asks about alone.
    """
    keys = questions.select("key", "since")
    facts = describe.summaries(keys, members, p).join(describe.activities(keys, p), "key")
    same = p.nodes.select(F.col("key").alias("source"), F.when(F.col("type") == "process", F.to_json(F.struct(F.lit("process").alias("kind"), "name", "path", "cmd", "user", "sha256", "host"))).otherwise(F.col("key")).alias("as"))
    each = links.join(keys.select("key"), "key", "left_semi").join(same, "source")
    text = F.to_json(F.struct("n", "type", "as", "detail"))
    read = each.groupBy("key").agg(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor(F.xxhash64(text)).cast("string"), F.sum(F.xxhash64(F.lit("mix"), text).cast("decimal(38,0)")).cast("string")).alias("read"))
    rows = questions.select("key").join(links.where("n = 1").select("key", F.struct(F.col("o").alias("first"), F.col("key").alias("k")).alias("place")), "key").join(facts, "key").join(read, "key").join(p.nodes.select("key", "start"), "key")
    group = F.sha2(F.concat_ws("\n", "what", "read", "did"), 256) if options.group else F.sha2("key", 256)
    rows = stored(rows.withColumn("group", group))
    head = rows.groupBy("group").agg(F.min_by(F.struct("key", "summary", "activity", "start"), "place").alias("r"), F.min("place").alias("place"), F.count("*").alias("occurrences"), F.max_by("start", "place").alias("last_start"))
    what = describe.link_text(F.col("type"), F.col("to") == F.col("key"))
    shown = F.struct("n", "source", what.alias("what"), relative(F.col("t"), p.zero).alias("at"), F.when(F.col("count") > 1, F.col("count")).alias("times"), F.when(F.col("count") > 1, relative(F.col("last"), p.zero)).alias("last"), clip(F.col("detail"), 200).alias("detail"))
    asked = links.join(head.select(F.col("r.key").alias("key")), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(shown)).alias("links"))
    head = head.select("group", "r.key", "r.summary", "r.activity", "place", "occurrences", relative(F.col("r.start"), p.zero).alias("first_started"), relative(F.col("last_start"), p.zero).alias("last_started"))
    return stored(head.join(asked, "key")), rows.select("key", "group")


def _state(p: Picture, seed: str, members: DataFrame, via: DataFrame, groups: DataFrame, options: Options) -> dict:
    """What a judge is told of the seed and of the members that the round's links come from, who are no more than its links."""
    sources = groups.select(F.explode("links").alias("x")).select(F.col("x.source").alias("key")).distinct()
    wanted = sources.union(p.nodes.where(F.col("key") == seed).select("key")).distinct()
    told = describe.summaries(wanted, members, p).join(members, "key").withColumn("joined", relative(F.col("since"), p.zero))
    labels = p.nodes.select(F.col("key").alias("other"), describe.node_label().alias("label"))
    via = via.join(wanted, "key", "left_semi").where("n <= 3").select("key", "n", describe.link_text(F.col("type"), F.col("to") == F.col("key")).alias("what"), "other").join(labels, "other")
    via = via.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "what", "label"))).alias("via"))
    out = []
    for r in told.join(via, "key", "left").orderBy("place", "key").collect():
        said = json.loads(r["summary"]) | ({"joined_incident": r["joined"]} if r["joined"] else {})
        if r["key"] in options.confirmed:
            said["joined_via"] = [{"what": "confirmed by the analyst as part of this incident", "from": "analyst"}]
        elif r["via"]:
            said["joined_via"] = [{"what": v["what"], "from": v["label"]} for v in r["via"]]
        out.append({"key": r["key"], "told": said})
    own = p.nodes.where(F.col("key") == seed).select("key", F.lit(None).cast("long").alias("since"))
    activity = describe.activities(own, p).first()
    mine = next(m["told"] for m in out if m["key"] == seed)
    mine = {k: v for k, v in mine.items() if k not in ("joined_incident", "joined_via")} | {"activity": json.loads(activity["activity"])}
    return {"context": options.context, "seed": {"key": seed, "told": mine}, "members": out}


def pruned(members: DataFrame, via: DataFrame, refused: DataFrame) -> DataFrame:
    """Members less ``refused`` (key) and whoever joined only through them, to a fixed point.

    ``via``: key, other: what each member's decision rests on. Each pass takes away those whose others have all gone; only
    the ones that lean on what went in the pass before are looked at.
    """
    via = stored(via.select("key", "other").distinct().join(members.where("round > 0").select("key"), "key", "left_semi").join(members.select(F.col("key").alias("other")), "other", "left_semi"))
    gone = stored(refused.select("key").distinct().join(members.select("key"), "key", "left_semi"))
    unheld = members.where("round > 0").select("key").join(via.select("key"), "key", "left_anti")
    new = stored(gone.unionByName(unheld).distinct())
    gone = new
    while not new.isEmpty():
        leaning = via.join(new.select(F.col("key").alias("other")), "other", "left_semi").select("key").distinct().join(gone, "key", "left_anti")
        held = via.join(leaning, "key", "left_semi").join(gone.select(F.col("key").alias("other")), "other", "left_anti").select("key").distinct()
        new = stored(leaning.join(held, "key", "left_anti"))
        gone = stored(gone.unionByName(new))
    return members.join(gone, "key", "left_anti")
