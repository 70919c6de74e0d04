"""Which process each event is about.

A process is a host and a GUID where a source has one, else a host, a PID and a start. What one source calls by a
GUID and another by a PID, or by another GUID, is one process if times and images agree.

All of it is joins and windows: starts become the lives of their PIDs, GUIDs without a start join one or add one where
they are first seen, and what is known by a PID alone is looked up among these lives by time. References by GUID, which
are most, never go through a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.text import basename
from tracewell.operators.carry import bucket_of, carried, nearest_other
from tracewell.operators.tables import stored

#: Records of one start are at most this far apart.
TWIN = 2_000_000
#: Later than any time.
FAR = 2**62


@dataclass
class Processes:
    """``nodes``: a row for each process; ``actor``: seq, key of an event's process; ``target``: seq, key of the other one."""

    nodes: DataFrame
    actor: DataFrame
    target: DataFrame


def is_process(ref: str) -> Column:
    """a user's name alone is no process."""
    return F.coalesce(f"{ref}.guid", F.col(f"{ref}.pid").cast("string"), f"{ref}.path", f"{ref}.name").isNotNull()


def _base(ref: str) -> Column:
    return F.lower(basename(F.coalesce(f"{ref}.path", f"{ref}.name")))


def _refs(events: DataFrame, ref: str, role: int, t: Column | None = None) -> DataFrame:
    return events.select(
        "seq", F.lit(role).alias("role"), "host", F.col(f"{ref}.guid").alias("guid"), F.col(f"{ref}.pid").alias("pid"), _base(ref).alias("base"), F.lower(F.coalesce(f"{ref}.path", f"{ref}.name")).alias("image"),
        (F.col("t") if t is None else t).alias("t"), F.concat_ws("|", F.col("file").cast("string"), F.split_part("source", F.lit(":"), F.lit(1))).alias("space"), "kind",
    )


def _own(guid: str = "guid") -> Column:
    return F.concat(F.lit("g:"), "host", F.lit(":"), guid)


def _at(c: str = "t") -> Column:
    return F.coalesce(c, F.lit(FAR))


def _fits(a: str, b: str) -> Column:
    """Images agree where both are known."""
    return F.coalesce(F.col(a) == F.col(b), F.lit(True))


def _on_pids(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` on a host and PID that one of ``others`` has."""
    return rows.join(others.select("host", "pid").distinct(), ["host", "pid"], "left_semi")


def _first_near(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """__id (seq), ``name``: of ``others`` (key, space) on the host and PID of ``rows`` the first at most TWIN before or after, whose image agrees."""
    along = lambda marks, by, order, bucket: carried(marks, by, order, bucket, last={"__found": F.col("__other")}, inclusive=False, descending=True)
    return _looked_up(_on_pids(rows, others).where("t is not null").withColumn("__id", F.struct("seq")), others, along, name)


def _looked_up(rows: DataFrame, others: DataFrame, carry, name: str) -> DataFrame:
    """__id, ``name`` (t, seq, key, space): what ``carry`` brings to ``rows`` of the first of ``others`` since TWIN before them.

    Rows and others have host, pid, t, seq, base. Others of a row's own image and of none are looked up, for a row without an
    image any; values go along time from bucket to bucket, so no pairs are made.
    """
    by = ["host", "pid", "__any", "__base"]
    nothing, none = F.lit(None).cast("string"), F.lit(False)
    one = lambda any_, base: F.struct(any_.alias("__any"), base.alias("__base"))
    where = F.array(one(F.lit(True), nothing), one(none, F.col("base")))
    told = others.where("t is not null").select("host", "pid", F.inline(where), F.col("t").alias("__at"), F.lit(0).alias("__o"), "seq", F.struct("t", "seq", "key", "space").alias("__other"))
    sought = F.when(F.col("base").isNull(), F.array(one(F.lit(True), nothing))).otherwise(F.array(one(none, F.col("base")), one(none, nothing)))
    space = F.col("space") if "space" in rows.columns else nothing
    marks = rows.select("host", "pid", F.inline(sought), (F.col("t") - TWIN).alias("__at"), F.lit(1).alias("__o"), "seq", F.lit(None).cast(told.schema["__other"].dataType).alias("__other"), space.alias("space"), F.col("t").alias("__t"), "__id")
    marks = marks.unionByName(told.withColumn("space", F.col("__other.space")), allowMissingColumns=True)
    order = [F.col("__at").desc(), F.col("__o"), F.col("seq").desc()]
    found = carry(marks, by, order, bucket_of(F.col("__at"))).where("__o = 1 and __found is not null")
    return found.groupBy("__id").agg(F.min("__found").alias(name), F.first("__t").alias("__t")).where(F.col(f"{name}.t") <= F.col("__t") + TWIN).drop("__t")


def start_keys(refs: DataFrame) -> DataFrame:
    """The process of each recorded start: seq, host, pid, guid, t, base, space, key.

    A start with a GUID is its own process, or that of an earlier start which another source calls by another GUID. A start
    without one is the process of a start with a GUID nearby, else one of its own.
    """
    starts = refs.where("role = 0 and kind = 'process_start'").select("seq", "host", "pid", "guid", "t", "base", "space")
    by_guid = starts.where("guid is not null").withColumn("key", _own())
    firsts = by_guid.where("pid is not null").groupBy("host", "pid", "key").agg(F.min_by(F.struct("t", "seq", "space", "base"), F.struct(_at(), "seq")).alias("f")).select("host", "pid", "key", "f.*")
    other = lambda marks, by, order, bucket: nearest_other(marks, by, order, bucket, F.col("__other"), "space", "__found", descending=True)
    sourced = firsts.where("space is not null")
    twins = _looked_up(sourced.where("t is not null").withColumn("__id", F.struct("key", "space", "t", "seq")), sourced, other, "to")
    twins = twins.where("struct(to.t, to.seq) < struct(__id.t, __id.seq)").groupBy("__id.key", "__id.space").agg(F.min("to").alias("to")).select("key", "space", F.struct("to.key", "to.space").alias("to"))
    again = twins.select(F.col("key").alias("middle"), F.col("to").alias("first"))
    to = F.coalesce("first", "to")  # what is a twin's twin is one process too, but not for two GUIDs of one source
    twins = stored(twins.join(again, F.col("to.key") == F.col("middle"), "left").where(to["space"] != F.col("space")).select("key", to["key"].alias("to")))
    by_guid = by_guid.join(twins, "key", "left").withColumn("key", F.coalesce("to", "key"))
    plain = starts.where("guid is null")
    lives = firsts.join(twins, "key", "left_anti")
    beside = _first_near(plain, lives, "found").select("__id.seq", F.col("found.key").alias("to"))
    alone = F.concat(F.lit("p:"), "host", F.lit(":"), F.coalesce(F.col("pid").cast("string"), F.lit("?")), F.lit(":"), F.coalesce("t", "seq").cast("string"))
    plain = plain.join(beside, "seq", "left").withColumn("key", F.coalesce("to", alone))
    columns = ["seq", "host", "pid", "guid", "t", "base", "space", "key"]
    return by_guid.select(*columns).unionByName(plain.select(*columns))


def _with_next(lives: DataFrame, *told: str) -> DataFrame:
    """host, pid, ``life``: what is ``told`` of each of ``lives`` (key and start too) with the next one in ``life.next``, and for each PID what stands before the first."""
    by = ["host", "pid"]
    lives = carried(lives, by, [F.col("start").desc(), F.col("key").desc()], bucket_of(F.col("start")), last={"next": F.struct("key", "known")}, inclusive=False, descending=True)
    lives = lives.select(*by, F.struct("key", "start", *told, "next").alias("life"), "known")
    before = lives.groupBy(*by).agg(F.min(F.struct("life.start", "life.key", "known")).alias("f"))
    lives = lives.drop("known")
    kind = lives.schema["life"].dataType
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[:-1]], F.struct("f.key", "f.known").alias("next")).cast(kind)
    return lives.unionByName(before.select(*by, empty.alias("life")))


def _running(lives: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with the ``life`` of their host and PID that is the last to start before (or TWIN after) them.

    Without any before, key and start of ``life`` are null. Lives: host, pid, life (key, start and what else is told of it).
    """
    by, kind = ["host", "pid"], lives.schema["life"].dataType
    point = F.struct(*[c for c in points.columns if c not in by])
    marks = lives.select(*by, F.coalesce("life.start", F.lit(-FAR)).alias("at"), F.lit(0).alias("o"), "life", F.lit(None).cast(points.select(point).schema[0].dataType).alias("p"))
    marks = marks.unionByName(points.select(*by, F.coalesce(F.col("t") + TWIN, F.lit(FAR)).alias("at"), F.lit(1).alias("o"), F.lit(None).cast(kind).alias("life"), point.alias("p")))
    timed, nth = F.when(F.col("at") < FAR, F.col("at")), F.coalesce("p.seq", F.lit(0)) if "seq" in points.columns else F.lit(0)
    marks = carried(marks, by, [F.col("at"), F.col("o"), F.col("life.key"), nth], bucket_of(timed, nth), last={"so_far": F.col("life")})
    return marks.where("o = 1").select(*by, "p.*", F.col("so_far").alias("life"))


_ALIVE = "life.key is not null and (t is null or life.end is null or life.end >= t - %d)"


def _ended(lives: DataFrame, ends: DataFrame, alias: DataFrame) -> DataFrame:
    """``lives`` with the last recorded end of each: by its GUID, or of the life that a PID had then."""
    by_guid = ends.where("guid is not null").withColumn("own", _own()).join(alias, "own", "left").select(F.coalesce("to", "own").alias("key"), "t")
    by_pid = ends.where("guid is null and pid is not null").select("host", "pid", "t")
    by_pid = _running(_on_pids(lives, by_pid).select("host", "pid", F.struct("key", "start").alias("life")), by_pid).select("life.key", "t")
    last = by_guid.unionByName(by_pid).groupBy("key").agg(F.max("t").alias("end"))
    return lives.drop("end").join(last, "key", "left")


def _first_seen(rows: DataFrame) -> DataFrame:
    """``rows``, which no life covers (``since``: the start of the last one), with the ``key`` of a process that is first seen there: one for each gap between ends."""
    kept = [c for c in rows.columns if c not in ("key", "since")]
    rows = rows.select(*kept, F.col("since").alias("__since"))
    by = ["host", "pid", "__since"]
    # An end counts for what comes later than TWIN after it; untimed rows come before all ends.
    marks = rows.select(*by, F.coalesce("t", F.lit(-FAR)).alias("__at"), F.lit(1).alias("__o"), F.lit(0).alias("__one"), F.struct(*kept).alias("__row"))
    ends = rows.where("ends and t is not null").select(*by, (F.col("t") + TWIN + 1).alias("__at"), F.lit(0).alias("__o"), F.lit(1).alias("__one"), F.lit(None).cast(marks.schema["__row"].dataType).alias("__row"))
    marks = carried(marks.unionByName(ends), by, [F.col("__at"), F.col("__o"), F.col("__row.seq")], bucket_of(F.col("__at")), total={"gone": F.col("__one")}).where("__o = 1")
    rows = stored(marks.select("__since", "gone", "__row.*"))
    gaps = rows.groupBy(*by, "gone").agg(F.min("t").alias("__t"), F.min("seq").alias("__seq"))
    gaps = gaps.select(F.col("host").alias("__h"), F.col("pid").alias("__p"), F.col("__since").alias("__s"), F.col("gone").alias("__g"), "__t", "__seq")
    rows = rows.join(gaps, (F.col("host") == F.col("__h")) & (F.col("pid") == F.col("__p")) & F.col("__since").eqNullSafe(F.col("__s")) & (F.col("gone") == F.col("__g")))
    key = F.concat(F.lit("p:"), "host", F.lit(":"), F.col("pid").cast("string"), F.lit(":"), F.coalesce(F.col("__t").cast("string"), F.concat(F.lit("?"), F.col("__seq").cast("string"))))
    return rows.withColumn("key", key).select(*kept, "key")


def resolve_references(refs: DataFrame, starts: DataFrame) -> DataFrame:
    """Seq, role, key, host, guid, t of all references; ``starts``: what start_keys() made of them.

    A GUID is its own process, unless it is first seen while another source's or a nameless process runs under its PID with
    an agreeing image: then it is that one. A PID alone is what runs under it at that time; what runs under none
    yet, or no longer, is a process first seen there. A name alone is one process a host.
    """
    known = starts.where("pid is not null and t is not null").groupBy("host", "pid", "key").agg(F.min("t").alias("start"), F.min_by("base", F.when(F.col("base").isNotNull(), F.struct("t", "seq"))).alias("base"), F.min_by("space", F.struct(F.col("guid").isNull(), "t", "seq")).alias("space"))
    known = stored(known.withColumn("known", F.lit(True)))
    moved = starts.where("guid is not null").select(_own().alias("own"), F.col("key").alias("to")).distinct()
    alias = moved.where("own <> to")
    ends = refs.where("role = 0 and kind = 'process_end' and t is not null").select("host", "pid", "guid", "t")

    # GUIDs without a recorded start, where they are first seen
    sights = refs.where("guid is not null and pid is not null").withColumn("own", _own()).join(moved, "own", "left_anti")
    sights = sights.groupBy("host", "own").agg(F.min_by(F.struct("pid", "t", "seq", "space", "base"), F.struct(F.col("role") > 1, _at(), "seq")).alias("f")).select("host", "own", "f.*")
    near = ends.where("guid is not null").unionByName(_on_pids(ends.where("guid is null"), sights))
    seen = _running(stored(_with_next(stored(_ended(_on_pids(known, sights), near, alias)), "base", "space", "end")), sights)
    other = F.col("life.key").startswith("p:") | (F.col("life.space") != F.col("space"))
    seen = stored(seen.withColumn("to", F.when(F.expr(_ALIVE % TWIN) & other & _fits("life.base", "base"), F.col("life.key"))).select("host", "pid", "own", "t", "seq", "space", "base", "to", F.col("life.key").alias("under")))
    order = Window.partitionBy("host", "pid", "under").orderBy(_at(), "seq")
    before = lambda c: F.lag(c).over(order)
    fresh = seen.where("to is null").withColumn("new", (~F.coalesce((before("space") != F.col("space")) & F.coalesce(before("base") == F.col("base"), F.lit(True)), F.lit(False))).cast("int"))
    fresh = fresh.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = fresh.withColumn("to", F.first("own").over(Window.partitionBy("host", "pid", "under", "run").orderBy(_at(), "seq")))
    alias = stored(alias.unionByName(seen.where("to is not null").select("own", "to")).unionByName(fresh.where("own <> to").select("own", "to")))
    unknown = fresh.where("own = to and t is not null").select("host", "pid", F.col("own").alias("key"), F.col("t").alias("start"), "base", "space", F.lit(False).alias("known"))
    lives = stored(_ended(stored(known.unionByName(unknown)), ends, alias))

    columns = ["seq", "role", "key", "host", "guid", "t"]
    rest = refs.where("not coalesce(role = 0 and kind = 'process_start', false)")  # ``starts`` has the others
    by_guid = rest.where("guid is not null").withColumn("own", _own()).join(alias, "own", "left").withColumn("key", F.coalesce("to", "own"))
    # Rows without a GUID are read several times: for their buckets, for themselves and for those without a PID.
    plain = stored(rest.where("guid is null").select("seq", "role", "host", "pid", "guid", "t", (F.col("kind") == "process_end").alias("ends"), F.when(F.col("pid").isNull(), F.col("image")).alias("image")))
    by_pid = _running(stored(_with_next(lives, "end")), plain.where("pid is not null").drop("image"))
    key = F.when(F.expr(_ALIVE % TWIN), F.col("life.key")).when(~F.col("life.next.known"), F.col("life.next.key"))
    by_pid = stored(by_pid.withColumns({"key": key, "since": F.col("life.start")}).drop("life"))
    by_pid = by_pid.where("key is not null").drop("since").unionByName(_first_seen(by_pid.where("key is null")))
    by_name = plain.where("pid is null").withColumn("key", F.concat(F.lit("u:"), "host", F.lit(":"), F.coalesce("image", F.lit("?"))))
    done = starts.withColumn("role", F.lit(0)).select(*columns)
    for part in (by_guid, by_pid, by_name):
        done = done.unionByName(part.select(*columns))
    return done


def resolve_processes(events: DataFrame) -> Processes:
    """Nodes, and each event's actor and target."""
    own = _refs(events.where(is_process("proc")), "proc", 0).unionByName(_refs(events.where(F.col("kind").isin("inject", "process_access") & is_process("target")), "target", 1))
    started = stored(start_keys(own))
    starts = started.select("seq", "key", "host", "t").join(events.where("kind = 'process_start'").select("seq", "proc", "parent", "real_parent", "effective_parent", "file", "source"), "seq")
    preferred = F.struct(F.col("proc.guid").isNull(), F.coalesce("t", F.lit(2**62)), "seq")
    best = starts.groupBy("key").agg(F.min_by(F.struct("seq", "t", "host", "proc", "parent", "real_parent", "effective_parent", "file", "source"), preferred).alias("s"), F.count("*").alias("n_starts"), F.min_by("seq", preferred).alias("start_seq"), F.min_by("seq", F.struct(F.coalesce("t", F.lit(2**62)), "seq")).alias("first_start"))
    best = stored(best)
    at = best.select("key", "s.*").withColumn("kind", F.lit("parent"))
    parents = None
    for role, ref in ((2, "parent"), (3, "real_parent"), (4, "effective_parent")):
        some = at.where(F.coalesce(f"{ref}.guid", F.col(f"{ref}.pid").cast("string")).isNotNull())
        some = _refs(some, ref, role)
        parents = some if parents is None else parents.unionByName(some)
    parents = stored(parents)
    everything = stored(resolve_references(own.unionByName(parents), started))
    first = everything.where("role < 2")
    actor = first.where("role = 0")
    above = everything.where("role > 1").groupBy("seq").pivot("role", [2, 3, 4]).agg(F.first("key")).withColumnsRenamed({"2": "parent", "3": "real_parent", "4": "effective_parent"})
    link = best.select("key", "n_starts", "start_seq", "first_start", F.col("s.t").alias("start"), F.col("s.seq").alias("seq")).join(above, "seq", "left")
    link = link.withColumn("parent", F.when(F.col("parent") != F.col("key"), F.col("parent")))
    differs = lambda c, *others: F.when((F.col(c) != F.col("key")) & F.coalesce(*[F.col(c) != F.col(o) for o in others[:1]], F.lit(True)), F.col(c))
    link = link.withColumn("real_parent", differs("real_parent", "parent"))
    link = link.withColumn("effective_parent", F.when(F.coalesce(F.col("effective_parent") != F.col("real_parent"), F.lit(True)), differs("effective_parent", "parent")))

    seen = everything.groupBy("key").agg(F.min("t").alias("first_seen"), F.min("host").alias("host"))
    ends = actor.join(events.where("kind = 'process_end'").select("seq"), "seq").groupBy("key").agg(F.max("t").alias("end"))
    nodes = seen.join(link.drop("seq"), "key", "left").join(ends, "key", "left").join(_attributes(events, actor, first.where("role = 1"), best, everything, parents), "key", "left")
    nodes = nodes.select("key", F.lit("process").alias("type"), "host", "guid", "pid", "name", "path", "cmd", "user", "sha256", "start", "first_seen", "end", "parent", "real_parent", "effective_parent", F.coalesce("n_starts", F.lit(0)).alias("n_starts"), "first_start")
    return Processes(stored(nodes), stored(actor.select("seq", "key")), stored(first.where("role = 1").select("seq", "key")))


def _attributes(events: DataFrame, actor: DataFrame, target: DataFrame, best: DataFrame, everything: DataFrame, parents: DataFrame) -> DataFrame:
    """A3: each attribute's first value out of a process's preferred start, other starts, own events, and others' words."""
    procs = events.select("seq", "proc", "kind", "t", F.col("target").alias("other"))
    mine = actor.select("seq", "key").join(procs, "seq").join(best.select("key", "start_seq"), "key", "left")
    rank = F.when(F.col("seq") == F.col("start_seq"), 0).when(F.col("kind") == "process_start", 1).otherwise(2)
    told = mine.select("key", F.struct(rank.alias("r"), F.coalesce("t", F.lit(2**62)).alias("t"), "seq").alias("o"), "proc")
    of = best.select(F.col("s.seq").alias("seq"), F.col("s.parent").alias("p"), F.col("s.effective_parent").alias("e"))
    named = everything.where("role in (2, 4)").join(of, "seq").select("key", F.struct(F.lit(3).alias("r"), F.coalesce("t", F.lit(2**62)).alias("t"), "seq").alias("o"), F.when(F.col("role") == 2, F.col("p")).otherwise(F.col("e")).alias("proc"))
    hit = target.select("seq", "key").join(procs, "seq").select("key", F.struct(F.lit(4).alias("r"), F.coalesce("t", F.lit(2**62)).alias("t"), "seq").alias("o"), F.col("other").alias("proc"))
    told = told.unionByName(named).unionByName(hit)
    firsts = [F.min_by(F.col(f"proc.{a}"), F.when(F.col(f"proc.{a}").isNotNull(), F.col("o"))).alias(a) for a in ("guid", "pid", "name", "path", "cmd", "user", "sha256")]
    out = told.groupBy("key").agg(*firsts)
    return out.withColumn("name", F.coalesce("name", basename(F.col("path"))))
