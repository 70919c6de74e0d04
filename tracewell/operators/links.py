"""Typed, time-stamped links between processes, and their merging.

An observation is a row (type, from, to, t, act, seq, detail, phase); observations of one (type, from, to) become one
link. Last and next writers are found by running over writes and reads together, never by pairing them: for each
row the last writer and the last other writer are carried along, so that a process can be excluded as its own writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.masks import CREATE_PROCESS, has, hexadecimal, injection_capable
from tracewell.functions.text import launched_paths, path_key, persistence_key
from tracewell.functions.times import SKEW
from tracewell.operators.carry import bucket_of, nearest_other
from tracewell.operators.identity import Processes
from tracewell.operators.tables import stored

#: A process started this soon after its parent was opened with the right to create processes was started through that handle.
THROUGH_HANDLE = 5_000_000
EVIDENCE = 3
#: Link types followed from either end.
UNDIRECTED = ("pipe", "contacted", "logged_on", "logon_from", "used_account", "failed_logon", "requested")
# Injection steps that put code into a process, and that run it there.
WRITES = r"(?i)^(WriteProcessMemory|NtWriteVirtualMemory|NtMapViewOfSection|MapViewOfFile\w*)$"
RUNS = r"(?i)^(CreateRemoteThread\w*|NtCreateThreadEx|QueueUserAPC\w*|NtQueueApcThread\w*|SetThreadContext|Wow64SetThreadContext|NtSetContextThread)$"
HOLLOWING, SHELLCODE = "process hollowing", "shellcode"
_NEVER = 2**62
OBSERVATION = ("type", "from", "to", "t", "act", "seq", "detail", "phase")


def undirected(type_: Column) -> Column:
    return type_.isin(*UNDIRECTED)


def conclusive(steps: Column, techniques: Column) -> Column:
    """An injection that the records show whole: code run, written into memory allocated there, hollowing, shellcode."""
    ran = F.exists(steps, lambda s: s.rlike(RUNS))
    wrote = F.exists(steps, lambda s: s.rlike(WRITES)) & F.array_contains(steps, "VirtualAllocEx")
    return F.coalesce(F.arrays_overlap(techniques, F.array(F.lit(HOLLOWING), F.lit(SHELLCODE))) | ran | wrote, F.lit(False))


def _observed(rows: DataFrame, type_: str, phase: int, detail: Column | None = None, act: Column | None = None, t: Column | None = None) -> DataFrame:
    t = F.col("t") if t is None else t
    detail = F.lit(None) if detail is None else detail
    return rows.select(F.lit(type_).alias("type"), "from", "to", t.alias("t"), (t if act is None else act).alias("act"), "seq", detail.cast("string").alias("detail"), F.lit(phase).alias("phase"))


def last_writer(writes: DataFrame, reads: DataFrame, path: str = "path", look_ahead: int = 0) -> DataFrame:
    """Each read with the last earlier write of its ``path`` by another ``key``: w_key, w_t, w_seq.

    Both have path, t, seq, key. An untimed row comes last; at one time the lesser seq is earlier, but with ``look_ahead``, which
    is for starts, all writes are. If nothing was
    written before, the first write within ``look_ahead`` counts. Reads without a write are left out.
    """
    rows = writes.select(F.col(path).alias("path"), "t", "seq", "key", F.lit(0).alias("reads"))
    rows = rows.unionByName(reads.select(F.col(path).alias("path"), "t", "seq", "key", F.lit(1).alias("reads")))
    at = F.coalesce("t", F.lit(_NEVER))
    write, bucket = F.when(F.col("reads") == 0, F.struct("key", "t", "seq")), bucket_of(F.col("t"), None if look_ahead else F.col("seq"))
    rows = nearest_other(rows, ["path"], [at, F.col("reads"), F.col("seq")] if look_ahead else [at, F.col("seq")], bucket, write, "key", "before")
    if look_ahead:
        rows = stored(rows)
        rows = nearest_other(rows, ["path"], [at.desc(), F.col("reads").desc(), F.col("seq").desc()], bucket, write, "key", "after", descending=True)
        soon = (F.col("after.t") > F.col("t")) & (F.col("after.t") <= F.col("t") + look_ahead)
        best = F.coalesce(F.col("before"), F.when(soon, F.col("after")))
    else:
        best = F.col("before")
    out = rows.where("reads = 1").withColumn("w", best).where("w is not null")
    return out.select("path", "t", "seq", "key", F.col("w.key").alias("w_key"), F.col("w.t").alias("w_t"), F.col("w.seq").alias("w_seq"))


def next_start(registrations: DataFrame, starts: DataFrame) -> DataFrame:
    """Each registration (path, t, seq, key) with the next start (path, t, key) of its path by another key, at most SKEW earlier.

    Returns path, t, seq, key, s_key, s_t. An untimed registration meets the first start.
    """
    rows = registrations.select("path", (F.coalesce("t", F.lit(-_NEVER)) - SKEW).alias("o"), "t", "seq", "key", F.lit(0).alias("starts"))
    rows = rows.unionByName(starts.select("path", F.col("t").alias("o"), "t", F.lit(None).cast("long").alias("seq"), "key", F.lit(1).alias("starts")))
    # Descending, so that a row's past holds what starts at its time or later; starts come after registrations of their time.
    back = [F.col("o").desc(), F.col("starts").desc(), F.col("key").desc()]
    rows = nearest_other(rows, ["path"], back, bucket_of(F.col("o")), F.when(F.col("starts") == 1, F.struct("key", "t")), "key", "b", descending=True)
    return rows.where("starts = 0 and b is not null").select("path", "t", "seq", "key", F.col("b.key").alias("s_key"), F.col("b.t").alias("s_t"))


def handle_starts(handles: DataFrame, started: DataFrame, back: int = THROUGH_HANDLE, ahead: int = SKEW) -> DataFrame:
    """Pairs of a handle (opened, t, seq, key) and a start (parent, start, child) with start - back <= t <= start + ahead.

    A range join on buckets of time, each start in the few buckets that its range meets.
    """
    width = back + ahead
    h = handles.where("t is not null").withColumn("b", F.floor(F.col("t") / width))
    s = started.where("start is not null").withColumn("b", F.explode(F.sequence(F.floor((F.col("start") - back) / width), F.floor((F.col("start") + ahead) / width))))
    return h.join(s, (h.opened == s.parent) & (h.b == s.b) & (h.t >= s.start - back) & (h.t <= s.start + ahead) & (h.key != s.child)).drop("b")


def process_observations(events: DataFrame, processes: Processes) -> DataFrame:
    """Every observed way in which a process leads to another."""
    nodes = processes.nodes
    names = nodes.select(F.col("key").alias("pk"), F.col("name").alias("parent_name"))
    started = nodes.join(names, nodes.parent == names.pk, "left")
    out = []
    for column, detail in (("parent", None), ("real_parent", F.concat(F.lit("created it posing as a child of "), F.coalesce("parent_name", F.lit("another process")))), ("effective_parent", F.concat(F.lit("had it started through "), F.coalesce("parent_name", F.lit("a broker"))))):
        some = started.where(F.col(column).isNotNull()).select(F.col(column).alias("from"), F.col("key").alias("to"), F.col("start").alias("t"), F.col("first_start").alias("seq"), "parent_name")
        out.append(_observed(some, "spawned", 0, detail))

    acted = events.join(processes.actor.withColumnRenamed("key", "from"), "seq")
    aimed = acted.join(processes.target.withColumnRenamed("key", "to"), "seq").where(F.col("from") != F.col("to"))
    made_by = nodes.select(F.col("key").alias("mk"), F.coalesce("real_parent", "parent").alias("creator"))
    step = F.coalesce("api", F.when(F.col("source") == "sysmon:8", "CreateRemoteThread"), "source")
    hollowed = (F.col("creator") == F.col("from")) & (F.coalesce("target_suspended", F.lit(False)) | F.coalesce(F.array_contains("behaviors", "hollow_image"), F.lit(False)))
    shell = F.exists("behaviors", lambda b: b.contains("shellcode"))
    technique = F.when(hollowed, HOLLOWING).when(shell, SHELLCODE)
    injected = aimed.where("kind = 'inject'").join(made_by, F.col("to") == F.col("mk"), "left").select("from", "to", "t", "seq", step.alias("step"), technique.alias("technique"))
    tampered = acted.where("kind = 'tamper'").where(F.lower("tampering").contains("replaced")).join(made_by, F.col("from") == F.col("mk")).where(F.col("creator") != F.col("from"))
    injected = injected.unionByName(tampered.select(F.col("creator").alias("from"), F.col("from").alias("to"), "t", "seq", F.lit("image replaced").alias("step"), F.lit(HOLLOWING).alias("technique")))
    order = F.struct(F.coalesce("t", F.lit(_NEVER)), "seq")
    seen = lambda what: injected.where(F.col(what).isNotNull()).groupBy("from", "to", what).agg(F.min(order).alias("o")).groupBy("from", "to").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", what))), lambda x: x[what]).alias(f"{what}s"))
    how = seen("step").join(seen("technique"), ["from", "to"], "left")
    text = F.concat(F.array_join("steps", " + "), F.when(F.col("techniques").isNotNull(), F.concat(F.lit(" ("), F.array_join("techniques", ", "), F.lit(")"))).otherwise(""))
    out.append(_observed(injected.join(how.select("from", "to", text.alias("text")), ["from", "to"]), "injected", 1, F.col("text")))

    opened = aimed.where("kind = 'process_access' and access is not null")
    out.append(_observed(opened.where(injection_capable(F.col("access"))), "opened_for_injection", 1, hexadecimal(F.col("access"))))

    written = acted.where("kind = 'file_create'")
    by_path = written.where("file_path is not null").select(path_key(F.col("file_path")).alias("path"), "t", "seq", F.col("from").alias("key"))
    by_hash = written.where("file_sha256 is not null").select(F.col("file_sha256").alias("path"), "t", "seq", F.col("from").alias("key"))
    loads = acted.where("kind = 'image_load' and file_path is not null").select(path_key(F.col("file_path")).alias("path"), "t", "seq", F.col("from").alias("key"))
    found = last_writer(by_path, loads).withColumnsRenamed({"w_key": "from", "key": "to"}).join(events.select("seq", "file_path"), "seq")
    out.append(_observed(found.drop("seq").withColumnRenamed("w_seq", "seq"), "dropped_and_loaded", 1, F.col("file_path"), F.col("w_t")))
    made = acted.where("kind = 'pipe_create' and pipe is not null").select(F.lower("pipe").alias("path"), "t", "seq", F.col("from").alias("key"))
    joins = acted.where("kind = 'pipe_connect' and pipe is not null").select(F.lower("pipe").alias("path"), "t", "seq", F.col("from").alias("key"))
    found = last_writer(made, joins).withColumnsRenamed({"w_key": "from", "key": "to"}).join(events.select("seq", "pipe"), "seq")
    out.append(_observed(found, "pipe", 1, F.col("pipe")))

    handles = opened.where(has(F.col("access"), CREATE_PROCESS)).select(F.col("to").alias("opened"), "t", "seq", F.col("from").alias("key"))
    children = started.where("parent is not null and start is not null and real_parent is null").select("parent", "start", F.col("key").alias("child"), "parent_name")
    found = handle_starts(handles, children).select(F.col("key").alias("from"), F.col("child").alias("to"), F.col("start").alias("t"), F.col("t").alias("act"), "seq", "parent_name")
    out.append(_observed(found, "spawned", 2, F.concat(F.lit("created it through a handle to "), F.coalesce("parent_name", F.lit("its parent"))), F.col("act")))

    ran = nodes.where("n_starts > 0")
    starts = ran.where("path is not null").select(path_key(F.col("path")).alias("path"), F.col("start").alias("t"), F.col("first_start").alias("seq"), "key", F.col("path").alias("as"))
    wrote = last_writer(by_path, starts, look_ahead=SKEW)
    found = wrote.join(starts.select("key", "as"), "key").select(F.col("w_key").alias("from"), F.col("key").alias("to"), "t", F.col("w_t").alias("act"), F.col("w_seq").alias("seq"), "as")
    out.append(_observed(found, "dropped_and_ran", 3, F.col("as"), F.col("act")))
    hashed = ran.where("sha256 is not null").select(F.col("sha256").alias("path"), F.col("start").alias("t"), F.col("first_start").alias("seq"), "key")
    found = last_writer(by_hash, hashed, look_ahead=SKEW).join(wrote.select("key", F.col("w_key").alias("path_writer")), "key", "left").where(~F.col("w_key").eqNullSafe(F.col("path_writer")))
    found = found.select(F.col("w_key").alias("from"), F.col("key").alias("to"), "t", F.col("w_t").alias("act"), F.col("w_seq").alias("seq")).join(events.select("seq", "file_path"), "seq")
    out.append(_observed(found, "dropped_and_ran", 4, F.concat(F.lit("same SHA-256 as "), F.coalesce("file_path", F.lit("a written file"))), F.col("act")))

    text = F.when(F.col("kind") == "registry_set", F.when(persistence_key(F.col("reg.key")), F.col("reg.value"))).otherwise(F.col("launches"))
    registered = acted.where(F.col("kind").isin("registry_set", "service_install", "task_create")).select(F.explode(launched_paths(text)).alias("path"), "t", "seq", F.col("from").alias("key"))
    found = next_start(registered, starts.where("t is not null"))
    found = found.select(F.col("key").alias("from"), F.col("s_key").alias("to"), F.col("s_t").alias("t"), F.col("t").alias("act"), "seq").join(events.select("seq", F.coalesce("reg.key", "launches").alias("what")), "seq")
    out.append(_observed(found, "persisted_and_ran", 5, F.col("what"), F.col("act")))

    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def merged(observations: DataFrame) -> DataFrame:
    """A2: one link for each (type, from, to): t, act, last, count, evidence (first three events), detail.

    t is the earliest time, and act the one observed with it; detail is that of the earliest observation that has one.
    Links from a node to itself are dropped. Evidence is picked before rows are gathered, at most three a link and task.
    """
    key = ["type", "from", "to"]
    rows = observations.where(F.col("from") != F.col("to"))
    order = F.struct("phase", F.coalesce("t", F.lit(_NEVER)).alias("o"), "seq")
    early = F.struct(F.coalesce("t", F.lit(_NEVER)).alias("o"), "phase", "seq")
    links = rows.groupBy(*key).agg(F.min("t").alias("t"), F.min_by("act", early).alias("act"), F.max("t").alias("last"), F.count("*").alias("count"), F.min_by("detail", F.when(F.col("detail").isNotNull(), early)).alias("detail"))
    firsts = rows.where("seq is not null").groupBy(*key, "seq").agg(F.min(order).alias("o"))
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("o"))).where(F.col("n") <= EVIDENCE)
    firsts = firsts.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "seq"))), lambda x: x["seq"]).alias("evidence"))
    return links.join(firsts, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<bigint>")))


def touching(links: DataFrame) -> DataFrame:
    """Links by the node that they can be followed from: ``node``, ``other`` and the link."""
    both = links.where(undirected(F.col("type")))
    return links.withColumn("node", F.col("from")).withColumn("other", F.col("to")).unionByName(both.withColumn("node", F.col("to")).withColumn("other", F.col("from")))
