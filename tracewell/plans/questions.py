"""Schemas learned from a judge: requests about types of events, and mappings from its answers.

All of it is tables. A row of ``groups_of`` describes a type of event with its fields. A first request asks which kind of
event it is, further ones which role each field has. A request holds no more than MAX_QUESTIONS questions and
MAX_BYTES bytes; how many fields it asks about follows from the sizes of its parts, so no request is built twice. Answers
are matched by their request's digest and become one mapping a type, however its questions were split.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.operators.tables import stored
from tracewell.plans.asking import Asker, Model
from tracewell.plans.learn import KINDS, MENUS, flattened, heads_and_fields

MAX_QUESTIONS, MAX_BYTES = 60, 240 * 1024
#: Characters of a name in a request whose full form is too long.
NAME_CHARS, EXAMPLE_CHARS = 1000, 160
#: A field counts if so large a share of the type's records has it.
USED = 0.2

TASK = "Say what the fields of one type of security log event hold, so that such events can be followed in an investigation."
_KIND_TEXTS = {"http_request": "A web request", "other": "Anything else", "dns": "A name lookup", "inject": "A process put code into another process"}
_PART_TEXTS = {
    "id": "unique ID", "pid": "process ID (PID)", "image": "program file", "start_time": "start time", "command_line": "command line", "hash": "hash of the program file", "path": "full path or folder", "name": "name only", "ip": "IP address", "port": "port",
    "host": "computer", "key": "key path", "value": "data", "value_name": "name of the value", "method": "method", "status": "status code", "type": "type", "mask": "access rights asked for",
}


def _text_of(role: str) -> str:
    """What a role means, in words."""
    owner, _, part = role.partition("_")
    for name in ("new_process", "creator", "actor", "target", "process"):
        if role.startswith(name + "_"):
            owner, part = name, role[len(name) + 1 :]
    told = {"other": "Nothing of these", "time": "When the event happened", "host": "The computer it happened on", "user": "The account it happened under", "event_type": "The type of event", "launches": "The program or command line that it will run"}
    return told.get(role, f"{owner.replace('_', ' ').capitalize()}: {_PART_TEXTS.get(part, part.replace('_', ' '))}" if part else role.replace("_", " ").capitalize())


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


KIND_CRITERIA = {k: _KIND_TEXTS.get(k, k.replace("_", " ").capitalize()) for k in KINDS}
ROLE_CRITERIA = {kind: {r: _text_of(r) for r in sorted(menu)} for kind, menu in MENUS.items() if menu}
_KIND_QUESTION = _json({"kind": {"type": "choice", "instructions": "What kind of event is this type of event?", "criteria": KIND_CRITERIA}})


def _quoted(text: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _clipped(text: Column, chars: int) -> Column:
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each type of event in flattened ``rows``.

    grp, type_name, type_value, count, sources, example (fields of the first record), fields (those that a fifth of
    the records have, by name: label, name, samples, looks), fingerprint.
    """
    heads, fields = heads_and_fields(rows)
    used = fields.join(heads.select("grp", F.col("count").alias("of")), "grp").where(F.col("count") >= F.col("of") * USED)
    fields = used.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("name", "samples", "looks"))).alias("found"))
    fields = fields.select("grp", F.transform("found", lambda f, i: F.struct(F.concat(F.lit("F"), (i + 1).cast("string")).alias("label"), f["name"].alias("name"), f["samples"].alias("samples"), f["looks"].alias("looks"))).alias("fields"))
    out = heads.join(fields, "grp", "left").withColumn("fields", F.coalesce("fields", F.array().cast(fields.schema["fields"].dataType)))
    out = out.withColumn("example", F.transform_values("example", lambda _, v: _clipped(v, EXAMPLE_CHARS)))
    kind = F.when(F.col("type_name").isNotNull(), F.to_json(F.array("type_name", "type_value"))).otherwise("null")
    names = F.to_json(F.transform("fields", lambda f: f["name"]))
    return out.withColumn("fingerprint", F.substring(F.sha2(F.concat(F.lit("["), kind, F.lit(","), names, F.lit("]")), 256), 1, 24))


def _described(f: Column, brief: bool, chars: int | None = None) -> Column:
    """A field's entry in a request."""
    name = f["name"] if chars is None else _clipped(f["name"], chars)
    samples = F.slice(f["samples"], 1, 1) if brief else f["samples"]
    return F.concat(_quoted(f["label"]), F.lit(":"), F.to_json(F.struct(name.alias("name"), f["looks"].alias("looks_like"), samples.alias("examples"))))


def _head(model: str, kind: Column | None, example: bool, chars: int | None = None) -> Column:
    """A request up to the list of its fields."""
    clip = lambda c: c if chars is None else _clipped(c, chars)
    told = F.when(F.col("type_name").isNotNull(), _quoted(F.concat(clip(F.col("type_name")), F.lit(" = "), F.col("type_value")))).otherwise("null")
    parts = [F.lit(f'{{"model":{_json(model)},"state":{{"task":{_json(TASK)},"source":'), F.to_json("sources"), F.lit(',"event_type":'), told, F.lit(',"events_of_this_type":'), F.col("count").cast("string")]
    if example:
        parts += [F.lit(',"example_event":'), F.to_json("example")]
    if kind is not None:
        parts += [F.lit(',"kind_of_event":'), _quoted(kind)]
    return F.concat(*parts, F.lit(',"fields":{'))


def _joined(texts: Column) -> Column:
    return F.array_join(texts, ",")


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _room(text: Column) -> Column:
    """Bytes that ``text`` leaves free in a request, less those of its closing brackets."""
    return F.lit(MAX_BYTES - 16) - _bytes(text)


def kind_requests(groups: DataFrame, model: str) -> DataFrame:
    """Grp, fingerprint, request, sha256: which kind of event each type is.

    All fields with an example event; where that is too long, without it and with one example each; where that is too
    long too, of the fields as many as fit, by name.
    """
    question = F.lit('}},"questions":' + _KIND_QUESTION + "}")
    full = F.concat(_head(model, None, True), _joined(F.transform("fields", lambda f: _described(f, False))), question)
    brief = F.concat(_head(model, None, False), _joined(F.transform("fields", lambda f: _described(f, True))), question)
    some = F.transform("fields", lambda f: _described(f, True, NAME_CHARS))
    head = _head(model, None, False, NAME_CHARS)
    n = F.greatest(F.lit(1), (_room(F.concat(head, question)) / (F.array_max(F.transform(some, _bytes)) + 1)).cast("int"))
    least = F.concat(head, _joined(F.slice(some, F.lit(1), F.coalesce(n, F.lit(1)))), question)
    request = F.when(_bytes(full) <= MAX_BYTES, full).when(_bytes(brief) <= MAX_BYTES, brief).otherwise(least)
    return groups.select("grp", "fingerprint", request.alias("request")).withColumn("sha256", F.sha2("request", 256))


def _by_kind(kind: Column, texts: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[kind]


def role_requests(kinds: DataFrame, model: str) -> DataFrame:
    """Grp, fingerprint, part, request, sha256, asked (labels and names): which role each field has.

    ``kinds``: groups with their ``kind``; those of kind other or without fields are asked nothing. Each request of a
    type describes all of its fields, in full or, where one question more is too long then, briefly; where that is too
    long too, it describes the fields that it asks about.
    """
    rows = kinds.where((F.col("kind") != "other") & (F.size("fields") > 0))
    told = _by_kind(F.col("kind"), KIND_CRITERIA)
    ask = F.lower(told)
    criteria = _by_kind(F.col("kind"), {k: _json(c) for k, c in ROLE_CRITERIA.items()})
    question = lambda f: F.concat(_quoted(f["label"]), F.lit(':{"type":"choice","instructions":"In this event ('), ask, F.lit("), what does field "), f["label"], F.lit(' hold?","criteria":'), criteria, F.lit("}"))
    rows = rows.select(
        "grp", "fingerprint", "fields", F.transform("fields", question).alias("questions"), _head(model, told, True).alias("full_head"), _head(model, told, False).alias("brief_head"), _head(model, told, False, NAME_CHARS).alias("own_head"),
        F.transform("fields", lambda f: _described(f, False)).alias("full"), F.transform("fields", lambda f: _described(f, True)).alias("brief"), F.transform("fields", lambda f: _described(f, True, NAME_CHARS)).alias("own"),
    )
    rows = rows.withColumns({"full_head": F.concat("full_head", _joined(F.col("full"))), "brief_head": F.concat("brief_head", _joined(F.col("brief")))})
    widest = F.array_max(F.transform("questions", _bytes)) + 1
    widest_own = F.array_max(F.zip_with("questions", "own", lambda q, o: _bytes(q) + _bytes(o))) + 2
    rows = rows.withColumns({"fits_full": (_room(F.col("full_head")) / widest).cast("int"), "fits_brief": (_room(F.col("brief_head")) / widest).cast("int"), "fits_own": (_room(F.col("own_head")) / widest_own).cast("int")})
    n = F.when(F.col("fits_full") > 0, F.col("fits_full")).when(F.col("fits_brief") > 0, F.col("fits_brief")).otherwise(F.greatest(F.lit(1), "fits_own"))
    rows = rows.withColumn("n", F.least(n, F.lit(MAX_QUESTIONS)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.size("fields") - 1) / F.col("n")).cast("int"))))
    here = lambda c: F.slice(c, F.col("part") * F.col("n") + 1, F.col("n"))
    state = F.when(F.col("fits_full") > 0, F.col("full_head")).when(F.col("fits_brief") > 0, F.col("brief_head")).otherwise(F.concat("own_head", _joined(here("own"))))
    request = F.concat(state, F.lit('}},"questions":{'), _joined(here("questions")), F.lit("}}"))
    asked = F.transform(here("fields"), lambda f: F.struct(f["label"].alias("label"), f["name"].alias("name")))
    return rows.select("grp", "fingerprint", "part", request.alias("request"), asked.alias("asked")).withColumn("sha256", F.sha2("request", 256))


_ANSWERS = "struct<answers:map<string,struct<choice:string,probabilities:map<string,double>,confidence:double>>>"


def _told(answers: DataFrame) -> DataFrame:
    """sha256, told (answers by label), times: of several different responses to a request the first in byte order."""
    each = answers.groupBy("sha256").agg(F.min("response").alias("response"), F.count_distinct("response").alias("times"))
    return each.select("sha256", F.from_json("response", _ANSWERS)["answers"].alias("told"), "times")


def _sure(answer: Column) -> Column:
    return F.coalesce(F.element_at(answer["probabilities"], answer["choice"]), answer["confidence"], F.lit(1.0))


def read_kinds(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """grp, kind, confidence: the kind that was chosen; other, at 0, where there is no usable answer."""
    rows = requests.select("grp", "sha256").join(_told(answers), "sha256", "left").withColumn("answer", F.element_at("told", "kind"))
    usable = F.coalesce(F.col("answer.choice").isin(*KINDS), F.lit(False))
    return rows.select("grp", F.when(usable, F.col("answer.choice")).otherwise("other").alias("kind"), F.when(usable, _sure(F.col("answer"))).otherwise(0.0).alias("confidence"))


def read_mappings(kinds: DataFrame, requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Grp, fingerprint, kind, roles (name to role), confidence (by name, and of the kind), warnings.

    Each role goes to the field that is surest of it, the first by name of equals; answers under a half don't count; a
    PID that only holds long numbers is an identifier. A field without a usable answer, a request answered in more
    than one way and events without a time are warned of. How questions were split makes no difference.
    """
    asked = requests.select("grp", "sha256", F.explode("asked").alias("a")).join(_told(answers), "sha256", "left")
    asked = asked.select("grp", F.col("a.name").alias("name"), F.element_at("told", F.col("a.label")).alias("answer"), F.coalesce("times", F.lit(0)).alias("times"))
    samples = kinds.select("grp", "kind", F.explode("fields").alias("f")).select("grp", "kind", F.col("f.name").alias("name"), F.col("f.samples").alias("samples"))
    rows = asked.join(samples, ["grp", "name"])
    menu = F.create_map(*[x for k, m in MENUS.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in sorted(m)]).cast("array<string>"))])[F.col("kind")]
    chosen, p = F.col("answer.choice"), _sure(F.col("answer"))
    rows = rows.withColumns({"usable": F.coalesce(F.array_contains(menu, chosen), F.lit(False)), "chosen": chosen, "p": p})
    numbers = chosen.endswith("_pid") & (F.size("samples") > 0) & F.forall("samples", lambda s: s.rlike(r"^\d{9,}$"))
    rows = rows.withColumn("long_pid", F.col("usable") & numbers & (p >= 0.5))
    rows = rows.withColumn("role", F.when(F.col("long_pid"), F.regexp_replace("chosen", "_pid$", "_id")).otherwise(F.col("chosen")))
    held = F.col("usable") & (F.col("role") != "other") & (F.col("p") >= 0.5)
    best = Window.partitionBy("grp", "role", "held").orderBy(F.col("p").desc(), "name")
    rows = rows.withColumn("held", held).withColumns({"nth": F.row_number().over(best), "winner": F.first("name").over(best)})
    say = lambda when, *parts: F.when(when, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    name, role = F.col("name"), F.col("role")
    warned = F.array_compact(F.array(
        say(F.col("times") > 1, name, " was answered in several ways; the first is used"),
        say(~F.col("usable"), "no usable answer for ", name),
        say(F.col("usable") & (role != "other") & (F.col("p") < 0.5), name, ": ", role, " only at ", F.round(F.col("p") * 100).cast("int").cast("string"), "%, not used"),
        say(F.col("long_pid"), name, " holds long numbers: an identifier, no PID"),
        say(F.col("held") & (F.col("nth") > 1), name, " also looked like ", role, "; ", F.col("winner"), " kept"),
    ))
    per = rows.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.when(F.col("held") & (F.col("nth") == 1), F.struct("name", "role")))).alias("pairs"), F.sort_array(F.collect_list(F.when(F.col("usable"), F.struct("name", "p")))).alias("sure"), F.sort_array(F.collect_list(F.struct("name", warned.alias("said")))).alias("said"),
    )
    out = kinds.select("grp", "fingerprint", "kind", F.col("confidence").alias("kind_p")).join(per, "grp", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    pairs, sure = empty(F.col("pairs"), "array<struct<name:string,role:string>>"), empty(F.col("sure"), "array<struct<name:string,p:double>>")
    timed = F.exists(pairs, lambda x: (x["role"] == "time") | ((F.col("kind") == "process_start") & (x["role"] == "new_process_start_time")))
    untimed = F.when((F.col("kind") != "other") & ~timed, F.array(F.lit("no time field: these events have no time"))).otherwise(F.array().cast("array<string>"))
    said = F.flatten(F.transform(empty(F.col("said"), "array<struct<name:string,said:array<string>>>"), lambda x: x["said"]))
    return out.select("grp", "fingerprint", "kind", F.map_from_entries(pairs).alias("roles"), F.map_concat(F.create_map(F.lit("kind"), F.col("kind_p")), F.map_from_entries(F.filter(sure, lambda x: x["name"] != "kind"))).alias("confidence"), F.concat(said, untimed).alias("warnings"))


@dataclass
class JudgedLearner:
    """Learns schemas by asking; ``known``: mappings of earlier runs (fingerprint, kind, roles, warnings)."""

    asker: Asker
    model: Model | str = "judge"
    known: DataFrame | None = field(default=None)

    def mappings(self, records: DataFrame) -> DataFrame:
        """A mapping for each type of event in unknown ``records``: grp, fingerprint, kind, roles, confidence, warnings, learned, count.

        Types with a known fingerprint are not asked about; those of kind other need one question.
        """
        groups = stored(groups_of(flattened(records)))
        spark = groups.sparkSession
        known = self.known if self.known is not None else spark.createDataFrame([], "fingerprint string, kind string, roles map<string,string>, warnings array<string>")
        known = known.select("fingerprint", "kind", "roles", "warnings").dropDuplicates(["fingerprint"])
        recalled = groups.select("grp", "count", "fingerprint").join(known, "fingerprint").withColumns({"confidence": F.create_map().cast("map<string,double>"), "learned": F.lit("known")})
        fresh = stored(groups.join(known.select("fingerprint"), "fingerprint", "left_anti"))
        columns = ["grp", "fingerprint", "kind", "roles", "confidence", "warnings", "learned", "count"]
        if fresh.isEmpty():
            return recalled.select(*columns)
        model = str(self.model)
        first = stored(kind_requests(fresh, model))
        kinds = stored(fresh.join(read_kinds(first, self.asker.ask(first)), "grp"))
        second = stored(role_requests(kinds, model))
        made = read_mappings(kinds, second, self.asker.ask(second)).join(fresh.select("grp", "count"), "grp").withColumn("learned", F.lit("asked"))
        return stored(made.select(*columns).unionByName(recalled.select(*columns)))


def judged_summaries(mappings: DataFrame, learned: DataFrame) -> list[dict]:
    """Records and events of each type, most records first."""
    made = learned.groupBy(F.expr("substr(source, length('learned:') + 1)").alias("grp")).agg(F.count("*").alias("events"))
    rows = mappings.join(made, "grp", "left").orderBy(F.col("count").desc(), "grp").select(F.col("grp").alias("group"), F.col("count").alias("records"), F.coalesce("events", F.lit(0)).alias("events"), "kind", "learned", "roles", "warnings")
    return [r.asDict() for r in rows.collect()]


def keep_mappings(mappings: DataFrame, path: str) -> None:
    """What was asked, appended as JSON lines for later runs; read_known() takes the last one of a fingerprint."""
    kept = mappings.where("learned = 'asked'").select("fingerprint", "kind", "roles", "warnings", F.current_timestamp().cast("long").alias("at"))
    kept.write.mode("append").json(path)


def read_known(spark, path: str) -> DataFrame:
    """Mappings that keep_mappings() wrote; torn lines are skipped."""
    rows = spark.read.schema("fingerprint string, kind string, roles map<string,string>, warnings array<string>, at long").option("mode", "DROPMALFORMED").json(path)
    last = Window.partitionBy("fingerprint").orderBy(F.col("at").desc_nulls_last(), "kind", F.to_json("roles"))
    return rows.where("fingerprint is not null and kind is not null").withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", "at")
