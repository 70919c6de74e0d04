"""Chat formatting with linked tool calls.

Calls and results of tools are joined by identifier, brought into an order in which a call comes after the
results that it needs, validated against the tools' schemas and written as canonical JSON, one line a message: a
conversation is never gathered into one value, so one that holds a third of all rows is no different. All of it
is DataFrame functions and hash joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm._common import stored

#: JSON types of schemas to what schema_of_variant calls them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
_CALLS = "array<struct<id:string,name:string,arguments:variant,needs:array<string>>>"


def parsed_messages(messages: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, kind, call_id, name, arguments, needs, content from messages that hold tool calls as JSON.

    An assistant text ``{"tool_calls": [{"id", "name", "arguments", "needs"?}, ...]}`` becomes a row for each call, a tool
    text ``{"tool_call_id", "content"}`` a result; every other text is a plain message.
    """
    v = F.try_parse_json("text")
    calls = F.try_variant_get(v, "$.tool_calls", _CALLS)
    rows = messages.select("conv_id", "turn", "role", "text", calls.alias("calls"), F.try_variant_get(v, "$.tool_call_id", "string").alias("result_of"), F.try_variant_get(v, "$.content", "string").alias("result"))
    is_call = (F.col("role") == "assistant") & (F.size("calls") > 0)
    is_result = (F.col("role") == "tool") & F.col("result_of").isNotNull()
    rows = rows.withColumn("calls", F.when(is_call, F.col("calls"))).withColumn("kind", F.when(is_call, "call").when(is_result, "result").otherwise("message"))
    rows = rows.select("*", F.explode_outer("calls").alias("call"))
    return rows.select(
        "conv_id", "turn", "role", "kind", F.coalesce("call.id", F.when(F.col("kind") == "result", F.col("result_of"))).alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"),
        F.col("call.needs").alias("needs"), F.when(F.col("kind") == "result", F.col("result")).when(F.col("kind") == "message", F.col("text")).alias("content"),
    )


def exchanges_as_calls(messages: DataFrame, tool: str = "reply") -> DataFrame:
    """The same rows from plain conversations: a user's turn calls ``tool``, the assistant's next turn is its result.

    What calls need is told by exchange_needs(), so that texts aren't shuffled for it.
    """
    turn = _asked()
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    is_call = F.col("role") == "user"
    arguments = F.parse_json(F.to_json(F.struct(F.col("text"), F.col("turn"))))
    return messages.select(
        "conv_id", "turn", "role", kind.alias("kind"), _exchange(turn).alias("call_id"), F.when(is_call, F.lit(tool)).alias("name"),
        F.when(is_call, arguments).alias("arguments"), F.lit(None).cast("array<string>").alias("needs"), F.when(~F.coalesce(is_call, F.lit(False)), F.col("text")).alias("content"),
    )


def _asked() -> Column:
    return F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)


def _exchange(turn: Column) -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def exchange_needs(messages: DataFrame) -> DataFrame:
    """conv_id, call_id, need of plain conversations: a call needs the one whose result stands directly before it.

    That is the call of two turns earlier, if both it and its result are there.
    """
    turns = messages.where("role in ('user', 'assistant')").select("conv_id", _asked().alias("asked"), "role")
    told = turns.groupBy("conv_id", "asked").agg(F.bool_or(F.col("role") == "user").alias("called"), F.count_distinct("role").alias("n"))
    before = told.where("n = 2").select("conv_id", (F.col("asked") + 2).alias("asked"))
    return told.where("called").join(before, ["conv_id", "asked"]).select("conv_id", _exchange(F.col("asked")).alias("call_id"), _exchange(F.col("asked") - 2).alias("need"))


def schema_error(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """What is wrong with a call's arguments, null if nothing is.

    ``schemas``: tool to {"properties": {argument: {"type", "minLength"?, "enum"?}}, "required": [...],
    "additionalProperties"?: bool}, the common part of JSON Schema.
    """
    out = F.lit("unknown tool")
    for tool, schema in sorted(schemas.items()):
        wrong = F.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), "arguments are no object")
        for arg in sorted(schema.get("required", ())):
            wrong = wrong.when(F.try_variant_get(arguments, f"$['{arg}']", "variant").isNull(), f"{arg} is missing")
        for arg, rule in sorted(schema.get("properties", {}).items()):
            value = F.try_variant_get(arguments, f"$['{arg}']", "variant")
            there = value.isNotNull()
            if "type" in rule:
                wrong = wrong.when(there & ~F.schema_of_variant(value).rlike(f"^({_TYPES[rule['type']]})$"), f"{arg} is no {rule['type']}")
            text = F.try_variant_get(arguments, f"$['{arg}']", "string")
            if "minLength" in rule:
                wrong = wrong.when(there & (F.char_length(text) < rule["minLength"]), f"{arg} is too short")
            if "enum" in rule:
                wrong = wrong.when(there & ~text.isin([str(x) for x in rule["enum"]]), f"{arg} is none of its values")
        if schema.get("additionalProperties", True) is False:
            names = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
            wrong = wrong.when(F.size(F.array_except(names, F.array(*[F.lit(a) for a in sorted(schema.get("properties", {}))]))) > 0, "an argument is not in the schema")
        out = F.when(name == tool, wrong).otherwise(out)
    return out


def _levels(calls: DataFrame, more_needs: DataFrame | None = None) -> DataFrame:
    """conv_id, call_id, level: 0 for calls that need nothing, else one more than the highest that they need.

    Each call has terms: its level is at least ``more``, or at least ``more`` above the level of ``need``. A round puts the
    terms of a needed call in its place if it has but one open need, so paths double: a chain or tree takes as many rounds
    as its depth has binary digits, and only calls with several open needs wait for them. Of equal needs the largest
    term stays, so terms never grow in number. A path longer than there are calls is a circle; calls with a need that is
    missing or part of a circle stay without a level. One call that very many need is a skewed join, nothing else.
    """
    key, need_key = ["conv_id", "call_id"], ["conv_id", "need"]
    ids = stored(calls.select(*key).distinct())
    never = ids.count() + 1
    known = ids.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("known"))
    needs = calls.select(*key, F.explode("needs").alias("need"))
    needs = (needs if more_needs is None else needs.union(more_needs.select(*key, "need"))).where("need is not null").join(known, need_key, "left")
    needs = needs.select(*key, F.when(F.col("known"), F.col("need")).alias("need"), F.when(F.col("known"), F.lit(1)).otherwise(never).cast("long").alias("more"))
    terms = _merged(ids.select(*key, F.lit(None).cast("string").alias("need"), F.lit(0).cast("long").alias("more")).union(needs), never)
    while True:
        is_open = F.col("need").isNotNull()
        state = terms.groupBy(*key).agg(
            F.max(F.when(~is_open, F.col("more"))).alias("base"), F.count_if(is_open).alias("n_open"), F.max(F.when(is_open, F.struct("need", "more"))).alias("onward")
        ).select("conv_id", F.col("call_id").alias("need"), "base", "n_open", "onward")
        met = stored(terms.where(is_open).join(state, need_key))
        if met.where("n_open <= 1").isEmpty():
            break
        none = F.lit(None).cast("string")
        put = F.when(F.col("n_open") > 1, F.array(F.struct("need", "more"))).otherwise(F.array_compact(F.array(
            F.struct(none.alias("need"), (F.col("base") + F.col("more")).alias("more")), F.when(F.col("n_open") == 1, F.struct(F.col("onward.need").alias("need"), (F.col("onward.more") + F.col("more")).alias("more"))),
        )))
        terms = _merged(terms.where(~is_open).union(met.select(*key, F.inline(put))), never)
    return terms.groupBy(*key).agg(F.max("more").alias("level"), F.max("need").alias("open")).where(F.col("open").isNull() & (F.col("level") < never)).select(*key, "level")


def _merged(terms: DataFrame, never: int) -> DataFrame:
    """The largest term for each need; a need of itself or over too long a path is never met, and a call with one has no open needs."""
    circle = F.col("need").isNotNull() & ((F.col("need") == F.col("call_id")) | (F.col("more") >= never))
    told = terms.select("conv_id", "call_id", F.when(~circle, F.col("need")).alias("need"), F.when(circle, F.lit(never)).otherwise(F.least("more", F.lit(never))).cast("long").alias("more"))
    largest = told.groupBy("conv_id", "call_id", "need").agg(F.max("more").alias("more"))
    lost = largest.where(F.col("need").isNull() & (F.col("more") >= never)).select("conv_id", "call_id", F.lit(True).alias("lost"))
    return stored(largest.join(lost, ["conv_id", "call_id"], "left").where("lost is null or need is null").drop("lost"))


def linked(rows: DataFrame, schemas: Mapping[str, Mapping], needs: DataFrame | None = None) -> DataFrame:
    """Link, order, validate and serialise rows as parsed_messages() makes them.

    ``needs``: conv_id, call_id, need of calls of ``rows``, beside those in the rows.

    Returns conv_id, turn, kind, call_id, ``n_results`` (of the call), ``linked`` (a call with a result, a result with a
    call; false for plain messages), ``step`` (2 * level for calls, one more for their results; by (step, turn) each
    call follows the results that it needs; null for messages and what can't be ordered), ``error`` (null: valid) and
    ``json`` (canonical: keys sorted, no spaces, absent values left out).

    An identifier counts within its conversation. If several calls share one, the first by (turn, arguments) stands
    for it and others with different contents get the error "identifier repeats". Rows without an identifier or
    conversation link to nothing. Repeated rows give repeated results.
    """
    key = ["conv_id", "call_id"]
    rows = rows.withColumn("args", F.to_json("arguments"))
    calls = rows.where("kind = 'call' and conv_id is not null and call_id is not null").select(*key, "turn", "args", "needs")
    ids = calls.groupBy(*key).agg(F.min(F.struct("turn", "args")).alias("first"), F.count("*").alias("n_calls"))
    results = rows.where("kind = 'result' and conv_id is not null and call_id is not null").groupBy(*key).agg(F.count("*").alias("n_results"))
    link = ids.join(results, key, "full").join(_levels(calls, needs), key, "left")
    out = rows.join(link, key, "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    n_calls, n_results = F.coalesce("n_calls", F.lit(0)), F.coalesce("n_results", F.lit(0))
    repeats = call & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn", "args"))
    error = F.when(repeats, "identifier repeats").when(call, schema_error(F.col("name"), F.col("arguments"), schemas)).when(result & (n_calls == 0), "result without call")
    line = F.when(call, F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", F.lit("tool_call").alias("type")))).when(
        result, F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")))
    ).otherwise(F.to_json(F.struct("content", "role")))
    return out.select(
        "conv_id", "turn", "kind", "call_id", F.when(call, n_results).alias("n_results"),
        F.coalesce((call & (n_results > 0) & ~F.coalesce(repeats, F.lit(False))) | (result & (n_calls > 0)), F.lit(False)).alias("linked"),
        F.when(call, F.col("level") * 2).when(result, F.col("level") * 2 + 1).cast("long").alias("step"), error.alias("error"), line.alias("json"),
    )
