"""Readers: JSON documents, NDJSON, CSV/TSV and key=value text become one frame of raw records.

A raw record has ``file`` (index of its input), ``line`` (1-based; its position in a JSON document), ``id``, ``line_id``
(the id was made from the line), and either ``nested`` (JSON text of an object) or ``flat`` with ``names`` (normalised
name to value, and to the name as written).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewell.functions.text import present
from tracewell.operators.tables import stored

FORMATS = ("auto", "json", "ndjson", "csv", "text")
DELIMITERS = (",", "\t", ";", "|")
_HEADER = re.compile(r"[A-Za-z_@][A-Za-z0-9_.@ -]{0,99}\Z")
_STAMP = r"^\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\]?"
_PAIR = r"(?:^|[ \t\f\x0B,;])([A-Za-z_@][A-Za-z0-9_.@-]*)=(?:\"((?:[^\"\\]|\\.)*)\"|([^ \t\f\x0B,;]*))"
_BLANK = r"^[ \t\r\f\x0B]*$"
SCHEMA = "file int, line long, id string, line_id boolean, nested string, flat map<string,string>, names map<string,string>"


class ReadError(ValueError):
    """Input that no reader accepts, with the reason."""


@dataclass(frozen=True)
class Input:
    path: str
    format: str = "auto"


def split_csv(line: str, delimiter: str) -> tuple[list[str], bool]:
    """Fields of a line, and whether it ends within quotes; only a quote that begins a field quotes."""
    fields, at, n = [], 0, len(line)
    while True:
        if line.startswith('"', at):
            at, value = at + 1, ""
            while True:
                end = line.find('"', at)
                if end < 0:
                    return [*fields, value + line[at:]], True
                value, at = value + line[at:end], end + 1
                if not line.startswith('"', at):
                    break
                value, at = value + '"', at + 1
        else:
            value = ""
        end = line.find(delimiter, at)
        fields.append(value + line[at : n if end < 0 else end])
        if end < 0:
            return fields, False
        at = end + len(delimiter)


def csv_header(line: str) -> tuple[str, list[str]] | None:
    """The delimiter that makes most columns, and their names, if the line is a header."""
    best = max(DELIMITERS, key=lambda d: (len(split_csv(line, d)[0]), -DELIMITERS.index(d)))
    names, open_quote = split_csv(line, best)
    names = [x.strip() for x in names]
    if len(names) < 2 or open_quote or len(set(names)) < len(names) or not all(_HEADER.match(x) for x in names):
        return None
    if len(names) < 3 and any(" " in x for x in names):
        return None
    return best, names


def detect_format(first: str) -> str:
    """The format by the first line that isn't blank."""
    line = first.lstrip(" \t\r\f\v")
    if line.startswith("[") and line[1:].lstrip()[:1] in ("", "{", "]"):
        return "json"
    if line.startswith("{"):
        try:
            return "ndjson" if isinstance(json.loads(line), dict) else "json"
        except ValueError:
            return "json"
    return "csv" if csv_header(line) else "text"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (1-based, blanks count) and ``value`` without BOM and carriage returns; ``file_path`` and ``block``: where it lies.

    Lines are numbered within the file's blocks, and blocks by the lines before them: one count per block, no sort of the
    lines and no single task. A file counts as one input, so ``path`` should name one file.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    order = Window.partitionBy(F.lit(0)).orderBy("file_path", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    line = (F.col("at") - F.col("low") + F.col("before") + 1).alias("line")
    value = F.regexp_replace("value", r"\r+$", "")
    return rows.join(blocks.drop("n"), ["file_path", "block"]).select("file_path", "block", line, F.when(F.col("block") == 0, F.regexp_replace(value, "^﻿+", "")).otherwise(value).alias("value"))


def _first_lines(spark: SparkSession, path: str, lines: DataFrame) -> list:
    """The first two lines that aren't blank, with their numbers: from the file's head if its first lines hold two, else from all lines."""
    head = spark.read.option("lineSep", "\n").text(path).select("value").head(20)
    head = [(k + 1, re.sub(r"\r+$", "", r["value"]).lstrip("\ufeff") if k == 0 else re.sub(r"\r+$", "", r["value"])) for k, r in enumerate(head)]
    full = [{"line": k, "value": v} for k, v in head if not re.fullmatch(_BLANK.strip("^$"), v)]
    return full[:2] if len(full) > 1 else lines.where(~F.col("value").rlike(_BLANK)).orderBy("line").limit(2).collect()


def _text_of(v: Column, path: str) -> Column:
    return present(F.try_variant_get(v, path, "string"))


def _json_records(rows: DataFrame, label: str) -> DataFrame:
    """Records of ``line`` and ``value`` (JSON text)."""
    where = F.concat(F.lit(f"{label} "), F.col("line").cast("string"))
    v = F.try_parse_json("value")
    rows = rows.withColumn("v", F.when(v.isNull(), F.raise_error(F.concat(where, F.lit(" is not valid JSON"))).cast("variant")).otherwise(v))
    kind = F.schema_of_variant("v")
    rows = rows.withColumn("v", F.when(kind.startswith("OBJECT"), F.col("v")).otherwise(F.raise_error(F.concat(where, F.lit(" is not a JSON object"))).cast("variant")))
    source, fields = F.try_variant_get("v", "$._source", "variant"), F.try_variant_get("v", "$.fields", "variant")
    is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    inner = F.when(is_object(source), source).otherwise(F.col("v"))
    own = F.coalesce(_text_of(F.col("v"), "$.id"), _text_of(F.col("v"), "$._id"), _text_of(inner, "$.id"), _text_of(inner, "$.event.id"))
    flat = is_object(fields) & ~is_object(source)
    pairs = F.map_entries(F.from_json(F.to_json(fields), "map<string,string>"))
    first = lambda c: F.when(c.startswith("["), F.coalesce(F.get(F.from_json(c, "array<string>"), F.lit(0)), F.lit(""))).otherwise(c)
    made = F.when(flat, F.transform(pairs, lambda e: F.struct(e["key"].alias("name"), first(e["value"]).alias("value"))))
    rows = rows.select("line", F.coalesce(own, F.concat(F.lit(f"{label}-"), F.col("line").cast("string"))).alias("id"), (own.isNull() & F.lit(label == "line")).alias("line_id"), F.when(~flat, F.when(is_object(source), F.to_json(source)).otherwise(F.col("value"))).alias("nested"), made.alias("pairs"))
    return _mapped(rows)


def _mapped(rows: DataFrame) -> DataFrame:
    """Turn ``pairs`` into flat and names: the first value that isn't empty counts for a name."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[ _.@-]", "")
    pairs = F.filter("pairs", lambda p: p["value"] != "")
    keyed = F.transform(pairs, lambda p: F.struct(norm(p["name"]).alias("key"), p["value"].alias("value"), p["name"].alias("name")))
    rows = rows.withColumn("keyed", keyed)
    keys = F.array_distinct(F.transform("keyed", lambda p: p["key"]))
    at = lambda k, what: F.get(F.filter("keyed", lambda p: p["key"] == k), F.lit(0))[what]
    return rows.withColumn("keys", keys).select(
        "line", "id", "line_id", "nested",
        F.map_from_arrays("keys", F.transform("keys", lambda k: at(k, "value"))).alias("flat"),
        F.map_from_arrays("keys", F.transform("keys", lambda k: at(k, "name"))).alias("names"),
    )


def _flat_ids(rows: DataFrame) -> DataFrame:
    own = present(F.element_at("flat", "id"))
    return rows.withColumn("line_id", own.isNull()).withColumn("id", F.coalesce(own, F.concat(F.lit("line-"), F.col("line").cast("string"))))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """S3: the events of a JSON document, which one task has to parse whole."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿+", "").alias("value"))
    v = F.try_parse_json("value")
    text = text.withColumn("v", F.when(v.isNull(), F.raise_error(F.lit("not valid JSON")).cast("variant")).otherwise(v))
    many = "array<variant>"
    events = F.coalesce(F.try_variant_get("v", "$", many), F.try_variant_get("v", "$.events", many), F.try_variant_get("v", "$.hits.hits", many), F.array("v"))
    rows = text.select(F.posexplode(events).alias("at", "one")).select((F.col("at") + 1).cast("long").alias("line"), F.to_json("one").alias("value"))
    return _json_records(rows, "event")


def _quoting(lines: DataFrame, whole: str) -> DataFrame:
    """``lines`` with ``inside`` (it begins within quotes) and ``open`` (it ends so).

    A line takes one of two states to one of two states. Such steps compose: a block of lines is again one step, found
    within the block; a scan over the blocks' steps tells how each block begins, and lines follow from that.
    """
    closed = lambda value: value.rlike(whole)
    rows = lines.withColumns({"from_out": ~closed(F.col("value")), "from_in": ~closed(F.concat(F.lit('"'), F.col("value")))})
    # A line fixes the state, flips it or leaves it; what holds is the last fixed state and the flips since.
    rows = rows.withColumns({"fixed": F.when(F.col("from_out") == F.col("from_in"), F.col("from_out").cast("int")), "flip": (F.col("from_out") & ~F.col("from_in")).cast("int")})
    block = Window.partitionBy("file_path", "block").orderBy("line")
    upto, before = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("flips", F.sum("flip").over(upto))
    mark = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "flips"))
    rows = stored(rows.withColumns({"mark": F.last(mark, ignorenulls=True).over(before), "flipped": F.col("flips") - F.col("flip")}))
    state = lambda m, flips, entry: (F.coalesce(m["fixed"] + flips - m["flips"], entry + flips) % 2).cast("int")
    steps = rows.groupBy("file_path", "block").agg(F.max_by(mark, F.when(mark.isNotNull(), F.col("line"))).alias("last"), F.sum("flip").alias("all"))
    steps = steps.withColumns({"ends": state(F.col("last"), F.col("all"), F.lit(None).cast("long")), "flip": F.when(F.col("last").isNull(), F.col("all")).otherwise(0)})
    over = Window.partitionBy(F.lit(0)).orderBy("file_path", "block")
    steps = steps.withColumn("sum", F.sum("flip").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.last(F.when(F.col("ends").isNotNull(), F.struct(F.col("ends").alias("fixed"), F.col("sum").alias("flips"))), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.select("file_path", "block", state(known, F.col("sum") - F.col("flip"), F.lit(0)).alias("entry"))
    rows = rows.join(steps, ["file_path", "block"])
    rows = rows.withColumn("inside", state(F.col("mark"), F.col("flipped"), F.col("entry")) == 1)
    return rows.select("file_path", "block", "line", "value", "inside", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("open"))


def _csv_lines(lines: DataFrame, whole: str) -> DataFrame:
    """``line`` and ``value`` of each record of lines after the header, of those that span lines the first line and their text.

    Only lines of such records are shuffled, by their record; others stay where they are.
    """
    rows = stored(_quoting(lines, whole)).where(F.col("inside") | ~F.col("value").rlike(_BLANK))
    alone = rows.where("not inside and not open").select("line", "value")
    spread = rows.where("inside or open")
    block = Window.partitionBy("file_path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(~F.col("inside"), F.col("line"))
    carried = spread.groupBy("file_path", "block").agg(F.max(begins).alias("last"))
    carried = carried.select("file_path", "block", F.last("last", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("file_path", "block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    spread = spread.join(carried, ["file_path", "block"]).withColumn("start", F.coalesce(F.last(begins, ignorenulls=True).over(block), "carried"))
    joined = spread.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts"), F.max_by("open", "line").alias("left"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    error = F.raise_error(F.concat(F.lit("line "), F.col("start").cast("string"), F.lit(" opens a quoted CSV field that never closes"))).cast("string")
    return alone.unionByName(joined.select(F.col("start").alias("line"), F.when(F.col("left"), error).otherwise(text).alias("value")))


def _csv(spark: SparkSession, path: str, lines: DataFrame, first: tuple[int, str]) -> DataFrame:
    """S5, S11. Lines are split where they lie, also where quoted fields hold line breaks."""
    header = csv_header(first[1])
    if not header:
        raise ReadError("first line is not a CSV header of field names")
    delimiter, names = header
    d = re.escape(delimiter)
    whole = rf'^(?:(?:"(?:[^"]|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|)(?:{d}|\z))*+\z'
    after = lines.where(F.col("line") > first[0])
    full = after.where(~F.col("value").rlike(_BLANK))
    body = full if full.where(~F.col("value").rlike(whole)).isEmpty() else _csv_lines(after, whole)
    field = rf'{d}(?:"((?:[^"]|"")*+)"([^{d}]*+)|([^{d}]*+))'  # with a delimiter before it, so that no match is empty
    quoted, rest, bare = (F.regexp_extract_all(F.concat(F.lit(delimiter), "value"), F.lit(field), k) for k in (1, 2, 3))
    cells = F.transform(F.arrays_zip(quoted.alias("q"), rest.alias("r"), bare.alias("b")), lambda x: F.concat(F.replace(x["q"], F.lit('""'), F.lit('"')), x["r"], x["b"]))
    body = body.select("line", cells.alias("cells"))
    known = F.array(*[F.lit(n) for n in names])
    pairs = F.zip_with(F.slice("cells", F.lit(1), F.least(F.size("cells"), F.lit(len(names)))), F.slice(known, F.lit(1), F.least(F.size("cells"), F.lit(len(names)))), lambda v, n: F.struct(n.alias("name"), v.alias("value")))
    return _flat_ids(_mapped(body.select("line", F.lit(None).cast("string").alias("id"), F.lit(True).alias("line_id"), F.lit(None).cast("string").alias("nested"), pairs.alias("pairs"))))


def _plain(lines: DataFrame) -> DataFrame:
    """Message, key=value pairs and the leading time of each line."""
    body = lines.where(~F.col("value").rlike(_BLANK))
    name, quoted, bare = (F.regexp_extract_all("value", F.lit(_PAIR), k) for k in (1, 2, 3))
    pairs = F.transform(F.arrays_zip(name.alias("n"), quoted.alias("q"), bare.alias("b")), lambda x: F.struct(x["n"].alias("name"), F.when(x["q"] != "", F.replace(x["q"], F.lit('\\"'), F.lit('"'))).otherwise(x["b"]).alias("value")))
    message = F.array(F.struct(F.lit("message").alias("name"), F.col("value").alias("value")))
    stamp = F.array(F.struct(F.lit("@timestamp").alias("name"), F.regexp_extract("value", _STAMP, 1).alias("value")))
    return _flat_ids(_mapped(body.select("line", F.lit(None).cast("string").alias("id"), F.lit(True).alias("line_id"), F.lit(None).cast("string").alias("nested"), F.concat(message, pairs, stamp).alias("pairs"))))


def read_input(spark: SparkSession, source: Input, file: int = 0) -> DataFrame:
    """Raw records of one input; format "auto" decides by its first line that isn't blank."""
    if source.format not in FORMATS:
        raise ReadError(f"format must be one of {', '.join(FORMATS)}")
    lines = numbered_lines(spark, source.path)
    full = lines.where(~F.col("value").rlike(_BLANK))
    two = _first_lines(spark, source.path, lines)
    if not two:
        raise ReadError("input contains no events")
    kind = detect_format(two[0]["value"]) if source.format == "auto" else source.format
    if kind == "ndjson" and len(two) == 1:
        try:
            one = json.loads(two[0]["value"])
        except ValueError:
            one = None
        if isinstance(one, dict) and (isinstance(one.get("events"), list) or isinstance(one.get("hits"), dict) and isinstance(one["hits"].get("hits"), list)):
            kind = "json"
    if kind == "json":
        rows = _documents(spark, source.path)
    elif kind == "ndjson":
        rows = _json_records(full, "line")
    elif kind == "csv":
        rows = _csv(spark, source.path, lines, (two[0]["line"], two[0]["value"]))
    else:
        rows = _plain(lines)
    return rows.select(F.lit(file).alias("file"), "line", "id", "line_id", "nested", "flat", "names")


def read_inputs(spark: SparkSession, sources: list[Input | str]) -> DataFrame:
    """All inputs' records, ``file`` being their position."""
    out = None
    for k, s in enumerate(sources):
        rows = read_input(spark, s if isinstance(s, Input) else Input(s), k)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ReadError("no inputs")
    return out
