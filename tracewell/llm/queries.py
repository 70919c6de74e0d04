"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
import public_tokenizers
from tracewell.llm import byte_bpe, chat, decontam, html_extract, licenses, merkle, mixing, near_dup, quality, sharding, substring_dedup, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_words(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The target mix: twice the share for one domain, more for the rarer languages.
MIX = {"budget_share": 0.6, "domain_weights": {"d0": 2.0}, "lang_weights": {"en": 1.0, "de": 1.5, "es": 2.0, "fr": 1.5}}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), max_epochs=2, **MIX)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("clauses").cast("long").alias("n_clauses"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.line_first(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: What a user's turn must look like as a call.
REPLY = {"reply": {"properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}}, "required": ["text", "turn"], "additionalProperties": False}}


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    return chat.linked(chat.exchanges_as_calls(messages), REPLY, chat.exchange_needs(messages))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(_table(spark, sf_dir, "embeddings"))


#: The rank file that op12 encodes by.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    out = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = lambda text: merkle.record_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select("doc_id", "source", told(F.col("text")).alias("leaf"), F.when(tampered, told(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered_leaf"))
    out = merkle.proofs(leaves).withColumn("folded_root", merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op5_near_dup": op5_near_dup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_decontam": op8_decontam,
    "op9_sharding": op9_sharding,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

#: Words as the operators take them: between ASCII white space.
_W = r"'[^ \t\n\v\f\r]+'"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str = "text") -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {_W})"


_OP2 = f"""WITH d AS (SELECT doc_id, {_words()} AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, p, array_to_string(list_slice(w, p, p + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM s) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest(range(0, 20)) AS o)),
e AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN e ON d.doc_id = e.doc_id"""

_OP8 = f"""WITH i AS (SELECT item_id, regexp_extract_all({_LOW}, {_W}) AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
t AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i WHERE len(w) >= 5)),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_W}) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id), h AS (SELECT doc_id, item_id, count(*) AS k FROM s JOIN t USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, k AS n_shared, n AS n_shingles, k / n AS containment FROM h JOIN n USING (item_id) WHERE k >= 0.8 * n - 1e-9"""


def _share_sql(nodes: str, parent: str, name: str) -> str:
    """The nodes with ``given``: those filled up come first by capacity / weight, the others share what is left by weight."""
    over = f"PARTITION BY {parent or '1'}"
    order = f"{over} ORDER BY capacity / weight, {name} NULLS FIRST"
    return f"""SELECT * EXCLUDE (lft, opn, nth, stp), CASE WHEN stp IS NULL OR nth < stp[1] THEN capacity ELSE least(CAST(stp[2] * weight // stp[3] AS BIGINT), capacity) END AS given FROM (
SELECT *, min(CASE WHEN lft * weight < CAST(capacity AS HUGEINT) * opn THEN [nth, lft, opn] END) OVER ({over}) AS stp FROM (
SELECT *, CAST(row_number() OVER ({order}) AS HUGEINT) AS nth, CAST(greatest(budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS HUGEINT) AS lft, CAST(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS opn FROM {nodes}))"""


def _weight_sql(name: str, weights: dict[str, float]) -> str:
    return f"CAST(CASE {name} " + " ".join(f"WHEN '{k}' THEN {round(v * mixing.UNIT)}" for k, v in weights.items()) + f" ELSE {mixing.UNIT} END AS BIGINT)"


_OP4 = f"""WITH r AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) AS key, 'd' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 8) AS BIGINT) % 4) AS domain, lang, source, CAST(len({_words()}) AS BIGINT) AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS capacity FROM r GROUP BY ALL),
a0 AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, {_weight_sql('domain', MIX['domain_weights'])} AS weight, CAST(floor((SELECT sum(tokens) FROM l) * {round(MIX['budget_share'] * mixing.UNIT)} / {mixing.UNIT}.0) AS BIGINT) AS budget FROM l GROUP BY domain), a AS ({_share_sql('a0', '', 'domain')}),
b0 AS (SELECT l.domain, lang, CAST(sum(l.capacity) AS BIGINT) AS capacity, {_weight_sql('lang', MIX['lang_weights'])} AS weight, any_value(given) AS budget FROM l JOIN a ON l.domain IS NOT DISTINCT FROM a.domain GROUP BY l.domain, lang), b AS ({_share_sql('b0', 'domain', 'lang')}),
c0 AS (SELECT l.*, CAST({mixing.UNIT} AS BIGINT) AS weight, b.given AS budget FROM l JOIN b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang), c AS ({_share_sql('c0', 'domain, lang', 'source')}),
e AS (SELECT *, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole FROM c),
o AS (SELECT r.*, whole, given - whole * tokens AS rest, sum(n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY md5('17|' || whole || '|' || key)) AS upto FROM r JOIN e ON r.domain IS NOT DISTINCT FROM e.domain AND r.lang IS NOT DISTINCT FROM e.lang AND r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS INT) AS epoch FROM o WHERE n_tokens > 0 AND whole < 2 AND upto <= rest
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(x AS INT) FROM (SELECT *, unnest(CASE WHEN n_tokens = 0 THEN [0] ELSE range(0, whole) END) AS x FROM o)"""

_SYMBOLS = "'[#*$%&|<>]'"
_LINE_FAILS = f"""(len(regexp_extract_all(x, {_W})) > 0 AND (len(regexp_extract_all(x, '[#*$%&<>]+|[!?]{{2,}}')) * 3 > len(regexp_extract_all(x, {_W}))
OR (len(regexp_extract_all(x, '\\s[|>»·•/]\\s')) >= 3 AND len(regexp_extract_all(x, {_W})) <= len(regexp_extract_all(x, '\\s[|>»·•/]\\s')) * 3 + 3) OR regexp_matches(lower(trim(x)), '{quality.BOILERPLATE}')))"""
_OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words()} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_W})) AS lines, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT {_LINE_FAILS}) AS good FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, p, p + 2), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, CAST(count(DISTINCT p + o) AS BIGINT) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, {_SYMBOLS})) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
CAST(length(array_to_string(w, '')) - length(array_to_string(regexp_extract_all(array_to_string(good, chr(10)), {_W}), '')) AS BIGINT) AS n_lost FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost <= word_chars * 0.5 AND n_symbols * 10 < n_words * 3 AS kept FROM m"""

#: Calls stand in a row while each has its result and the next call is two turns on; the place in the row is the level.
_OP10 = """WITH c AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, conv_id || ':' || CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_id FROM conversations),
a AS (SELECT call_id, count(*) AS n FROM c WHERE kind = 'call' GROUP BY 1), b AS (SELECT call_id, count(*) AS n FROM c WHERE kind = 'result' GROUP BY 1),
u AS (SELECT DISTINCT c.conv_id, c.turn, c.call_id, b.call_id IS NOT NULL AS answered FROM c LEFT JOIN b ON b.call_id = c.call_id WHERE kind = 'call'),
w AS (SELECT u.*, CASE WHEN o.call_id IS NULL THEN u.turn END AS head FROM u LEFT JOIN u AS o ON o.conv_id = u.conv_id AND o.turn = u.turn - 2 AND o.answered),
l AS (SELECT call_id, (turn - max(head) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn)) // 2 AS level FROM w)
SELECT conv_id, turn, kind, c.call_id, CASE WHEN kind = 'call' THEN coalesce(b.n, 0) END AS n_results, coalesce((kind = 'call' AND b.n > 0) OR (kind = 'result' AND a.n > 0), FALSE) AS linked,
CAST(CASE WHEN kind = 'call' THEN 2 * l.level WHEN kind = 'result' THEN 2 * l.level + 1 END AS BIGINT) AS step, CASE WHEN kind = 'call' AND text IS NULL THEN 'text is missing' WHEN kind = 'call' AND length(text) < 1 THEN 'text is too short' WHEN kind = 'result' AND a.n IS NULL THEN 'result without call' END AS error,
CASE kind WHEN 'call' THEN '{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(c.call_id) || ',"name":"reply","type":"tool_call"}' WHEN 'result' THEN '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":' || to_json(c.call_id) || '}' ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
FROM c LEFT JOIN a ON a.call_id = c.call_id LEFT JOIN b ON b.call_id = c.call_id LEFT JOIN l ON l.call_id = c.call_id"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = " UNION ALL ".join(f"SELECT {k} AS k, '{label}' AS label, {len(t.split()) + licenses.SLACK} AS width, {sorted(set(t.split()))} AS words, CAST({licenses.in_place(t)} AS VARCHAR[]) AS named" for k, (t, label) in enumerate(licenses.TEMPLATES.items()))
_PHRASES = " UNION ALL ".join(f"SELECT {p.split()} AS words, '{label}' AS label" for p, label in licenses.PHRASES.items())
_OP1 = f"""WITH d AS (SELECT doc_id, text, {_FOLDED} AS w FROM documents), t AS ({_TEMPLATES}), p AS ({_PHRASES}),
q AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p ON list_slice(w, i, i + len(words) - 1) = words),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word FROM q GROUP BY doc_id),
runs AS (SELECT doc_id, p, k, label, words, width, named, ' ' || array_to_string(list_slice(w, p, p + width - 1), ' ') || ' ' AS block, len(list_intersect(list_distinct(list_slice(w, p, p + width - 1)), words)) / len(words) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) JOIN t ON list_contains(words, w[p])),
met AS (SELECT doc_id, p, k, label, words, width, c, len(named) AS named FROM runs WHERE c >= 0.9 AND len(list_filter(named, lambda x: NOT contains(block, ' ' || x || ' '))) = 0),
best AS (SELECT * FROM met a WHERE a.named > 0 OR NOT EXISTS (SELECT 1 FROM met b WHERE a.doc_id = b.doc_id AND b.p < a.p + a.width AND a.p < b.p + b.width AND (b.c > a.c OR (b.c = a.c AND len(b.words) > len(a.words) AND list_has_all(b.words, a.words))))),
own AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM best UNION ALL SELECT doc_id, label FROM q) GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM q GROUP BY doc_id), score AS (SELECT doc_id, max(c) AS c FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word, coalesce(named.labels, '') AS base_labels, coalesce(own.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(score.c, 0.0) END AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN score ON score.doc_id = d.doc_id"""

def _wins(n: int) -> str:
    draws = ", ".join(f"{{'score': -1.0 / ln((CAST('0x' || substr(md5(key || '/{i}'), 1, 13) AS BIGINT) + 0.5) / {2**52}.0), 'shard': {i}}}" for i in range(n))
    return f"list_max([{draws}]).shard"


#: CRC-32 from its rule: each byte's eight steps make a table, which is then walked byte by byte.
_OP9 = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(CAST({0xEDB88320} AS BIGINT), c >> 1) ELSE c >> 1 END)) AS tab),
s AS (SELECT doc_id, key, octet_length(t) + 1 AS size, xor(list_reduce(list_prepend(CAST({2**32 - 1} AS BIGINT), list_transform(regexp_extract_all(hex(t), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(tab[xor(a & 255, b) + 1], a >> 8)), CAST({2**32 - 1} AS BIGINT)) AS text_crc32, {_wins(8)} AS shard, {_wins(9)} AS grown_shard FROM d, c)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key), text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM s"""

def _record_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def _siblings_sql(nodes: str) -> str:
    """Of each node the digests of its run's nodes before and after it."""
    return f"""SELECT a.lvl, a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|' || coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS step
FROM {nodes} a JOIN {nodes} b ON a.lvl = b.lvl AND a.tree = b.tree AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL"""


#: crc32(doc_id) as in op9.
_OP13 = f"""WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(CAST({0xEDB88320} AS BIGINT), c >> 1) ELSE c >> 1 END)) AS tab),
l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, {_record_sql('text')} AS leaf, CASE WHEN xor(list_reduce(list_prepend(CAST({2**32 - 1} AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(tab[xor(a & 255, b) + 1], a >> 8)), CAST({2**32 - 1} AS BIGINT)) % 2 = 0 THEN {_record_sql("replace(text, chr(10), '')")} END AS bent FROM documents, c),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (SELECT 0 AS lvl, tree, pos, leaf AS digest, n FROM p UNION ALL SELECT lvl + 1, tree, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY lvl, tree, pos // 3, n),
s AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, '' AS tree, pos, subroot AS digest, n FROM s UNION ALL SELECT lvl + 1, tree, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, tree, pos // 3, n),
low AS (SELECT p.tree, p.pos, list(x.step ORDER BY x.lvl) AS steps FROM p JOIN ({_siblings_sql('t')}) x ON x.tree = p.tree AND x.pos = p.pos // CAST(pow(3, x.lvl) AS BIGINT) GROUP BY p.tree, p.pos),
high AS (SELECT s.name, list(x.step ORDER BY x.lvl) AS steps FROM s JOIN ({_siblings_sql('u')}) x ON x.pos = s.pos // CAST(pow(3, x.lvl) AS BIGINT) GROUP BY s.name),
j AS (SELECT p.doc_id, p.leaf, coalesce(p.bent, p.leaf) AS shown, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
FROM p JOIN s ON s.name = p.tree LEFT JOIN low ON low.tree = p.tree AND low.pos = p.pos LEFT JOIN high ON high.name = p.tree),
f AS (SELECT *, list_reduce(list_prepend(shown, steps), lambda node, x: sha256(split_part(x, '|', 1) || node || split_part(x, '|', 2))) AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""

#: Not here: op3, op5, op6, op11 (eigenvectors), op12 (merges by rank) and the pipeline, which SQL can't express; tests hold them to brute force or held-out labels.
ORACLES: dict[str, str] = {"op1_licenses": _OP1, "op2_substring_dedup": _OP2, "op4_mixing": _OP4, "op7_quality": _OP7, "op8_decontam": _OP8, "op9_sharding": _OP9, "op10_chat": _OP10, "op13_merkle": _OP13}
