"""The incident operators as queries over the driver's tables, each with DuckDB SQL for the same rows.

``events`` stands for telemetry: a user acts (``event_type``) on a key (``props.k``) at a time; a day is an input file.
``orders`` and ``lineitem`` make a bipartite graph, ``pages`` give domains, ``documents`` details that vary.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewell.functions import masks, net, text, times
from tracewell.operators.dedup import numbered, without_duplicates
from tracewell.operators.describe import Picture, summaries
from tracewell.operators.entities import entity_observations, owners_of_addresses
from tracewell.operators.fold import folded_runs, identical_members, with_upper_median
from tracewell.operators.identity import Processes, resolve_references, start_keys
from tracewell.operators.links import handle_starts, last_writer, merged, next_start, process_observations, touching
from tracewell.operators.tables import stored
from tracewell.plans.investigate import Options, frontier, investigate, joined, pruned, reachable
from tracewell.plans.judge import phrase_score
from tracewell.plans.learn import flattened, profiles_frame
from tracewell.plans.questions import groups_of, role_requests
from tracewell.plans.report import context_records
from tracewell.sources.sinks import chain

_Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, _Query] = {}
ORACLES: dict[str, str] = {}

#: The adapter in SQL; queries' SQL begins with it.
EV = "WITH ev AS (SELECT event_id AS seq, epoch_us(ts) AS t, user_id AS u, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS file FROM events)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, t, u, kind, k, value, file."""
    ts = F.col("ts").cast("timestamp")
    days = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.unix_micros(ts).alias("t"), F.col("user_id").alias("u"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", days.alias("file"))


def _query(sql: str | None):
    def add(f: _Query) -> _Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query(EV + """, n AS (SELECT *, row_number() OVER (PARTITION BY u, kind, file ORDER BY seq) AS n FROM ev), b AS (SELECT *, max(n) OVER (PARTITION BY u, kind ORDER BY file RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM n)
SELECT seq, u, kind, file FROM b WHERE n > coalesce(earlier, 0)""")
def dedup_across_inputs(spark, sf_dir):
    """A1, U2, W2, W3 with the user and type as an event's identity."""
    return without_duplicates(events(spark, sf_dir), ["u", "kind"], order=["seq"]).select("seq", "u", "kind", "file")


@_query(EV + """, o AS (SELECT *, t - lag(t) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY u, kind ORDER BY t, seq)),
m AS (SELECT u, kind, gap AS usual FROM (SELECT u, kind, gap, row_number() OVER (PARTITION BY u, kind ORDER BY gap) AS r, count(*) OVER (PARTITION BY u, kind) AS n FROM o WHERE gap IS NOT NULL) WHERE r = n // 2 + 1 AND n >= 4),
f AS (SELECT o.*, sum(CASE WHEN gap > greatest(3600000000, coalesce(3 * usual, 0)) THEN 1 ELSE 0 END) OVER (PARTITION BY o.u, o.kind ORDER BY t, seq) AS run FROM o LEFT JOIN m USING (u, kind)),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY u, kind, run ORDER BY t, seq) AS g FROM f),
i AS (SELECT u, kind, run, floor(g / 100000.0 + 0.5) / 10 AS every_s FROM (SELECT u, kind, run, g, row_number() OVER (PARTITION BY u, kind, run ORDER BY g) AS r, count(*) OVER (PARTITION BY u, kind, run) AS n FROM g WHERE g IS NOT NULL) WHERE r = n // 2 + 1 AND n >= 2)
SELECT f.u, f.kind, CAST(f.run AS BIGINT) AS run, count(*) AS n, min(t) AS first_t, max(t) AS last_t, arg_min(seq, t * 100000000 + seq) AS first_seq, arg_max(seq, t * 100000000 + seq) AS last_seq, count(DISTINCT k) AS variants, any_value(every_s) AS every_s
FROM f LEFT JOIN i ON i.u = f.u AND i.kind = f.kind AND i.run = f.run GROUP BY f.u, f.kind, f.run""".replace("t * 100000000 + seq", "CAST(t AS HUGEINT) * 100000000 + seq"))
def runs_fold(spark, sf_dir):
    """W1, A16, A17."""
    return folded_runs(events(spark, sf_dir), ["u", "kind"], detail="k").withColumnRenamed("count", "n")


_LAST_WRITER = EV + """, w AS (SELECT * FROM ev WHERE kind = 'click'), s AS (SELECT * FROM ev WHERE kind = 'error'),
c AS (SELECT s.seq, s.u, s.k, w.u AS w_u, w.seq AS w_seq, w.t AS w_t, row_number() OVER (PARTITION BY s.seq ORDER BY w.t > s.t, CASE WHEN w.t <= s.t THEN -w.t ELSE w.t END, CASE WHEN w.t <= s.t THEN -w.seq ELSE w.seq END) AS r FROM s JOIN w ON w.k = s.k AND w.u <> s.u AND w.t <= s.t + 2000000)
SELECT seq, k, u, w_u, w_t, w_seq FROM c WHERE r = 1"""


@_query(_LAST_WRITER)
def last_writer_asof(spark, sf_dir):
    """Clicks write, errors start, a key is a path; a user isn't its own writer."""
    ev = events(spark, sf_dir).select(F.col("k").alias("path"), "t", "seq", F.col("u").alias("key"), "kind")
    out = last_writer(ev.where("kind = 'click'"), ev.where("kind = 'error'"), look_ahead=times.SKEW)
    return out.select("seq", F.col("path").alias("k"), F.col("key").alias("u"), F.col("w_key").alias("w_u"), "w_t", "w_seq")


@_query(EV + """, c AS (SELECT r.seq, r.k, r.u, w.u AS w_u, w.seq AS w_seq, row_number() OVER (PARTITION BY r.seq ORDER BY w.t DESC, w.seq DESC) AS n FROM ev r JOIN ev w ON r.kind = 'view' AND w.kind = 'signup' AND r.k = w.k AND r.u <> w.u AND (w.t < r.t OR (w.t = r.t AND w.seq < r.seq)))
SELECT seq, k, u, w_u, w_seq FROM c WHERE n = 1""")
def loaded_after_write(spark, sf_dir):
    """The last write seen before, without looking ahead."""
    ev = events(spark, sf_dir).select(F.col("k").alias("path"), "t", "seq", F.col("u").alias("key"), "kind")
    out = last_writer(ev.where("kind = 'signup'"), ev.where("kind = 'view'"))
    return out.select("seq", F.col("path").alias("k"), F.col("key").alias("u"), F.col("w_key").alias("w_u"), "w_seq")


@_query(EV + """, c AS (SELECT r.seq, r.k, r.u, s.u AS s_u, s.t AS s_t, row_number() OVER (PARTITION BY r.seq ORDER BY s.t, s.u) AS n FROM ev r JOIN ev s ON r.kind = 'signup' AND s.kind = 'purchase' AND r.k = s.k AND r.u <> s.u AND s.t >= r.t - 2000000)
SELECT seq, k, u, s_u, s_t FROM c WHERE n = 1""")
def next_start_forward(spark, sf_dir):
    """Signups register, the next purchase of the key by another user is what they start."""
    ev = events(spark, sf_dir).select(F.col("k").alias("path"), "t", "seq", F.col("u").alias("key"), "kind")
    out = next_start(ev.where("kind = 'signup'"), ev.where("kind = 'purchase'").select("path", "t", "key"))
    return out.select("seq", F.col("path").alias("k"), F.col("key").alias("u"), F.col("s_key").alias("s_u"), "s_t")


@_query(EV + """ SELECT h.seq, h.u, s.seq AS s_seq, s.u AS s_u FROM ev h JOIN ev s ON h.kind = 'view' AND s.kind = 'purchase' AND h.k = s.k AND h.u <> s.u AND h.t BETWEEN s.t - 3600000000 AND s.t + 2000000""")
def handle_interval_join(spark, sf_dir):
    """J9 with an hour's look-back: views open, purchases start."""
    ev = events(spark, sf_dir)
    h = ev.where("kind = 'view'").select(F.col("k").alias("opened"), "t", "seq", F.col("u").alias("key"))
    s = ev.where("kind = 'purchase'").select(F.col("k").alias("parent"), F.col("t").alias("start"), F.col("seq").alias("s_seq"), F.col("u").alias("child"))
    return handle_starts(h, s, back=3_600_000_000).select("seq", F.col("key").alias("u"), "s_seq", F.col("child").alias("s_u"))


@_query(EV + """, h AS (SELECT a.seq, b.kind || ' ' || b.k AS note, min(b.t) AS first_t FROM ev a JOIN ev b ON a.kind = 'error' AND a.u = b.u AND b.t > a.t AND b.t <= a.t + 300000000 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY first_t, note) AS n FROM h)
SELECT seq, note, n FROM r WHERE n <= 8""")
def follow_up_window(spark, sf_dir):
    """What a user did within five minutes of an error, eight notes at most."""
    ev, width = events(spark, sf_dir), F.lit(300_000_000)
    a = ev.where("kind = 'error'").select("seq", "u", F.col("t").alias("t0")).withColumn("b", F.explode(F.array(F.floor(F.col("t0") / width), F.floor(F.col("t0") / width) + 1)))
    b = ev.select("u", F.col("t").alias("at"), F.concat_ws(" ", "kind", F.col("k").cast("string")).alias("note")).withColumn("b", F.floor(F.col("at") / width))
    hit = a.join(b, ["u", "b"]).where((F.col("at") > F.col("t0")) & (F.col("at") <= F.col("t0") + 300_000_000)).groupBy("seq", "note").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("seq").orderBy("at", "note"))
    return hit.withColumn("n", n.cast("long")).where("n <= 8").select("seq", "note", "n")


def _links(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.select(F.lit("contacted").alias("type"), F.concat(F.lit("user:"), "u").alias("from"), F.concat(F.lit("k:"), "k").alias("to"), "t", F.col("t").alias("act"), "seq", F.col("kind").alias("detail"), F.lit(1).alias("phase"))


_LINKS = EV + """, o AS (SELECT 'user:' || u AS f, 'k:' || k AS g, t, seq, kind FROM ev), e AS (SELECT *, row_number() OVER (PARTITION BY f, g ORDER BY t, seq) AS n FROM o),
links AS (SELECT f, g, min(t) AS t, max(t) AS last, count(*) AS n, max(CASE WHEN n = 1 THEN kind END) AS detail, string_agg(CASE WHEN n <= 3 THEN CAST(seq AS VARCHAR) END, ',' ORDER BY n) AS evidence FROM e GROUP BY f, g)"""


@_query(_LINKS + " SELECT f AS src, g AS dst, t, t AS act, last, n, detail, evidence FROM links")
def link_merge(spark, sf_dir):
    """Links of users and keys."""
    out = merged(_links(spark, sf_dir))
    return out.select(F.col("from").alias("src"), F.col("to").alias("dst"), "t", "act", "last", F.col("count").alias("n"), "detail", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


@_query(_LINKS + " SELECT 'contacted' AS type, count(*) AS n_links, CAST(sum(n) AS BIGINT) AS n_seen FROM links")
def links_by_type(spark, sf_dir):
    """A18."""
    return merged(_links(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n_links"), F.sum("count").alias("n_seen"))


@_query(_LINKS + """, u AS (SELECT f AS node, g AS other FROM links UNION ALL SELECT g, f FROM links)
SELECT node, count(DISTINCT other) AS seen_with, count(DISTINCT CASE WHEN NOT (other LIKE 'user:%' AND CAST(substr(other, 6) AS BIGINT) < 20) THEN other END) AS outside FROM u WHERE node LIKE 'k:%' GROUP BY node""")
def prevalence(spark, sf_dir):
    """A10: exact numbers of neighbours, and of those outside the members (users below 20)."""
    links = merged(_links(spark, sf_dir))
    near = links.select(F.col("to").alias("node"), F.col("from").alias("other"))
    member = F.substring_index("other", ":", -1).cast("long") < 20
    return near.groupBy("node").agg(F.count_distinct("other").alias("seen_with"), F.count_distinct(F.when(~member, F.col("other"))).alias("outside"))


@_query(_LINKS + " SELECT DISTINCT g AS node FROM links a WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.g = a.g AND CAST(substr(b.f, 6) AS BIGINT) >= 75)")
def exclusive(spark, sf_dir):
    """Keys that nobody but the members (users below 75) touched."""
    links = merged(_links(spark, sf_dir))
    outside = links.where(F.substring_index("from", ":", -1).cast("long") >= 75).select("to")
    return links.select("to").distinct().join(outside, "to", "left_anti").select(F.col("to").alias("node"))


def _touching(spark, sf_dir) -> DataFrame:
    links = merged(_links(spark, sf_dir))
    return links.select("*", F.col("from").alias("node"), F.col("to").alias("other")).unionByName(links.select("*", F.col("to").alias("node"), F.col("from").alias("other")))


_ROUNDS = _LINKS + ", b AS (SELECT f AS node, g AS other, t, last FROM links UNION ALL SELECT g, f, t, last FROM links), m0 AS (SELECT 'user:8' AS key, CAST(min(t) AS BIGINT) AS since, 0 AS round FROM links WHERE f = 'user:8')" + "".join(
    f""", j{n} AS (SELECT b.other AS key, min(greatest(b.t, m.since)) AS since, {n} AS round FROM m{n - 1} m JOIN b ON b.node = m.key WHERE b.last >= m.since - 2000000 AND b.other NOT IN (SELECT key FROM m{n - 1}) GROUP BY b.other),
m{n} AS (SELECT * FROM m{n - 1} UNION ALL SELECT * FROM j{n})"""
    for n in range(1, 7)
)


@_query(_ROUNDS + " SELECT key, since, round FROM m6")
def rounds_bfs(spark, sf_dir):
    """Six rounds from user 8, all that is reached joins."""
    touching = _touching(spark, sf_dir)
    seed = touching.where("node = 'user:8'").groupBy(F.col("node").alias("key")).agg(F.min("t").alias("since")).withColumn("round", F.lit(0))
    return reachable(touching, seed, 6)


@_query(_LINKS + """, m AS (SELECT f AS key, min(t) AS since FROM links WHERE CAST(substr(f, 6) AS BIGINT) < 10 GROUP BY f), b AS (SELECT f AS node, g AS other, t, last FROM links UNION ALL SELECT g, f, t, last FROM links)
SELECT b.other AS key, min(greatest(b.t, m.since)) AS since FROM m JOIN b ON b.node = m.key WHERE b.last >= m.since - 2000000 AND b.other NOT IN (SELECT key FROM m) GROUP BY b.other""")
def frontier_join(spark, sf_dir):
    """One round from several confirmed members."""
    touching = _touching(spark, sf_dir)
    members = touching.where(F.col("node").startswith("user:") & (F.substring_index("node", ":", -1).cast("long") < 10)).groupBy(F.col("node").alias("key")).agg(F.min("t").alias("since"))
    return joined(frontier(members, touching))


@_query(EV + " SELECT kind, arg_min(seq, CAST(t AS HUGEINT) * 100000000 + seq) AS seq, min(t) AS t, count(*) AS starts FROM ev GROUP BY kind")
def seed_lookup(spark, sf_dir):
    """The earliest event of each type."""
    return events(spark, sf_dir).groupBy("kind").agg(F.min_by("seq", F.struct("t", "seq")).alias("seq"), F.min("t").alias("t"), F.count("*").alias("starts"))


@_query("SELECT domain, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, regexp_replace(lower(trim(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1))), '\\.$', '') AS domain FROM pages) WHERE domain LIKE '%.%' GROUP BY domain")
def entity_domains(spark, sf_dir):
    """Domains of addresses."""
    rows = _table(spark, sf_dir, "pages").select("page_id", net.domain_name(net.url_host(F.col("url"))).alias("domain")).where("domain is not null")
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


_VARIABLE = r"regexp_replace(regexp_replace(regexp_replace({c}, '([0-9][A-Za-z0-9]{{3,}}|[A-Za-z][0-9][A-Za-z0-9]{{2,}}|[A-Za-z]{{2}}[0-9][A-Za-z0-9]+|[A-Za-z]{{3,}}[0-9][A-Za-z0-9]*)', '#', 'g'), '(^|[^A-Za-z0-9])([0-9]{{1,3}})($|[^A-Za-z0-9])', '\1#\3', 'g'), '(^|[^A-Za-z0-9])([0-9]{{1,3}})($|[^A-Za-z0-9])', '\1#\3', 'g')"


@_query(f"SELECT doc_id, sha256({_VARIABLE.format(c='text')}) AS folded FROM documents")
def variable_fold(spark, sf_dir):
    """Details with numbers and generated words as #."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.variable(F.col("text")), 256).alias("folded"))


@_query(f"SELECT page_id, {_VARIABLE.format(c='url')} AS folded, count(*) OVER (PARTITION BY {_VARIABLE.format(c='url')}) AS alike FROM pages")
def same_activity(spark, sf_dir):
    """Pages whose addresses differ in changing parts only."""
    folded = text.same_detail(F.lit("process_start"), F.col("url"))
    return _table(spark, sf_dir, "pages").withColumn("folded", folded).select("page_id", "folded", F.count("*").over(Window.partitionBy("folded")).alias("alike"))


@_query(EV + """, e AS (SELECT kind AS grp, file, seq, unnest(['user_id', 'k', 'event_id']) AS name, unnest([CAST(u AS VARCHAR), CAST(k AS VARCHAR), CAST(seq AS VARCHAR)]) AS v FROM ev),
f AS (SELECT grp, name, v, count(*) AS n, row_number() OVER (PARTITION BY grp, name ORDER BY min(CAST(file AS BIGINT) * 1000000000 + seq), v) AS r FROM e GROUP BY grp, name, v) SELECT grp, name, CAST(sum(n) AS BIGINT) AS n, string_agg(CASE WHEN r <= 3 THEN v END, ',' ORDER BY r) AS samples FROM f GROUP BY grp, name""")
def schema_profile(spark, sf_dir):
    """Fields of each type of event with their first distinct values."""
    fields = F.create_map(F.lit("user_id"), F.col("u").cast("string"), F.lit("k"), F.col("k").cast("string"), F.lit("event_id"), F.col("seq").cast("string"))
    rows = events(spark, sf_dir).select(F.col("kind").alias("grp"), "file", F.col("seq").alias("line"), fields.alias("fields"))
    return profiles_frame(rows).select("grp", "name", F.col("count").alias("n"), F.array_join("samples", ",").alias("samples"))


@_query("SELECT event_type AS grp, substr(sha256('[\"' || event_type || '\",[\"event_id\",\"props\",\"user_id\"]]'), 1, 24) AS fingerprint, count(*) AS n FROM events GROUP BY event_type")
def fingerprint(spark, sf_dir):
    """A fingerprint of a type and its fields."""
    told = F.concat(F.lit('["'), "event_type", F.lit('",'), F.to_json(F.array_sort(F.array(F.lit("user_id"), F.lit("event_id"), F.lit("props")))), F.lit("]"))
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp"), F.substring(F.sha2(told, 256), 1, 24).alias("fingerprint")).agg(F.count("*").alias("n"))


@_query(EV + " SELECT k, arg_min(u, seq) AS owner FROM ev GROUP BY k")
def ip_owner_dim(spark, sf_dir):
    """The first to claim a key owns it."""
    ev = events(spark, sf_dir).select(F.array(F.col("k").cast("string")).alias("host_ips"), F.col("u").cast("string").alias("host"), "seq")
    return owners_of_addresses(ev).select(F.col("ip").cast("long").alias("k"), F.col("owner").cast("long").alias("owner"))


@_query(EV + ", r AS (SELECT k, seq, u < 20 AS member, row_number() OVER (PARTITION BY k, u < 20 ORDER BY t, seq) AS n FROM ev) SELECT k, seq FROM r WHERE member OR n <= 50")
def context_topk(spark, sf_dir):
    """All events of members and the 50 earliest others of each key."""
    ev = events(spark, sf_dir).withColumn("member", F.col("u") < 20)
    others = ev.where("not member").withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "seq"))).where("n <= 50")
    return ev.where("member").select("k", "seq").union(others.select("k", "seq"))


@_query(EV + " SELECT kind AS grp, count(*) AS records, count(DISTINCT k) AS fields, min(file) AS first_input FROM ev GROUP BY kind ORDER BY records DESC, grp")
def schema_summary(spark, sf_dir):
    """A8, O6."""
    return events(spark, sf_dir).groupBy(F.col("kind").alias("grp")).agg(F.count("*").alias("records"), F.count_distinct("k").alias("fields"), F.min("file").alias("first_input")).orderBy(F.desc("records"), "grp")


@_query(EV + " SELECT kind, count(*) AS n FROM ev GROUP BY kind ORDER BY n DESC, kind LIMIT 3")
def source_top(spark, sf_dir):
    """The types with most events (a top-k report)."""
    return events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(3)


@_query(EV + " SELECT seq, file, row_number() OVER (ORDER BY file, seq) - 1 AS place FROM ev")
def input_order(spark, sf_dir):
    """Positions in input order without a global sort in one task."""
    return numbered(events(spark, sf_dir).withColumn("line", F.col("seq")), name="place", block=1000).select("seq", "file", "place")


@_query(EV + ", g AS (SELECT u, t - lag(t) OVER (PARTITION BY u ORDER BY t, seq) AS gap FROM ev), r AS (SELECT u, gap, row_number() OVER (PARTITION BY u ORDER BY gap) AS r, count(*) OVER (PARTITION BY u) AS n FROM g WHERE gap IS NOT NULL) SELECT u, n, gap AS usual FROM r WHERE r = n // 2 + 1")
def interval_median(spark, sf_dir):
    """The upper median of gaps."""
    ev = events(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("u").orderBy("t", "seq"))).where("gap is not null")
    return with_upper_median(ev, ["u"], "gap", "usual")


@_query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso, CASE WHEN d < 0 AND s > 0 THEN '-' ELSE '+' END || CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ' ELSE '' END || printf('%02d:%02d:%02d', (s // 3600) % 24, (s // 60) % 60, s % 60) AS since
FROM (SELECT event_id, ts, epoch_us(ts) - 1705000000000000 AS d, abs(epoch_us(ts) - 1705000000000000) // 1000000 AS s FROM events)""")
def event_times(spark, sf_dir):
    """Times as text, absolute and from an origin."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select("event_id", times.iso(t).alias("iso"), times.relative(t, F.lit(1_705_000_000_000_000)).alias("since"))


@_query("SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) // 1000000 * 1000000 AS t_s, epoch_us(ts) // 1000 * 1000 AS t_ms FROM events")
def parsed_times(spark, sf_dir):
    """ISO text with nine digits of a second, of which six count, and numbers of any unit back to microseconds."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    told = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'789+00:00'")
    return _table(spark, sf_dir, "events").select("event_id", times.parse_time(told, False).alias("t"), times.time_of(F.floor(t / 1_000_000).cast("string")).alias("t_s"), times.time_of(F.floor(t / 1000).cast("string")).alias("t_ms"))


@_query("""SELECT l_orderkey, l_linenumber, m, ((m & 2097151) = 2097151) OR ((m & 2035711) = 2035711) OR ((m & 2) = 2) OR ((m & 40) = 40) AS capable, '0x' || lower(to_hex(m)) AS hex FROM (SELECT l_orderkey, l_linenumber, l_partkey * 37 + l_suppkey AS m FROM lineitem)""")
def access_masks(spark, sf_dir):
    """Access masks."""
    m = F.col("l_partkey") * 37 + F.col("l_suppkey")
    rows = _table(spark, sf_dir, "lineitem").withColumn("m", masks.integer(m.cast("string")))
    return rows.select("l_orderkey", "l_linenumber", "m", masks.injection_capable(F.col("m")).alias("capable"), masks.hexadecimal(F.col("m")).alias("hex"))


@_query("""SELECT c_custkey, lower(split_part(split_part('CORP\\' || c_name || '@example.org', '\\', -1), '@', 1)) AS account, split_part(lower(c_name || '.corp.example'), '.', 1) AS host, regexp_replace(lower(c_name), '[ _.@-]', '', 'g') AS key FROM customer""")
def canonical_names(spark, sf_dir):
    """P1, P7, P8."""
    name = F.col("c_name")
    return _table(spark, sf_dir, "customer").select("c_custkey", text.canonical_user(F.concat(F.lit("CORP\\"), name, F.lit("@example.org"))).alias("account"), text.canonical_host(F.concat(name, F.lit(".corp.example"))).alias("host"), text.norm_key(name).alias("key"))


@_query("""SELECT n_nationkey, greatest(0.1, CASE WHEN what LIKE '%started this process%' THEN 0.9 WHEN what LIKE '%sent web requests to this candidate%' THEN 0.8 ELSE 0.0 END, CASE WHEN what LIKE '%contacted%' THEN CASE WHEN hosts <= 3 AND procs <= 5 THEN 0.85 ELSE 0.2 END ELSE 0.0 END) AS score
FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'started this process' WHEN 1 THEN 'contacted this candidate' ELSE 'sent web requests to this candidate' END AS what, n_regionkey AS hosts, n_nationkey % 8 AS procs FROM nation)""")
def stand_in_scores(spark, sf_dir):
    """phrases' scores; contact counts with what is rare."""
    n = F.col("n_nationkey")
    what = F.when(n % 3 == 0, "started this process").when(n % 3 == 1, "contacted this candidate").otherwise("sent web requests to this candidate")
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.greatest(F.lit(0.1), phrase_score(what, F.col("n_regionkey"), n % 8)).alias("score"))


@_query("""WITH e AS (SELECT DISTINCT 'c:' || o_custkey AS f, 'p:' || l_partkey AS g FROM orders JOIN lineitem ON l_orderkey = o_orderkey), d AS (SELECT f, count(*) AS n FROM e GROUP BY f) SELECT f AS node, n AS degree, CAST(sum(n) OVER (ORDER BY n DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM d ORDER BY n DESC, f LIMIT 100""")
def busiest_nodes(spark, sf_dir):
    """J23's index on the graph of customers and parts: the nodes with most links (a top-k report)."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    edges = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c:"), "o_custkey").alias("f"), F.concat(F.lit("p:"), "l_partkey").alias("g")).distinct()
    top = edges.groupBy(F.col("f").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(100)
    return top.withColumn("upto", F.sum("degree").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "node").rowsBetween(Window.unboundedPreceding, 0)))


@_query("""WITH d AS (SELECT c_custkey, c_nationkey, c_mktsegment, md5(c_mktsegment || '|' || c_nationkey) AS same FROM customer) SELECT same AS grp, min(c_custkey) AS head, count(*) AS occurrences FROM d GROUP BY same""")
def candidate_groups(spark, sf_dir):
    """What reads the same shares one row with its first member."""
    same = F.md5(F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return _table(spark, sf_dir, "customer").groupBy(same.alias("grp")).agg(F.min("c_custkey").alias("head"), F.count("*").alias("occurrences"))


def _references(ev: DataFrame, guid: Column, kind: Column | None = None) -> DataFrame:
    """Events as references to processes: a key is a PID, purchases are starts without a GUID."""
    kind = F.when(F.col("kind") == "purchase", "process_start").otherwise("network") if kind is None else kind
    nothing = F.lit(None).cast("string")
    return ev.select("seq", F.lit(0).alias("role"), F.lit("h").alias("host"), guid.cast("string").alias("guid"), F.col("k").alias("pid"), nothing.alias("base"), nothing.alias("image"), "t", F.lit("0|a").alias("space"), kind.alias("kind"))


@_query(EV + """, s AS (SELECT DISTINCT k, t FROM ev WHERE kind = 'purchase'), r AS (SELECT ev.seq, ev.k, ev.t, s.t AS st FROM ev ASOF LEFT JOIN s ON ev.k = s.k AND ev.t + 2000000 >= s.t WHERE kind <> 'purchase')
SELECT seq, 'p:h:' || k || ':' || coalesce(st, min(t) OVER (PARTITION BY k, st IS NULL)) AS key FROM r UNION ALL SELECT seq, 'p:h:' || k || ':' || t FROM ev WHERE kind = 'purchase'""")
def pid_lifetimes(spark, sf_dir):
    """What runs under a PID at a time, and what is first seen there."""
    refs = _references(events(spark, sf_dir), F.lit(None))
    return resolve_references(refs, stored(start_keys(refs))).select("seq", "key")


@_query(EV + """, c AS (SELECT seq, k, t, 'u' || u || 'd' || file AS guid FROM ev WHERE kind = 'click'), f AS (SELECT guid, k, t FROM c QUALIFY row_number() OVER (PARTITION BY guid ORDER BY t, seq) = 1), s AS (SELECT DISTINCT k, t FROM ev WHERE kind = 'purchase'),
l AS (SELECT f.guid, coalesce('p:h:' || f.k || ':' || s.t, 'g:h:' || f.guid) AS key FROM f ASOF LEFT JOIN s ON f.k = s.k AND f.t + 2000000 >= s.t)
SELECT seq, key FROM c JOIN l USING (guid) UNION ALL SELECT seq, 'p:h:' || k || ':' || t FROM ev WHERE kind = 'purchase'""")
def late_guids(spark, sf_dir):
    """A GUID (a user's day) that is first seen while a process without one runs under its PID is that process."""
    refs = _references(events(spark, sf_dir).where("kind in ('click', 'purchase')"), F.when(F.col("kind") == "click", F.concat(F.lit("u"), "u", F.lit("d"), "file")))
    return resolve_references(refs, stored(start_keys(refs))).select("seq", "key")


@_query(EV + """, x AS (SELECT seq, k, t // 3600 AS t, u, kind FROM ev WHERE kind IN ('click', 'purchase')), g AS (SELECT * FROM x WHERE kind = 'click'), p AS (SELECT * FROM x WHERE kind = 'purchase')
SELECT seq, 'g:h:' || seq AS key FROM g UNION ALL SELECT p.seq, coalesce((SELECT arg_min('g:h:' || g.seq, CAST(g.t AS HUGEINT) * 100000000 + g.seq) FROM g WHERE g.k = p.k AND abs(g.t - p.t) <= 2000000), 'p:h:' || p.k || ':' || p.t) FROM p""")
def start_twins(spark, sf_dir):
    """A start without a GUID is the earliest start with one that is near (an hour of events is a second here)."""
    ev = events(spark, sf_dir).where("kind in ('click', 'purchase')").withColumn("t", F.floor(F.col("t") / 3600).cast("long"))
    refs = _references(ev, F.when(F.col("kind") == "click", F.col("seq"))).withColumn("kind", F.lit("process_start"))
    return start_keys(refs).select("seq", "key")


def _by_day(ev: DataFrame) -> Picture:
    """Users as processes that contact keys of a day, or fail to log on to them (errors), as a whole picture.

    A key of a day is an entity, so few users share one. Columns that the events don't have are null.
    """
    user, key = F.concat(F.lit("user:"), "u"), F.concat_ws("/", F.concat(F.lit("k:"), "k"), "file")
    kind = F.when(F.col("kind") == "error", "failed_logon").otherwise("contacted")
    seen = stored(ev.select(kind.alias("type"), user.alias("from"), key.alias("to"), "t", F.col("t").alias("act"), "seq", F.lit(None).cast("string").alias("detail"), F.lit(1).alias("phase")))
    found = stored(touching(merged(seen).withColumns({"steps": F.array().cast("array<string>"), "techniques": F.array().cast("array<string>")})))
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    of = lambda c, kind: seen.groupBy(F.col(c).alias("key")).agg(F.min("t").alias("first_seen")).select("key", F.lit(kind).alias("type"), F.lit("h").alias("host"), F.col("key").alias("name"), "first_seen")
    nodes = of("from", "process").unionByName(of("to", "domain"))
    nodes = stored(nodes.select("*", *null("string", "guid", "path", "cmd", "user", "sha256", "parent", "real_parent", "effective_parent"), *null("long", "pid", "start", "end", "first_start"), F.lit(0).alias("n_starts")))
    acted = seen.select("seq", "t", F.lit("network").alias("kind"), F.col("from").alias("actor"), *null("string", "file_path", "pipe"), *null("long", "access"), *null("struct<key:string,value:string>", "reg"), *null("struct<ip:string,port:long,domain:string>", "net"), *null("struct<name:string,path:string>", "target"))
    return Picture(acted, nodes, found, seen.select(F.col("to").alias("key"), "seq"), 0, "h")


_SIX = EV + """, o AS (SELECT CASE WHEN kind = 'error' THEN 'failed_logon' ELSE 'contacted' END AS type, 'user:' || u AS f, 'k:' || k || '/' || file AS g, t FROM ev),
links AS (SELECT type, f, g, min(t) AS t, max(t) AS last FROM o GROUP BY ALL), b AS (SELECT type, f AS node, g AS other, t, last FROM links UNION ALL SELECT type, g, f, t, last FROM links),
rare AS (SELECT node, count(DISTINCT other) <= 5 AS rare FROM b WHERE node LIKE 'k:%' GROUP BY node),
m0 AS (SELECT 'user:8' AS key, min(t) AS since, 0 AS round FROM o WHERE f = 'user:8'), d0 AS (SELECT NULL AS key, 0 AS round, 0 AS n, 0::DOUBLE AS probability, FALSE AS related, 0::DOUBLE AS threshold, 0::BIGINT AS joined_at WHERE FALSE)""" + "".join(
    f""", f{r} AS (SELECT b.*, m.since FROM m{r - 1} m JOIN b ON b.node = m.key WHERE b.last >= m.since - 2000000 AND b.other NOT IN (SELECT key FROM m{r - 1})),
c{r} AS (SELECT other AS key, count(*) AS n, min(greatest(t, since)) AS joined_at, CAST(max(CASE WHEN type = 'failed_logon' THEN 0.6 WHEN coalesce(rare, TRUE) THEN 0.85 ELSE 0.2 END) AS DOUBLE) AS probability FROM f{r} LEFT JOIN rare ON rare.node = other GROUP BY other),
p{r} AS (SELECT c.*, CASE WHEN c.key LIKE 'k:%' AND NOT EXISTS (SELECT 1 FROM b WHERE b.node = c.key AND b.other NOT IN (SELECT key FROM m{r - 1})) THEN 0.5::DOUBLE ELSE 0.8 END AS threshold FROM c{r} c WHERE NOT EXISTS (SELECT 1 FROM d{r - 1} d WHERE d.key = c.key AND d.n = c.n)),
d{r} AS (SELECT * FROM d{r - 1} WHERE key NOT IN (SELECT key FROM p{r}) UNION ALL SELECT key, {r}, n, probability, probability >= threshold, threshold, joined_at FROM p{r}),
m{r} AS (SELECT * FROM m{r - 1} UNION ALL SELECT key, joined_at, {r} FROM d{r} WHERE round = {r} AND related)"""
    for r in range(1, 7)
)


@_query(_SIX + " SELECT key, round, n, probability, related, threshold, joined_at FROM d6")
def investigation(spark, sf_dir):
    """Six rounds from user 8 with the offline rule; what a candidate was last asked with decides."""
    found = investigate(_by_day(events(spark, sf_dir)), "user:8", Options(max_rounds=6, group=False))
    n = found.via().groupBy("key").agg(F.count("*").alias("n"))
    return found.decisions.join(n, "key").select("key", "round", "n", "probability", "related", "threshold", "joined_at")


@_query(_SIX + """, via AS (SELECT d.key, f.node AS other FROM d6 d JOIN (""" + " UNION ALL ".join(f"SELECT {r} AS round, other, node FROM f{r}" for r in range(1, 7)) + """) f ON f.round = d.round AND f.other = d.key WHERE d.related),
no AS (SELECT key FROM m6 WHERE round > 0 AND substr(md5(key), 1, 1) IN ('0', '1', '2', '3', '4')), kept0 AS (SELECT * FROM m6 WHERE key NOT IN (SELECT key FROM no))""" + "".join(f", kept{i} AS (SELECT * FROM kept{i - 1} WHERE round = 0 OR key IN (SELECT v.key FROM via v JOIN kept{i - 1} k ON k.key = v.other))" for i in range(1, 8)) + " SELECT key, round FROM kept7")
def verify_and_prune(spark, sf_dir):
    """Members of the six rounds less those that are refused (by a hash of their key) and whoever came through them alone."""
    found = investigate(_by_day(events(spark, sf_dir)), "user:8", Options(max_rounds=6, group=False))
    refused = found.members.where((F.col("round") > 0) & F.substring(F.md5("key"), 1, 1).isin("0", "1", "2", "3", "4")).select("key")
    return pruned(found.members, found.via(), refused).select("key", "round")


@_query(EV.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, p AS (SELECT seq, least(lag(seq) OVER (PARTITION BY u ORDER BY seq), lag(seq) OVER (PARTITION BY k, kind ORDER BY seq)) AS up FROM ev),
r AS (SELECT seq, up, 0 AS depth, [seq] AS path FROM p WHERE up IS NULL UNION ALL SELECT p.seq, p.up, r.depth + 1, list_append(r.path, p.seq) FROM p JOIN r ON p.up = r.seq)
SELECT 'e' || seq AS key, 'e' || up AS parent, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY path) - 1 AS nth FROM r""")
def chain_tree(spark, sf_dir):
    """Each event under the first of the events before it by its user, and of its type on its key."""
    ev = events(spark, sf_dir).select("seq", "u", "k", "kind")
    before = lambda *by: F.lag("seq").over(Window.partitionBy(*by).orderBy("seq"))
    near = ev.select("seq", before("u").alias("a"), before("k", "kind").alias("b"))
    near = near.select("seq", F.explode(F.array_compact(F.array("a", "b"))).alias("other"))
    key = lambda c: F.concat(F.lit("e"), c)
    return chain(ev.select(key("seq").alias("key"), F.col("seq").alias("place")), near.select(key("seq").alias("key"), key("other").alias("other")))


@_query(EV + """, m AS (SELECT 'e' || seq AS key, seq, kind, k % 2 AS odd, 'e' || lag(seq) OVER (PARTITION BY u ORDER BY seq) AS up FROM ev), r0 AS (SELECT key, key AS rep FROM m)""" + "".join(
    f", r{i} AS (SELECT key, 'e' || min(seq) OVER (PARTITION BY kind, odd, coalesce(r{i - 1}.rep, '')) AS rep FROM (SELECT m.key, seq, kind, odd, p.rep FROM m LEFT JOIN r{i - 1} p ON p.key = m.up) r{i - 1})" for i in range(1, 6)
) + " SELECT key, rep FROM r5")
def identical_fold(spark, sf_dir):
    """Events as members that are the same again if type, parity of key and what their parent stands for agree; five passes."""
    ev = events(spark, sf_dir).select("seq", "kind", (F.col("k") % 2).alias("odd"), F.lag("seq").over(Window.partitionBy("u").orderBy("seq")).alias("up"))
    key, nothing = (lambda c: F.concat(F.lit("e"), c)), F.lit(None).cast("string")
    members = ev.select(key("seq").alias("key"), F.col("seq").alias("place"), F.lit(False).alias("keep"), F.lit("h").alias("host"), nothing.alias("path"), F.col("kind").alias("name"), nothing.alias("cmd"), F.col("odd").cast("string").alias("user"), nothing.alias("sha256"), key("up").alias("parent"))
    members = stored(members)
    return identical_members(members, members.where("parent is not null").select("key", F.lit("spawned").alias("type"), F.col("parent").alias("other")))


_TWO_SOURCES = EV + """, x AS (SELECT seq, k, t // 3600 AS t, kind, CASE WHEN u % 5 > 0 THEN 'i' || (u % 2) END AS base, CASE kind WHEN 'click' THEN '0|a' WHEN 'view' THEN '1|b' END AS space FROM ev WHERE kind IN ('click', 'view', 'purchase')),
g AS (SELECT *, 'g:h:' || seq AS key FROM x WHERE kind <> 'purchase'),
w AS (SELECT x.key, x.space, arg_min({'key': y.key, 'space': y.space}, CAST(y.t AS HUGEINT) * 100000000 + y.seq) AS up FROM g x JOIN g y ON x.k = y.k AND x.space <> y.space AND (y.t < x.t OR (y.t = x.t AND y.seq < x.seq)) AND x.t - y.t <= 2000000 AND coalesce(x.base = y.base, TRUE) GROUP BY x.key, x.space),
z AS (SELECT w.key, CASE WHEN a.key IS NULL THEN w.up ELSE a.up END AS up, w.space FROM w LEFT JOIN w a ON a.key = w.up.key), tw AS (SELECT key, up.key AS up FROM z WHERE up.space <> space),
l AS (SELECT * FROM g WHERE key NOT IN (SELECT key FROM tw))"""


@_query(_TWO_SOURCES + """ SELECT g.seq, coalesce(tw.up, g.key) AS key FROM g LEFT JOIN tw ON tw.key = g.key UNION ALL
SELECT p.seq, coalesce((SELECT arg_min(l.key, CAST(l.t AS HUGEINT) * 100000000 + l.seq) FROM l WHERE l.k = p.k AND abs(l.t - p.t) <= 2000000 AND coalesce(l.base = p.base, TRUE)), 'p:h:' || p.k || ':' || p.t) FROM x p WHERE kind = 'purchase'""")
def two_source_starts(spark, sf_dir):
    """Clicks of one source and views of another have GUIDs, purchases have none; images disagree for odd and even users."""
    ev = events(spark, sf_dir).where("kind in ('click', 'view', 'purchase')").withColumn("t", F.floor(F.col("t") / 3600).cast("long"))
    base = F.when(F.col("u") % 5 > 0, F.concat(F.lit("i"), F.col("u") % 2))
    refs = ev.select("seq", F.lit(0).alias("role"), F.lit("h").alias("host"), F.when(F.col("kind") != "purchase", F.col("seq")).cast("string").alias("guid"), F.col("k").alias("pid"), base.alias("base"), base.alias("image"), "t", F.when(F.col("kind") == "view", "1|b").otherwise("0|a").alias("space"), F.lit("process_start").alias("kind"))
    return start_keys(refs).select("seq", "key")


@_query(EV + """, s AS (SELECT DISTINCT k, t FROM ev WHERE kind = 'purchase'), r AS (SELECT ev.*, s.t AS st FROM ev ASOF LEFT JOIN s ON ev.k = s.k AND ev.t + 2000000 >= s.t WHERE kind <> 'purchase'),
e AS (SELECT k, st, max(t) AS over_at FROM r WHERE kind = 'signup' AND st IS NOT NULL GROUP BY k, st), a AS (SELECT r.*, r.st IS NOT NULL AND (e.over_at IS NULL OR e.over_at >= r.t - 2000000) AS alive FROM r LEFT JOIN e ON e.k = r.k AND e.st = r.st),
d AS (SELECT *, (SELECT count(*) FROM a b WHERE NOT b.alive AND b.kind = 'signup' AND b.k = a.k AND b.st IS NOT DISTINCT FROM a.st AND b.t < a.t - 2000000) AS gone FROM a WHERE NOT alive)
SELECT seq, 'p:h:' || k || ':' || st AS key FROM a WHERE alive UNION ALL SELECT seq, 'p:h:' || k || ':' || min(t) OVER (PARTITION BY k, st, gone) FROM d UNION ALL SELECT seq, 'p:h:' || k || ':' || t FROM ev WHERE kind = 'purchase'""")
def ended_lives(spark, sf_dir):
    """Signups end what runs under a PID; what comes later is first seen there, anew after each further end."""
    ends = F.when(F.col("kind") == "signup", "process_end").when(F.col("kind") == "purchase", "process_start").otherwise("network")
    refs = _references(events(spark, sf_dir), F.lit(None), ends)
    return resolve_references(refs, stored(start_keys(refs))).select("seq", "key")


_ENTITY = EV + """, x AS (SELECT *, 'h' || (k % 10) AS h, '10.0.0.' || (u % 50) AS ip, 'user:acc' || u AS account FROM ev), own AS (SELECT ip, arg_min(h, seq) AS h FROM x WHERE kind = 'signup' GROUP BY ip),
y AS (SELECT x.*, CASE WHEN own.h IS NULL THEN 'ip:' || x.ip ELSE 'host:' || own.h END AS came, 'host:' || x.h AS server FROM x LEFT JOIN own ON own.ip = x.ip)"""


@_query(_ENTITY + """ SELECT 'contacted' AS type, 'p:' || u AS src, 'ip:198.51.100.' || k AS dst, seq, 'port 443' AS detail FROM y WHERE kind = 'click' UNION ALL SELECT 'logged_on', account, server, seq, 'logon type 3' FROM y WHERE kind = 'view'
UNION ALL SELECT 'logon_from', came, server, seq, 'logon type 3' FROM y WHERE kind = 'view' AND came <> server UNION ALL SELECT 'used_account', came, account, seq, 'logon type 3' FROM y WHERE kind = 'view' AND came <> server
UNION ALL SELECT 'failed_logon', came, account, seq, 'logon type 3' FROM y WHERE kind = 'error' AND came <> server UNION ALL SELECT 'requested', came, server, seq, 'GET /' || k || ' 200' FROM y WHERE kind = 'purchase'""")
def entity_links(spark, sf_dir):
    """Clicks are connections of processes, views logons, errors failed ones, purchases web requests; signups claim addresses for hosts."""
    ev, null = events(spark, sf_dir), lambda kind: F.lit(None).cast(kind)
    kind = F.create_map(*[F.lit(x) for x in ("click", "network", "view", "logon", "error", "logon_failed", "purchase", "http_request", "signup", "service_install")])[F.col("kind")]
    of, ip = (lambda c, *kinds: F.when(F.col("kind").isin(*kinds), c)), F.concat(F.lit("10.0.0."), F.col("u") % 50)
    src = of(F.struct(ip.alias("ip"), null("long").alias("port"), null("string").alias("host")), "view", "error", "purchase")
    net = of(F.struct(F.concat(F.lit("198.51.100."), "k").alias("ip"), F.lit(443).cast("long").alias("port"), null("string").alias("domain")), "click")
    http = of(F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/"), "k").alias("url"), F.lit(200).cast("long").alias("status")), "purchase")
    rows = ev.select(
        "seq", "t", kind.alias("kind"), F.concat(F.lit("h"), F.col("k") % 10).alias("host"), of(F.concat(F.lit("acc"), "u"), "view", "error").alias("account"), src.alias("src"), net.alias("net"), F.lit("3").alias("logon_type"), http.alias("http"), null("boolean").alias("dns_answer"),
        of(F.array(ip), "signup").alias("host_ips"),
    )
    actor = ev.where("kind = 'click'").select("seq", F.concat(F.lit("p:"), "u").alias("key"))
    return entity_observations(rows, actor).observations.select("type", F.col("from").alias("src"), F.col("to").alias("dst"), "seq", "detail")


@_query(EV + " SELECT 'k:' || k || '/' || file AS key, count(DISTINCT u) AS seen_with, count(DISTINCT CASE WHEN u >= 20 THEN u END) AS outside, count(*) AS events FROM ev GROUP BY 1")
def entity_summaries(spark, sf_dir):
    """What a judge is told of keys of a day: with how many users they were seen, how many of these are no members (users below 20)."""
    p = _by_day(events(spark, sf_dir))
    members = p.nodes.where((F.col("type") == "process") & (F.substring_index("key", ":", -1).cast("long") < 20)).select("key", F.col("first_seen").alias("since"))
    told = F.try_parse_json("summary")
    number = lambda path: F.coalesce(F.try_variant_get(told, path, "long"), F.lit(0))
    out = summaries(p.nodes.where("type = 'domain'").select("key"), members, p)
    return out.select("key", number("$.seen_with.processes").alias("seen_with"), number("$.seen_outside_incident.processes").alias("outside"), number("$.events").alias("events"))


@_query("""SELECT 'event_type=' || event_type AS grp, substr(sha256('[["event_type","' || event_type || '"],["event_id","event_type","props.k","user_id","value"]]'), 1, 24) AS fingerprint, count(*) AS n, 5 AS n_fields, 5 AS n_asked, 1 AS n_requests FROM events GROUP BY event_type""")
def schema_groups(spark, sf_dir):
    """Events as records of an unknown schema: their types, fingerprints, and what a judge would be asked about their fields."""
    rows = _table(spark, sf_dir, "events")
    kind = "file int, line long, id string, line_id boolean, nested string, flat map<string,string>, names map<string,string>"
    records = rows.select(F.lit(0).alias("file"), F.col("event_id").alias("line"), F.lit(None).cast("string").alias("id"), F.lit(True).alias("line_id"), F.to_json(F.struct("event_id", "user_id", "event_type", "props", "value")).alias("nested"), F.lit(None).cast("map<string,string>").alias("flat"), F.lit(None).cast("map<string,string>").alias("names"))
    records = records.select(*[F.col(c.split()[0]) for c in kind.split(", ")])
    groups = stored(groups_of(flattened(records)).withColumns({"kind": F.lit("network"), "confidence": F.lit(1.0)}))
    asked = role_requests(groups, "judge").groupBy("grp").agg(F.sum(F.size("asked")).cast("int").alias("n_asked"), F.count("*").cast("int").alias("n_requests"))
    return groups.join(asked, "grp").select("grp", "fingerprint", F.col("count").alias("n"), F.size("fields").alias("n_fields"), "n_asked", "n_requests")


@_query(EV + ", r AS (SELECT k, seq, file, u < 20 AS member, row_number() OVER (PARTITION BY k, u < 20 ORDER BY t, seq) AS n FROM ev) SELECT DISTINCT file AS input, seq AS line FROM r WHERE member OR n <= 50")
def context_rows(spark, sf_dir):
    """The records that rebuild an incident of users below 20: their own, and the 50 earliest others of each key."""
    ev = events(spark, sf_dir)
    acted = ev.select("seq", "t", "file", F.col("seq").alias("line"), F.concat(F.lit("user:"), "u").alias("actor"))
    touched = ev.select(F.concat(F.lit("k:"), "k").alias("key"), "seq")
    members = acted.where(F.substring_index("actor", ":", -1).cast("long") < 20).select(F.col("actor").alias("key")).distinct()
    return context_records(SimpleNamespace(acted=acted, entity_events=touched), SimpleNamespace(members=members, decisions=touched.select("key").distinct()))


_PROCESSES = EV + """, n AS (SELECT 'p:' || u AS key, 'n' || u AS name, min(t) AS start, min(seq) AS first, CASE WHEN u > 0 THEN 'p:' || (u // 2) END AS parent, CASE WHEN u % 7 = 0 THEN 'p:' || (u // 3) END AS real, CASE WHEN u % 11 = 0 THEN 'p:' || (u // 5 + 1) END AS eff FROM ev GROUP BY u),
a AS (SELECT seq, t, k, kind, 'p:' || u AS f, 'p:' || k AS g, CASE WHEN k % 3 = 0 THEN 2097151 ELSE 4096 + k END AS m FROM ev),
i AS (SELECT a.f, a.g, a.t, a.seq, CASE WHEN k % 2 = 1 THEN 'WriteProcessMemory' ELSE 'CreateRemoteThread' END AS step, CASE WHEN coalesce(n.real, n.parent) = a.f AND k % 5 = 0 THEN 'process hollowing' WHEN k % 7 = 0 THEN 'shellcode' END AS technique FROM a LEFT JOIN n ON n.key = a.g WHERE kind = 'click' AND a.f <> a.g
UNION ALL SELECT coalesce(n.real, n.parent), a.f, a.t, a.seq, 'image replaced', 'process hollowing' FROM a JOIN n ON n.key = a.f WHERE kind = 'view' AND k % 4 = 0 AND coalesce(n.real, n.parent) <> a.f),
s AS (SELECT f, g, string_agg(step, ' + ' ORDER BY o, step) AS steps FROM (SELECT f, g, step, min(CAST(t AS HUGEINT) * 100000000 + seq) AS o FROM i GROUP BY f, g, step) GROUP BY f, g),
h AS (SELECT f, g, string_agg(technique, ', ' ORDER BY o, technique) AS techniques FROM (SELECT f, g, technique, min(CAST(t AS HUGEINT) * 100000000 + seq) AS o FROM i WHERE technique IS NOT NULL GROUP BY f, g, technique) GROUP BY f, g)"""


@_query(_PROCESSES + """ SELECT 'spawned' AS type, parent AS src, key AS dst, start AS t, first AS seq, NULL AS detail FROM n WHERE parent IS NOT NULL
UNION ALL SELECT 'spawned', n.real, n.key, n.start, n.first, 'created it posing as a child of ' || coalesce(p.name, 'another process') FROM n LEFT JOIN n p ON p.key = n.parent WHERE n.real IS NOT NULL
UNION ALL SELECT 'spawned', n.eff, n.key, n.start, n.first, 'had it started through ' || coalesce(p.name, 'a broker') FROM n LEFT JOIN n p ON p.key = n.parent WHERE n.eff IS NOT NULL
UNION ALL SELECT 'injected', i.f, i.g, i.t, i.seq, steps || coalesce(' (' || techniques || ')', '') FROM i JOIN s ON s.f = i.f AND s.g = i.g LEFT JOIN h ON h.f = i.f AND h.g = i.g
UNION ALL SELECT 'opened_for_injection', f, g, t, seq, '0x' || lower(to_hex(m)) FROM a WHERE kind = 'error' AND f <> g AND ((m & 2097151) = 2097151 OR (m & 2035711) = 2035711 OR (m & 2) = 2 OR (m & 40) = 40)""")
def process_links(spark, sf_dir):
    """Users are processes with three kinds of parents; clicks inject, views tamper, errors open others."""
    ev = events(spark, sf_dir)
    p, null = (lambda c: F.concat(F.lit("p:"), c.cast("long"))), lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    u, k = F.col("u"), F.col("k")
    nodes = ev.groupBy("u").agg(F.min("t").alias("start"), F.min("seq").alias("first_start")).select(
        p(u).alias("key"), F.concat(F.lit("n"), "u").alias("name"), "start", "first_start", F.when(u > 0, p(F.floor(u / 2))).alias("parent"), F.when(u % 7 == 0, p(F.floor(u / 3))).alias("real_parent"), F.when(u % 11 == 0, p(F.floor(u / 5) + 1)).alias("effective_parent"),
        F.lit(1).alias("n_starts"), *null("string", "path", "sha256"),
    )
    kind = F.create_map(*[F.lit(x) for x in ("click", "inject", "view", "tamper", "error", "process_access")])[F.col("kind")]
    of = lambda c, what: F.when(F.col("kind") == what, c)
    rows = ev.select(
        "seq", "t", kind.alias("kind"), F.lit("edr").alias("source"), of(F.when(k % 2 == 1, "WriteProcessMemory").otherwise("CreateRemoteThread"), "click").alias("api"), (k % 5 == 0).alias("target_suspended"), of(F.when(k % 7 == 0, F.array(F.lit("runs shellcode"))), "click").alias("behaviors"),
        of(F.when(k % 4 == 0, "Image is REPLACED"), "view").alias("tampering"), of(F.when(k % 3 == 0, 2097151).otherwise(4096 + k), "error").alias("access"), *null("string", "file_path", "file_sha256", "pipe", "launches"), *null("struct<key:string,value:string>", "reg"),
    )
    actor, target = ev.select("seq", p(u).alias("key")), ev.where("kind in ('click', 'error')").select("seq", p(k).alias("key"))
    out = process_observations(rows, Processes(nodes, actor, target)).where("phase < 2")
    return out.select("type", F.col("from").alias("src"), F.col("to").alias("dst"), "t", "seq", "detail")
