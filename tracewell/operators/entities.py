"""Accounts, hosts, addresses and domains, and the links that events make between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.net import domain_name, is_dotted, is_service_account, nowhere, url_host
from tracewell.functions.text import canonical_host


@dataclass
class Entities:
    """``nodes`` in the columns of process nodes; ``events``: key, seq of what an entity took part in; ``observations``."""

    nodes: DataFrame
    events: DataFrame
    observations: DataFrame


def owners_of_addresses(events: DataFrame) -> DataFrame:
    """Ip, owner: the host of the first event that claims the address as its own."""
    rows = events.where("host <> '' and host_ips is not null").select(F.explode("host_ips").alias("ip"), "host", "seq")
    return rows.groupBy("ip").agg(F.min_by("host", "seq").alias("owner"))


def _place(ip: Column, owner: Column) -> Column:
    """The node of an address: its host, itself, or nothing for loopback."""
    return F.when(ip.isNotNull() & ~nowhere(ip), F.when(owner.isNotNull(), F.concat(F.lit("host:"), owner)).otherwise(F.concat(F.lit("ip:"), F.lower(ip))))


def _edge(type_: str, a: str, b: str, when: Column, detail: Column) -> Column:
    return F.when(when & F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(type_).alias("type"), F.col(a).alias("from"), F.col(b).alias("to"), detail.alias("detail")))


def entity_observations(events: DataFrame, actor: DataFrame) -> Entities:
    """``contacted``, ``logged_on``, ``logon_from``, ``used_account``, ``failed_logon``, ``requested``."""
    rows = events.where(F.col("kind").isin("network", "dns", "logon", "logon_failed", "http_request")).where("dns_answer is null")
    rows = rows.select("seq", "t", "kind", "host", "account", "src", "net", "logon_type", "http").join(actor.withColumnRenamed("key", "actor"), "seq", "left")
    name = F.when(F.col("kind").isin("network", "dns"), F.col("net.domain")).when((F.col("kind") == "http_request") & (F.col("host") == ""), url_host(F.col("http.url")))
    rows = rows.withColumn("name", domain_name(name)).withColumn("dotted", F.when(is_dotted(F.col("name")), F.col("name")))
    owners = owners_of_addresses(events)
    for column, ip in (("src_owner", F.col("src.ip")), ("net_owner", F.col("net.ip")), ("dotted_owner", F.col("dotted"))):
        rows = rows.withColumn("__ip", ip).join(owners.withColumnsRenamed({"ip": "__ip", "owner": column}), "__ip", "left").drop("__ip")
    flow, logon, web = F.col("kind").isin("network", "dns"), F.col("kind").isin("logon", "logon_failed") & (F.col("host") != ""), F.col("kind") == "http_request"
    source = _place(F.col("src.ip"), F.col("src_owner"))
    other = canonical_host(F.col("src.host"))
    by_name = F.when(logon & F.col("src.host").isNotNull() & (other != F.col("host")) & ~other.rlike("^(-|localhost)$"), F.concat(F.lit("host:"), other))
    domain = F.when(F.col("dotted").isNotNull(), _place(F.col("dotted"), F.col("dotted_owner"))).when(F.col("name").isNotNull(), F.concat(F.lit("domain:"), "name"))
    rows = rows.withColumns({
        "place": source,
        "ip_node": F.when(flow, _place(F.col("net.ip"), F.col("net_owner"))),
        "domain_node": domain,
        "server": F.when(logon | (web & (F.col("host") != "")), F.concat(F.lit("host:"), "host")).when(web, domain),
        "user": F.when(logon & F.col("account").isNotNull() & ~is_service_account(F.col("account")), F.concat(F.lit("user:"), "account")),
    })
    rows = rows.withColumn("came", F.when(flow, F.coalesce("actor", "place")).when(logon, F.coalesce("place", by_name)).when(web, F.col("place")))
    rows = rows.withColumn("came_from", F.when(~logon | (F.col("came") != F.col("server")), F.col("came")))
    port = F.concat(F.lit("port "), F.col("net.port").cast("string"))
    how = F.concat(F.lit("logon type "), F.col("logon_type"))
    asked = F.nullif(F.concat_ws(" ", "http.method", "http.url", F.col("http.status").cast("string")), F.lit(""))
    good, bad = logon & (F.col("kind") == "logon"), logon & (F.col("kind") == "logon_failed")
    edges = F.array_compact(F.array(
        _edge("contacted", "came_from", "ip_node", flow, port), _edge("contacted", "came_from", "domain_node", flow, port), _edge("logged_on", "user", "server", good, how),
        _edge("logon_from", "came_from", "server", good, how), _edge("used_account", "came_from", "user", good, how), _edge("failed_logon", "came_from", "user", bad, how), _edge("requested", "came_from", "server", web, asked),
    ))
    rows = rows.withColumn("edges", edges)
    observations = rows.select("t", "seq", F.explode("edges").alias("e")).select("e.type", "e.from", "e.to", "t", F.col("t").alias("act"), "seq", "e.detail", F.lit(6).alias("phase"))
    # Nodes that an event names take part in it whether or not a link comes of it; a flow without a source names none.
    named = F.when(flow, F.when(F.col("came").isNotNull(), F.array("came", "ip_node", "domain_node"))).when(logon, F.array("server", "user", "came")).when(web, F.array("came", "server"))
    part = rows.select("seq", "t", F.explode(F.array_distinct(F.array_compact(named))).alias("key")).where(F.regexp_like("key", F.lit("^(host|user|ip|domain):")))
    nodes = part.groupBy("key").agg(F.min("t").alias("first_seen"))
    kind, value = F.substring_index("key", ":", 1), F.expr("substring(key, instr(key, ':') + 1)")
    null = lambda t: F.lit(None).cast(t)
    nodes = nodes.select(
        "key", kind.alias("type"), F.when(kind == "host", value).otherwise("").alias("host"), null("string").alias("guid"), null("long").alias("pid"), value.alias("name"), *[null("string").alias(c) for c in ("path", "cmd", "user", "sha256")],
        null("long").alias("start"), "first_seen", null("long").alias("end"), *[null("string").alias(c) for c in ("parent", "real_parent", "effective_parent")], F.lit(0).cast("long").alias("n_starts"), null("long").alias("first_start"),
    )
    return Entities(nodes, part.select("key", "seq"), observations)
