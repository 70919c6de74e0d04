"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources. At each node it is shared among the
children by weight; a child that can't use its share is filled up, and the rest goes to its siblings by weight
again. What a node's children can't use at all was never given to the node, as its capacity is the sum of
theirs: so shortages are met by siblings first, then by the parent's siblings.

A leaf passes over its documents in epochs, each in an order of its own that a seed decides; it takes whole
epochs and then the prefix of the next one that its budget covers. The prefix is found digit by digit on the
hash that orders the epoch: token sums by digit say where the budget ends, and only documents within that last
range of hashes are looked at one by one. No leaf is sorted in one task, however large.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm._common import stored

#: A weight's unit; weights are whole numbers of it, so that shares are exact.
UNIT = 1_000_000
#: Rounds of two hexadecimal digits of the order's hash: a last range is 1 / 16**6 of a leaf.
ROUNDS = 3


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_domain(source: Column, domains: int = 4) -> Column:
    """A domain for sources that come without: one of d0, d1, ... by the first 32 bits of the source's MD5."""
    number = F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.concat(F.lit("d"), (number % domains).cast("string"))


def _weight(key: Column, weights: Mapping[str, float] | None) -> Column:
    out = F.lit(UNIT)
    for name, w in sorted((weights or {}).items()):
        out = F.when(key == F.lit(name), F.lit(round(w * UNIT))).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each node of ``nodes`` (parent columns, name, weight, capacity, budget of its parent) its ``given``.

    Nodes in the order of capacity / weight are filled up as long as their share of what is left exceeds their capacity;
    all further ones get their shares of what is left then, rounded down.
    """
    level = Window.partitionBy(*(parent or [F.lit(0)]))
    order = level.orderBy((F.col("capacity") / F.nullif("weight", F.lit(0))).asc_nulls_last(), F.col(name).asc_nulls_first())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    nodes = nodes.withColumns({
        "nth": F.row_number().over(order),
        "left": F.greatest(wide("budget") - F.coalesce(F.sum(wide("capacity")).over(before), F.lit(0)), F.lit(0)).cast("decimal(20,0)"),
        "open": F.sum(F.col("weight")).over(onward),
    })
    short = (F.col("weight") == 0) | (F.col("left") * F.col("weight") < wide("capacity") * F.col("open"))
    nodes = nodes.withColumn("stop", F.min(F.when(short, F.struct("nth", "left", "open"))).over(level))
    share = F.expr("cast(stop.left * weight div greatest(stop.open, 1) as long)")
    given = F.when(F.col("nth") < F.coalesce(F.col("stop.nth"), F.col("nth") + 1), F.col("capacity")).otherwise(F.least(share, F.col("capacity")))
    return nodes.withColumn("given", given).drop("nth", "left", "open", "stop")


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, domain_weights: Mapping[str, float] | None = None, lang_weights: Mapping[str, float] | None = None, source_weights: Mapping[str, float] | None = None) -> DataFrame:
    """The tokens ``given`` to each leaf (domain, lang, source, tokens); weights are 1 where none is stated.

    The whole budget is ``budget_share`` of all tokens. A leaf can use its tokens ``max_epochs`` times. Shares are rounded
    down, so a node may leave fewer tokens than it has children.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    domains = domains.withColumn("budget", (whole.cast("decimal(38,0)") * round(budget_share * UNIT) / UNIT).cast("long"))
    domains = _share(domains.withColumn("weight", _weight(F.col("domain"), domain_weights)), [], "domain")
    langs = langs.join(domains.select(F.col("domain").alias("d"), F.col("given").alias("budget")), F.col("domain").eqNullSafe(F.col("d"))).drop("d")
    langs = _share(langs.withColumn("weight", _weight(F.col("lang"), lang_weights)), ["domain"], "lang")
    above = langs.select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("given").alias("budget"))
    leaves = leaves.join(above, F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))).drop("d", "l")
    leaves = _share(leaves.withColumn("weight", _weight(F.col("source"), source_weights)), ["domain", "lang"], "source")
    return leaves.select("domain", "lang", "source", "tokens", "given")


def _uses(docs: DataFrame, budget_share: float, max_epochs: int, domain_weights: Mapping[str, float] | None, lang_weights: Mapping[str, float] | None, source_weights: Mapping[str, float] | None, seed: int, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The uses of documents: id, domain, lang, source, n_tokens, epoch, and leaf and told, which with the id mark a row."""
    rows = stored(docs.select(F.col(id_col).alias("id"), _told(F.col(text_col)).alias("told"), domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), word_tokens(F.col(text_col)).alias("n_tokens")))
    rows = rows.withColumn("leaf", _leaf(F.col("domain"), F.col("lang"), F.col("source")))
    leaves = rows.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(leaves, budget_share, max_epochs, domain_weights, lang_weights, source_weights)
    whole = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0)).cast("int")
    leaves = stored(leaves.withColumn("whole", whole).withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens")).withColumn("leaf", _leaf(F.col("domain"), F.col("lang"), F.col("source"))).select("leaf", "whole", "rest"))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), key, "told"))
    rows = stored(rows.join(leaves.select("leaf", "whole"), "leaf").withColumn("order", order))

    # What is left of a leaf's budget goes into one more epoch, unless all epochs are used.
    open_rows = rows.where((F.col("n_tokens") > 0) & (F.col("whole") < max_epochs))
    end = leaves.select("leaf", F.lit("").alias("end"), "rest")
    for r in range(ROUNDS):
        here = open_rows.join(end, "leaf").where(F.substring("order", 1, 2 * r) == F.col("end"))
        sums = here.groupBy("leaf", "end", "rest", F.substring("order", 2 * r + 1, 2).alias("digit")).agg(F.sum("n_tokens").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("digit")))
        over = sums.where("upto > rest").groupBy("leaf").agg(F.min(F.struct("digit", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"), "end")).alias("m"))
        end = stored(end.select("leaf").join(over, "leaf", "left").select("leaf", F.coalesce(F.concat("m.end", "m.digit"), F.lit("~")).alias("end"), F.coalesce("m.left", F.lit(0)).alias("rest")))
    open_rows = open_rows.join(end, "leaf").withColumn("start", F.substring("order", 1, 2 * ROUNDS))
    edge = open_rows.where("start = end")
    fits = edge.groupBy("leaf", "order", "rest").agg(F.sum("n_tokens").alias("n"))
    fits = fits.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))).where("upto <= rest")
    columns = ["id", "told", "leaf", "domain", "lang", "source", "n_tokens"]
    last = open_rows.where("start < end").select(*columns, F.col("whole").alias("epoch"))
    last = last.union(edge.join(fits.select("leaf", "order"), ["leaf", "order"]).select(*columns, F.col("whole").alias("epoch")))
    wordless = rows.where("n_tokens = 0").select(*columns, F.lit(0).alias("epoch"))
    return rows.where("whole > 0 and n_tokens > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch")).union(last).union(wordless)


def _told(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))


def _leaf(*names: Column) -> Column:
    return F.sha1(F.to_json(F.struct(*[n.alias(f"n{i}") for i, n in enumerate(names)])))


def mixture(docs: DataFrame, budget_share: float = 0.6, max_epochs: int = 2, domain_weights: Mapping[str, float] | None = None, lang_weights: Mapping[str, float] | None = None, source_weights: Mapping[str, float] | None = None, seed: int = 17, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that fill a token budget at target weights: the id, domain, lang, source, n_tokens, epoch.

    A row stands for one use of a document; epochs count from 0, and none is beyond ``max_epochs``. In epoch e a leaf's
    order is that of MD5("seed|e|id|MD5 of the text"). A document is used in it if the tokens up to and with it don't exceed
    what the leaf has left for that epoch.

    Null lang, source and domain are values of their own. Null text has no tokens; a text without words costs nothing and
    is used once, in epoch 0. A null id orders as "null". Rows that share an id are rows of their own; those of a leaf
    that share id and text are used together, if all of them fit, or not at all.
    """
    domain = source_domain(F.col(source_col)) if domain is None else domain
    uses = _uses(docs, budget_share, max_epochs, domain_weights, lang_weights, source_weights, seed, domain, id_col, text_col, lang_col, source_col)
    return uses.select(F.col("id").alias(id_col), "domain", "lang", "source", "n_tokens", "epoch")


def mixed(docs: DataFrame, budget_share: float = 0.6, max_epochs: int = 2, domain_weights: Mapping[str, float] | None = None, lang_weights: Mapping[str, float] | None = None, source_weights: Mapping[str, float] | None = None, seed: int = 17, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` as mixture() uses them, one row for each epoch that uses it; columns stay as they are."""
    domain = source_domain(F.col(source_col)) if domain is None else domain
    uses = _uses(docs, budget_share, max_epochs, domain_weights, lang_weights, source_weights, seed, domain, id_col, text_col, lang_col, source_col)
    used = uses.select(F.col("id").alias("__id"), F.col("told").alias("__told"), F.col("leaf").alias("__leaf"), F.col("epoch").alias("__epoch")).distinct()
    here = (F.col(id_col).eqNullSafe(F.col("__id"))) & (_told(F.col(text_col)) == F.col("__told")) & (_leaf(domain, F.col(lang_col), F.col(source_col)) == F.col("__leaf"))
    return docs.join(used, here).drop("__id", "__told", "__leaf", "__epoch")
