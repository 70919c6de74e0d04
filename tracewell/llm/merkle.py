"""A Merkle manifest of a table: a tree of degree three over each source's rows, and one over the sources.

Rows are numbered within their source through sorted ranges, so no task holds a source. Blocks of 3**LEVELS consecutive
nodes are reduced to one node each by tasks of their own; that repeats until what is left is a small top. The driver builds
the top and hands the paths from its nodes to the root out again as a broadcast; tasks put their block's own paths before
them, and each row is folded to the root by column functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm._common import partitions, stored

#: Children of a node, levels that a block of nodes is reduced by, and nodes that the driver builds the top from at most.
DEGREE, LEVELS, TOP = 3, 9, 4096

PATH = "array<struct<left:string,right:string>>"
_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def record_digest(fields: Sequence[Column]) -> Column:
    """The digest of a record: of each field its UTF-8 byte count, ":" and its text, or "-" where it is null."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def path_digest(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _depth(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // DEGREE), levels + 1
    return levels


def _raised(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and what they become, level by level."""
    out = [nodes]
    for _ in range(levels):
        out.append([_hash(out[-1][i : i + DEGREE]) for i in range(0, len(out[-1]), DEGREE)])
    return out


def _paths(levels: list[list[str]], above: Sequence[list[dict]]) -> list[list[dict]]:
    """Of each node of the lowest level the path to the highest one, and on by ``above`` of the node it ends in."""
    paths = list(above)
    for nodes in reversed(levels[:-1]):
        runs = [nodes[i - i % DEGREE : i - i % DEGREE + DEGREE] for i in range(len(nodes))]
        paths = [[{"left": "".join(run[: i % DEGREE]), "right": "".join(run[i % DEGREE + 1 :])}, *paths[i // DEGREE]] for i, run in enumerate(runs)]
    return paths


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows``, which have a ``tree``, with ``pos`` within the tree in the given order, and ``n``, the tree's size."""
    ranges = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranges = ranges.repartitionByRange(partitions(rows.sparkSession), "tree", *order, "__tie").sortWithinPartitions("tree", *order, "__tie").drop("__tie")
    ranges = stored(ranges.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__nth")))
    sizes = ranges.groupBy("tree", "__range").agg(F.count("*").alias("size"), F.min("__nth").alias("first"))
    tree = Window.partitionBy("tree")
    sizes = sizes.select(
        F.col("tree").alias("__tree"),
        F.col("__range").alias("__r"),
        (F.sum("size").over(tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") - F.col("first")).alias("__shift"),
        F.sum("size").over(tree).alias("n"),
    )
    out = ranges.join(sizes, (F.col("tree") == F.col("__tree")) & (F.col("__range") == F.col("__r")))
    return out.withColumn("pos", F.col("__nth") + F.col("__shift")).drop("__range", "__nth", "__tree", "__r", "__shift")


def _by_pos(nodes: pa.Table) -> pa.Table:
    return nodes.sort_by("pos")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Each block of nodes as one node, ``levels`` higher, or the tree's root where that comes first."""

    def work(key: tuple, group: pa.Table) -> pa.Table:
        group = _by_pos(group)
        n = group["n"][0].as_py()
        up = min(levels, _depth(n))
        (top,) = _raised(group["digest"].to_pylist(), up)[-1]
        return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // DEGREE**up)], pa.int64()), "digest": [top]})

    rows = nodes.select("tree", "pos", "n", "digest").withColumn("block", F.floor(F.col("pos") / DEGREE**levels))
    return rows.groupBy("tree", "block").applyInArrow(work, "tree string, pos long, n long, digest string")


def _top(nodes: list) -> tuple[str | None, list[tuple]]:
    """The root over a few nodes of any trees, and of each node (tree, pos, path to the root, its tree's root)."""
    trees: dict[str, list] = {}
    for x in sorted(nodes, key=lambda x: (x["tree"].encode(), x["pos"])):
        trees.setdefault(x["tree"], []).append(x["digest"])
    raised = {tree: _raised(own, _depth(len(own))) for tree, own in trees.items()}
    upper = _raised([x[-1][0] for x in raised.values()], _depth(len(raised)))
    above = _paths(upper, [[]] * len(upper[-1]))
    rows = [(tree, pos, path, levels[-1][0]) for (tree, levels), last in zip(raised.items(), above, strict=True) for pos, path in enumerate(_paths(levels, [last]))]
    return (upper[-1][0] if rows else None), rows


def _with_paths(nodes: DataFrame, above: DataFrame, few: bool, levels: int) -> DataFrame:
    """``nodes`` with ``path`` to the root and ``subroot``; ``above`` has both for the blocks of ``nodes``.

    Few paths from above are broadcast; many meet their blocks in a cogroup, so that each travels once.
    """
    rows = nodes.withColumn("block", F.floor(F.col("pos") / DEGREE**levels))
    above = above.select(F.col("tree").alias("__tree"), F.col("pos").alias("__block"), F.col("path").alias("__above"), F.col("subroot").alias("__subroot"))

    def own(group: pa.Table, last: list[dict]) -> pa.Table:
        group = _by_pos(group)
        raised = _raised(group["digest"].to_pylist(), min(levels, _depth(group["n"][0].as_py())))
        return group.append_column("path", pa.array(_paths(raised, [last]), _ARROW_PATH))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    if few:
        out = rows.groupBy("tree", "block").applyInArrow(lambda group: own(group, []), ", ".join([*kept, f"path {PATH}"]))
        out = out.join(F.broadcast(above), (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__block")))
        return out.withColumn("path", F.concat("path", "__above")).withColumn("subroot", F.col("__subroot")).drop("block", "__tree", "__block", "__above", "__subroot")

    def met(group: pa.Table, last: pa.Table) -> pa.Table:
        out = own(group, last["__above"][0].as_py())
        return out.append_column("subroot", pa.array(last["__subroot"].to_pylist() * len(out), pa.string()))

    pairs = rows.groupBy("tree", "block").cogroup(above.groupBy("__tree", "__block"))
    return pairs.applyInArrow(met, ", ".join([*kept, f"path {PATH}", "subroot string"])).drop("block")


def _climbed(nodes: DataFrame, levels: int, top: int) -> tuple[str | None, DataFrame, bool]:
    """The root, of each node its path and subroot, and whether there are few nodes, so that these can be broadcast."""
    spark = nodes.sparkSession
    sizes = nodes.agg(F.count("*").alias("nodes"), F.max("n").alias("n")).first()
    if sizes["nodes"] <= top:
        root, rows = _top(nodes.select("tree", "pos", "digest").collect())
        return root, spark.createDataFrame(rows, f"tree string, pos long, path {PATH}, subroot string"), True
    if sizes["n"] > 1:
        root, above, few = _climbed(stored(_blocks(nodes, levels)), levels, top)
        return root, _with_paths(nodes, above, few, levels).select("tree", "pos", "path", "subroot"), False
    sources = _placed(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    root, above, few = _climbed(stored(_blocks(sources, levels)), levels, top)
    out = _with_paths(sources, above, few, levels)
    return root, out.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot")), False


def proofs(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", leaf_col: str = "leaf", levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """``rows`` with pos, subroot, root and path: the siblings (left, right) on each level from the leaf to the root.

    In a source, leaves ascend by id (null first, equal ids by leaf). While several nodes remain, every three
    consecutive ones become the digest of their digests. The sources' roots, ordered by source (null first, by UTF-8
    bytes), become the root likewise. All other columns stay; columns of the four names are replaced. An empty table has
    no rows and no root.

    levels: of a block; a task holds 3**levels rows. top: nodes that the driver takes at most.
    """
    own = ["pos", "subroot", "root", "path"]
    names = [c for c in rows.columns if c not in own]
    packed = rows.select(F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("tree"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    leaves = stored(_placed(stored(packed), ["id", "digest"]).drop("id"))
    root, above, few = _climbed(stored(_blocks(leaves, levels)), levels, top)
    out = _with_paths(leaves, above, few, levels)
    return out.select("row.*", "pos", "subroot", F.lit(root).cast("string").alias("root"), "path")
