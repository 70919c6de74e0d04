"""Exact substring deduplication with fixed-block anchors.

Any passage of ``window`` words holds one of its document's non-overlapping reference blocks of
``window // 2`` words whole. So reference blocks are indexed, every rolling window of block length probes
them, and only around a block with another occurrence are windows of full length compared; runs of repeated
windows then make up the maximal exact repeats that are cut out.

Nothing is paired: documents are dealt into even groups of at most about GROUP_BYTES of text, a group sends each of its
distinct hashes once to the hash's bucket, and a bucket answers each group. A passage in a third of all documents is
therefore one entry per group and bucket, however often it occurs. Within a group, too, only windows around live
blocks are compared. Windows are compared by 96 bits; anchors have fewer (about 1 in 1000 meets another by chance),
which costs comparisons and never a wrong cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracewell.llm._common import CHUNK_BYTES, hashed_words, mix, partitions, rolling, starts_of

#: Text bytes that a group has on average at most; a document is never divided, so one that is longer makes its group larger.
GROUP_BYTES = 64_000_000

_MESSAGES = "bucket long, grp long, n long, width int, owner_width int, first long, data binary, flags binary, owners binary, checks binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("owner_width", pa.int32()), ("first", pa.int64()), ("data", pa.binary()), ("flags", pa.binary()), ("owners", pa.binary()), ("checks", pa.binary())])


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned integers in as few bytes each as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8")


class _Outbox:
    """Sorted distinct hashes of one group, cut by bucket, as rows of _MESSAGES."""

    def __init__(self, group: int, buckets: int, bits: int):
        self.group, self.buckets, self.bits = group, buckets, bits

    def bucket_of(self, values: np.ndarray) -> np.ndarray:
        top = values >> np.uint64(max(0, self.bits - 32))
        return ((top * np.uint64(self.buckets)) >> np.uint64(min(32, self.bits))).astype(np.int64)

    def table(self, values: np.ndarray, flags: np.ndarray | None = None, owners: np.ndarray | None = None, checks: np.ndarray | None = None) -> pa.Table:
        cut = np.searchsorted(self.bucket_of(values), np.arange(self.buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            v = values[part]
            steps = np.diff(v, prepend=np.uint64(0))
            steps[0] = 0
            width, data = _packed(steps)
            row = {"bucket": int(b), "grp": self.group, "n": len(v), "width": width, "owner_width": 0, "first": int(v[0].astype(np.int64)), "data": data, "flags": b"", "owners": b"", "checks": b"" if checks is None else checks[part].tobytes()}
            if flags is not None:
                row["flags"] = np.packbits(flags[part].astype(np.uint8)[:, None] & np.array([1, 2], dtype=np.uint8) > 0, axis=None).tobytes()
            if owners is not None:
                low = owners[part].min()
                row["owner_width"], packed = _packed((owners[part] - low).astype(np.uint64))
                row["owners"] = int(low).to_bytes(8, "little", signed=True) + packed
            rows.append(row)
        return pa.Table.from_pylist(rows, schema=_SCHEMA)


def _values(row: dict) -> np.ndarray:
    steps = _unpacked(row["data"], row["width"], row["n"])
    steps[0] = np.int64(row["first"]).astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


def _owners(row: dict) -> np.ndarray:
    return int.from_bytes(row["owners"][:8], "little", signed=True) + _unpacked(row["owners"][8:], row["owner_width"], row["n"]).astype(np.int64)


def _flags(row: dict) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row["flags"], dtype=np.uint8), count=2 * row["n"]).reshape(-1, 2).astype(bool)


def _checks(row: dict) -> np.ndarray:
    return np.frombuffer(row["checks"], dtype=np.uint32)


def _documents(docs: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A group's rows in document order, a bounded amount of text at a time: ids, texts, where each begins among the words, and of all words hash, first and end byte."""
    ids, texts = docs.column("__id").to_numpy(), docs.column("__text")
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], texts[i].as_py() or b"")))
    sizes = np.array([x or 0 for x in pc.binary_length(texts).to_pylist()], dtype=np.int64)[order]
    part = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    for at in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []:
        some = [t or b"" for t in texts.take(pa.array(at)).to_pylist()]
        counts, h, first, end = hashed_words(some)
        yield ids[at], some, starts_of(counts), h, first, end


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=~values[:1]) != 0] if len(values) else values


def _groups(values: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (value, check) stand together, the earlier first, and whether each in it is the first of its kind."""
    order = np.argsort(values, kind="stable")
    v, c = values[order], checks[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    if (~new[1:] & (c[1:] != c[:-1])).any():  # equal hashes of different windows
        order = np.lexsort((checks, values))
        v, c = values[order], checks[order]
        new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    return order, new


def _around(alive: np.ndarray, starts: np.ndarray, h: np.ndarray, block: int, window: int, shift: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and checks of all full windows that hold a live reference block."""
    r, whole = rolling(h, block) >> shift, _whole(starts, block)
    within = np.repeat(starts[:-1], np.diff(starts))
    at = np.flatnonzero(((np.arange(len(r)) - within[: len(r)]) % block == 0) & whole)
    place = np.minimum(np.searchsorted(alive, r[at]), len(alive) - 1)
    at = at[alive[place] == r[at]]
    full, ok = rolling(h, window), _whole(starts, window)
    wanted = np.zeros(len(full) + window + 1, dtype=np.int32)
    np.add.at(wanted, np.maximum(at - (window - block), 0), 1)
    np.add.at(wanted, np.minimum(at + 1, len(full)), -1)
    take = np.flatnonzero((np.cumsum(wanted)[: len(full)] > 0) & ok)
    check = rolling(mix(h ^ np.uint64(0x5851F42D4C957F2D)), window)
    return take, full[take], (check[take] >> np.uint64(32)).astype(np.uint32)


def _whole(starts: np.ndarray, width: int) -> np.ndarray:
    """For each window start over joined documents: does the window end in the document that it starts in."""
    total = int(starts[-1])
    ends = np.repeat(starts[1:], np.diff(starts))
    return np.arange(max(0, total - width + 1)) + width <= ends[: max(0, total - width + 1)]


def repeated_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut from each text every word covered by a window of ``window`` words that also starts earlier in the corpus.

    Words are runs of characters other than ASCII white space, compared unchanged. A window starts earlier if
    its document has a smaller id, or starts earlier in the same document; all windows are judged on the input.
    Returns one row per input row: the id, ``kept_text`` (kept words joined by one space), ``n_words``,
    ``n_removed`` and ``spans`` (start and end word of each maximal run that was cut).

    Null or empty text: no words, kept_text "". Null id: the row has no place in the order, so it is neither a
    reference nor cut. Rows that share an id count as one document, taken in the order of their texts; an exact
    repeat of a row is thus cut like any later text. Other columns are ignored.
    """
    parts = partitions(docs.sparkSession)
    block = window // 2
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    groups = max(2 * parts, -(-size // GROUP_BYTES))
    buckets = -(-groups // 2)  # a message for each pair of them
    bits = min(60, 35 + math.ceil(math.log2(buckets + 1)))
    shift = np.uint64(64 - bits)
    dealt = rows.where("__id is not null").select(F.pmod(F.xxhash64("__id"), F.lit(groups)).alias("grp"), "__id", "__text")

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        """Each distinct rolling block hash of the group: bit 1 if it occurs twice, bit 2 if it is a reference block."""
        each = [np.empty(0, dtype=np.uint64)]
        for _, _, starts, h, _, _ in _documents(table):
            r, ok = rolling(h, block) >> shift, _whole(starts, block)
            own = (np.arange(len(r)) - np.repeat(starts[:-1], np.diff(starts))[: len(r)]) % block == 0
            each.append(((r << np.uint64(1)) | own)[ok])
        told = np.sort(np.concatenate(each))
        if not len(told):
            return _SCHEMA.empty_table()
        last = np.flatnonzero(np.diff(told >> np.uint64(1), append=~told[-1:] >> np.uint64(1)))  # of each hash, its reference blocks come last
        v, n = told[last] >> np.uint64(1), np.diff(last, prepend=-1)
        return _Outbox(key[0].as_py(), buckets, bits).table(v, (n > 1).astype(np.uint8) | ((told[last] & np.uint64(1)).astype(np.uint8) << 1))

    def live(_: tuple, table: pa.Table) -> pa.Table:
        """Tell each group which of its reference blocks have another occurrence."""
        rows = table.to_pylist()
        each = [_values(r) for r in rows]
        flags = [_flags(r) for r in rows]
        told = np.sort(np.concatenate([*each, *(x[f[:, 0]] for x, f in zip(each, flags, strict=True))]))
        again = _sorted_distinct(told[1:][told[1:] == told[:-1]])
        out = []
        for r, x, f in zip(rows, each, flags, strict=True):
            x = x[f[:, 1]]
            hit = x[again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x] if len(again) else x[:0]
            if len(hit):
                out.append(_Outbox(r["grp"], 1, bits).table(hit))
        return pa.concat_tables(out) if out else _SCHEMA.empty_table()

    def candidates(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Each distinct full window around a live block, with the smallest id that has it in this group."""
        alive = [_values(r) for r in answers.to_pylist()]
        if not alive or not table.num_rows:
            return _SCHEMA.empty_table()
        alive = _sorted_distinct(np.concatenate(alive))
        found = []
        for ids, _, starts, h, _, _ in _documents(table):
            take, v, c = _around(alive, starts, h, block, window, shift)
            found.append((v, c, ids[np.searchsorted(starts, take, "right") - 1]))
        v, c, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        order, new = _groups(v, c)
        first = order[new]
        return _Outbox(key[0].as_py(), buckets, 64).table(v[first], owners=owner[first], checks=c[first])

    def earlier(_: tuple, table: pa.Table) -> pa.Table:
        """Tell each group which of its windows another group has in a smaller document."""
        rows = table.to_pylist()
        each = [_values(r) for r in rows]
        v, c, owners = np.concatenate(each), np.concatenate([_checks(r) for r in rows]), np.concatenate([_owners(r) for r in rows])
        order, new = _groups(v, c)
        least = np.empty(len(v), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(owners[order], np.flatnonzero(new)), np.diff(np.flatnonzero(new), append=len(v)))
        hit, out, at = least < owners, [], 0
        for r, x in zip(rows, each, strict=True):
            own = slice(at, at + len(x))
            at += len(x)
            if hit[own].any():
                out.append(_Outbox(r["grp"], 1, 64).table(x[hit[own]], checks=c[own][hit[own]]))
        return pa.concat_tables(out) if out else _SCHEMA.empty_table()

    schema = pa.schema([("__id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def cut(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        told = answers.to_pylist()
        alive = [_values(r) for r in told if not r["checks"]]
        alive = _sorted_distinct(np.concatenate(alive)) if alive else None
        there = [r for r in told if r["checks"]]
        parts = [(np.concatenate([_values(r) for r in there]), np.concatenate([_checks(r) for r in there]))] if there else []
        places, before = [], sum(len(v) for v, _ in parts)
        chunks = []
        for ids, some, starts, h, first, end in _documents(table):
            take, v, c = _around(alive, starts, h, block, window, shift) if alive is not None else (np.empty(0, dtype=np.int64),) * 3
            places.append(take)
            parts.append((v.astype(np.uint64), c.astype(np.uint32)))
            chunks.append((ids, some, starts, first.astype(np.int32), end.astype(np.int32)))
        # what another group has earlier stands before all own windows, so that each of these that isn't the first of its kind goes
        order, new = _groups(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        again = np.empty(len(order), dtype=bool)
        again[order] = ~new
        again = again[before:]
        out = {n: [] for n in schema.names}
        for (ids, some, starts, first, end), take in zip(chunks, places, strict=True):
            at, again = take[again[: len(take)]], again[len(take) :]
            covered = np.zeros(starts[-1] + 1, dtype=np.int32)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
            gone = np.cumsum(covered)[:-1] > 0
            lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[starts])
            for k, t in enumerate(some):
                a, b = starts[k], starts[k + 1]
                if lost[k]:
                    edge = np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                    inner = [0, *edge, b - a]
                    t = b" ".join([t[first[a + x] : end[a + y - 1]] for x, y in zip(inner[::2], inner[1::2], strict=True) if x < y])
                else:
                    edge = []
                for n, x in zip(schema.names, (ids[k], b" ".join(t.split()).decode(), b - a, lost[k], [{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)]), strict=True):
                    out[n].append(x)
        return pa.table(out, schema=schema)

    answers = dealt.groupBy("grp").applyInArrow(anchors, _MESSAGES).groupBy("bucket").applyInArrow(live, _MESSAGES)
    asked = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(candidates, _MESSAGES)
    found = asked.groupBy("bucket").applyInArrow(earlier, _MESSAGES)
    done = dealt.groupBy("grp").cogroup(answers.union(found).groupBy("grp")).applyInArrow(cut, "__id long, kept_text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>")
    plain = F.filter(F.split(F.col("__text").cast("string"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    apart = rows.where("__id is null").select("__id", F.coalesce(F.array_join(plain, " "), F.lit("")).alias("kept_text"), F.coalesce(F.size(F.when(F.col("__text").isNotNull(), plain)), F.lit(0)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    apart = apart.withColumn("n_words", F.greatest("n_words", F.lit(0).cast("long")))
    return done.unionByName(apart).withColumnRenamed("__id", id_col)
