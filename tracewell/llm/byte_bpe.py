"""Byte-level BPE over a global shuffle of distinct words, and its inverse.

Texts are cut into pre-tokens. A block of texts lists its distinct pre-tokens once and keeps the places as numbers into
that list, so a place costs a few bits. The lists are dealt out by a hash of the word and shuffled: all blocks' entries of
a word meet in one task, which encodes it once. The ids go back to their blocks, where they are put together in the order of
the places. The blocks' places are a table bucketed by block, so they are written once and never shuffled.

Decoding looks each id up in the table of token bytes, whose size is that of the vocabulary.
"""

from __future__ import annotations

import atexit
import base64
import uuid
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tracewell.llm._common import _remove, partitions, shared_dir, slices, starts_of

#: Parts that words are dealt out to by their hash; a task that encodes holds the distinct words of one part.
PARTS = 1024
#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 16_000_000
#: Characters that are cut into pre-tokens at once, and places that are put together at once.
WINDOW, PLACES = 1_000_000, 1_000_000
#: Characters beyond a match's end that can decide it: what follows white space, or two letters after an apostrophe.
AHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line. Read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=1)
def unlike() -> dict[int, int]:
    """Characters from U+0080 on that this regex library and tiktoken's hold for different kinds, as they know different versions of
    Unicode, and for each a character that both hold for what tiktoken does."""
    chars = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    out, known = {}, {}
    for kind, alike in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t")):
        theirs = set(bytes(tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(chars)).decode())
        out |= dict.fromkeys(theirs ^ set(regex.findall(kind, chars)), "!")
        known |= dict.fromkeys(theirs, alike)
    return {ord(c): ord(known.get(c, x)) for c, x in out.items()}


@lru_cache(maxsize=1)
def _unlike_characters() -> frozenset[str]:
    return frozenset(map(chr, unlike()))


def pre_tokens(pattern: regex.Pattern, text: str, window: int = WINDOW) -> Iterator[list[str]]:
    """All matches of ``pattern``, which must cover any text, in lists; kinds of characters are tiktoken's.

    A long text is cut in windows. What more text could change, matches that end within AHEAD characters of a window's
    end, begins the next window.
    """
    at, size = 0, window
    original = text
    if not text.isascii() and not _unlike_characters().isdisjoint(text):
        text = text.translate(unlike())
    while at < len(text):
        found = pattern.findall(text, at, at + size)
        end = at + sum(map(len, found))
        if at + size < len(text):
            while found and end > at + size - AHEAD:
                end -= len(found.pop())
            if not found:
                size *= 2
                continue
        if original is not text:
            edges = at + starts_of(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            found = [original[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        yield found
        at, size = end, window


class _Block:
    """The texts of a block: ids of their rows, distinct pre-tokens and places."""

    def __init__(self, number: int):
        self.number, self.bytes, self.ids, self.counts, self.places = number, 0, [], [], []
        self.words: dict[str, int] = {}

    def add(self, row_id, text: bytes, pattern: regex.Pattern) -> None:
        words, count = self.words, 0
        for found in pre_tokens(pattern, text.decode("utf-8", "replace")):
            self.places.append(np.array([words.setdefault(w, len(words)) for w in found], dtype=np.uint32))
            count += len(found)
        self.bytes += len(text)
        self.ids.append(row_id)
        self.counts.append(count)

    def row(self, id_type: pa.DataType) -> pa.RecordBatch:
        places = np.concatenate([np.empty(0, dtype=np.uint32), *self.places])
        words = [w.encode() for w in self.words]
        part = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % PARTS
        order = np.argsort(part, kind="stable").astype(np.uint32)
        edges = np.searchsorted(part[order], np.arange(PARTS + 1))
        lists = [{"part": k, "at": int(a), "n": int(b - a), "words": pa.compress(_END.join(words[i] for i in order[a:b]), codec="zstd", asbytes=True), "size": int(sum(len(words[i]) for i in order[a:b]) + b - a - 1)} for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number], pa.int64()), pa.array([self.ids], pa.list_(id_type)), pa.array([self.counts], pa.list_(pa.int64())), pa.array([_packed(places)], pa.binary()), pa.array([_packed(order)], pa.binary()), pa.array([lists], pa.list_(_LIST))],
            ["block", "ids", "counts", "places", "numbers", "lists"],
        )


#: Between words, as no UTF-8 text holds it.
_END = b"\xff"
_LIST = pa.struct([("part", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("size", pa.int32())])


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes of bytes, as high bytes are alike, and compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _pieces(docs: DataFrame, pattern: str, block_bytes: int) -> DataFrame:
    """A row for each block, written bucketed by block."""
    spark = docs.sparkSession
    id_type = docs.schema["id"].dataType.simpleString()

    def work(batches):
        compiled, task, blocks = regex.compile(pattern), TaskContext.get().partitionId() << 32, 0
        block, kind = None, pa.null()
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in slices(batch, "text"):
                for row_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if block is not None and block.bytes + len(text) > block_bytes:
                        yield block.row(kind)
                        block = None
                    if block is None:
                        block, blocks = _Block(task + blocks), blocks + 1
                    block.add(row_id, text, compiled)
        if block is not None:
            yield block.row(kind)

    name = f"tracewell_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = docs.mapInArrow(work, f"block long, ids array<{id_type}>, counts array<long>, places binary, numbers binary, lists array<struct<part:int,at:int,n:int,words:binary,size:int>>")
    rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(partitions(spark), "block").saveAsTable(name)
    atexit.register(_dropped, spark, name, path)
    return spark.table(name)


def _dropped(spark, name: str, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark, path)


@lru_cache(maxsize=2)
def _whole_words(ranks: tuple[tuple[bytes, int], ...]) -> tiktoken.Encoding:
    """An encoding that takes any text as one pre-token."""
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=dict(ranks), special_tokens={})


def _encoder(ranks: Mapping[bytes, int]):
    """Ids of lists of words that come sorted by part; each distinct word of a part is encoded once."""
    listed = tuple(ranks.items())

    def work(batches):
        encoding, part, known = _whole_words(listed), None, {}
        for batch in batches:
            packed, counts = [], []
            for k, size, words in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "words")), strict=True):
                if k != part:
                    part, known = k, {}
                ids = []
                for word in pa.decompress(words, decompressed_size=size, codec="zstd", asbytes=True).split(_END):
                    if word not in known:
                        known[word] = encoding.encode_ordinary(word.decode())
                    ids.append(known[word])
                flat = [len(x) for x in ids] + [i for x in ids for i in x]
                packed.append(_packed(np.array(flat, dtype=np.uint32)))
                counts.append(len(flat))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), batch.column("n"), pa.array(packed, pa.binary()), pa.array(counts, pa.int32())], ["block", "at", "n", "ids", "size"])

    return work


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + lengths[i]] one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given sizes out of consecutive bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(starts_of(sizes)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _texts(block: pa.Table, coded: pa.Table, id_col: str) -> pa.Table:
    """The ids of a block's texts, in the order of their places."""
    coded = coded.sort_by("at")
    lists = [(n, _unpacked(data, size)) for n, data, size in zip(*(coded[c].to_pylist() for c in ("n", "ids", "size")), strict=True)]
    flat = np.concatenate([np.empty(0, dtype="<u4"), *(x[n:] for n, x in lists)])
    dealt = np.concatenate([np.empty(0, dtype=np.int64), *(x[:n].astype(np.int64) for n, x in lists)])
    numbers = _unpacked(block["numbers"][0].as_py(), len(dealt))
    lengths, starts = np.empty(len(dealt), dtype=np.int64), np.empty(len(dealt), dtype=np.int64)
    lengths[numbers], starts[numbers] = dealt, starts_of(dealt)[:-1]
    ids, kind, parts = block["ids"].combine_chunks().flatten(), block.schema.field("ids").type.value_type, []
    counts = np.array(block["counts"][0].as_py(), dtype=np.int64)
    places = _unpacked(block["places"][0].as_py(), int(counts.sum()))
    first = starts_of(counts)
    edges = [0, *(np.flatnonzero(np.diff(first[:-1] // PLACES)) + 1).tolist(), len(counts)]
    for a, b in zip(edges, edges[1:], strict=False):
        here = places[first[a] : first[b]]
        n = starts_of(lengths[here])[first[a : b + 1] - first[a]]
        tokens = _gathered(flat, starts[here], lengths[here])
        parts.append(pa.table([ids.slice(a, b - a).cast(kind), pa.array(np.diff(n)), _binaries(tokens.view(np.uint8), 4 * np.diff(n))], [id_col, "n_tokens", "ids"]))
    return pa.concat_tables(parts)


def encode(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col``, n_tokens long and ids binary (little-endian unsigned 32-bit) of each row, without special tokens.

    Null text is empty and has no ids. Null and repeated ids are rows like others; other columns are not read. Bytes that
    are no UTF-8 count as U+FFFD. ``ranks`` must hold all single bytes; ``pattern`` see pre_tokens().
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    pieces = _pieces(rows, pattern, block_bytes)
    words = pieces.select("block", F.inline("lists")).repartition(partitions(spark), "part").sortWithinPartitions("part")
    coded = words.mapInArrow(_encoder(ranks), "block long, at int, n int, ids binary, size int")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    places = pieces.select("block", "ids", "counts", "places", "numbers")
    return places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(lambda block, of: _texts(block, of, id_col), schema)


def decode(encoded: DataFrame, ranks: Mapping[bytes, int], ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``to_col`` binary: the bytes that its ids stand for. Null ids stay null; an unknown id fails."""
    table = dict(sorted((rank, token) for token, rank in ranks.items()))
    tokens = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    flat, starts = np.frombuffer(b"".join(tokens), dtype=np.uint8), starts_of(lengths)[:-1]
    columns = [c for c in encoded.columns if c != to_col]
    rows = encoded.select(*[F.col(f"`{c}`") for c in columns])
    schema = T.StructType([*rows.schema.fields, T.StructField(to_col, T.BinaryType())])

    def work(batches):
        for batch in batches:
            for part in slices(batch, ids_col):
                column = part.column(ids_col)
                n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                ids = np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype="<u4")
                if len(ids) and not lengths[ids].all():
                    raise ValueError(f"no token has the id {ids[lengths[ids] == 0][0]}")
                sizes = np.diff(starts_of(lengths[ids])[starts_of(n)])
                out = _binaries(_gathered(flat, starts[ids], lengths[ids]), sizes)
                out = pc.if_else(column.is_valid(), out, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*columns, to_col])

    return rows.mapInArrow(work, schema)
