"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of shingles, in powers of two. For a partition with at most u
shingles a document is covered by overlapping windows of 2u shingles that begin every u: any passage of an item's
length lies whole in one of them, and against a window of that size the item's containment implies a Jaccard
similarity that MinHash finds, however long the document. A window and an item with any equal minimum become a
candidate. Items of less than LEAST / 2 shingles are looked up by each of their shingles instead, as a window would
dwarf them. A candidate document is then verified by exact containment of the item's shingles in all of it.

The benchmark is searched in blocks of bounded size, each in one pass over the documents, so what executors
hold of it is bounded whatever its size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm._common import hashed_words, rolling, row_key, slices, starts_of

#: Text bytes of the benchmark that are searched for in one pass.
BLOCK_BYTES = 16_000_000
#: Shingles in the smallest window half; smaller items use it too.
LEAST = 16


class _Index:
    """Minima of a block of items by size partition and seed."""

    def __init__(self, items: list[tuple[int, str]], k: int, seeds: np.ndarray, odds: np.ndarray):
        self.k, self.seeds, self.odds = k, seeds, odds
        self.shingles: dict[int, list[set[tuple[bytes, ...]]]] = defaultdict(list)
        short: list[tuple[int, int]] = []
        minima: dict[int, list[list[tuple[int, int]]]] = {}
        for item, text in items:
            words = text.encode().lower().split()
            if len(words) < k:
                continue
            h = rolling(hashed_words([b" ".join(words)])[1], k)
            distinct = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
            if len(h) < LEAST // 2:
                self.shingles[item].append(distinct)
                short += [(x, item) for x in set(h.tolist())]
                continue
            u = LEAST
            while u < len(h):
                u *= 2
            self.shingles[item].append(distinct)
            own = minima.setdefault(u, [[] for _ in seeds])
            for j, (s, o) in enumerate(zip(seeds, odds, strict=True)):
                own[j].append((int(((h ^ s) * o).min()), item))
        self.short = self._sorted(short) if short else None
        self.parts = {u: [self._sorted(pairs) for pairs in by_seed] for u, by_seed in sorted(minima.items())}

    @staticmethod
    def _sorted(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Hashes in order, their items, and which leading 16 bits there are."""
        pairs.sort()
        values = np.array([p[0] for p in pairs], dtype=np.uint64)
        bits = np.zeros(1 << 16, dtype=bool)
        bits[(values >> np.uint64(48)).astype(np.int64)] = True
        return values, [p[1] for p in pairs], bits

    def candidates(self, h: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(Document, item) whose windows have an equal minimum, or that share a shingle if the item is short; ``h``: joined shingle hashes of documents with ``counts``."""
        docs = np.repeat(np.arange(len(counts)), -(-counts // LEAST))
        starts = starts_of(counts)
        first = starts_of(-(-counts // LEAST))
        inside = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
        blocks = np.repeat(starts[:-1], np.diff(first)) + inside * LEAST
        found: set[tuple[int, int]] = set()
        if self.short:
            values, items, bits = self.short
            at = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(values, h[at], "left"), np.searchsorted(values, h[at], "right")
            owner = np.searchsorted(starts, at, "right") - 1
            for i in np.flatnonzero(hi > lo):
                found.update((int(owner[i]), items[x]) for x in range(lo[i], hi[i]))
        if not self.parts:
            return found
        for j, (s, o) in enumerate(zip(self.seeds, self.odds, strict=True)):
            least = np.minimum.reduceat((h ^ s) * o, blocks)
            width, whole = 1, least
            for u, by_seed in self.parts.items():
                while width < 2 * u // LEAST:
                    # runs of doubling length; a run ends with its document
                    ahead = np.minimum(np.arange(len(whole)) + width, len(whole) - 1)
                    whole = np.where(docs[ahead] == docs, np.minimum(whole, whole[ahead]), whole)
                    width *= 2
                values, items, bits = by_seed[j]
                at = np.flatnonzero((inside % (u // LEAST) == 0) & bits[(whole >> np.uint64(48)).astype(np.int64)])
                lo, hi = np.searchsorted(values, whole[at], "left"), np.searchsorted(values, whole[at], "right")
                for i in np.flatnonzero(hi > lo):
                    found.update((int(docs[at[i]]), items[x]) for x in range(lo[i], hi[i]))
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, seeds: int = 48, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item of which at least ``threshold`` of the shingles stand in the document.

    A shingle is ``k`` consecutive words (split at ASCII white space, A-Z lower-cased). Returns the id, the item's id,
    ``n_shared`` and ``n_shingles`` (distinct shingles of the item, in the document and in all), ``containment``. A
    passage that is whole has a Jaccard similarity of at least 1/4 to a window; 48 seeds miss such a one with a
    probability under 0.000002. Items of less than LEAST / 2 shingles are always found.

    Null text or id on either side: no pair. An item of fewer than k words has no shingle and meets nothing. Of rows that
    share an id each is searched as a text of its own; the best pair counts.
    """
    rng = np.random.default_rng(20240602)
    seed = rng.integers(1, 2**63, seeds, dtype=np.uint64)
    odd = rng.integers(1, 2**63, seeds, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())])

    def search(index: _Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    texts = [t.lower() for t in part.column("text").to_pylist()]
                    words_n, h, _, _ = hashed_words(texts)
                    counts = np.maximum(words_n - k + 1, 0)
                    ends = np.repeat(starts_of(words_n)[1:], words_n)
                    r = rolling(h, k)
                    r = r[np.arange(len(r)) + k <= ends[: len(r)]]
                    if not len(r) or not index.shingles:
                        continue
                    real = np.flatnonzero(counts)
                    ids, out = part.column("id").to_pylist(), []
                    by_doc = defaultdict(list)
                    for d, item in index.candidates(r, counts[real]):
                        by_doc[int(real[d])].append(item)
                    for d, near in by_doc.items():
                        w = texts[d].split()
                        has = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
                        for item in near:
                            for own in index.shingles[item]:
                                if (n := len(own & has)) >= threshold * len(own) - 1e-9:
                                    out.append({"id": ids[d], "item": item, "n_shared": n, "n_shingles": len(own)})
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

        return run

    pairs = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        index = _Index([(r["item"], r["text"]) for r in part.collect()], k, seed, odd)
        found = texts.mapInArrow(search(index), "id long, item long, n_shared long, n_shingles long")
        pairs = found if pairs is None else pairs.union(found)
    best = pairs.groupBy("id", "item").agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shared", "n_shingles")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.n_shared", "m.n_shingles", "m.containment")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; columns stay as they are.

    Rows without an id are searched like all others; rows that share an id go if one of them does.
    """
    key = row_key(id_col, text_col)
    bad = contaminated(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, id_col="key", text_col="text", **options).select("key").distinct()
    return docs.join(bad, key == F.col("key"), "left_anti")
