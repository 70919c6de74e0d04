"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch samples the few least k-mers of words of a whole text under one hash and keeps them in text order; a k-mer that
occurs again carries its occurrence number. So texts share a sketch if they share k-mers in the same order, wherever
words were changed, inserted or cut. Texts of up to 50 words are sketched by single words, of which any pair within
the limit shares two thirds; longer texts by pairs of words, which far fewer unrelated texts share. Documents with an
equal sketch share a bucket.

Each text is first aligned with the one leader (least id of a bucket) that it shares most buckets with; this
joins most copies at one alignment a text, however large their group. Then comes an exact pass: within every bucket
that still holds several classes all texts of different classes are compared, large buckets in tiles spread over
tasks. How many words one text has in excess of the other is a lower bound of their distance. Of the pairs that it
leaves a spanning forest of each tile is aligned first, which joins what can be joined by few alignments; then all
pairs that still stand in different classes, each in the least bucket that it shares. So no bucket is capped, and no link between two texts that share a bucket
is lost. Identical texts are aligned once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm._common import hashed_words, mix, rolling, row_key, slices, starts_of, stored

#: Texts of up to so many words are sketched by so many single words; longer ones by k-mers.
SHORT = ((15, 3), (50, 5))
#: Bins of words for the first lower bound of a distance.
BINS = 128
#: Texts of a class that one task compares with as many others of a large bucket.
TILE = 1000


def _sketches(km: np.ndarray, counts: np.ndarray, seeds: np.ndarray, odds: np.ndarray, size: int) -> np.ndarray:
    """A row of sketches for each run of ``counts`` (none empty) k-mer hashes: of each seed the ``size`` least k-mers, in text order.

    Only hashes under a bound that some 3 * size + 6 are expected under are sorted; a run with too few of them is sorted whole.
    """
    n, starts = len(counts), starts_of(counts)
    out = np.zeros((n, len(seeds)), dtype=np.uint64)
    owner = np.repeat(np.arange(n), counts)
    share = np.minimum((3 * size + 6) / counts, 1.0)
    bound = np.repeat(np.where(share < 1, share * 2.0**64, 0).astype(np.uint64) - np.uint64(1), counts)
    least = np.minimum(counts, size)
    for j, (seed, odd) in enumerate(zip(seeds, odds, strict=True)):
        v = (km ^ seed) * odd
        at = np.flatnonzero(v <= bound)
        few = np.flatnonzero(np.bincount(owner[at], minlength=n) < least)
        if len(few):
            whole = np.zeros(n, dtype=bool)
            whole[few] = True
            at = np.flatnonzero((v <= bound) | whole[owner])
        order = at[np.lexsort((v[at], owner[at]))]
        sizes = np.bincount(owner[order], minlength=n)
        rank = np.arange(len(order)) - np.repeat(starts_of(sizes)[:-1], sizes)
        chosen = np.sort(order[rank < size])  # places in the joined texts: each run's k-mers in text order
        row = owner[chosen]
        place = np.arange(len(chosen)) - starts_of(least)[row]
        told = np.zeros((n, size), dtype=np.uint64)
        told[row, place] = km[chosen]
        sketch = np.full(n, seed, dtype=np.uint64)
        for c in range(size):
            sketch = mix(sketch * np.uint64(0x9E3779B97F4A7C15) + told[:, c])
        out[:, j] = sketch
    return out


def _kmers(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of each document of ``n`` words, joined, and their counts; a shorter text is one k-mer."""
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    starts, to = starts_of(n), starts_of(counts)
    km = np.empty(to[-1], dtype=np.uint64)
    ends = np.repeat(starts[1:], n)
    run = rolling(h, k)
    km[np.repeat(n >= k, counts)] = run[np.arange(len(run)) + k <= ends[: len(run)]] if len(run) else run
    for i in np.flatnonzero((n > 0) & (n < k)):
        km[to[i]] = rolling(h[starts[i] : starts[i + 1]], int(n[i]))[0]
    owner = np.repeat(np.arange(len(n)), counts)
    order = np.lexsort((km, owner))
    new = np.ones(len(km), dtype=bool)
    new[1:] = (km[order][1:] != km[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(km)), 0))
    nth = np.empty(len(km), dtype=np.uint64)
    nth[order] = (np.arange(len(km)) - first).astype(np.uint64)
    again = nth > 0
    km[again] = mix(km[again] + nth[again] * np.uint64(0xD6E8FEB86659FD93))
    return km, counts


def banded_distance(a: list, b: list, limit: int) -> int | None:
    """Word edit distance of two texts if it is at most ``limit``, computed bit-parallel in the band around the diagonal."""
    lo, hi = 0, 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    if not b:
        return len(a)
    alone = Counter(a)
    alone.subtract(b)
    if max(sum(x for x in alone.values() if x > 0), -sum(x for x in alone.values() if x < 0)) > limit:
        return None
    band = min(limit, len(a))
    width = 2 * band + 1
    ones, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, dist, end = ones ^ ((1 << band) - 1), 0, band, top >> 1
    for j, w in enumerate(b):
        at = j + band + 1 - width
        m = where.get(w, 0)
        m = (m >> at if at >= 0 else m << -at) & ones
        d = (((m & plus) + plus) & ones ^ plus) | m | minus
        hp, hn = minus | (ones ^ (d | plus)), d & plus
        if j < len(a) - band:
            dist += not d & top
            if dist > limit + band + len(b) - len(a):
                return None
        else:
            dist += bool(hp & end) - bool(hn & end)
            end >>= 1
        d >>= 1
        plus, minus = hn | (ones ^ (d | hp)), d & hp
    return dist if dist <= limit else None


def _bags(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each document's words as pairs of 16 bits of the hash and how often it occurs; counts stop at 65535, which only lowers the bound."""
    owner = np.repeat(np.arange(len(n)), n)
    told, counts = np.unique((owner.astype(np.uint64) << np.uint64(16)) | (h & np.uint64(0xFFFF)), return_counts=True)
    pairs = np.stack([told & np.uint64(0xFFFF), np.minimum(counts, 65535)], axis=1).astype("<u2")
    cut = np.searchsorted(told >> np.uint64(16), np.arange(len(n) + 1))
    return [pairs[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]


def _possible(comps: np.ndarray, n: np.ndarray, bags: list[bytes], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of texts of different classes that may be within the limit, as i, all its j > i, and lower bounds of their distances.

    The bound is the number of words that one text has in excess of the other: first by bins, then for what is left by words.
    """
    sizes = np.array([len(x) // 4 for x in bags])
    starts = starts_of(sizes)
    words, times = np.frombuffer(b"".join(bags), dtype="<u2").reshape(-1, 2).T.astype(np.int64)
    owner = np.repeat(np.arange(len(n)), sizes)
    bins = np.bincount(owner * BINS + words % BINS, weights=times, minlength=len(n) * BINS).astype(np.int32).reshape(len(n), BINS)
    have = np.zeros(1 << 16, dtype=np.int64)
    for i in range(len(n) - 1):
        limit = np.floor((1 - threshold) * np.maximum(n[i], n[i + 1 :]) + 1e-9)
        js = np.flatnonzero((comps[i + 1 :] != comps[i]) & (np.abs(n[i + 1 :] - n[i]) <= limit))
        # what the longer text has in excess is the larger part
        excess = lambda js, common: np.maximum(n[i], n[i + 1 + js]) - common  # noqa: E731, B023
        if len(js):
            js = js[excess(js, np.minimum(bins[i], bins[i + 1 + js]).sum(axis=1)) <= limit[js]]
        if len(js):
            own = slice(starts[i], starts[i + 1])
            have[words[own]] = times[own]
            at = i + 1 + js
            each = np.repeat(starts[at] - starts_of(sizes[at])[:-1], sizes[at]) + np.arange(sizes[at].sum())
            common = np.add.reduceat(np.minimum(have[words[each]], times[each]), starts_of(sizes[at])[:-1])
            have[words[own]] = 0
            bound = excess(js, common)
            ok = bound <= limit[js]
            if ok.any():
                yield i, at[ok], bound[ok]


def _forest(found: Iterator[tuple[int, np.ndarray, np.ndarray]], comps: np.ndarray) -> list[tuple[int, int]]:
    """Of ``found`` the pairs, those with the lowest bounds first, that would join all its classes if all were links."""
    each = [(np.full(len(js), i), js, bounds) for i, js, bounds in found]
    if not each:
        return []
    one, two, bounds = (np.concatenate(c) for c in zip(*each, strict=True))
    head: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := head.get(x, x)) != x:
            head[x] = x = head.get(up, up)
        return x

    out = []
    for k in np.argsort(bounds, kind="stable").tolist():
        x, y = root(int(comps[one[k]])), root(int(comps[two[k]]))
        if x != y:
            head[x] = y
            out.append((int(one[k]), int(two[k])))
    return out


def _tiles(state: DataFrame) -> DataFrame:
    """Members of the buckets that hold several classes, with the ``tile`` where they are compared.

    A bucket of up to TILE members is one tile. In a larger one the members of the largest class (m) and the others (o) are dealt
    into parts; a tile holds two parts, m and o or o and o, so that each two members of different classes meet in one.
    """
    classes = state.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    gm = F.when(F.col("size") <= TILE, 1).otherwise(F.ceil(F.col("top.n") / TILE))
    go = F.when(F.col("size") <= TILE, 1).otherwise(F.ceil((F.col("size") - F.col("top.n")) / TILE))
    rows = state.join(mixed.select("bucket", F.col("top.comp").alias("top"), gm.cast("long").alias("gm"), go.cast("long").alias("go")), "bucket")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("comp") == F.col("top"), F.col("gm")).otherwise(F.col("go")))
    of_m = F.transform(F.sequence(F.lit(0).cast("long"), F.col("go") - 1), lambda j: F.col("part") * F.col("go") + j)
    with_m = F.transform(F.sequence(F.lit(0).cast("long"), F.col("gm") - 1), lambda i: i * F.col("go") + F.col("part"))
    with_o = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("go") - 1), lambda j: j != F.col("part")), lambda j: (F.col("gm") + F.least(j, F.col("part"))) * F.col("go") + F.greatest(j, F.col("part")))
    tile = F.explode(F.when(F.col("comp") == F.col("top"), of_m).otherwise(F.concat(with_m, with_o))).alias("t")
    return rows.withColumn("part", part).select("bucket", "node", "comp", "n_words", tile).select(F.xxhash64("bucket", "t").alias("tile"), "bucket", "node", "comp", "n_words")


def _components(links: DataFrame) -> DataFrame:
    """Columns node, comp (its least node) of the undirected links a, b: least labels spread and jump until none changes."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(state, both.b == state.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = state.join(near, state.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = state.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = stored(step.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("comp"), F.col("old")))
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        state = new.select("node", "comp")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``comps`` (node, comp) after new ``links`` (a, b), found among the components that these join."""
    a, b = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    over = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    found = _components(over)
    moved = comps.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(moved.unionByName(found.join(comps, "node", "left_anti")))


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, k: int = 2, sample: int = 3, sketches: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near-duplicates that each document belongs to.

    Two texts are linked if their word edit distance is at most (1 - threshold) of the longer one's words
    (words: split at ASCII white space, A-Z lower-cased); a class is what links join, and identical texts.
    Returns one row per input row: the id, ``class_id`` (least id of the class), ``n_words``.

    Sketches find a pair that shares the part J of its k-mers with a probability of about 1 - (1 - J**sample)**sketches. At the
    limit of 20 % edits J is 3/7 if each edit stands alone (0.994), more for edits side by side. Two texts that share
    a bucket are always compared, unless they have a class in common already.

    Null text: no words, a class of its own. Texts without words are linked only if identical. Null id: class null, not
    compared. Rows that share an id are one document: a link of any of its texts counts for all of them.
    """
    rng = np.random.default_rng(20240601)
    tiers, low = [], 0.0  # a text near the border of two tiers is sketched in both, as its copies may stand beyond it
    for high, width, size in (*((high, 1, size) for high, size in SHORT), (2**62, k, sample)):
        tiers.append((low, high, width, size, rng.integers(1, 2**63, sketches, dtype=np.uint64), rng.integers(1, 2**63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
        low = threshold * high
    out = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("n_words", pa.int64()), ("bag", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, h, _, _ = hashed_words([(t or b"").lower() for t in part.column("text").to_pylist()])
                made: list[list[np.ndarray]] = [[] for _ in n]
                for low, high, width, size, seeds, odds in tiers:
                    chosen = (n > low) & (n <= high)
                    if chosen.any():
                        km, counts = _kmers(h[np.repeat(chosen, n)], n[chosen], width)
                        for i, s in zip(np.flatnonzero(chosen), _sketches(km, counts, seeds, odds, size).astype(np.int64), strict=True):
                            made[i].append(s)
                made = [np.concatenate(m) if m else [] for m in made]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("same"), pa.array(n), pa.array(_bags(h, n), type=pa.binary()), pa.array(made, type=pa.list_(pa.int64()))], schema=out)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = x.lower().split(), y.lower().split()
                far.append(banded_distance(x, y, int((1 - threshold) * max(len(x), len(y)) + 1e-9)))
            ok = pa.array([d is not None for d in far])
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array([d for d in far if d is not None], type=pa.int64())], names=["a", "b", "distance"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("same", F.unhex(F.md5("text")))
    base = stored(rows.mapInArrow(sketch, "id long, same binary, n_words long, bag binary, sketch array<long>"))
    named = base.where("id is not null and same is not null")
    first = stored(named.groupBy("same").agg(F.min("id").alias("node")))
    texts = named.join(first, (named.same == first.same) & (named.id == first.node), "left_semi").where("n_words > 0").select(F.col("id").alias("node"), "n_words", "bag", "sketch")
    placed = texts.select("node", "n_words", F.explode("sketch").alias("bucket"))
    heads = stored(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1"))
    members = stored(placed.join(heads.select("bucket", "leader"), "bucket"))
    kept = stored(rows.where("text is not null").select(F.col("id").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi"))

    def possible(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

            def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
                tile, node, comp, n = (rows.column(c).to_numpy() for c in ("tile", "node", "comp", "n_words"))
                edges = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
                bags, pairs, sketches_of = rows.column("bag").to_pylist(), set(), {}

                def first_met(at: int, i: int, j: int) -> bool:
                    """Is the tile's bucket the least that both share? In all others the pair is left out."""
                    for row in (i, j):
                        if row not in sketches_of:
                            sketches_of[row] = frozenset(rows.column("sketch")[row].as_py())
                    return rows.column("bucket")[at].as_py() == min(sketches_of[i] & sketches_of[j])

                for x, y in zip(edges, edges[1:], strict=False):
                    found = _possible(comp[x:y], n[x:y], bags[x:y], threshold)
                    for i, j in ((i, j) for i, js, _ in found for j in js.tolist() if first_met(x, x + i, x + j)) if every else _forest(found, comp[x:y]):
                        pairs.add((int(min(node[x + i], node[x + j])), int(max(node[x + i], node[x + j]))))
                        if len(pairs) > 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*pairs, strict=True)], schema=schema)
                            pairs = set()
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*pairs, strict=True)], schema=schema)

            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                if held and held[-1].column("tile")[-1] == batch.column("tile")[-1]:
                    held.append(batch)  # the same tile goes on
                    continue
                tile = batch.column("tile").to_numpy()
                last = int(np.flatnonzero(tile != tile[-1])[-1] + 1) if tile[0] != tile[-1] else 0
                if held or last:
                    yield from of(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            if held:
                yield from of(pa.Table.from_batches(held))

        return run

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose texts are within the limit."""
        near = pairs.join(kept.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(kept.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        return stored(near.select("a", "b", "text_a", "text_b").mapInArrow(aligned, "a long, b long, distance long"))

    # first round: each text against the leader that it shares most buckets with
    shared = members.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    nearest = shared.groupBy(F.col("node").alias("b")).agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a"))
    comps = _components(linked(nearest))
    for every in (False, True):
        now = stored(members.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"), "n_words"))
        tiles = _tiles(now).join(texts.select("node", "bag", *(["sketch"] if every else [])), "node").repartition("tile").sortWithinPartitions("tile")
        pairs = stored(tiles.mapInArrow(possible(every), "a long, b long").distinct())
        if pairs.isEmpty():
            break
        found = linked(pairs)
        comps = _merged(comps, found)

    classes = first.join(comps, "node", "left").select("same", F.coalesce("comp", "node").alias("class"))
    own = base.where("id is not null").join(classes, "same", "left").groupBy("id").agg(F.min(F.coalesce("class", "id")).alias("class_id"))
    return base.select("id", "n_words").join(own, "id", "left").select(F.col("id").alias(id_col), "class_id", "n_words")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that with the least id; all columns stay.

    Rows without an id are compared like all others and come after them; those without a text too stay. Of rows that
    share id and text one stays; rows that share an id alone are one document, of which all texts stay or go.
    """
    key = row_key(id_col, text_col)
    classes = near_duplicate_classes(docs.select(key.alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text", **options)
    odd = stored(classes.where("key is not null").groupBy("key").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")).where("key <> class_id or n > 1"))
    again = docs.join(odd.where("key = class_id"), key == F.col("key"), "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(odd, key == F.col("key"), "left_anti").unionByName(again)
