"""The pipeline's rows against brute force over a planted corpus."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest

import corpus_pipeline
from tests.llm.test_near_dup_whole import brute_force

UNIT = 1_000_000


def share(budget, nodes):
    """What each of ``nodes`` (name: weight, capacity) is given of ``budget``: the ones filled up first, then by weight."""
    given, left, open_ = {}, budget, sum(w for w, _ in nodes.values())
    for name, (w, capacity) in sorted(nodes.items(), key=lambda x: (x[1][1] / x[1][0], x[0])):
        if left * w < capacity * open_:
            break
        given[name] = capacity
        left, open_ = left - capacity, open_ - w
    return {name: given.get(name, min(left * w // open_, capacity) if open_ else capacity) for name, (w, capacity) in nodes.items()}


def mix(rows):
    """Of ``rows`` (id, text, lang, source) those that fill 0.6 of all tokens in one epoch at the pipeline's weights."""
    domains, langs = corpus_pipeline.MIX["domain_weights"], corpus_pipeline.MIX["lang_weights"]
    tree = {}
    for r in rows:
        domain = f"d{int(hashlib.md5(r[3].encode()).hexdigest()[:8], 16) % 4}"
        tree.setdefault(domain, {}).setdefault(r[2], {}).setdefault(r[3], []).append((len((r[1] or "").split()), r))
    tokens = lambda x: sum(n for n, _ in x) if isinstance(x, list) else sum(map(tokens, x.values()))
    out = []
    top = share(tokens(tree) * 6 // 10, {d: (round(domains.get(d, 1) * UNIT), tokens(x)) for d, x in tree.items()})
    for d, x in tree.items():
        for lang, budget in share(top[d], {k: (round(langs.get(k, 1) * UNIT), tokens(y)) for k, y in x.items()}).items():
            for source, left in share(budget, {k: (UNIT, tokens(z)) for k, z in x[lang].items()}).items():
                leaf = x[lang][source]
                if left == tokens(leaf):
                    out += [r for _, r in leaf]
                    continue
                name = lambda r: "null" if r[0] is None else str(r[0])
                out += [r for n, r in leaf if not n]
                alike = {}
                for n, r in leaf:
                    if n:
                        told = hashlib.md5(r[1].encode()).hexdigest()
                        alike.setdefault(hashlib.md5(f"17|0|{name(r)}|{told}".encode()).hexdigest(), []).append((n, r))
                for _, same in sorted(alike.items()):
                    left -= sum(n for n, _ in same)
                    if left < 0:
                        break
                    out += [r for _, r in same]
    return out


def shards(rows):
    """(id, text, shard, slot, shard of nine) of ``rows``."""
    def wins(key, n):
        draw = lambda i: (int(hashlib.md5(f"{key}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max(range(n), key=lambda i: -1 / math.log(draw(i)))

    out, slots = [], {}
    keyed = [("null" if r[0] is None else str(r[0]), (r[1] or "").encode(), r) for r in rows]
    for key, text, r in sorted(keyed, key=lambda x: (hashlib.md5(x[0].encode()).hexdigest(), zlib.crc32(x[1]), len(x[1]))):
        shard = wins(key, 8)
        out.append((r[0], r[1], shard, slots.setdefault(shard, 0), wins(key, 9)))
        slots[shard] += 1
    return out


@pytest.fixture(scope="module")
def planted():
    """Documents (id, text, lang, source) in random order, labels, items, and the ids of toxic ones."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrt')}{rng.choice('aeiou')}"
    texts, toxic = [[word() for _ in range(60)] for _ in range(300)], set(range(0, 300, 4))
    for i in toxic:
        for at in rng.sample(range(60), 6):
            texts[i][at] = "zurk" + rng.choice(["en", "a", "ou", "eri", "il"])
    items = [[f"item{b}word{i}" for i in range(n)] for b, n in enumerate((5, 9, 20, 40))]
    for i in range(1, 60, 4):
        texts[i][10:10] = items[i // 4 % 4]
    rows = [(i, " ".join(t) + ".") for i, t in enumerate(texts)]
    for i in range(2, 150, 8):  # copies, edited ones, and edited ones of those
        near = list(texts[i])
        for at in rng.sample(range(60), 9):
            near[at] = word() + "x"
        far = list(near)
        for at in rng.sample(range(60), 9):
            far[at] = word() + "y"
        rows += [(len(rows), rows[i][1].upper()), (len(rows) + 1, " ".join(near)), (len(rows) + 2, " ".join(far))]
    rows += [(None, rows[3][1]), (None, "a text without an id " * 3), (None, "a text without an id " * 3), (None, " ".join(["so", *items[2], "on"])), (7, rows[7][1]), (None, None), (900, None), (901, ""), (902, "\t\n")]
    rows = [(*r, rng.choice(["en", "de", "es"]), rng.choice("abcdef")) for r in rows]
    # the same document has the same other columns
    first = {}
    rows = [first.setdefault(r[:2], r) for r in rows]
    rng.shuffle(rows)
    return rows, [(i, int(i in toxic)) for i in range(300)], [(b, " ".join(t)) for b, t in enumerate(items)], toxic, [" ".join(t) for t in items]


def expected(rows, toxic, items):
    kept = [r for r in rows if r[0] not in toxic]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    heads, seen, one = brute_force([r[1] or "" for r in kept]), set(), []
    for i, r in enumerate(kept):
        words = (r[1] or "").split()
        if (heads[i] == i and words) or (not words and (r[:2] == (None, None) or r[1] not in seen or r[1] is None)):
            one.append(r)
            seen.add(r[1])
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    needed = [grams(t.split()) for t in items]
    clean = []
    for r in one:
        own = grams((r[1] or "").lower().split())
        if not any(len(g & own) >= 0.8 * len(g) for g in needed):
            clean.append(r)
    return [len(kept), len(one), len(clean)], shards(mix(clean))


def test_run_is_brute_force(spark, planted, tmp_path):
    rows, labels, benchmark, toxic, items = planted
    sf = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    sizes, whole = expected(rows, toxic, items)
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > len(whole) > 50
    told = lambda rows: sorted(map(repr, rows))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "text", "shard", "slot", "grown_shard").collect()
    assert told(tuple(r) for r in got) == told(whole)


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
