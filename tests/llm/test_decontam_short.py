"""Benchmark items of a few shingles are all found, however long the document."""

from __future__ import annotations

import random

from tracewell.llm import decontam


def test_short_items_are_brute_force(spark):
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [prose(5 + k % 8) for k in range(80)]
    docs = []
    for k, item in enumerate(items):
        at, held = rng.randrange(3000), list(item)
        if k % 5 == 4:
            held[-1] = "changed"
        docs.append(prose(at) + held + prose(3000 - at))
    out = decontam.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    has, own = [grams(d) for d in docs], [grams(w) for w in items]
    expected = {(d, k): len(own[k] & has[d]) for d in range(80) for k in range(80) if len(own[k] & has[d]) >= 0.8 * len(own[k]) - 1e-9}
    assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in out.collect()} == expected and len(expected) >= 64
