"""The text operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import json
import random
import time
import zlib
from collections import Counter
from itertools import product

import pytest

from pyspark.sql import functions as F

from tracewell.llm import chat, decontam, html_extract, licenses, mixing, near_dup, quality, sharding, substring_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, lang="en", source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in zip(ids, texts, strict=True)], DOC)


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    a, b, c = prose(rng, 120), prose(rng, 90), prose(rng, 60, 9000)
    edited = a.split()
    edited[40], edited[80] = "x", "y"
    texts = [a, None, "", "   ", a, " ".join(edited), b + " " + c, c, "one", prose(rng, 4000, 50000), c + "\n" + c, "Über straße naïve " * 30]
    return docs_of(spark, texts), texts


def test_substring_dedup_is_brute_force(spark, corpus):
    df, texts = corpus
    out = {r["doc_id"]: r for r in substring_dedup.repeated_words(df.withColumnRenamed("source", "grp")).collect()}
    seen = set()
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        assert (out[i]["kept_text"], out[i]["n_words"], out[i]["n_removed"]) == (kept, len(words), sum(gone))
        assert sum(s["end"] - s["start"] for s in out[i]["spans"]) == sum(gone)


def test_substring_dedup_null_ids_repeats_and_empty(spark):
    t = prose(random.Random(1), 40)
    out = substring_dedup.repeated_words(docs_of(spark, [t, t, t, t], [None, 1, 1, None])).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in out) == {(None, 0): 2, (1, 0): 1, (1, 40): 1}
    assert substring_dedup.repeated_words(docs_of(spark, [])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_is_edit_distance():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        b = list(a) if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcd"))
        limit, d = rng.randrange(8), distance(a, b)
        assert near_dup.banded_distance(a, b, limit) == (d if d <= limit else None)


def test_near_dup_classes(spark, corpus):
    df, texts = corpus
    out = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(df).collect()}
    assert out[0] == out[4] == out[5] == 0
    assert out[2] == 2 and out[3] == 3 and out[1] == 1
    assert all(out[i] == i for i in (6, 7, 8, 9, 10, 11))
    kept = near_dup.without_near_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(12)) - {4, 5}


def test_near_dup_group_of_copies_and_odd_rows(spark):
    rng = random.Random(3)
    base = prose(rng, 80, 5000).split()
    texts = []
    for k in range(60):
        w = list(base)
        w[k] = f"edit{k}"
        texts.append(" ".join(w))
    out = near_dup.near_duplicate_classes(docs_of(spark, [*texts, texts[0], None, "x"], [*range(60), None, 61, 61])).collect()
    assert {r["class_id"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60} == {0}
    assert [r["class_id"] for r in out if r["doc_id"] is None] == [None]
    assert {r["class_id"] for r in out if r["doc_id"] == 61} == {61}
    assert near_dup.near_duplicate_classes(docs_of(spark, [])).count() == 0


def test_licenses(spark):
    texts = ["Released under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", None, "", "Apache License, Version 2 and Apache License Version 2", "mit dem Hund"]
    out = [tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in licenses.license_scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert out[0] == (6, 1, 1, 1, "mit", "mit", 1.0)
    assert out[1] == (7, 1, 2, 2, "cc-by-nc", "cc-by-nc", 1.0)
    assert out[2][4:] == ("", "gpl-3", 1.0)
    assert out[3] == out[4] == (0, 0, None, None, "", "", 0.0)
    assert out[5][:6] == (9, 2, 0, 5, "apache-2", "apache-2")
    assert out[6][4:] == ("", "", 0.0)
    assert licenses.license_scan(docs_of(spark, [])).count() == 0


def test_license_filters_lose_nothing():
    rng = random.Random(4)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.split()})
    index = licenses.Templates(licenses.TEMPLATES, 0.9, {w: rng.randrange(100) for w in vocabulary})
    for _ in range(3000):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(25))] + rng.choice(list(licenses.TEMPLATES)).split()[rng.randrange(3) :]
        met = {(k, at): c for k, at, c in index.meets([w.encode() for w in words])}
        for k, t in enumerate(licenses.TEMPLATES):
            own = set(t.split())
            for at, w in enumerate(words):
                share = len(own & set(words[at : at + len(t.split()) + licenses.SLACK])) / len(own)
                assert met.get((k, at)) == (share if share >= 0.9 and w in own else None)


def test_license_notices_run_over_lines(spark):
    wrapped = ["/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0"]
    rows = licenses.license_scan(docs_of(spark, [*wrapped, "x " * 200_000 + wrapped[0], wrapped[0]], [0, 1, 2, 3, None]).withColumn("labels", F.lit("old")).withColumn("id", F.lit(1))).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["labels"]) for r in rows) == [(-1, "mit"), (0, "mit"), (1, "bsd"), (2, "mpl-2"), (3, "mit")]


def test_minimum_cut_is_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randint(1, 7)
        s, t = [rng.randrange(10) for _ in range(n)], [rng.randrange(10) for _ in range(n)]
        edges = [(a, b, rng.randrange(6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(t[i] if x else s[i] for i, x in enumerate(side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023

        assert cost(html_extract.minimum_cut(s, t, edges)) == min(map(cost, product([False, True], repeat=n)))


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies here</div>
<article><h1>T&eacute;st &amp; more</h1><p><b>First   <i>paragraph</i> of the article.<br><p>Second one,\n of the text.</p><div class="ad">Buy this</div><ul><li>point</li></ul><div id="comments"><p>Great, I liked it a lot, thanks!</p></div></article>
<aside><p>Side story that is long enough to look like text.</p></aside><form><p>Sign here</p></form><footer>Contact</footer></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain words"), (5, "<p>unclosed <b>bold"), (6, PAGE)], "page_id long, html string")
    out = {r["page_id"]: r["text"] for r in html_extract.extract_text(df.selectExpr("*", "html as text")).collect()}
    assert out[1] == out[6] == "Tést & more\nFirst paragraph of the article.\nSecond one, of the text.\npoint"
    assert out[2] == out[3] == "" and out[5] == "unclosed bold"
    assert html_extract.extract_text(df.limit(0)).count() == 0


def alone(page):
    """What each block would be called without its neighbours."""
    blocks, around = html_extract.blocks_of(page)
    marks = html_extract.marked(blocks, around)
    article = any(b.good == 2 and m < html_extract.MARKED for b, m in zip(blocks, marks, strict=True))
    return [b.text for b, m in zip(blocks, marks, strict=True) if (c := html_extract.costs(b, m, article))[0] > c[1]]


LONG = "<p>A paragraph of some length that tells a part of the story and holds no link at all.</p>"


def test_html_neighbours_decide():
    links = '<p><a href="/1">One source of this</a>, <a href="/2">another source</a></p>'
    page = f"<html><body><div>{LONG}{links}{LONG}</div></body></html>"
    assert "One source of this, another source" not in alone(page) and "One source of this, another source" in html_extract.main_blocks(page)
    item = '<li><a href="/x">Some entry</a></li>'
    page = f"<html><body><ul>{item * 3}<li>New in the list, without a link so far</li>{item * 3}</ul><div>{LONG * 3}</div></body></html>"
    assert "New in the list, without a link so far" in alone(page) and len(html_extract.main_blocks(page)) == 3 and html_extract.main_blocks(page)[0].startswith("A paragraph")


def test_html_frames_heads_and_odd_elements():
    own = "A paragraph of some length that tells a part of the story and holds no link at all."
    assert html_extract.main_blocks(f'<div class="layout-with-sidebar"><div id="content">{LONG * 4}</div><div class="sidebar"><p>Read this too</p></div></div>') == [own] * 4
    assert html_extract.main_blocks(f'<article><header class="entry-header"><h1 class="post-header">Headline</h1></header>{LONG}<p>where <math><mi>x</mi></math> is known <noscript>here</noscript></p><p class="ad">Buy this</p></article>') == ["Headline", own, "where x is known here"]
    deep = "<div>" * 3000 + own + "</div>" * 3000
    assert html_extract.main_blocks(deep) == [own] and html_extract.main_blocks("<p>" + "word " * 300_000) == [" ".join(["word"] * 300_000)]


ARTICLE = "<p>The article itself is one paragraph that says what there is to say, and no more than that, honestly.</p>"
CROWD = "".join(f"<p>Reader {i} says something rather long here, longer than the article, and again, and again, and again, so it is text.</p>" for i in range(10))


@pytest.mark.parametrize("page", [
    f'<div class="content">{ARTICLE}</div><div class="comments">{CROWD}</div>', f'<div>{ARTICLE}</div><div class="comments">{CROWD}</div>', f'<article>{ARTICLE}<div class="comments">{CROWD}</div></article>', f"<main>{ARTICLE}<aside>{CROWD}</aside></main>",
    f'<div class="content">{ARTICLE}</div><div class="sidebar">{CROWD}</div>', f"<article>{ARTICLE}</article><div class='comments'>{CROWD}</div>", f'<article>{ARTICLE}</article><section id="comments">' + f'<article class="comment">{CROWD}</article>' * 3 + "</section>",
    f'<div class="with-sidebar"><div id="content">{ARTICLE}</div><div class="sidebar">{CROWD}</div></div>',
])
def test_html_long_sidebars_and_comments_go(page):
    assert html_extract.main_blocks(f"<html><body>{page}</body></html>") == [ARTICLE[3:-4]]


def test_html_a_frame_keeps_its_content():
    for page in (f'<form><nav><a href="/">Home</a></nav>{ARTICLE * 3}</form>', f'<div class="left-sidebar-page">{ARTICLE * 3}</div>', f'<div class="page-with-comments"><main>{ARTICLE * 3}</main></div>'):
        assert html_extract.main_blocks(page) == [ARTICLE[3:-4]] * 3


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<nav>x", '<a "', "<!", "<p>x", "<li><p>", "<b>x<hr>", "<!--", "<script>", "<p><button><div>", "<table><p>", "</div>", "<x y='"])
def test_html_hostile_pages_are_read_in_linear_time(piece):
    """A megabyte of it; what is quadratic takes minutes."""
    began = time.process_time()
    html_extract.main_blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


def test_water_filling(spark):
    rng = random.Random(6)
    leaves = [(f"d{d}", f"l{x}", f"s{s}", rng.randrange(1, 4000)) for d in range(3) for x in range(3) for s in range(4)] + [(None, None, None, 50)]
    weights = {"d0": 3.0, "d1": 0.5}
    out = mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 0.7, 2, weights, {"l0": 2.0}).collect()

    def fill(budget, nodes):
        given, nodes = {}, dict(nodes)
        while nodes:
            total = sum(w for w, _ in nodes.values())
            full = [k for k, (w, c) in nodes.items() if budget * w >= c * total]
            if not full:
                return given | {k: int(budget * w // total) for k, (w, _) in nodes.items()}
            for k in full:
                given[k] = nodes[k][1]
            budget -= sum(nodes[k][1] for k in full)
            nodes = {k: v for k, v in nodes.items() if k not in full}
        return given

    cap = lambda f: 2 * sum(x[3] for x in leaves if f(x))
    domains = fill(int(sum(x[3] for x in leaves) * 0.7), {d: (weights.get(d, 1.0), cap(lambda x, d=d: x[0] == d)) for d in {x[0] for x in leaves}})
    for d, budget in domains.items():
        langs = fill(budget, {y: (2.0 if y == "l0" else 1.0, cap(lambda x, d=d, y=y: x[:2] == (d, y))) for y in {x[1] for x in leaves if x[0] == d}})
        for y, inner in langs.items():
            given = fill(inner, {x[2]: (1.0, 2 * x[3]) for x in leaves if x[:2] == (d, y)})
            for s, g in given.items():
                (got,) = [r["given"] for r in out if (r["domain"], r["lang"], r["source"]) == (d, y, s)]
                assert abs(got - g) <= 8


def by_hand(rows, given, max_epochs, seed=17):
    """The uses of ``rows`` (id, text, lang, source) of one leaf with so many tokens given: (id, text, epoch)."""
    size = lambda t: len((t or "").split())
    out = [(i, t, 0) for i, t, *_ in rows if not size(t)]
    rows = [r for r in rows if size(r[1])]
    whole, rest = divmod(given, sum(size(r[1]) for r in rows)) if rows else (0, 0)
    out += [(i, t, e) for e in range(whole) for i, t, *_ in rows]
    if whole < max_epochs:
        order = {}
        for r in rows:
            told = hashlib.md5((r[1] or "").encode()).hexdigest()
            order.setdefault(hashlib.md5(f"{seed}|{whole}|{'null' if r[0] is None else r[0]}|{told}".encode()).hexdigest(), []).append(r)
        for _, alike in sorted(order.items()):
            rest -= sum(size(r[1]) for r in alike)
            if rest < 0:
                break
            out += [(r[0], r[1], whole) for r in alike]
    return out


def test_mixture_takes_prefixes_of_epochs(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"]), 0) for i in range(400)] + [(None, "x y", "en", "a", 0), (3, None, None, None, 0), (5, "", "en", "a", 0)]
    rows += [(7, "same id and text", "en", "a", 0)] * 5 + [(7, "same id", "en", "a", 0), (None, "x y z", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOC)
    for max_epochs, share in ((2, 0.9), (2, 2.0), (1, 0.4), (1, 1.0), (3, 2.5)):
        options = {"budget_share": share, "max_epochs": max_epochs, "lang_weights": {"de": 3.0}}
        used = mixing.mixture(df, **options).collect()
        assert sorted(map(str, used)) == sorted(map(str, mixing.mixture(df.repartition(7), **options).collect()))
        leaves = df.select(mixing.source_domain(F.col("source")).alias("domain"), "lang", "source", mixing.word_tokens(F.col("text")).alias("n")).groupBy("domain", "lang", "source").agg(F.sum("n").alias("tokens"))
        expected = Counter()
        for leaf in mixing.leaf_budgets(leaves, share, max_epochs, None, {"de": 3.0}).collect():
            mine = [r for r in rows if (r[2], r[3]) == (leaf["lang"], leaf["source"])]
            uses = by_hand(mine, leaf["given"], max_epochs)
            assert sum(len((t or "").split()) for _, t, _ in uses) <= leaf["given"] and all(e < max_epochs for *_, e in uses)
            expected.update((i, len((t or "").split()), leaf["lang"], leaf["source"], e) for i, t, e in uses)
        assert Counter((r["doc_id"], r["n_tokens"], r["lang"], r["source"], r["epoch"]) for r in used) == expected
        kept = mixing.mixed(df, **options)
        assert kept.columns == df.columns
        assert Counter((r["doc_id"], len((r["text"] or "").split()), r["lang"], r["source"]) for r in kept.collect()) == Counter({k: n for k, n in Counter(x[:4] for x in expected.elements()).items()})
    assert mixing.mixture(df.limit(0)).count() == 0


def test_mixture_uses_texts_without_words_once(spark):
    rows = [(i, None if i % 2 else " ", "en", "a", 0) for i in range(57)] + [(100 + i, "one two three", "en", "a", 0) for i in range(3)]
    for max_epochs, share, n in ((1, 1.0, 60), (2, 2.0, 63), (1, 0.0, 57)):
        df = spark.createDataFrame(rows, DOC)
        assert mixing.mixture(df, budget_share=share, max_epochs=max_epochs).count() == n
        assert mixing.mixed(df, budget_share=share, max_epochs=max_epochs).count() == n


def test_toxicity(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrt')}{rng.choice('aeiou')}" for _ in range(60)]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words[rng.randrange(60)] = "zurk" + rng.choice(["en", "a", "ou", "eri", "il"])
        texts.append(" ".join(words) + ".")
        labels.append((i, int(bad)))
    docs = docs_of(spark, [*texts, None, "", "x" * 50000])
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    assert "zurk" in model.stems
    out = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    held = [(out[i] >= 0.7, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.95
    assert out[600] == out[601] < 0.7
    kept = toxicity.without_toxic(docs.withColumnRenamed("n_chars", "score"), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"] and kept.count() < docs.count()
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).stems == toxicity.Model().stems


def test_toxicity_grammar_reads_clauses():
    scorer = toxicity._Scorer(toxicity.Model())
    names = toxicity.CATEGORIES
    read = lambda t: dict(zip(names, scorer.read(t)[0] > 0, strict=False))
    assert read("he is an idiot.")["plain"] and read("you are an idiot.")["addressed"]
    assert read("he is not an idiot.") == dict.fromkeys(names, False) | {"negated": True}
    assert read("she said idiot.")["reported"] and read("i will kill you.")["threat"]
    assert not any(read("a cat sat. on a mat").values()) and scorer.read("fine. you idiot! fine")[1] == ["you idiot"]
    # a quotation ends; a threat needs someone it is against
    assert read('the "idiot" was here.') == dict.fromkeys(names, False) | {"reported": True} and read('a "fool" met an idiot.')["plain"]
    assert not any(read("they say: i will kill you.").values()) and not read("to kill time.")["threat"]
    score = lambda t: scorer.score(scorer.read(t)[0])
    assert score("i will kill you.") > 2 * score("to kill time.") and score("you are an idiot.") > 3 * score("he is not an idiot.") and score("you idiot.") > 3 * score('she said "you idiot".')


def test_quality(spark):
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(8))
    texts = [good, None, "", "a b c " * 40, good + "\n" + good, "\n".join(" | ".join(f"n{i}{k}" for k in range(9)) for i in range(9)), " ".join(f"w{i}###" for i in range(80)), "short text"]
    rows = quality.line_first(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        w = (t or "").split()
        windows = Counter(zip(w, w[1:], w[2:]))
        cover = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert [r["kept"] for r in rows] == [True, False, False, False, False, False, False, False]
    assert quality.line_first(docs_of(spark, [])).count() == 0


def test_decontam_is_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, n, 20000)) for k, n in enumerate([9, 15, 30, 59, 200])] + [(7, None), (None, "x"), (8, "too short here"), (9, "")]
    long = prose(rng, 6000, 20000)
    words = items[3][1].split()
    words[20] = "CHANGED"
    texts = [long, long[:20000] + " " + items[2][1] + " " + long[20000:], items[1][1].upper(), " ".join(words), items[4][1] + " " + items[0][1], None, "", " ".join(items[3][1].split()[:30])]
    out = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontam.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        has = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for k, x in items:
            v = (x or "").lower().split()
            own = {tuple(v[j : j + 5]) for j in range(len(v) - 4)}
            if k is not None and own and len(own & has) >= 0.8 * len(own):
                expected[i, k] = len(own & has)
    assert out == expected and len(out) == 5
    small = decontam.BLOCK_BYTES
    try:
        decontam.BLOCK_BYTES = 400
        again = decontam.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
        assert {(r["doc_id"], r["item_id"]) for r in again.collect()} == set(expected)
    finally:
        decontam.BLOCK_BYTES = small
    assert decontam.contaminated(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_sharding(spark):
    texts = [f"text {i}" for i in range(500)] + [None, "é"]
    df = docs_of(spark, texts, [*range(500), None, 7]).withColumnRenamed("n_chars", "slot")
    rows = sharding.assign_shards(df).collect()
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        assert r["grown_shard"] in (r["shard"], 8)
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        draw = lambda s, key=key: int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16)
        assert r["shard"] == max(range(8), key=draw) and r["grown_shard"] == max(range(9), key=draw)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    heavy = Counter(r["shard"] for r in sharding.assign_shards(df, [1.0, 3.0]).collect())
    assert 2 < heavy[1] / heavy[0] < 4.5
    assert sharding.assign_shards(df.limit(0)).count() == 0


TOOLS = {"w": {"properties": {"city": {"type": "string", "minLength": 1}, "n": {"type": "integer"}}, "required": ["city"], "additionalProperties": False}}


def test_chat(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} | ({"needs": d} if d else {}) for i, n, a, d in calls]})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "w", {"n": 1, "city": "Rom"}, None), ("b", "w", {"city": 3}, ["a"]), ("c", "w", {"city": "x"}, ["c"]), ("d", "q", {}, None), ("e", "w", {"city": "y", "z": 1}, ["b"]))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": 'say "ä"\n'})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": ""})), (1, 4, "assistant", call(("a", "w", {"city": "other"}, None))),
        (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": "other conversation"})), (None, None, None, None), (None, 1, "assistant", call(("a", "w", {"city": "q"}, None))), (1, 0, "user", "hi"),
    ]
    out = chat.linked(chat.parsed_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), TOOLS).collect()
    of = {(r["conv_id"], r["turn"], r["call_id"]): r for r in out}
    assert of[1, 1, "a"]["json"] == '{"arguments":{"city":"Rom","n":1},"id":"a","name":"w","type":"tool_call"}' and of[1, 1, "a"]["error"] is None and of[1, 1, "a"]["linked"]
    assert of[1, 1, "b"]["error"] == "city is no string" and of[1, 1, "d"]["error"] == "unknown tool" and of[1, 1, "e"]["error"] == "an argument is not in the schema"
    assert [of[1, 1, x]["step"] for x in "abcde"] == [0, 2, None, 0, 4]
    assert of[1, 2, "a"]["step"] == 1 and of[1, 2, "a"]["linked"] and json.loads(of[1, 2, "a"]["json"]) == {"content": 'say "ä"\n', "role": "tool", "tool_call_id": "a"}
    assert of[1, 3, "zz"]["error"] == "result without call" and of[2, 0, "a"]["error"] == "result without call"
    assert of[1, 4, "a"]["error"] == "identifier repeats" and not of[1, 4, "a"]["linked"]
    assert of[None, 1, "a"]["linked"] is False and len(out) == 13
    assert chat.linked(chat.exchanges_as_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), TOOLS).count() == 0
