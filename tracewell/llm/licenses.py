"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, wherever lines end, of a template's length and SLACK more, that begins with one of
the template's tokens. Tokens are ordered by their frequency over all texts, rarest first. A block meets a template if it
holds at least the threshold's share of the template's tokens; it must then hold one of the template's few rarest tokens
(prefix filter), have enough tokens (length filter), and leave enough after a match's position (positional filter).
What passes is counted exactly, so no block that meets a template is lost. As a set of tokens knows no order, the name and
version of the license must then stand in the block as in the template, word by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Phrases and the labels that they stand for.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices of public licenses and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the eclipse public license version 2 0": "epl-2",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl-3",
    "this work is licensed under the gnu affero general public license version 3": "agpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "this work is licensed under the gnu lesser general public license version 2 1": "lgpl-2.1",
    "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2",
    "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3",
    "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2.1",
    "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache-2",
    "spdx license identifier mpl 2 0": "mpl-2",
    "spdx license identifier epl 2 0": "epl-2",
    "spdx license identifier gpl 3 0": "gpl-3",
    "spdx license identifier gpl 2 0": "gpl-2",
    "spdx license identifier lgpl 3 0": "lgpl-3",
    "spdx license identifier lgpl 2 1": "lgpl-2.1",
    "spdx license identifier agpl 3 0": "agpl-3",
    "spdx license identifier bsd 2 clause": "bsd",
    "spdx license identifier bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "this work is dedicated to the public domain under cc0 1 0": "cc0",
}
# Names and versions that must stand word by word in a block of a template that holds them.
IN_PLACE = (
    "mit license", "apache license version 2", "eclipse public license version 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0", "gnu general public license", "gnu lesser general public license",
    "gnu affero general public license", "license version 3", "license version 2", "license version 2 1", "either version 3 of", "either version 2 of", "either version 2 1 of", "cc by 4 0", "cc by sa 4 0", "cc by nd 4 0", "cc by nc 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "cc0",
    "spdx license identifier mit", "identifier apache 2 0", "identifier mpl 2 0", "identifier epl 2 0", "identifier gpl 3 0", "identifier gpl 2 0", "identifier lgpl 3 0", "identifier lgpl 2 1", "identifier agpl 3 0", "identifier bsd 2 clause", "identifier bsd 3 clause",
)
#: Words that a block has more than its template.
SLACK = 2
#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def in_place(template: str) -> list[str]:
    """Those of IN_PLACE that ``template`` holds word by word."""
    return [p for p in IN_PLACE if f" {p} " in f" {template} "]


class Templates:
    """Templates with tokens in a global order, and the index of their prefixes."""

    def __init__(self, templates: Mapping[str, str], threshold: float, frequency: Mapping[str, int]):
        self.threshold = threshold
        rank = {w: i for i, w in enumerate(sorted({w for t in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w)))}
        self.rank = {w.encode(): r for w, r in rank.items()}
        self.items = [(tuple(sorted({rank[w] for w in t.split()})), label) for t, label in templates.items()]
        self.sets = [frozenset(tokens) for tokens, _ in self.items]
        self.need = [math.ceil(threshold * len(tokens) - 1e-9) for tokens, _ in self.items]
        self.width = [len(t.split()) + SLACK for t in templates]
        self.phrases = [[b" " + p.encode() + b" " for p in in_place(t)] for t in templates]
        self.prefix: dict[bytes, list[int]] = {}
        names = {r: w for w, r in self.rank.items()}
        for k, (tokens, _) in enumerate(self.items):
            for token in tokens[: len(tokens) - self.need[k] + 1]:
                self.prefix.setdefault(names[token], []).append(k)

    def held(self, k: int, block: list[int]) -> float | None:
        """The share of template ``k``'s tokens in ``block``, the ranks of its words (-1: no token), if it is enough."""
        tokens, need = self.items[k][0], self.need[k]
        have = set(block)
        have.discard(-1)
        if len(have) < need:
            return None
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            if token in have:
                if place + need > len(tokens) or sum(x >= token for x in have) < need:
                    return None
                n = len(self.sets[k] & have)
                return n / len(tokens) if n >= need else None
        return None

    def meets(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Each template and place where a block of ``words`` begins that meets it, with its containment."""
        ranks = [self.rank.get(w, -1) for w in words]
        done = [0] * len(self.items)
        found = []
        for i, w in enumerate(words):
            for k in self.prefix.get(w, ()):
                width, own = self.width[k], self.sets[k]
                for start in range(max(done[k], i - width + 1), i + 1):
                    if ranks[start] in own:
                        share = self.held(k, ranks[start : start + width])
                        if share is not None:
                            found.append((start, k, share))
                done[k] = i + 1
        return [(k, start, c) for start, k, c in sorted(found)]

    def named(self, words: list[bytes], met: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The matches whose block holds the template's names and versions word by word."""
        blocks = ((m, b" " + b" ".join(words[m[1] : m[1] + self.width[m[0]]]) + b" ") for m in met)
        return [m for m, block in blocks if all(p in block for p in self.phrases[m[0]])]

    def best(self, met: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Matches with names and versions in place; of others none whose block overlaps one that holds more of its template,
        or as much of a template that has all its tokens and more.

        Each pair of templates is compared at once over all their places: the highest of a range of places is read from maxima
        of doubling ranges.
        """
        of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {k for k, _, _ in met}:
            mine = sorted((s, c) for o, s, c in met if o == k)
            of[k] = np.array([s for s, _ in mine]), np.array([c for _, c in mine])
        kept = []
        for k, (starts, share) in of.items():
            beaten = np.zeros(len(starts), dtype=bool)
            for o, (theirs, shares) in of.items() if not self.phrases[k] else ():
                low, high = np.searchsorted(theirs, starts - self.width[o], "right"), np.searchsorted(theirs, starts + self.width[k], "left")
                top = _highest(shares, low, high)
                beaten |= (top > share) | ((top == share) & (self.sets[k] < self.sets[o]))
            kept += [(k, s, c) for s, c, gone in zip(starts.tolist(), share.tolist(), beaten.tolist(), strict=True) if not gone]
        return sorted(kept)


def _highest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest of values[low:high] for each pair of bounds; -1 for an empty range."""
    levels, size = [values], 1
    while 2 * size <= len(values):
        levels.append(np.maximum(levels[-1][:-size], levels[-1][size:]))
        size *= 2
    out = np.full(len(low), -1.0)
    depth = np.where(high > low, np.frexp(np.maximum(high - low, 1))[1] - 1, -1)
    for d in np.unique(depth[depth >= 0]):
        at = depth == d
        out[at] = np.maximum(levels[d][low[at]], levels[d][high[at] - (1 << d)])
    return out


def _words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def token_frequencies(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """In how many texts each token of the templates stands; as many entries as templates have tokens."""
    vocabulary = {w.encode() for t in templates for w in t.split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                total.update(vocabulary.intersection(_words(t or b"")))
        yield pa.RecordBatch.from_pydict({"token": [w.decode() for w in total], "n": list(total.values())}, schema=pa.schema([("token", pa.string()), ("n", pa.int64())]))

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, threshold: float = 0.9, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in each text: one row per input row.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Returns the id, ``n_words``;
    ``n_base``, ``first_word``, ``last_word``: number, smallest and largest start of the places where a phrase's words stand
    consecutively; ``base_labels``; ``labels``: with those of the templates that blocks meet (of overlapping
    matches without a name those with the highest containment); ``score``: the highest containment, 1 if a phrase stands there;
    ``matches``: every template and block that meet, names and versions in place, as (word where it begins, label, containment), words from 0.

    Null text: no words, labels "", score 0. Repeated rows are scanned each. Other columns are ignored.
    """
    index = Templates(templates, threshold, token_frequencies(docs, templates, text_col))
    sought = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
    match = pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(match))])

    def scan(text: bytes) -> dict:
        words = _words(text)
        places, base = [], set()
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in sought:
            at = joined.find(phrase)
            while at >= 0:
                places.append(joined.count(b" ", 0, at))
                base.add(label)
                at = joined.find(phrase, at + 1)
        met = index.named(words, index.meets(words))
        own = {index.items[k][1] for k, _, _ in index.best(met)}
        score = max((c for _, _, c in met), default=0.0)
        matches = [{"word": start, "label": index.items[k][1], "containment": c} for k, start, c in met]
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | own)), "score": 1.0 if base else score, "matches": matches}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t or b"") | {"id": i} for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<word:long,label:string,containment:double>>")
    return out.withColumnRenamed("id", id_col)
