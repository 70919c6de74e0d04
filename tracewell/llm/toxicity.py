"""Toxicity by a weighted finite-state pattern grammar.

Five machines read a clause word by word. The lexicon maps a word to a class: insult, threat, target, negation,
report or other. One machine each then remembers whether a negation is near, whether speech is being reported,
whether someone is addressed, and whether a threat is open; composed, they are one automaton over word classes
that emits a category for each insult or threat: a plain insult (neither negated nor reported), one addressed to
someone, a negated one, a reported one, a threat against someone. What is emitted in a document's clauses, insults by
the log odds of their stems, and how far plain insults exceed what the text's length makes likely by chance, is
weighed to a score between 0 and 1. Nothing else is: an insult that the grammar calls negated or reported counts as that
alone, and a threatening word without a target counts nothing.

The grammar's context words are fixed. The insults' stems (word beginnings, as languages inflect and compound)
and all weights are learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tracewell.llm._common import slices

# Context words of the grammar, in four languages.
THREATS = "kill hurt destroy beat crush shoot stab burn töten umbringen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself they them their he him she her du dich dir dein euch ihr ihn sie tu te toi ton vous votre ils eux lui tú ti usted ustedes ellos ella".split()
NEGATIONS = "not never no isn't aren't don't won't nicht kein keine nie niemals pas jamais aucun non nunca jamás ningún".split()
REPORTS = "said says say told wrote called quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
#: Insults known without labels.
SEEDS = ("idiot", "stupid", "moron", "scum", "worthless", "pathetic", "loser", "trash", "disgusting")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
CONTEXT = {**dict.fromkeys(THREATS, THREAT), **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT)}
#: Words for which a negation reaches on.
REACH = 3
CATEGORIES = ("plain", "negated", "reported", "addressed", "threat")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"«»„“”]")
_STOP = re.compile(r"[.!?;\n]")
_PREFIX = range(3, 10)


def _negation(state: int, c: int) -> int:
    return REACH if c == NEGATION else max(0, state - 1)


def _flag(kind: int):
    return lambda state, c: 1 if c == kind else state


def _speech(state: int, c: int) -> int:
    """0: the writer's own words; 1: reported up to the clause's end; 2: between quotation marks."""
    return 1 if c == REPORT else {0: 2, 1: 1, 2: 0}[state] if c == QUOTE else state


def compose() -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """The product of the context machines: (state, word class) to (next state, categories emitted)."""
    machines = (_negation, _speech, _flag(TARGET), _flag(THREAT))
    states = list(product(range(REACH + 1), range(3), range(2), range(2)))
    number = {s: i for i, s in enumerate(states)}
    arcs = {}
    for s, c in product(states, range(7)):
        n = tuple(m(x, c) for m, x in zip(machines, s, strict=True))
        emitted = []
        if c == INSULT:
            kind = "negated" if s[0] else "reported" if s[1] else "plain"
            emitted = [CATEGORIES.index(kind), *([CATEGORIES.index("addressed")] if s[2] and kind == "plain" else [])]
        if n[2] and n[3] and not (s[2] and s[3]) and not s[0] and not s[1]:
            emitted.append(CATEGORIES.index("threat"))
        arcs[number[s], c] = number[n], tuple(emitted)
    return arcs


#: Weights of the categories and of the excess before anything is learned; what never occurs in training keeps its own.
PRIOR = (1.0, 0.05, 0.05, 0.4, 2.5, 0.6)


@dataclass
class Model:
    """What is learned: stems with their log odds and chance rates a word, and the weights of the features."""

    stems: dict[str, tuple[float, float]] = field(default_factory=lambda: {s: (4.0, 1e-6) for s in SEEDS})
    weights: list[float] = field(default_factory=lambda: list(PRIOR))
    bias: float = -4.0


class _Scorer:
    """Runs the grammar over texts; made once in each worker."""

    def __init__(self, model: Model):
        self.model, self.arcs = model, compose()
        self.find = ahocorasick.Automaton()
        for s in model.stems:
            self.find.add_word(s, s)
        self.threats = ahocorasick.Automaton()
        for s in (*model.stems, *THREATS):
            self.threats.add_word(s, s)
        self.threats.make_automaton()
        self.chance = sum(rate for _, rate in model.stems.values())

    def stem(self, word: str) -> str | None:
        """The longest stem that ``word`` begins with."""
        for k in range(min(len(word), _PREFIX.stop), 0, -1):
            if word[:k] in self.model.stems:
                return word[:k]
        return None

    def read(self, text: str) -> tuple[np.ndarray, list[str]]:
        """Features of a text and the clauses that emitted something."""
        text = text.lower()
        emitted, plain, clauses, done = [0.0] * len(CATEGORIES), 0, [], -1
        for end, s in self.threats.iter(text):
            at = end - len(s) + 1
            if at <= done or (at and text[at - 1].isalpha()):
                continue
            lo = max(text.rfind(x, 0, at) for x in ".!?;\n") + 1
            stop = _STOP.search(text, end)
            done = hi = stop.start() if stop else len(text)
            state, matched = 0, False
            for m in _WORD.finditer(text, lo, hi):
                w = m[0]
                c, odds = CONTEXT.get(w, QUOTE if w[0] in "\"«»„“”" else OTHER), 4.0
                if c == OTHER and (known := self.stem(w)):
                    c, odds = INSULT, self.model.stems[known][0]
                state, out = self.arcs[state, c]
                for k in out:
                    emitted[k] += odds
                    plain += k == 0
                    matched = True
            if matched:
                clauses.append(text[lo:hi].strip())
        words = text.count(" ") + text.count("\n") + 1
        over = math.log((plain + 0.3) / (words * self.chance + 0.3))
        return np.array([*(math.log1p(x) for x in emitted), over]), clauses

    def score(self, features: np.ndarray) -> float:
        z = float(features @ np.array(self.model.weights)) + self.model.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _words(text: str) -> Counter:
    return Counter(re.findall(r"[^\W\d_]+", text.lower()))


def _prefixes(text: str) -> Counter:
    """Beginnings of a text's words with the number of their occurrences, 5 at most: a text that repeats one word shows little."""
    out: Counter = Counter()
    for w, n in _words(text).items():
        for k in _PREFIX:
            if len(w) >= k:
                out[w[:k]] += n
    return Counter({p: min(n, 5) for p, n in out.items()})


def _signature(text: str) -> int:
    words = text.split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def training_rows(labels: DataFrame, rows_each: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most ``rows_each`` toxic and clean labelled ids that may train, and how many there are of each."""
    mine = labels.where("toxic is not null").where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    mine = mine.where(F.crc32(F.col("__id").cast("string").cast("binary")) % 3 != 1)
    counts = {r["__toxic"]: r["count"] for r in mine.groupBy("__toxic").count().collect()}
    part = lambda x: mine.where(F.col("__toxic") == x).orderBy(F.xxhash64("__id"), "__id").limit(rows_each)
    return part(1).union(part(0)), counts


def fit(docs: DataFrame, labels: DataFrame, rows_each: int = 8000, max_stems: int = 200, candidates: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn stems and weights from ``labels`` (id, toxic) of ``docs``.

    Trains on at most ``rows_each`` toxic and as many clean documents, those with the least hashes of their ids, out of
    rows whose crc32(id) mod 3 is not 1; so what reaches the driver is bounded whatever the corpus. Of texts with
    the same least hash of five words, which near copies have, one counts. At most ``max_stems`` stems are chosen out of the
    ``candidates`` beginnings of words most frequent in toxic texts. Without toxic and clean rows the
    grammar's own seeds and weights hold. Null labels, ids and texts train nothing.
    """
    sample, counts = training_rows(labels, rows_each, id_col)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).where("__text is not null")
    texts = texts.join(F.broadcast(sample), "__id").select("__toxic", "__text")
    # Bounded: a word's share in 2 * rows_each documents, and so many beginnings.

    def toxic_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, _signature(t), t) for x, t in zip(batch.column("__toxic").to_pylist(), batch.column("__text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{"toxic": x, "sig": s - 2**63, "text_hash": xxhash.xxh3_64_intdigest(t) - 2**63, "words": sum(_words(t).values()), "prefixes": list((p := _prefixes(t) if x else {}).keys()), "times": list(p.values())} for x, s, t in rows], schema=pa.schema([("toxic", pa.int32()), ("sig", pa.int64()), ("text_hash", pa.int64()), ("words", pa.int64()), ("prefixes", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))]))

    seen = texts.mapInArrow(toxic_side, "toxic int, sig long, text_hash long, words long, prefixes array<string>, times array<int>").persist()
    kept, size = {}, {0: 0, 1: 0}
    for r in seen.groupBy("toxic", "sig").agg(F.min(F.struct("text_hash", "words")).alias("m")).collect():
        kept[r["m"]["text_hash"]] = r["toxic"]
        size[r["toxic"]] += r["m"]["words"]
    rows = Counter(kept.values())
    if not rows[0] or not rows[1]:
        seen.unpersist()
        return Model()
    one = seen.where("toxic = 1").groupBy("sig").agg(F.min_by(F.struct("prefixes", "times"), "text_hash").alias("m")).select("sig", F.explode(F.arrays_zip("m.prefixes", "m.times")).alias("p"))
    least = max(4, rows[1] // 200)
    often = one.groupBy("p.prefixes").agg(F.sum("p.times").alias("n"), F.count("*").alias("docs")).where(F.col("docs") >= least).orderBy(F.desc("n"), "prefixes").limit(candidates).collect()
    seen.unpersist()
    toxic = {r["prefixes"]: r["n"] for r in often}

    def clean_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x, t in zip(batch.column("__toxic").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                if not x and xxhash.xxh3_64_intdigest(t) - 2**63 in kept:
                    total.update({p: n for p, n in _prefixes(t).items() if p in toxic})
        yield pa.RecordBatch.from_pydict({"p": list(total), "n": list(total.values())}, schema=pa.schema([("p", pa.string()), ("n", pa.int64())]))

    clean = {r["p"]: r["n"] for r in texts.mapInArrow(clean_side, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()}
    model = Model(stems=choose_stems(toxic, clean, size, max_stems))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            rows = [(x, scorer.read(t)[0].tolist()) for x, t in zip(batch.column("__toxic").to_pylist(), batch.column("__text").to_pylist(), strict=True) if xxhash.xxh3_64_intdigest(t) - 2**63 in kept]
            yield pa.RecordBatch.from_pydict({"y": [r[0] for r in rows], "f": [r[1] for r in rows]}, schema=pa.schema([("y", pa.int32()), ("f", pa.list_(pa.float64()))]))

    data = sorted((tuple(r["f"]), r["y"]) for r in texts.mapInArrow(features, "y int, f array<double>").collect())
    x, y = np.array([d[0] for d in data]), np.array([d[1] for d in data], dtype=float)
    model.weights, model.bias = _logistic(x, y)
    model.bias += math.log(max(counts.get(1, 1), 1) / max(counts.get(0, 1), 1)) - math.log(y.sum() / (len(y) - y.sum()))
    return model


def choose_stems(toxic: dict[str, int], clean: dict[str, int], words: dict[int, int], most: int) -> dict[str, tuple[float, float]]:
    """Beginnings of words far more frequent in toxic than in clean texts, the most telling first.

    A stem that is taken takes its occurrences from its own beginnings and takes its continuations along. Of equally
    telling ones the longest is taken, as it meets the fewest other words.
    """
    toxic = dict(toxic)
    out: dict[str, tuple[float, float]] = {}
    clean = {p: clean.get(p, 0) for p in toxic}

    def told(p: str) -> float:
        due = (clean[p] + 0.5) * words[1] / max(words[0], 1)
        return (toxic[p] - due) / math.sqrt(due + 1)

    while toxic and len(out) < most:
        best = max(toxic, key=lambda p: (round(told(p), 6), len(p), p))
        ratio = (toxic[best] + 0.5) / max(words[1], 1) / ((clean[best] + 0.5) / max(words[0], 1))
        if told(best) < 6 or toxic[best] < 6:
            break
        t, c = toxic[best], clean[best]
        if ratio >= 4:
            out[best] = math.log(ratio), (c + 0.5) / max(words[0], 1)
            for k in range(1, len(best)):
                if (p := best[:k]) in toxic:
                    toxic[p] -= t
                    clean[p] = max(0, clean[p] - c)
            for p in [p for p in toxic if p.startswith(best)]:
                del toxic[p]
        else:
            del toxic[best]
    return out or Model().stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression by Newton's method; weights are drawn towards those of the grammar, the bias is not."""
    a = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([*PRIOR, 0.0])
    w = prior.copy()
    shrink = np.diag([ridge] * x.shape[1] + [1e-3])
    loss = lambda w: np.logaddexp(0, np.where(y > 0.5, -1, 1) * (a @ w)).sum() + (w - prior) @ shrink @ (w - prior) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + shrink, a.T @ (y - p) - shrink @ (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``clauses`` (lower-cased clauses that matched).

    Null and empty texts match nothing and get the score of a text without matches. Columns named score or clauses are
    replaced; all others stay.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("score", "clauses") and c != text_col))
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for part in slices(batch, text_col):
                read = [scorer.read(t or "") for t in part.column(text_col).to_pylist()]
                more = [pa.array([scorer.score(f) for f, _ in read], type=pa.float64()), pa.array([c for _, c in read], type=pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, "score", "clauses"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("clauses", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(scored, schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score below ``threshold``; columns stay as they are."""
    columns = docs.columns
    kept = score_documents(docs.withColumnRenamed("score", "__score").withColumnRenamed("clauses", "__clauses"), model, text_col).where(F.col("score") < threshold).drop("score", "clauses")
    return kept.withColumnRenamed("__score", "score").withColumnRenamed("__clauses", "clauses").select(*columns)
