"""Who decides whether a candidate belongs to an incident: an offline rule, or a judge asked by request.

A scorer takes the round's groups (one row a question: group, key, summary, activity, links, ...) and returns group,
probability, request. The offline rule is an expression over the links' phrases. A judge is any callable from a
request's text to its answers; requests are answered from a cache by their SHA-256 where it has them.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Answers = dict[str, dict]
Transport = Callable[[str], dict]
# The offline rule's scores, the first phrase that matches counts.
SCORES = (
    ("injected code", 0.95), ("wrote the file this process was started from", 0.9), ("registered persistence", 0.9), ("started this process", 0.9), ("wrote a DLL", 0.85),
    ("logged on to this candidate|logged on using this account|received a logon from|an account this candidate logged on as|a host this account logged on to", 0.85),
    ("sent web requests to this candidate", 0.8), ("received web requests from this candidate", 0.3), ("failed to log on", 0.6), ("injection-capable access", 0.5), ("named pipe", 0.4),
)
FLOOR, RARE, COMMON = 0.1, 0.85, 0.2


class Scorer(Protocol):
    def __call__(self, groups: DataFrame, state: dict) -> DataFrame: ...


class UnusableAnswer(RuntimeError):
    """a judge's answer that is no probability; no decision is assumed."""


def phrase_score(what: Column, hosts: Column, processes: Column) -> Column:
    """The score of one link's phrase; contact counts much only with what few hosts and processes touch."""
    out = F.lit(0.0)
    for pattern, score in reversed(SCORES):
        out = F.when(what.rlike(pattern), score).otherwise(out)
    rare = (F.coalesce(hosts, F.lit(0)) <= 3) & (F.coalesce(processes, F.lit(0)) <= 5)
    return F.greatest(out, F.when(what.contains("contacted"), F.when(rare, RARE).otherwise(COMMON)).otherwise(0.0))


def stand_in(groups: DataFrame, state: dict) -> DataFrame:
    """The highest score among a candidate's links, FLOOR at least; no request is made."""
    seen = F.try_parse_json("summary")
    hosts, processes = (F.try_variant_get(seen, f"$.seen_with.{k}", "long") for k in ("hosts", "processes"))
    scores = F.transform("links", lambda x: phrase_score(x["what"], hosts, processes))
    return groups.select("group", F.greatest(F.lit(FLOOR), F.array_max(scores)).alias("probability"), F.sha2(F.concat_ws("\n", "summary", "activity", F.to_json("links")), 256).alias("request"))


def question(label: str) -> dict:
    return {"type": "noul", "instructions": f"Does candidate {label} belong to the seed's incident, so that the attacker's activity goes on through it?", "criteria": {"true": "The links and activity show the attacker's activity going on through it", "false": "Independent, benign or common activity, or too little to tell"}}


def request_body(model: str, context: str, seed: dict, incident: dict, candidates: dict) -> str:
    """The canonical text of a request; the order of its parts is fixed."""
    return json.dumps({"model": model, "state": {"analyst_context": context, "seed": seed, "incident": incident, "candidates": candidates}, "questions": {k: question(k) for k in candidates}}, ensure_ascii=False, separators=(",", ":"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass
class AnswerCache:
    """Answers by their request's SHA-256, as JSON lines in a folder that Spark reads and writes; torn lines are skipped."""

    spark: SparkSession
    path: str | None = None
    known: dict[str, dict] = field(default_factory=dict)
    fresh: dict[str, dict] = field(default_factory=dict)

    def load(self, digests: Iterable[str]) -> None:
        """Fetch what the stored answers hold of ``digests``, which are no more than a round's questions."""
        digests = [d for d in digests if d not in self.known]
        if not self.path or not digests or not _exists(self.spark, self.path):
            return
        rows = self.spark.read.schema("sha256 string, response string").option("mode", "DROPMALFORMED").json(self.path)
        for r in rows.where(F.col("sha256").isin(digests) & F.col("response").isNotNull()).dropDuplicates(["sha256"]).collect():
            self.known[r["sha256"]] = json.loads(r["response"])

    def save(self) -> None:
        if self.path and self.fresh:
            rows = [(k, json.dumps(v, separators=(",", ":"))) for k, v in self.fresh.items()]
            self.spark.createDataFrame(rows, "sha256 string, response string").write.mode("append").json(self.path)
        self.fresh = {}


@dataclass
class Client:
    """Asks a transport, from the cache first, some requests at a time, again after failures that may pass."""

    transport: Transport
    cache: AnswerCache
    concurrency: int = 8
    retries: int = 5
    pause: float = 1.0
    calls: list[dict] = field(default_factory=list)
    log: dict[str, str] = field(default_factory=dict)

    def ask(self, bodies: list[str]) -> list[dict]:
        digests = [hashlib.sha256(b.encode()).hexdigest() for b in bodies]
        self.cache.load(digests)
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(self._one, bodies, digests))

    def _one(self, body: str, digest: str) -> dict:
        self.log.setdefault(digest, body)
        began = time.monotonic()
        cached = digest in self.cache.known
        if not cached:
            for attempt in range(self.retries + 1):
                try:
                    self.cache.known[digest] = self.cache.fresh[digest] = self.transport(body)
                    break
                except (ConnectionError, TimeoutError) as error:
                    if attempt == self.retries:
                        self.calls.append({"request": digest, "cached": False, "error": str(error), "ms": (time.monotonic() - began) * 1000})
                        raise
                    time.sleep(min(30.0, getattr(error, "retry_after", None) or self.pause * 2**attempt))
        self.calls.append({"request": digest, "cached": cached, "error": None, "ms": (time.monotonic() - began) * 1000})
        return self.cache.known[digest]

    def save_requests(self, spark: SparkSession, path: str) -> None:
        """Each distinct request once."""
        spark.createDataFrame(sorted(self.log.items()), "sha256 string, request string").write.mode("append").json(path)


def read_answer(response: dict, label: str) -> float:
    p = response.get("answers", {}).get(label, {}).get("noul")
    if isinstance(p, bool) or not isinstance(p, int | float) or not math.isfinite(p) or not 0 <= p <= 1:
        raise UnusableAnswer(f"no usable answer for {label}; no decision was assumed")
    return float(p)


@dataclass
class Judge:
    """A scorer that asks a client; ``batch`` candidates a request (D4). Questions are at most a round's cap, so they fit the driver."""

    client: Client
    model: str = "judge"
    batch: int = 1

    def __call__(self, groups: DataFrame, state: dict) -> DataFrame:
        rows = [r.asDict(recursive=True) for r in groups.orderBy("place").collect()]
        bodies, labels = [], []
        for at in range(0, len(rows), self.batch):
            part = rows[at : at + self.batch]
            sources = {x["source"] for r in part for x in r["links"]}
            named = {state["seed"]["key"]: "seed"}
            involved = [m for m in state["members"] if m["key"] != state["seed"]["key"] and m["key"] in sources]
            named |= {m["key"]: f"I{i + 1}" for i, m in enumerate(involved)}
            candidates = {}
            for i, r in enumerate(part):
                links = [{"from": named[x["source"]]} | {k: x[k] for k in ("what", "at", "times", "last", "detail") if x[k] is not None} for x in r["links"]]
                repeats = {k: r[k] for k in ("occurrences", "first_started", "last_started") if r["occurrences"] > 1 and r[k] is not None}
                candidates[f"C{i + 1}"] = json.loads(r["summary"]) | repeats | {"links": links, "activity": json.loads(r["activity"])}
            bodies.append(request_body(self.model, state["context"], state["seed"]["told"], {named[m["key"]]: m["told"] for m in involved}, candidates))
            labels.append([(r["group"], f"C{i + 1}") for i, r in enumerate(part)])
        answers = self.client.ask(bodies)
        out = [(g, read_answer(a, c), hashlib.sha256(b.encode()).hexdigest()) for b, a, ls in zip(bodies, answers, labels, strict=True) for g, c in ls]
        return groups.sparkSession.createDataFrame(out, "group string, probability double, request string")
