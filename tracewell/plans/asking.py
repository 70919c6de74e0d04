"""Asking a judge: each distinct request once, from tasks, out of a store of answers where it has them.

Requests and answers are tables. What the store lacks is found by an anti join, sent from a few tasks with a few requests
in flight each, and appended to the store as JSON lines, so that a later run sends nothing twice. No request or answer
passes through the driver.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.operators.tables import stored

Transport = Callable[[str], dict]


class TransportError(ConnectionError):
    """A request that failed; ``retryable`` if it may pass later, after ``retry_after`` seconds where the judge said so."""

    def __init__(self, message: str, retryable: bool, retry_after: float | None = None):
        super().__init__(message)
        self.retryable, self.retry_after = retryable, retry_after

    def __reduce__(self):
        return TransportError, (str(self), self.retryable, self.retry_after)


@dataclass(frozen=True)
class HttpTransport:
    """Posts a request to ``endpoint``. Busy or failing servers and lost connections may pass; other refusals don't."""

    endpoint: str
    key: str = field(repr=False, default="")
    timeout: float = 120.0

    def __call__(self, body: str) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.endpoint, body.encode(), headers), timeout=self.timeout) as response:
                text = response.read()
        except urllib.error.HTTPError as error:
            hint = {401: "; check the key", 403: "; check the key", 422: ": " + error.read(1200).decode("utf-8", "replace")[:300]}.get(error.code, "")
            after = error.headers.get("Retry-After", "")
            raise TransportError(f"the judge returned HTTP {error.code}{hint}", error.code == 429 or error.code >= 500, float(after) if re.fullmatch(r"\d+(\.\d+)?", after) and float(after) > 0 else None) from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            raise TransportError(f"the judge can't be reached or timed out ({type(error).__name__})", True) from None
        try:
            out = json.loads(text)
        except ValueError:
            raise TransportError("the judge returned a response that is not JSON", False) from None
        return out


def send(transport: Transport, body: str, retries: int, pause: float) -> tuple[dict | None, int, str | None]:
    """A response, or why there is none, and the attempts it took; waits double, or are what the judge asked for."""
    for attempt in range(1, retries + 2):
        try:
            response = transport(body)
            if not isinstance(response, dict) or not isinstance(response.get("answers"), dict):
                raise TransportError("the response has no answers", False)
            return response, attempt, None
        except (ConnectionError, TimeoutError) as error:
            if not getattr(error, "retryable", True) or attempt > retries:
                return None, attempt, str(error)
            after = getattr(error, "retry_after", None)
            time.sleep(min(30.0, pause * 2 ** (attempt - 1)) if after is None else after)
    raise AssertionError("unreachable")


@dataclass
class Model:
    """The release that an alias stands for, asked of the judge once a run and only when it is needed."""

    transport: Transport
    requested: str = "judge-latest"
    alias: str = "judge-latest"
    release: str = r"judge-\d+\.\d+\.\d+"
    resolved: str | None = None

    def __str__(self) -> str:
        if self.requested != self.alias and not re.fullmatch(self.release, self.requested):
            raise ValueError(f"the model must be {self.alias} or one release, not {self.requested!r}")
        if self.requested != self.alias:
            return self.requested
        if self.resolved is None:
            question = {"C1": {"type": "noul", "instructions": "Does this request only ask which release answers?"}}
            response, _, error = send(self.transport, json.dumps({"model": self.alias, "state": {"task": "Say which release answers."}, "questions": question}, separators=(",", ":")), 5, 1.0)
            if error is not None:
                raise TransportError(error, False)
            told = response.get("model")
            if not isinstance(told, str) or not re.fullmatch(self.release, told):
                raise ValueError(f"the judge did not say which release {self.alias} is; name one")
            self.resolved = told
        return self.resolved


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Unanswered(RuntimeError):
    """Some requests failed; those that were answered are in the store."""


@dataclass
class Asker:
    """Answers for tables of requests.

    ``store``, ``log``: folders of JSON lines, of answers and of distinct requests; torn lines are skipped. At most
    ``tasks`` * ``in_flight`` requests are under way at a time.
    """

    transport: Transport
    store: str | None = None
    log: str | None = None
    tasks: int = 4
    in_flight: int = 2
    retries: int = 5
    pause: float = 1.0

    def stored_answers(self, spark: SparkSession) -> DataFrame:
        """sha256, response; of several answers to a request the first in byte order."""
        kind = "sha256 string, response string"
        if self.store is None or not _exists(spark, self.store):
            return spark.createDataFrame([], kind)
        lines = spark.read.schema(kind).option("mode", "DROPMALFORMED").json(self.store)
        lines = lines.where(F.col("sha256").isNotNull() & F.try_variant_get(F.try_parse_json("response"), "$.answers", "variant").isNotNull())
        return lines.groupBy("sha256").agg(F.min("response").alias("response"))

    def ask(self, requests: DataFrame) -> DataFrame:
        """sha256, response, cached, attempts, ms, bytes of each distinct text in ``requests.request``.

        Raises Unanswered if any is left without an answer. Null requests are left out.
        """
        spark = requests.sparkSession
        wanted = stored(requests.where("request is not null").select(F.sha2("request", 256).alias("sha256"), "request").dropDuplicates(["sha256"]))
        if self.log is not None:
            wanted.write.mode("append").json(self.log)
        known = stored(self.stored_answers(spark).join(wanted.select("sha256"), "sha256", "left_semi"))
        transport, in_flight, retries, pause = self.transport, self.in_flight, self.retries, self.pause
        schema = "sha256 string, response string, attempts int, ms double, bytes long, error string"

        def one(digest: str, body: str) -> dict:
            began = time.monotonic()
            response, attempts, error = send(transport, body, retries, pause)
            text = None if response is None else json.dumps(response, ensure_ascii=False, separators=(",", ":"))
            return {"sha256": digest, "response": text, "attempts": attempts, "ms": (time.monotonic() - began) * 1000, "bytes": len(body.encode()), "error": error}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("sha256", pa.string()), ("response", pa.string()), ("attempts", pa.int32()), ("ms", pa.float64()), ("bytes", pa.int64()), ("error", pa.string())])
            with ThreadPoolExecutor(in_flight) as pool:
                for batch in batches:
                    rows = list(pool.map(one, batch.column("sha256").to_pylist(), batch.column("request").to_pylist()))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

        missing = wanted.join(known.select("sha256"), "sha256", "left_anti")
        sent = stored(missing.repartition(self.tasks).mapInArrow(work, schema))
        answered = sent.where("response is not null")
        if self.store is not None and not answered.isEmpty():
            answered.select("sha256", "response").write.mode("append").json(self.store)
        failed = sent.where("response is null").agg(F.count("*").alias("n"), F.min("error").alias("first")).first()
        if failed["n"]:
            raise Unanswered(f"{failed['n']} requests without an answer: {failed['first']}")
        hits = known.join(wanted, "sha256").select("sha256", "response", F.lit(True).alias("cached"), F.lit(0).alias("attempts"), F.lit(0.0).alias("ms"), F.octet_length("request").cast("long").alias("bytes"))
        return hits.unionByName(answered.select("sha256", "response", F.lit(False).alias("cached"), "attempts", "ms", "bytes"))
