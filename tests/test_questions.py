"""Schemas learned from a judge: requests within their bounds, answers folded alike however they were split."""

from __future__ import annotations

import hashlib
import json
import os
import sys

import pytest
from pyspark import cloudpickle

from tracewell.plans import asking, questions
from tracewell.plans.learn import KINDS, MENUS, Group, read_mapping

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
GROUP = "grp string, type_name string, type_value string, count long, sources array<int>, example map<string,string>, fields array<struct<label:string,name:string,samples:array<string>,looks:array<string>>>, fingerprint string, kind string, confidence double"


def group(name, fields, kind="process_start", type_name="Event"):
    listed = [(f"F{i + 1}", n, s, looks) for i, (n, (s, looks)) in enumerate(sorted(fields.items()))]
    return (name, type_name, "x", 9, [0], {n: (s[0] if s else "")[:160] for n, (s, _) in fields.items()}, listed, f"fp-{name}", kind, 0.9)


def wide(n, name=12, sample=20):
    return {f"{'n' * name}{i:04}": ([f"{i}" + "s" * sample, "b" * sample], ["text"]) for i in range(n)}


#: Few fields, more than a request may ask about, so long that one example or only some fields can be described, one name too long.
CASES = {"few": wide(3), "sixty": wide(60), "more": wide(61), "five hundred": wide(500), "long": wide(500, 250, 100), "longer": wide(900, 400, 100), "huge name": {"x" * 300_000: (["1"], ["text"]), "b": (["2"], ["text"])}, "none": {}}


@pytest.mark.parametrize("case", sorted(CASES))
def test_every_field_is_asked_once_within_bounds(spark, case):
    fields = CASES[case]
    df = spark.createDataFrame([group("g", fields), group("other", wide(2), "other")], GROUP)
    rows = questions.role_requests(df, "judge-1").orderBy("part").collect()
    asked = [a["name"] for r in rows for a in r["asked"]]
    assert asked == sorted(fields) and {r["grp"] for r in rows} <= {"g"}
    for r in rows:
        assert len(r["request"].encode()) <= questions.MAX_BYTES and r["sha256"] == hashlib.sha256(r["request"].encode()).hexdigest()
        body = json.loads(r["request"])
        assert list(body) == ["model", "state", "questions"] and 1 <= len(body["questions"]) <= questions.MAX_QUESTIONS
        assert list(body["questions"]) == [a["label"] for a in r["asked"]]
        assert all(q["criteria"] == questions.ROLE_CRITERIA["process_start"] for q in body["questions"].values())
        assert set(body["questions"]) <= set(body["state"]["fields"])
    if case == "few":
        assert json.loads(rows[0]["request"])["state"]["example_event"] and len(rows) == 1
    kinds = questions.kind_requests(df, "judge-1").collect()
    for r in kinds:
        assert len(r["request"].encode()) <= questions.MAX_BYTES
        body = json.loads(r["request"])
        assert list(body["questions"]) == ["kind"] and set(body["questions"]["kind"]["criteria"]) == set(KINDS)
        assert r["grp"] != "g" or not fields or body["state"]["fields"]


def answers_of(spark, requests, choose, extra=()):
    rows = []
    for r in requests.collect():
        told = {a["label"]: x for a in r["asked"] if (x := choose(a["name"])) is not None}
        rows.append((r["sha256"], json.dumps({"answers": told})))
    return spark.createDataFrame([*rows, *extra], "sha256 string, response string")


def choice(role, p=None, confidence=None):
    out = {"type": "choice", "choice": role}
    return out | ({"probabilities": {role: p}} if p is not None else {}) | ({"confidence": confidence} if confidence is not None else {})


ROLES = sorted(MENUS["process_start"])


def chosen(name):
    """Every kind of answer: usable ones, unsure ones, none, roles that the kind doesn't have."""
    i = int(name[-4:])
    return [choice(ROLES[i % len(ROLES)], 0.5 + i % 45 / 100), choice("other", 0.9), choice("destination_ip", 0.9), choice(ROLES[i % 7], 0.3), None, choice("new_process_pid", confidence=0.8), choice("time")][i % 7]


@pytest.mark.parametrize(("n", "bound"), [(500, 60), (500, 7), (61, 1)])
def test_mapping_is_the_same_however_questions_are_split(spark, monkeypatch, n, bound):
    fields = wide(n)
    fields |= {k: (["123456789012"], looks) for i, (k, (_, looks)) in enumerate(sorted(fields.items())) if i % 7 == 5}
    df = spark.createDataFrame([group("g", fields)], GROUP)
    monkeypatch.setattr(questions, "MAX_QUESTIONS", bound)
    requests = questions.role_requests(df, "m")
    assert requests.count() == -(-n // bound)
    (row,) = questions.read_mappings(df, requests, answers_of(spark, requests, chosen)).collect()
    told = {k: (a["choice"], a.get("probabilities", {}).get(a["choice"], a.get("confidence", 1.0))) for k in fields if (a := chosen(k))}
    expected = read_mapping(Group("g", ("Event", "x"), 9, [0], {k: {"count": 9, "samples": s, "looks_like": looks} for k, (s, looks) in fields.items()}), "process_start", told)
    assert row["roles"] == expected.roles and row["kind"] == "process_start"
    assert {w for w in row["warnings"] if "also looked" not in w} == {w for w in expected.warnings if "also looked" not in w}
    usable = {k for k, (role, _) in told.items() if role in MENUS["process_start"]}
    assert set(row["confidence"]) == usable | {"kind"} and all(row["confidence"][k] == pytest.approx(told[k][1]) for k in usable)
    held = {k for k in usable if told[k][0] != "other" and told[k][1] >= 0.5}
    assert {w.split(" also looked")[0] for w in row["warnings"] if "also looked" in w} == held - set(row["roles"])


def test_missing_repeated_and_broken_answers(spark):
    df = spark.createDataFrame([group("g", wide(3)), group("lone", {"a": (["1"], ["text"])})], GROUP)
    requests = questions.role_requests(df, "m")
    digest = {r["grp"]: r["sha256"] for r in requests.collect()}
    time_first, no_json = json.dumps({"answers": {"F1": choice("time", 0.9)}}), "{torn"
    answers = spark.createDataFrame([(digest["g"], time_first), (digest["g"], time_first), (digest["g"], json.dumps({"answers": {"F1": choice("user", 0.9), "F9": choice("host")}})), (digest["lone"], no_json)], "sha256 string, response string")
    out = {r["grp"]: r for r in questions.read_mappings(df, requests, answers).collect()}
    first = min(time_first, json.dumps({"answers": {"F1": choice("user", 0.9), "F9": choice("host")}}))
    assert list(out["g"]["roles"].values()) == [json.loads(first)["answers"]["F1"]["choice"]]
    assert sum("in several ways" in w for w in out["g"]["warnings"]) == 3 and sum("no usable answer" in w for w in out["g"]["warnings"]) == 2
    assert out["lone"]["roles"] == {} and out["lone"]["warnings"] == ["no usable answer for a", "no time field: these events have no time"]
    none = questions.read_mappings(df.where("grp = 'none'"), requests, answers)
    assert none.collect() == []


def test_kinds(spark):
    requests = spark.createDataFrame([(g, g) for g in "abcd"], "grp string, sha256 string")
    told = {"a": {"kind": choice("network", 0.7)}, "b": {"kind": choice("nonsense", 0.9)}, "c": {}}
    answers = spark.createDataFrame([(k, json.dumps({"answers": v})) for k, v in told.items()], "sha256 string, response string")
    assert {tuple(r) for r in questions.read_kinds(requests, answers).collect()} == {("a", "network", 0.7), ("b", "other", 0.0), ("c", "other", 0.0), ("d", "other", 0.0)}


class Counting:
    """A transport that writes down each call in a file, so that calls from tasks count."""

    def __init__(self, path, fails=0, error=None):
        self.path, self.fails, self.error = str(path), fails, error

    def __call__(self, body):
        with open(self.path, "a") as f:
            f.write(hashlib.sha256(body.encode()).hexdigest() + "\n")
        with open(self.path) as f:
            tries = f.read().count(hashlib.sha256(body.encode()).hexdigest())
        if tries <= self.fails:
            raise self.error
        asked = json.loads(body)["questions"] if body.startswith("{") else {}
        return {"model": "judge-1.2.3", "answers": {k: choice("logon" if k == "kind" else "time", 0.9) for k in asked}}

    def calls(self):
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return f.read().split()


def test_each_request_is_sent_once_and_stored(spark, tmp_path):
    transport = Counting(tmp_path / "calls", 2, asking.TransportError("busy", True, 0.0))
    asker = asking.Asker(transport, str(tmp_path / "store"), str(tmp_path / "log"), pause=0.0)
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "request string")
    first = asker.ask(df).collect()
    assert {(r["cached"], r["attempts"], r["bytes"]) for r in first} == {(False, 3, 1)} and len(transport.calls()) == 6
    with open(tmp_path / "store" / "torn.json", "w") as f:
        f.write('{"sha256":"' + hashlib.sha256(b"c").hexdigest() + '","respo')
    again = asker.ask(spark.createDataFrame([("a",), ("b",), ("c",)], "request string")).collect()
    assert {r["sha256"]: r["cached"] for r in again} == {hashlib.sha256(x).hexdigest(): x != b"c" for x in (b"a", b"b", b"c")}
    assert len(transport.calls()) == 9
    logged = {r["request"] for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert logged == {"a", "b", "c"}


def test_refusals_are_not_sent_again_and_good_answers_stay(spark, tmp_path):
    class Picky(Counting):
        def __call__(self, body):
            if body == "bad":
                with open(self.path, "a") as f:
                    f.write("refused\n")
                raise asking.TransportError("the judge returned HTTP 422: no", False)
            return super().__call__(body)

    transport = Picky(tmp_path / "calls")
    asker = asking.Asker(transport, str(tmp_path / "store"), pause=0.0)
    with pytest.raises(asking.Unanswered, match="1 requests without an answer: the judge returned HTTP 422: no"):
        asker.ask(spark.createDataFrame([("good",), ("bad",)], "request string"))
    assert transport.calls().count("refused") == 1
    assert [r["cached"] for r in asker.ask(spark.createDataFrame([("good",)], "request string")).collect()] == [True]
    assert asker.ask(spark.createDataFrame([], "request string")).collect() == []


def test_model_is_resolved_once(tmp_path):
    transport = Counting(tmp_path / "calls")
    model = asking.Model(transport)
    assert str(model) == str(model) == "judge-1.2.3" and len(transport.calls()) == 1
    assert str(asking.Model(transport, "judge-2.0.0")) == "judge-2.0.0" and len(transport.calls()) == 1
    with pytest.raises(ValueError, match="one release"):
        str(asking.Model(transport, "gpt"))
    with pytest.raises(ValueError, match="did not say"):
        str(asking.Model(lambda body: {"answers": {}}))


def test_http_transport(tmp_path):
    import http.server
    import threading

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            code, text = {"busy": (429, ""), "down": (503, ""), "key": (401, ""), "odd": (200, "no json")}.get(body, (200, json.dumps({"answers": {"got": self.headers["Authorization"]}})))
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    transport = asking.HttpTransport(f"http://127.0.0.1:{server.server_port}/", "k")
    assert transport("fine") == {"answers": {"got": "Bearer k"}} and "k'" not in repr(transport)
    told = {}
    for body in ("busy", "down", "key", "odd"):
        with pytest.raises(asking.TransportError) as error:
            transport(body)
        told[body] = (error.value.retryable, error.value.retry_after)
    server.shutdown()
    assert told == {"busy": (True, 7.0), "down": (True, None), "key": (False, None), "odd": (False, None)}
    with pytest.raises(asking.TransportError) as error:
        asking.HttpTransport("http://127.0.0.1:1/")("x")
    assert error.value.retryable


def test_learning_from_records(spark, tmp_path):
    """Two types; one is known from an earlier run and not asked about again."""
    lines = [{"EventType": "SignIn", "When": f"2026-01-0{i + 1}T00:00:00Z", "Who": "kim"} for i in range(5)] + [{"EventType": "Thing", "a": 1, "b": {"c": i}} for i in range(3)]
    kind = "file int, line long, id string, line_id boolean, nested string, flat array<struct<key:string,value:string>>, names map<string,string>"
    records = spark.createDataFrame([(0, i, None, False, json.dumps(x), None, None) for i, x in enumerate(lines)], kind)
    transport = Counting(tmp_path / "calls")
    learner = questions.JudgedLearner(asking.Asker(transport, str(tmp_path / "store"), pause=0.0), asking.Model(transport))
    out = {r["grp"]: r for r in learner.mappings(records).collect()}
    assert set(out) == {"EventType=SignIn", "EventType=Thing"} and {r["learned"] for r in out.values()} == {"asked"}
    assert out["EventType=SignIn"]["kind"] == "logon" and list(out["EventType=SignIn"]["roles"].values()) == ["time"] and out["EventType=SignIn"]["count"] == 5
    assert len(transport.calls()) == 5
    questions.keep_mappings(learner.mappings(records), str(tmp_path / "known"))
    assert len(transport.calls()) == 5
    later = questions.JudgedLearner(asking.Asker(transport), "judge-1.2.3", questions.read_known(spark, str(tmp_path / "known")))
    again = {r["grp"]: r for r in later.mappings(records).collect()}
    assert {r["learned"] for r in again.values()} == {"known"} and len(transport.calls()) == 5
    assert {k: (r["kind"], r["roles"], r["count"]) for k, r in again.items()} == {k: (r["kind"], r["roles"], r["count"]) for k, r in out.items()}


def test_fingerprints_are_those_of_the_offline_learner(spark):
    from tracewell.plans.learn import flattened, profiles

    lines = [{"action": "über \"x\"", "f": i, "ü\\n": 1} for i in range(3)] + [{"only": i} for i in range(4)] + [{"only": 1, "rare": 2}]
    kind = "file int, line long, id string, line_id boolean, nested string, flat array<struct<key:string,value:string>>, names map<string,string>"
    records = spark.createDataFrame([(0, i, None, False, json.dumps(x), None, None) for i, x in enumerate(lines)], kind)
    mine = {r["grp"]: r["fingerprint"] for r in questions.groups_of(flattened(records)).select("grp", "fingerprint").collect()}
    assert mine == {g.key: g.fingerprint() for g in profiles(records)}
