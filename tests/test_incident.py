"""The golden incident end to end, and the same incident in other renderings."""

from __future__ import annotations

import json

import pytest

import golden
from tracewell.plans import incident
from tracewell.plans.investigate import Options
from tracewell.plans.judge import AnswerCache, Client, Judge, UnusableAnswer, read_answer
from tracewell.plans.report import unfolded
from tracewell.sources.readers import Input


def names(rows):
    return {f"{r['name']}:{r['pid'] or ''}" for r in rows.collect()}


def offline(seen):
    """A judge that answers by phrases and keeps what it is asked."""
    from tracewell.plans.judge import SCORES

    def answer(body):
        import re

        request = json.loads(body)
        seen.append(body)
        out = {}
        for label, c in request["state"]["candidates"].items():
            best = 0.1
            for x in c["links"]:
                best = max(best, next((s for p, s in SCORES if re.search(p, x["what"])), 0), (0.85 if c.get("seen_with", {}).get("hosts", 0) <= 3 else 0.2) if "contacted" in x["what"] else 0)
            out[label] = {"noul": best}
        return {"answers": out}

    return answer


@pytest.fixture(scope="module")
def golden_run(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "a.ndjson"
    path.write_text(golden.as_ndjson())
    loaded = incident.load(spark, [str(path)])
    seed, note = incident.find_seed(loaded, "name:invoice.exe")
    seen = []
    report, found = incident.analyze(loaded, seed, Options(context="a test", scorer=Judge(Client(offline(seen), AnswerCache(spark)))), context=True)
    return loaded, seed, note, report, found, sorted(seen)


def test_golden_incident(golden_run):
    loaded, seed, note, report, found, seen = golden_run
    assert note == "2 starts of invoice.exe; using the earliest" and seed.startswith("g:ws-01:")
    assert names(report.incident) == golden.MEMBERS and names(report.rejected) == golden.REJECTED
    asked = {c["name"] for s in seen for c in json.loads(s)["state"]["candidates"].values()}
    assert asked == {"203.0.113.9", "cmd.exe", "evil.example", "explorer.exe", "rundll32.exe", "stage2.exe", "upd.exe", "whoami.exe"}
    (sihost,) = [r for r in report.incident.collect() if r["name"] == "sihost.exe"]
    assert sihost["basis"] == "injection" and sihost["via"][0]["link"] == "injected"
    assert loaded.nodes.where("type = 'process'").count() == 13 and report.counters["links_by_type"]["persisted_and_ran"] == 1
    opened = [r for r in report.timeline.collect() if r["target_after"]]
    assert len(opened) == 1 and opened[0]["target"] == "explorer.exe (1000)" and opened[0]["target_after"][0].startswith("started chrome.exe")
    assert report.timeline.where("kind = 'process_start' and process = 'stage2.exe'").count() == 1
    assert unfolded(report.incident).count() == 8
    assert report.context.count() > 10


def test_seeds(golden_run):
    loaded, seed, *_ = golden_run
    assert incident.find_seed(loaded, "ip:203.0.113.9")[0] == "ip:203.0.113.9"
    assert incident.find_seed(loaded, "guid:" + golden.guid("invoice"))[0] == seed
    for selector, error in (("name:none.exe", "no process start named"), ("ip:1.1.1.1", "no ip"), ("nothing", "no event with ID"), ("guid:x", "no process with GUID")):
        with pytest.raises(incident.SeedError, match=error):
            incident.find_seed(loaded, selector)
    assert incident.search_seeds(incident.seed_listing(loaded), "STAGE2").count() == 1
    assert incident.load_summary(loaded)["processes"] == 13


@pytest.mark.parametrize("rendering", ["csv", "text"])
def test_other_renderings_ask_the_same(spark, tmp_path, golden_run, rendering):
    path = tmp_path / f"a.{rendering}"
    path.write_bytes({"csv": golden.as_csv, "text": golden.as_text}[rendering]().encode())
    loaded = incident.load(spark, [Input(str(path))])
    seen = []
    report, _ = incident.analyze(loaded, incident.find_seed(loaded, "name:invoice.exe")[0], Options(context="a test", scorer=Judge(Client(offline(seen), AnswerCache(spark)))))
    assert names(report.incident) == golden.MEMBERS
    assert sorted(seen) == golden_run[-1]


def test_duplicate_inputs_count_once(spark, tmp_path):
    for name, text in (("a.csv", golden.as_csv()), ("b.txt", golden.as_text())):
        (tmp_path / name).write_text(text, newline="")
    loaded = incident.load(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.txt")])
    assert loaded.duplicates == len(golden.EVENTS) == loaded.events.count()


def test_logs_without_processes(spark, tmp_path):
    rows = [
        {"@timestamp": golden.stamp(0), "host": {"name": "web-01", "ip": ["10.0.2.30"]}, "event": {"category": ["web"]}, "source": {"ip": "198.51.100.66"}, "url": {"full": "/login"}, "http": {"request": {"method": "POST"}, "response": {"status_code": 200}}},
        {"@timestamp": golden.stamp(60), "host": {"name": "srv-01"}, "event": {"category": ["authentication"], "outcome": "failure"}, "source": {"ip": "198.51.100.66"}, "user": {"name": "admin"}},
        {"@timestamp": golden.stamp(90), "host": {"name": "srv-01"}, "event": {"category": ["authentication"], "outcome": "success"}, "source": {"ip": "198.51.100.66"}, "user": {"name": "svc_backup"}},
        {"@timestamp": golden.stamp(200), "host": {"name": "db-01"}, "event": {"category": ["authentication"], "outcome": "success"}, "source": {"ip": "10.0.2.30"}, "user": {"name": "svc_backup"}},
        {"@timestamp": golden.stamp(-5000), "host": {"name": "ws-09"}, "event": {"category": ["authentication"], "outcome": "success"}, "source": {"ip": "10.0.9.9"}, "user": {"name": "bob"}},
    ]
    path = tmp_path / "net.ndjson"
    path.write_text(golden.as_ndjson(rows))
    loaded = incident.load(spark, [str(path)])
    report, _ = incident.analyze(loaded, "ip:198.51.100.66")
    # Only the attacker's address tried admin, so the threshold for what nobody else touched holds.
    assert names(report.incident) == {"198.51.100.66:", "web-01:", "srv-01:", "svc_backup:", "db-01:", "admin:"}
    assert report.rejected.count() == 0
    assert loaded.links.where("type = 'logon_from' and `from` = 'host:web-01' and `to` = 'host:db-01'").count() == 1


def test_answers_are_checked_cached_and_retried(spark, tmp_path):
    for bad in ({}, {"answers": {"C1": {"noul": "x"}}}, {"answers": {"C1": {"noul": 1.5}}}, {"answers": {"C1": {"noul": float("nan")}}}, {"answers": {"C1": {"noul": True}}}):
        with pytest.raises(UnusableAnswer):
            read_answer(bad, "C1")
    calls = []

    def flaky(body):
        calls.append(body)
        if len(calls) < 3:
            raise ConnectionError("busy")
        return {"answers": {"C1": {"noul": 0.5}}}

    cache = AnswerCache(spark, str(tmp_path / "answers"))
    client = Client(flaky, cache, pause=0.0)
    assert client.ask(["q"]) == client.ask(["q"]) and len(calls) == 3
    cache.save()
    again = Client(lambda body: pytest.fail("asked again"), AnswerCache(spark, str(tmp_path / "answers")))
    assert again.ask(["q"])[0]["answers"]["C1"]["noul"] == 0.5 and again.calls[0]["cached"]
    client.save_requests(spark, str(tmp_path / "requests"))
    assert spark.read.json(str(tmp_path / "requests")).count() == 1
