"""Profiles of unknown records: one pass over the records, samples by brute force."""

from __future__ import annotations

import random

from tracewell.plans import learn, questions

KIND = "file int, line long, grp string, type_name string, type_value string, fields map<string,string>"


def drawn(n, seed):
    rng = random.Random(seed)
    out = []
    for i in rng.sample(range(n), n):
        grp = rng.choice("ab")
        fields = {"id": str(i), "few": rng.choice(["x", "y", "z", "v", "w"]), "null": None} | ({"long": "ü" * rng.randrange(98, 104)} if rng.random() < 0.3 else {})
        out.append((i % 3, i, grp, "kind", grp, fields))
    return out


def test_records_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame(drawn(300, 1), KIND).mapInArrow(counted, KIND)
    out = {r["grp"]: r["count"] for r in questions.groups_of(rows).collect()}
    assert sum(out.values()) == 300 and read.value == 300


def test_samples_are_the_first_of_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(learn, "_KEPT", 5)
    rows = drawn(400, 2)
    found = {(r["grp"], r["name"]): (r["count"], r["samples"]) for r in learn.profiles_frame(spark.createDataFrame(rows, KIND).repartition(7)).collect()}
    expected = {}
    for file, line, grp, _, _, fields in sorted(rows, key=lambda r: r[:2]):
        for name, value in fields.items():
            text = value[:100] + "…" if value and len(value) > 100 else value
            count, samples = expected.get((grp, name), (0, []))
            expected[grp, name] = (count + 1, samples if text in samples or len(samples) == 3 else [*samples, text])
    assert found == expected


def test_heads(spark):
    rows = drawn(200, 3)
    for r in questions.groups_of(spark.createDataFrame(rows, KIND).repartition(5)).collect():
        own = [x for x in rows if x[2] == r["grp"]]
        first = min(own, key=lambda x: x[:2])[5]
        assert (r["count"], r["sources"], r["type_name"], r["type_value"]) == (len(own), [0, 1, 2], "kind", r["grp"])
        assert {k: v and v[:160] for k, v in r["example"].items()} == first


def test_types_and_groups():
    assert learn.type_of({"x": "1", "Action": "a", "Event_Type": "b", "eventtype": "c"}) == ("Event_Type", "b", "Event_Type=b")
    assert learn.type_of({"event.type": "l" * 81, "action": "a"}) == ("action", "a", "action=a")
    assert learn.type_of({"b": "1", "a": "2"})[2] == "fields:" + __import__("hashlib").sha256(b"a\nb").hexdigest()[:16]
