"""Readers: formats, numbering, identifiers and errors."""

from __future__ import annotations

import pytest

from tracewell.sources.readers import Input, ReadError, csv_header, detect_format, read_input, read_inputs, split_csv


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content.encode())
    return str(p)


@pytest.mark.parametrize(("line", "kind"), [("[", "json"), ("[{", "json"), ("[2026-09-21 10:00:00] x", "text"), ('{"a": 1}', "ndjson"), ("{", "json"), ("time,host,user", "csv"), ("a b,c", "text"), ("hello world", "text"), ("time\thost", "csv")])
def test_detect(line, kind):
    assert detect_format(line) == kind


def test_csv_pieces():
    assert split_csv('a,"b ""c"", d",e"f', ",") == (["a", 'b "c", d', 'e"f'], False)
    assert split_csv('a,"b', ",") == (["a", "b"], True)
    assert csv_header("a;b;c") == (";", ["a", "b", "c"]) and csv_header("a,a") is None and csv_header("one") is None


def test_ndjson(spark, tmp_path):
    path = put(tmp_path, "a.ndjson", '﻿{"id": "x", "a": [1]}\r\n\r\n{"_source": {"id": 7, "b": {"c": 2}}}\n{"fields": {"Process Id": ["5"], "host.name": ["h"]}, "_id": "q"}\n')
    rows = read_input(spark, Input(path)).orderBy("line").collect()
    assert [(r["line"], r["id"], r["line_id"]) for r in rows] == [(1, "x", False), (3, "7", False), (4, "q", False)]
    assert rows[2]["flat"] == {"processid": "5", "hostname": "h"} and rows[2]["names"]["processid"] == "Process Id"
    with pytest.raises(Exception, match="line 2 is not valid JSON"):
        read_input(spark, Input(put(tmp_path, "b.ndjson", '{"a": 1}\n{"a": \n'))).collect()
    with pytest.raises(ReadError, match="no events"):
        read_input(spark, Input(put(tmp_path, "c.txt", "\n \n")))


def test_json_documents(spark, tmp_path):
    for k, content in enumerate(['[\n{"id": 1}, {"id": 2}]', '{"events": [{"id": 1}, {"id": 2}]}', '{"hits": {"hits": [{"_source": {"id": 1}}, {"_source": {"id": 2}}]}}', '{\n"events": [{"id": 1}, {"id": 2}]}']):
        rows = read_input(spark, Input(put(tmp_path, f"{k}.json", content))).orderBy("line").collect()
        assert [(r["line"], r["id"]) for r in rows] == [(1, "1"), (2, "2")]


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'time,host,cmd\r\n1,h,"a ""b"", c"\r\n\r\n2,,x\r\n3,h,y,extra\r\n')
    rows = read_input(spark, Input(path)).orderBy("line").collect()
    assert [(r["line"], r["flat"]) for r in rows] == [(2, {"time": "1", "host": "h", "cmd": 'a "b", c'}), (4, {"time": "2", "cmd": "x"}), (5, {"time": "3", "host": "h", "cmd": "y"})]
    rows = read_input(spark, Input(put(tmp_path, "b.csv", 'time,host,cmd\n1,h,"two\nlines"\n2,h,x\n'))).orderBy("line").collect()
    assert [(r["line"], r["flat"]["cmd"]) for r in rows] == [(2, "two\nlines"), (4, "x")]
    with pytest.raises(Exception, match="never closes"):
        read_input(spark, Input(put(tmp_path, "c.csv", 'time,host,cmd\n1,h,"open\n'))).collect()


def test_text_and_several_inputs(spark, tmp_path):
    path = put(tmp_path, "a.log", '2026-09-21T17:21:26Z user=alice cmd="say \\"hi\\" now" user=bob empty=\nplain line\n')
    rows = read_input(spark, Input(path)).orderBy("line").collect()
    assert rows[0]["flat"] == {"message": rows[0]["flat"]["message"], "user": "alice", "cmd": 'say "hi" now', "timestamp": "2026-09-21T17:21:26Z"}
    assert rows[1]["flat"] == {"message": "plain line"} and rows[1]["id"] == "line-2"
    both = read_inputs(spark, [path, Input(path, "text")])
    assert sorted((r["file"], r["line"]) for r in both.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    with pytest.raises(ReadError, match="format"):
        read_input(spark, Input(path, "xml"))
