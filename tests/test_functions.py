"""Column functions by tables of cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewell.functions import masks, net, text, times


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r["v"] for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


CASES = [
    (text.norm_key, ["Process Guid", "process_guid", "@timestamp", None], ["processguid", "processguid", "timestamp", None]),
    (text.guid, ["{26bbf027-0000-4000-8000-0000000000ab}", "aBc+/=", "{00000000-0000-0000-0000-000000000000}", "", None], ["26BBF027-0000-4000-8000-0000000000AB", "aBc+/=", None, None, None]),
    (text.basename, [r"C:\a\b.exe", "/usr/bin/x", "x", r"C:\dir" + "\\"], ["b.exe", "x", "x", "dir"]),
    (text.canonical_host, ["WS-01.corp.example", "10.0.0.5", "fe80::1", None, " A "], ["ws-01", "10.0.0.5", "fe80::1", "", "a"]),
    (text.canonical_user, [r"CORP\Alice", "bob@corp", "-", "", None], ["alice", "bob", None, None, None]),
    (text.sha256_from, ["MD5=1,SHA256=" + "A" * 64, "SHA1=2", None], ["a" * 64, None, None]),
    (text.hash256, ["B" * 64, "SHA256=" + "c" * 64, "xyz"], ["b" * 64, "c" * 64, None]),
    (text.task_command, ["<Exec><Command>a.exe</Command><Arguments>-x 1</Arguments></Exec>", "<Command>b</Command>", "<x/>"], ["a.exe -x 1", "b", None]),
    (text.path_key, [r"C:\X\y.exe", r"\\?\C:\x\Y.EXE", r"\Device\HarddiskVolume3\x\y.exe", "C:/x/y.exe"], [r"\x\y.exe"] * 4),
    (text.launched_paths, [r'cmd.exe /c start "" "C:\a b\p.exe" -k', r"C:\Windows\System32\cmd.exe /c C:\t\run.ps1", r"C:\Windows\System32\rundll32.exe", "none", None], [[r"\a b\p.exe"], [r"\t\run.ps1"], [r"\windows\system32\rundll32.exe"], [], []]),
    (text.variable, ["is-OB9B3JUD4C.tmp", "f_00a1b2", "a1 b22 c333d", "v2 of 2021"], ["is-#.tmp", "f_#", "a1 b22 #", "v2 of #"]),
    (masks.integer, ["12", "0x1F", " 7 ", "1234567890123456", "x", "-1"], [12, 31, 7, None, None, None]),
    (net.address, ["10.0.0.1", "::ffff:1.2.3.4", "::", "-", "fe80::1"], ["10.0.0.1", "1.2.3.4", None, None, "fe80::1"]),
    (net.domain_name, ["Evil.Example.", "localhost", "1.2.3.4", ""], ["evil.example", None, "1.2.3.4", None]),
    (net.url_host, ["https://a.example:8443/x", "/path", "ftp://h?x"], ["a.example", None, "h"]),
    (times.parse_iso, ["2026-09-21T17:21:26.904Z", "2026-09-21 17:21:26,9049999", "2026-09-21T19:21:26+02:00", "2026-02-30T00:00:00Z", "21/09/2026", None], [1790011286904000, 1790011286904999, 1790011286000000, None, None, None]),
    (times.time_of, ["1790011286", "1790011286904", "1790011286904000", "134344848869040000", "5", "2026-09-21T17:21:26Z"], [1790011286000000, 1790011286904000, 1790011286904000, 1789960486904000 + 50800000000, None, 1790011286000000]),
]


@pytest.mark.parametrize(("f", "cases", "expected"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_cases(spark, f, cases, expected):
    assert values(spark, f, cases) == expected


def test_masks_and_relative_times(spark):
    df = spark.createDataFrame([(0x1FFFFF, 90_061_500_000), (0x1410, -1_500_000), (0x28, 0), (0x8, -86_400_000_000)], "m long, d long")
    rows = df.select(masks.injection_capable(F.col("m")).alias("c"), masks.hexadecimal(F.col("m")).alias("h"), times.relative(F.col("d"), F.lit(0)).alias("r"), times.iso(F.col("d")).alias("i")).collect()
    assert [r["c"] for r in rows] == [True, False, True, False] and rows[0]["h"] == "0x1fffff"
    assert [r["r"] for r in rows] == ["+1d 01:01:01", "-00:00:01", "+00:00:00", "-1d 00:00:00"]
    assert rows[1]["i"] == "1969-12-31T23:59:58.500000Z"


def test_same_detail(spark):
    df = spark.createDataFrame([("process_start", "a.exe 123"), ("file_create", r"c:\t\f_00a1b2"), ("file_create", r"c:\t\ab12.exe"), ("registry_set", "K\\12 = 34"), ("network", "h:443")], "k string, d string")
    assert [r[0] for r in df.select(text.same_detail(F.col("k"), F.col("d"))).collect()] == ["a.exe #", r"c:\t\f_#", r"c:\t\ab12.exe", "K\\# = 34", "h:443"]
