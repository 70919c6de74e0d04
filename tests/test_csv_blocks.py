"""Quoted CSV that is read in blocks equals a reader that goes line by line."""

from __future__ import annotations

import random

import pytest

from tracewell.sources.readers import Input, ReadError, read_input, split_csv


def by_line(text):
    """Records of the lines after the header: (first line, cells)."""
    out, start, held = [], None, ""
    for line, value in enumerate(text.split("\n"), 1):
        if line == 1 or (start is None and not value.strip(" \t\r\f\v")):
            continue
        start, held = (line, value) if start is None else (start, f"{held}\n{value}")
        cells, quoted = split_csv(held, ",")
        if not quoted:
            out.append((start, cells))
            start = None
    if start is not None:
        raise ReadError(f"line {start} opens a quoted CSV field that never closes")
    return out


def drawn(rng, records, long=0):
    """Quotes that open, close, are doubled, stand within bare fields or follow a closed field; blank lines in and between."""
    fields = ["x", "", '"q"', '"a,b"', '"two\nlines"', '"\n"', '"\n\n \n"', '"he said ""hi""\n"', '"closed"rest', 'mid"dle', '"" ""', '"""\n"""', " "]
    rows = [",".join(rng.choice(fields) for _ in range(rng.randrange(1, 5))) for _ in range(records)]
    rows = ["a,b,c", *(x for r in rows for x in ([r, ""] if rng.random() < 0.1 else [r]))]
    if long:
        rows.insert(len(rows) // 2, '1,"' + "\n".join("y" * rng.randrange(30) + '""' * rng.randrange(3) for _ in range(long)) + '",z')
    return "\n".join(rows)


@pytest.mark.parametrize(("seed", "block", "long"), [(1, "64b", 0), (2, "100b", 0), (3, "64b", 60), (4, "1k", 200), (5, "128m", 20)])
def test_blocks_are_the_whole(spark, tmp_path, seed, block, long):
    text = drawn(random.Random(seed), 60, long)
    path = tmp_path / "a.csv"
    path.write_text(text)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_input(spark, Input(str(path), "csv"))
        told = sorted((r["line"], r["flat"]) for r in rows.collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert told == [(line, {n: c for n, c in zip("abc", cells, strict=False) if c}) for line, cells in by_line(text)]


def test_unclosed_quotes_in_blocks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n3,\"open\n" + "x,y\n" * 100)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        with pytest.raises(Exception, match="line 3 opens a quoted CSV field that never closes"):
            read_input(spark, Input(str(path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
