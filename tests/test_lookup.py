"""One row of an archive, read by its file and line number."""

from __future__ import annotations

import json
import os

import pytest

from colloquy.sources import index as X
from colloquy.sources import lookup as L


def line(i, size=40):
    return json.dumps({"source": "alpha", "execution_context": "cli", "collected_at": "2024-01-01T00:00:00Z", "contract": {"schema_version": "2026-03-19"}, "messages": [{"role": "user", "text": f"é{i} " + "x" * (i * 7 % size)}]}, ensure_ascii=False)


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "an archive" / "alpha"
    folder.mkdir(parents=True)
    (folder / "big.jsonl").write_text("\n".join("" if i % 50 == 0 else line(i) for i in range(1, 5001)) + "\n")
    (folder / "crlf.jsonl").write_bytes("\r\n".join(line(i) for i in range(3)).encode())
    (folder / "empty.jsonl").write_text("")
    return str(tmp_path / "an archive")


def at(root, name):
    return f"{root}/alpha/{name}"


def test_offsets_are_where_lines_begin(spark, root):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = {r.row_number: r.byte_offset for r in L.line_offsets(spark, f"{root}/alpha/big.jsonl", every=7).collect()}
        splits = spark.read.text(f"{root}/alpha/big.jsonl", lineSep="\n").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw, wanted, at = open(f"{root}/alpha/big.jsonl", "rb").read(), {}, 0
    for i, own in enumerate(raw.split(b"\n")[:-1]):
        if i % 7 == 0:
            wanted[i + 1] = at
        at += len(own) + 1
    assert splits > 3 and found == wanted


def test_one_small_read_finds_a_row(spark, root):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        X.refresh_index(spark, root)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    size = os.path.getsize(f"{root}/alpha/big.jsonl")
    for row in (1, 2, 255, 256, 257, 258, 3000, 4999):
        found = L.lookup(spark, root, at(root, "big.jsonl"), row)
        assert found.line == ("" if row % 50 == 0 else line(row)), row
        assert found.bytes_read <= L.EVERY * 260 + L.CHUNK < size / 5
    assert [L.lookup(spark, root, at(root, "crlf.jsonl"), i + 1).line for i in range(3)] == [line(i) for i in range(3)]
    indexed = {r.row_number: r.line for r in X.read_index(spark, root).where("output_path like '%big%'").collect()}
    named = X.read_listing(spark, root).where("output_path like '%big%'").first().output_path
    assert L.lookup(spark, root, named, 3001).line == indexed[3001]
    assert indexed[3001] == L.lookup(spark, root, at(root, "big.jsonl"), 3001).line
    for name, row in (("big.jsonl", 5001), ("big.jsonl", 0), ("crlf.jsonl", 4), ("empty.jsonl", 1), ("none.jsonl", 1)):
        with pytest.raises(LookupError):
            L.lookup(spark, root, at(root, name), row)


def test_a_changed_file_is_not_read_by_old_offsets(spark, root):
    X.refresh_index(spark, root)
    with open(f"{root}/alpha/big.jsonl", "a") as out:
        out.write(line(9) + "\n")
    with pytest.raises(L.StaleIndex):
        L.lookup(spark, root, at(root, "big.jsonl"), 1)
    assert X.ensure_index(spark, root).ready
    assert L.lookup(spark, root, at(root, "big.jsonl"), 5001).line == line(9)
    os.remove(f"{root}/alpha/crlf.jsonl")
    with pytest.raises(L.StaleIndex):
        L.lookup(spark, root, at(root, "crlf.jsonl"), 1)
