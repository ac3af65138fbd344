"""Streamed digests of files against hashlib over the files' bytes."""

import gzip
import hashlib

import pytest

from chatterforge.sources.datasets import file_digests, file_info

BOM = b"\xef\xbb\xbf"
BODIES = {
    "empty": b"",
    "mark": BOM,
    "end": b"\n",
    "ends": b"\n\n\n",
    "marked_end": BOM + b"\n",
    "one": b"x",
    "windows": b"a\r\nb\r\n",
    "old": b"a\rb\r",
    "marked": BOM + b'{"a": 1}\n{"b": 2}',
    "marked_ended": BOM + b'{"a": 1}\n',
    "mark_inside": b"a" + BOM + b"\n" + BOM,
    "two_marks": BOM + BOM + b"x\n",
    "no_text": bytes(range(256)) * 40,
    "long": b"long line " * 200_000 + b"\n" + b"y" * 3_000_000,
}


def in_chunks(path):
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1024):
            h.update(chunk)
    return h.hexdigest()


def test_digests_of_files(spark, tmp_path):
    for name, body in BODIES.items():
        (tmp_path / f"{name}.jsonl").write_bytes(body)
    (tmp_path / "packed.jsonl.gz").write_bytes(gzip.compress(b"a\nb\n"))
    found = {r["file"].rsplit("/", 1)[1]: r["sha256"] for r in file_digests(spark, str(tmp_path)).collect()}
    assert found == {p.name: in_chunks(p) for p in tmp_path.iterdir()}


@pytest.mark.parametrize("splits", ["1k", "128m"])
def test_files_that_are_split_elsewhere(spark, tmp_path, splits):
    path = tmp_path / "x.jsonl"
    path.write_bytes(b'{"conversations": []}\n' * 5000 + b"broken")
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    try:
        row = file_info(spark, str(path)).collect()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (row["sha256"], row["samples"] + row["invalid_rows"]) == (in_chunks(path), 5001)
