"""Small texts and sets of folders are replaced as a whole, in more than one file system."""

import json
import os

import pytest

from chatterforge.plans import jobs
from chatterforge.runtime import write_text
from chatterforge.sources.datasets import publish, write_json_atomic


@pytest.fixture(params=["path", "file", "viewfs"])
def place(request, spark, tmp_path):
    """The same folder by its name in three spellings; the last one is another file system's."""
    if request.param == "viewfs":
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.commit.link./here", f"file://{tmp_path.parent}")
        return f"viewfs://commit/here/{tmp_path.name}", tmp_path
    return (f"file://{tmp_path}" if request.param == "file" else str(tmp_path)), tmp_path


def test_texts_are_replaced(spark, place):
    path, folder = place
    for value in ({"a": "é"}, {"b": [1, None]}):
        write_json_atomic(spark, f"{path}/deep/m.json", value)
        assert json.loads((folder / "deep/m.json").read_text(encoding="utf-8")) == value
    assert [f for f in os.listdir(folder / "deep") if not f.endswith(".crc")] == ["m.json"]


def test_a_failed_write_leaves_the_older_text(spark, place):
    path, folder = place
    write_text(spark, f"{path}/m.json", "old")
    os.mkdir(folder / "file")
    with pytest.raises(TypeError):
        write_text(spark, f"{path}/m.json", None)
    assert (folder / "m.json").read_text() == "old"


def test_folders_are_published_with_their_manifest(spark, place):
    path, folder = place
    for n in (1, 2):
        staged = {}
        for name in "ab":
            spark.range(n).write.parquet(f"{path}/.{name}-{n}")
            staged[f"{path}/.{name}-{n}"] = f"{path}/{name}"
        publish(spark, staged, f"{path}/manifest.json", {"n": n})
        assert json.loads((folder / "manifest.json").read_text()) == {"n": n}
        assert [spark.read.parquet(f"{path}/{name}").count() for name in "ab"] == [n, n]
    assert not [f for f in os.listdir(folder) if f.startswith(".") and not f.endswith(".crc")]


def messages(spark, text):
    rows = [("t", i, ("self", "target")[i % 2], f"{text} {i}", f"2026-01-{1 + i // 2:02d}T00:0{i % 2}:00Z") for i in range(40)]
    return spark.createDataFrame(rows, "transcript_id string, pos bigint, participant string, content string, timestamp string")


def test_a_job_that_stops_leaves_the_older_datasets(spark, tmp_path, monkeypatch):
    prefix = str(tmp_path / "x")
    jobs.format_dataset(messages(spark, "old"), prefix)
    before = {f: (tmp_path / f / "_SUCCESS").exists() for f in os.listdir(tmp_path) if f.endswith(".jsonl")}
    lines = spark.read.text(f"{prefix}_train_sharegpt.jsonl").count()
    written, plain = [], jobs.write_sharegpt

    def stops(df, path):
        if len(written) == 2:
            raise RuntimeError("lost")
        written.append(path)
        plain(df, path)

    monkeypatch.setattr(jobs, "write_sharegpt", stops)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.format_dataset(messages(spark, "new"), prefix)
    assert len(written) == 2 and not [f for f in os.listdir(tmp_path) if "writing" in f]
    assert {f for f in os.listdir(tmp_path) if f.endswith(".jsonl")} == set(before) and (tmp_path / "x_split_manifest.json").exists()
    assert spark.read.text(f"{prefix}_train_sharegpt.jsonl").where("value like '%old%'").count() == lines
    monkeypatch.setattr(jobs, "write_sharegpt", plain)
    jobs.format_dataset(messages(spark, "new"), prefix)
    assert spark.read.text(f"{prefix}_train_sharegpt.jsonl").where("value like '%new%'").count() == lines
