"""The splittable reader of JSON arrays against json.loads."""

import json
import random

import pytest

from chatterforge.operators.identity import normalize_messages
from chatterforge.operators.validation import message_violations
from chatterforge.sources import exports
from chatterforge.sources.json_array import read_elements

NASTY = ['plain', 'a "quoted" [word] {x}', "back\\slash", 'ends with \\', 'two \\\\"', "", "messages", '"messages": [', "é\U0001f600\n\t", "},{", "][", ",,,", "\\u0041", ":["]


@pytest.fixture
def small_splits(spark):
    """Files are split every few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(rng, n):
    def value(depth):
        kind = rng.random()
        if depth > 2 or kind < 0.5:
            return rng.choice(NASTY)
        if kind < 0.65:
            return rng.choice([None, True, 1.5, -3])
        if kind < 0.8:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(NASTY): value(depth + 1) for _ in range(rng.randint(0, 3))}

    return [rng.choice([value(2), {"content": rng.choice(NASTY) * rng.randint(1, 30), "x": value(0)}, {}, [], 7, [[{"messages": [1]}]]]) for _ in range(n)]


def read_back(spark, path):
    elements, around = read_elements(spark, str(path))
    found = [(r["pos"], json.loads(r["json"])) for r in elements.orderBy("pos").collect()]
    return found, [json.loads(r["json"]) for r in around.collect()]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("indent", [None, 2])
def test_elements_equal_the_whole_file(spark, small_splits, tmp_path, seed, indent):
    rng = random.Random(seed)
    items = made(rng, 60)
    around = {"guild": {"messages": ["no"], "n": [{"messages": []}]}, "messages": items, "channel": {"name": "c", "topics": made(rng, 25)}, "last": "x"}
    for name, body, outer in (("list", items, []), ("object", around, {**around, "messages": []})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body, indent=indent, ensure_ascii=seed % 2 == 0), encoding="utf-8-sig" if seed == 3 else "utf-8")
        assert read_back(spark, path) == (list(enumerate(items)), [outer])


def test_many_files_at_once(spark, small_splits, tmp_path):
    rng, wanted = random.Random(9), {}
    for i in range(7):
        items = made(rng, rng.choice([0, 1, 30]))
        body = items if i % 2 else {"messages": items}
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
        wanted[f"{i}.json"] = items
    elements, around = read_elements(spark, str(tmp_path))
    got = {name: {} for name in wanted}
    for r in elements.collect():
        got[r["file"].rsplit("/", 1)[1]][r["pos"]] = json.loads(r["json"])
    assert got == {name: dict(enumerate(items)) for name, items in wanted.items()} and around.count() == 7


def test_three_ranges_of_one_line(spark, tmp_path):
    """One line without line ends is read by several tasks."""
    messages = [{"id": str(i), "content": f'text {i} "}}],[{{" \\', "author": {"id": str(i % 2)}} for i in range(300)]
    path = tmp_path / "export.json"
    path.write_text(json.dumps({"messages": messages, "channel_id": "7", "channel": {"name": "c"}}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 3 + 1))
    try:
        rows = exports.read_export(spark, str(path))
        found = rows.orderBy("pos").collect()
        assert [r["content"] for r in found] == [m["content"] for m in messages]
        assert {(r["export_channel_id"], r["channel_name"]) for r in found} == {("7", "c")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ['{"a": 1}', '{"messages": 5}', '{"messages": {"messages": [1]}}', '[{"a": 1}', '["a', "5", '{"messages": [1, 2'])
def test_what_is_no_list_of_messages(spark, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    with pytest.raises(ValueError, match="x.json: expected a list of messages"):
        exports.read_export(spark, str(path))


@pytest.mark.parametrize("value,kept", [('""', 1), ("0", 1), ("0.0", 1), ("-0", 1), ("false", 1), ("{}", 1), ("null", 1), ("[]", 1), ('["u"]', 1), ('"u"', 0), ('"false"', 0), ("1", 0), ("true", 0), ('{"a": 0}', 0)])
def test_attachments_that_are_no_list(spark, tmp_path, value, kept):
    path = tmp_path / "x.json"
    path.write_text('[{"content": "hi", "author": {"id": "1"}, "attachments": %s}]' % value)
    records = normalize_messages(exports.read_export(spark, str(path)))
    found = message_violations(records, spread=True).collect()
    assert [(r["pos"], r["code"]) for r in found] == ([] if kept else [(0, "bad_attachments")])
    if kept:
        assert records.collect()[0]["attachments"] == (["u"] if value == '["u"]' else [])
