"""Scans over range partitions against plain loops, and against the form by window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chatterforge.operators.identity import label_messages
from chatterforge.operators.ordered import scan
from chatterforge.operators.validation import message_violations, require_valid

from .model import parse

SCHEMA = "transcript_id string, pos bigint, v int, w string"


@pytest.fixture
def many_parts(spark):
    """More partitions than keys, none of them merged, so that keys span several and share some."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def made(seed, n=700):
    rng = random.Random(seed)
    keys = ["big"] * 6 + ["mid", "mid", None] + [f"k{i}" for i in range(5)]
    return [(rng.choice(keys), p, rng.choice([None, None, None, *range(5)]), rng.choice("ab")) for p in range(n)]


def loop(rows):
    out, state = [], {}
    for key, pos, v, w in sorted(rows, key=lambda r: r[1]):
        before, changes, known, top = state.get(key, (None, 0, None, 0))
        changes += before is None or before[1] != w
        top += v or 0
        out.append((key, pos, before, changes, top, known))
        state[key] = ((v, w), changes, v if v is not None else known, top)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("spread", [True, False])
def test_scan_equals_a_loop(spark, many_parts, seed, spread):
    rows = made(seed)
    counts = {
        "changes": lambda row, last: F.when(last.isNotNull() & (row["w"] == last["w"]), 0).otherwise(1),
        "total": lambda row, last: F.coalesce(row["v"], F.lit(0)),
    }
    found = scan(spark.createDataFrame(rows, SCHEMA).repartition(5), "transcript_id", "pos", ["v", "w"], counts, ["v"], spread)
    got = [(r["transcript_id"], r["pos"], r["previous"] and tuple(r["previous"]), r["changes"], r["total"], r["known_v"]) for r in found.collect()]
    assert sorted(got, key=repr) == loop(rows)
    assert set(found.columns) == {"transcript_id", "pos", "v", "w", "previous", "changes", "total", "known_v"}


def test_empty_and_single_rows(spark, many_parts):
    for rows in ([], [("a", 1, 2, "x")]):
        for spread in (True, False):
            found = scan(spark.createDataFrame(rows, SCHEMA), "transcript_id", "pos", ["v"], {"n": lambda row, last: F.lit(1)}, ["v"], spread)
            assert [(r["n"], r["previous"], r["known_v"]) for r in found.collect()] == [(1, None, None)] * len(rows)


def violations_model(rows):
    out, ids, last = [], {}, {}
    for t, pos, i, who, text, ts in sorted(rows, key=lambda r: (r[0], r[1])):
        if not text.strip():
            continue
        name = i if i is not None else f"row:{pos}"
        if who not in ("self", "target", "other"):
            out.append((t, pos, "unknown_participant"))
        if (t, name) in ids:
            out.append((t, pos, "duplicate_id"))
        ids[t, name] = True
        at = parse(ts)
        if at and last.get(t) and at < last[t]:
            out.append((t, pos, "order"))
        last[t] = at or last.get(t)
    return sorted(out)


@pytest.mark.parametrize("spread", [True, False])
def test_violations_of_random_transcripts(spark, many_parts, spread):
    rng = random.Random(4)
    rows = []
    for pos in range(600):
        ts = None if rng.random() < 0.4 else f"2026-01-01T{(pos * 60 + rng.randint(-90, 90)) % 86400 // 3600:02d}:{pos % 60:02d}:00Z"
        rows.append((rng.choice(["a", "a", "a", "b", "c"]), pos, rng.choice([None, "same", *map(str, range(pos, pos + 9))]), rng.choice(["self", "target", "other", "nobody"]), rng.choice(["hi", " "]), ts))
    df = spark.createDataFrame(rows, "transcript_id string, pos bigint, id string, participant string, content string, timestamp string")
    found = message_violations(df, spread).collect()
    assert sorted((r["transcript_id"], r["pos"], r["code"]) for r in found) == violations_model(rows)
    assert {r["code"] for r in found} == {"unknown_participant", "duplicate_id", "order"} and all(r["detail"] for r in found)
    with pytest.raises(ValueError, match="^Message "):
        require_valid(df, spread)


def test_spread_windows_look_at_parts_alone(spark, capsys):
    """Rows are windowed by part; only the table with a row for each part is windowed by transcript."""
    df = spark.createDataFrame([("a", 1, "1", "self", "x", None)], "transcript_id string, pos bigint, id string, participant string, content string, timestamp string")
    message_violations(df, spread=True).explain()
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", capsys.readouterr().out)
    assert windows and all("__part" in w for w in windows)


@pytest.mark.parametrize("spread", [True, False])
def test_boundary_of_dropped_speakers(spark, many_parts, spread):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b"]), pos, rng.choice("xyyz"), f"t{pos}") for pos in range(400)]
    expected, gone = [], {}
    for t, pos, who, text in rows:
        gone[t] = gone.get(t, 0) + (who == "z")
        if who != "z":
            expected.append((t, pos, gone[t]))
    df = spark.createDataFrame(rows, "transcript_id string, pos bigint, identity_key string, content string")
    found = label_messages(df, "x", "y", "drop", spread).collect()
    assert sorted((r["transcript_id"], r["pos"], r["session_id"]) for r in found) == sorted(expected)
