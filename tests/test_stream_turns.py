"""Turns and sessions of shuffled micro-batches against the batch form."""

import json
import random
import time

import pytest

from chatterforge.operators.turns import aggregate_turns
from chatterforge.streaming.turns import STATE_STORE, stream_turns

SCHEMA = "transcript_id string, pos bigint, id string, participant string, author_id string, content string, timestamp string, channel_id string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def made(seed, missing=0.0):
    rng, rows = random.Random(seed), []
    for t in range(6):
        at = 0
        for pos in range(rng.randint(1, 30)):
            at += rng.choice([0, 30, 300, 301, 1800, 1801])
            when = None if rng.random() < 0.3 else f"2026-01-{1 + at // 86400:02d}T{at % 86400 // 3600:02d}:{at % 3600 // 60:02d}:{at % 60:02d}Z"
            row = (f"t{t}", pos, f"{t}-{pos}", rng.choice(["self", "target", "target"]), rng.choice([None, "x"]), rng.choice(["hi", f"text {pos}", " "]), when, rng.choice([None, "a", "a"]))
            if rng.random() >= missing:
                rows.append(row)
    return rows


def write_batches(folder, rows, n, seed):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    folder.mkdir()
    for i in range(n):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(NAMES, r))) for r in rows[i::n]))


def spelled(rows):
    fields = ("transcript_id", "turn_no", "session_id", "participant", "role", "content", "author_id", "author_label", "channel_id", "source_session", "source_ids", "ts", "end_ts", "pos")
    return sorted((tuple(r[f] for f in fields) for r in rows), key=repr)


@pytest.mark.parametrize("unknown,missing", [(False, 0.0), (True, 0.1)])
def test_shuffled_batches_give_the_batch_result(spark, state_store, tmp_path, unknown, missing):
    rows = made(3 + unknown, missing)
    batch = aggregate_turns(spark.createDataFrame(rows, SCHEMA), 300, unknown, session_gap_seconds=1800)
    expected = spelled(batch.collect())
    write_batches(tmp_path / "in", rows, 4, 1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = stream_turns(stream, 300, 1800, unknown, wait_seconds=12)
    name = f"turns_{unknown}"
    query = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        began = time.time()
        while time.time() - began < 150 and query.exception() is None:
            got = spark.table(name).collect()
            if len(got) >= len(expected):
                break
            time.sleep(1)
    finally:
        query.stop()
    assert query.exception() is None
    assert spelled(got) == expected


def test_gaps_are_checked(spark, state_store):
    with pytest.raises(ValueError, match="at least 1 second"):
        stream_turns(spark.createDataFrame([], SCHEMA), 0)
