import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chatterforge.operators.splits import drop_duplicate_samples, permuted_places, split_counts, split_sessions, split_summary, validate_ratios
from chatterforge.operators.turns import aggregate_turns, sessionize
from chatterforge.operators.validation import message_violations, require_valid
from chatterforge.operators.windows import build_windows, trim_history, usable_sessions

from . import model

SCHEMA = "transcript_id string, pos bigint, id string, participant string, role string, author_id string, username string, content string, timestamp string, channel_id string, session_id string"
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def table(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    filled = [tuple({"transcript_id": "t", "pos": i, **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(filled, SCHEMA)


def say(i, who, seconds, **more):
    ts = None if seconds is None else (START + timedelta(seconds=seconds)).isoformat()
    return {"id": str(i), "participant": who, "content": f"text-{i}", "timestamp": ts, **more}


def spelled(turns):
    return [(r["participant"], r["content"], r["source_ids"]) for r in turns.orderBy("turn_no").collect()]


def test_burst(spark):
    rows = [say(1, "self", 0), say(2, "self", 30), say(3, "target", 60)]
    assert spelled(aggregate_turns(table(spark, rows))) == [("self", "text-1\ntext-2", ["1", "2"]), ("target", "text-3", ["3"])]


@pytest.mark.parametrize("seconds,n", [(300, 1), (301, 2)])
def test_turn_gap_is_inclusive(spark, seconds, n):
    assert aggregate_turns(table(spark, [say(1, "self", 0), say(2, "self", seconds)])).count() == n


def test_unknown_times(spark):
    rows = [say(1, "self", None), {**say(2, "self", None), "timestamp": "garbage"}]
    assert aggregate_turns(table(spark, rows)).count() == 2
    merged = aggregate_turns(table(spark, rows), merge_unknown_timestamps=True).collect()
    assert len(merged) == 1 and merged[0]["ts"] is None


@pytest.mark.parametrize("seconds,n", [(1800, 1), (1801, 2)])
def test_session_gap_is_exclusive(spark, seconds, n):
    turns = sessionize(aggregate_turns(table(spark, [say(1, "self", 0), say(2, "target", seconds)])))
    assert turns.select("session_id").distinct().count() == n


def test_boundaries(spark):
    known = table(spark, [say(1, "self", 0), say(2, "target", None)])
    assert sessionize(aggregate_turns(known)).select("session_id").distinct().count() == 2
    unknown = table(spark, [say(1, "self", None), say(2, "target", None)])
    turns = sessionize(aggregate_turns(unknown))
    assert turns.select("session_id").distinct().count() == 1 and build_windows(turns).count() == 1
    moved = table(spark, [say(1, "self", 0, session_id="0"), say(2, "target", 1, session_id="1")])
    assert sessionize(aggregate_turns(moved)).select("session_id").distinct().count() == 2


def test_windows(spark):
    rows = [say(i, "self" if i % 2 == 0 else "target", 60 * i) for i in range(4)]
    found = build_windows(sessionize(aggregate_turns(table(spark, rows)))).orderBy("turn_no").collect()
    assert [[t["participant"] for t in r["history"]] for r in found] == [["self", "target"], ["self", "target"] * 2]
    with pytest.raises(ValueError):
        build_windows(aggregate_turns(table(spark, rows)), 1)


def test_roles_stand_in_for_participants(spark):
    rows = [{"id": str(i), "role": r, "content": "x"} for i, r in enumerate((" You ", "THEM", "user", "gpt", "other"))]
    found = [r["participant"] for r in aggregate_turns(table(spark, rows)).orderBy("turn_no").collect()]
    assert found == ["self", "target", "self", "target", "other"]


def test_violations(spark):
    rows = [say(1, "self", 100), say(1, "target", 200), say(3, "someone", 300), say(4, "self", None), say(5, "self", 250), {**say(6, "self", 0), "content": " "}]
    found = {(r["pos"], r["code"]) for r in message_violations(table(spark, rows)).collect()}
    assert found == {(1, "duplicate_id"), (2, "unknown_participant"), (4, "order")}
    with pytest.raises(ValueError, match="Message 1: this message id stands above already"):
        require_valid(table(spark, rows))


@pytest.mark.parametrize(
    "gap,session_gap,unknown,w,spread", [(300, 1800, False, 6, False), (300, 1800, True, 3, True), (300, 60, False, 2, False), (300, 1800, False, 4, True)]
)
def test_random_transcripts_against_the_model(spark, gap, session_gap, unknown, w, spread):
    rng = random.Random(w)
    rows, expected = [], {}
    for n in range(60):
        at, mine = 0, []
        for i in range(rng.randint(0, 25)):
            at += rng.choice([0, 30, 300, 301, 1800, 1801])
            who = rng.choice(["self", "target", "target", "other"])
            m = say(f"{n}-{i}", who, None if rng.random() < 0.15 else at, channel_id=rng.choice([None, "a", "a", "a"]), author_id=rng.choice([None, "x"]))
            m["content"] = rng.choice(["hi", "yes", f"text-{i}", " "])
            mine.append(m)
        rows += [{**m, "transcript_id": str(n), "pos": i} for i, m in enumerate(mine)]
        found = model.sessions(model.turns(mine, gap, unknown), session_gap)
        expected[str(n)] = [[(t["participant"], t["content"], tuple(t["ids"])) for t in s] for s in found]
        expected[str(n), "w"] = [[(t["participant"], t["content"]) for t in h] for s in found for h in model.windows(s, w)]
    turns = sessionize(aggregate_turns(table(spark, rows), gap, unknown, spread), session_gap, spread)
    at_once = aggregate_turns(table(spark, rows), gap, unknown, spread, session_gap)
    assert at_once.orderBy("transcript_id", "turn_no").collect() == turns.select(*at_once.columns).orderBy("transcript_id", "turn_no").collect()
    got: dict = {}
    for r in turns.orderBy("transcript_id", "turn_no").collect():
        mine = got.setdefault(r["transcript_id"], [])
        if len(mine) <= r["session_id"]:
            mine.append([])
        mine[r["session_id"]].append((r["participant"], r["content"], tuple(r["source_ids"])))
    assert got == {k: v for k, v in expected.items() if isinstance(k, str) and v}
    seen: dict = {}
    for r in build_windows(turns, w).orderBy("transcript_id", "session_id", "turn_no").collect():
        seen.setdefault((r["transcript_id"], "w"), []).append([(t["participant"], t["content"]) for t in r["history"]])
    assert seen == {k: v for k, v in expected.items() if isinstance(k, tuple) and v}
    usable = usable_sessions(turns, w).select("transcript_id", "session_id").distinct().count()
    assert usable == build_windows(turns, w).select("transcript_id", "session_id").distinct().count()


def test_one_transcript_over_many_partitions(spark):
    """A transcript far larger than a partition gives the same turns and sessions when it is spread."""
    rng = random.Random(9)
    at, rows = 0, []
    for i in range(3000):
        at += rng.choice([0, 30, 300, 301, 1800, 1801])
        rows.append(say(i, rng.choice(["self", "target"]), None if rng.random() < 0.1 else at, transcript_id="big" if i % 50 else "small"))
    df = table(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spread = sessionize(aggregate_turns(df, spread=True), spread=True).orderBy("transcript_id", "turn_no").collect()
        at_once = aggregate_turns(df, spread=True, session_gap_seconds=1800).orderBy("transcript_id", "turn_no").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert at_once == spread == sessionize(aggregate_turns(df)).orderBy("transcript_id", "turn_no").collect()


def blocks(spark, n, text=None):
    rows = []
    for s in range(n):
        for i in range(2):
            m = say(2 * s + i, ("self", "target")[i], 7200 * s + 60 * i)
            rows.append({**m, **({"content": text[i]} if text else {})})
    return sessionize(aggregate_turns(table(spark, rows)))


def test_chronological_split(spark):
    split = split_sessions(blocks(spark, 10), 0.1, 0.1)
    found = {r["session_id"]: r["split"] for r in split.select("session_id", "split").distinct().collect()}
    assert found == {**{i: "train" for i in range(8)}, 8: "val", 9: "test"}


@pytest.mark.parametrize("total", [1, 2, 3, 7, 100, 101, 997, 10_007])
def test_permuted_places_are_a_bijection(spark, total):
    numbers = spark.range(total).withColumnRenamed("id", "n").repartition(3)
    orders = []
    for seed in (1, 2):
        found = {r["n"]: r["place"] for r in permuted_places(numbers, "n", total, seed).collect()}
        assert sorted(found) == sorted(found.values()) == list(range(total))
        orders.append([found[i] for i in range(total)])
    if total >= 100:
        assert orders[0] != orders[1] and sum(a == b for a, b in zip(*orders)) < total / 4
        held = [i for i in range(total) if orders[0][i] >= total * 0.9]
        assert total * 0.3 < sum(held) / len(held) < total * 0.7


def test_permuted_split(spark):
    turns = blocks(spark, 40)
    split = split_sessions(turns, 0.2, 0.1, "permuted", 5)
    found = {r["session_id"]: r["split"] for r in split.select("session_id", "split").distinct().collect()}
    assert sorted(found.values()) == ["test"] * 4 + ["train"] * 28 + ["val"] * 8
    again = {r["session_id"]: r["split"] for r in split_sessions(turns.repartition(7), 0.2, 0.1, "permuted", 5).select("session_id", "split").distinct().collect()}
    assert again == found and found != {i: "train" if i < 28 else "val" if i < 36 else "test" for i in range(40)}
    with pytest.raises(ValueError, match="permuted splits need a seed"):
        split_sessions(turns, 0.2, 0.1, "permuted")


def test_random_split_is_the_list_shuffle(spark):
    order = list(range(10))
    random.Random(7).shuffle(order)
    split = split_sessions(blocks(spark, 10), 0.2, 0.2, "random", 7)
    found = {r["session_id"]: r["split"] for r in split.select("session_id", "split").distinct().collect()}
    assert [found[i] for i in order] == ["train"] * 6 + ["val"] * 2 + ["test"] * 2
    hashed = split_sessions(blocks(spark, 10), 0.2, 0.2, "hashed", 7).groupBy("split").agg(F.countDistinct("session_id").alias("n"))
    assert {r["split"]: r["n"] for r in hashed.collect()} == {"train": 6, "val": 2, "test": 2}
    with pytest.raises(ValueError):
        split_sessions(blocks(spark, 10), strategy="random")


def test_held_out_copies_stay_and_training_copies_go(spark):
    turns = split_sessions(usable_sessions(blocks(spark, 4, ("hi", "yo"))), 0.25, 0.25)
    names = turns.select("transcript_id", "session_id", "session_no", "split").distinct()
    samples = drop_duplicate_samples(build_windows(turns).join(names, ["transcript_id", "session_id"]), ["session_no", "turn_no"])
    found = {r["split"]: r for r in split_summary(turns, samples).collect()}
    assert [(found[s]["samples"], found[s]["duplicates_removed"]) for s in ("train", "val", "test")] == [(0, 2), (0, 1), (1, 0)]
    assert found["test"]["messages"] == 2 and found["train"]["sessions"] == 2


@pytest.mark.parametrize("val,test", [(-0.1, 0.1), (0.6, 0.5), (float("nan"), 0), (float("inf"), 0), (1, 0), (True, 0)])
def test_bad_ratios(val, test):
    with pytest.raises(ValueError):
        validate_ratios(val, test)


def test_split_counts():
    assert split_counts(481, 0.075, 0.075) == (36, 36)
    assert split_counts(10, 0, 0.01) == (0, 1)
    with pytest.raises(ValueError):
        split_counts(2, 0.1, 0.1)
    with pytest.raises(ValueError):
        split_counts(0, 0, 0)


def test_trim_history(spark):
    roles = ("system", "user", "assistant", "user", "assistant", "user")
    rows = [("c", i, r, "x") for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "chat string, pos bigint, role string, content string")
    kept = trim_history(df, F.lit(1), 4, ["chat"]).orderBy("pos").collect()
    assert [r["pos"] for r in kept] == [0, 3, 4, 5]
    with pytest.raises(Exception, match="does not fit"):
        trim_history(df, F.lit(1), 1, ["chat"]).collect()


def test_short_forms(spark):
    from chatterforge.plans.compat import build_conversations, group_consecutive_messages, split_conversations

    rows = [say(2 * s + i, ("self", "target")[i], 7200 * s + 60 * i) for s in range(4) for i in range(2)]
    turns = group_consecutive_messages(table(spark, rows))
    assert turns.count() == 8 and build_conversations(turns).count() == 4
    train, val = split_conversations(turns, 0.25)
    assert (train.count(), val.count()) == (3, 1)
    assert [x.count() for x in split_conversations(turns, 0.0)] == [4, 0]
    for bad, of in ((1.0, turns), (0.5, turns.where("turn_no < 2")), (0.1, turns.where("participant = 'self'"))):
        with pytest.raises(ValueError):
            split_conversations(of, bad)
    with pytest.raises(ValueError):
        group_consecutive_messages(table(spark, rows), 10, 5)
