"""Windows that are taken block by block against those that are taken session by session."""

import random

import pytest

from chatterforge.operators import windows
from chatterforge.operators.splits import split_sessions
from chatterforge.operators.windows import PLACE, build_windows, placed, usable_sessions


@pytest.mark.parametrize("width", [2, 6, 9])
def test_blocks_equal_whole_sessions(spark, monkeypatch, width):
    monkeypatch.setattr(windows, "BLOCK", 7)
    rng = random.Random(width)
    rows, at = [], {}
    for i in range(500):
        t = rng.choice(["a", "a", "a", "b", "c"])
        no, session = at.get(t, (0, 0))
        # Numbers of turns may have gaps.
        at[t] = no + rng.randint(1, 9), session + (rng.random() < 0.05)
        rows.append((t, *at[t], rng.choice(["target", "target", "self", "other"]), f"text-{i}"))
    turns = spark.createDataFrame(rows, "transcript_id string, turn_no bigint, session_id bigint, participant string, content string").repartition(5)
    blocks = placed(turns)
    spell = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert spell(build_windows(blocks, width)) == spell(build_windows(turns, width))
    assert spell(usable_sessions(blocks, width).drop(PLACE)) == spell(usable_sessions(turns, width))


def test_no_step_deals_turns_by_session(spark, capsys):
    """One session may be all there is, so its turns must not meet in one task."""
    rows = [(t, i, 0, "self" if i % 2 else "target", t) for i in range(40) for t in "ab"]
    turns = spark.createDataFrame(rows, "transcript_id string, turn_no bigint, session_id bigint, participant string, content string")
    build_windows(split_sessions(usable_sessions(placed(turns)), 0.3, 0.0)).explain()
    plan = capsys.readouterr().out
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("__block" in line for line in dealt) and all("__block" in line for line in dealt)
