"""Short forms of the turn, window and split steps with the names of earlier versions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chatterforge.operators import windows
from chatterforge.operators.splits import split_sessions
from chatterforge.operators.turns import aggregate_turns
from chatterforge.operators.windows import usable_sessions
from chatterforge.runtime import materialize


def group_consecutive_messages(messages: DataFrame, max_gap_seconds: int = 300, session_gap_seconds: int = 1800, spread: bool = False) -> DataFrame:
    """Turns with their sessions."""
    if not 1 <= max_gap_seconds <= session_gap_seconds:
        raise ValueError("a session's gap is at least a turn's, and a turn's at least 1 second")
    return aggregate_turns(messages, max_gap_seconds, spread=spread, session_gap_seconds=session_gap_seconds)


def build_conversations(turns: DataFrame, window_size: int = 6) -> DataFrame:
    """The windows of every session."""
    return windows.build_windows(turns, window_size)


def split_conversations(turns: DataFrame, val_split: float, window_size: int = 6) -> tuple[DataFrame, DataFrame]:
    """Windows of the training and of the validation sessions; equal samples are kept."""
    split = split_sessions(materialize(usable_sessions(turns, window_size)), val_split, 0.0)
    train, val = (build_conversations(split.where(split["split"] == name), window_size) for name in ("train", "val"))
    return train, val
