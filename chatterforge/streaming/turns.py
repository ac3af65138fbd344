"""Turns and sessions of a message stream that arrives out of order and whose times may be unknown.

The place of a message in its transcript is known, its time need not be, so no watermark helps.  Each transcript keeps the
messages that came too early, by their place, and the turn that is open.  Messages are taken in the order of their
places; a turn is given out, with its number and session, once the next one begins.  A timer goes on without a
place that never comes, and gives out the last turn of a transcript that has fallen silent.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatterforge.functions import text as T
from chatterforge.operators.turns import ROLES, filled, participant_of

FIXED = ("participant", "author_id", "author_label", "channel_id", "source_session")
_MESSAGE = "pos bigint, participant string, content string, source_id string, us bigint, channel_id string, source_session string, author_id string, author_label string"
#: The next place, the open turn's number, session and first message, its end, and the time when the transcript is given up waiting for.
_OPEN = f"next bigint, turn_no bigint, session_id bigint, is_open boolean, start_us bigint, end_us bigint, first_pos bigint, deadline bigint, {', '.join(f'{c} string' for c in FIXED)}"
_TURN = "transcript_id string, turn_no bigint, session_id bigint, participant string, role string, content string, author_id string, author_label string, channel_id string, source_session string, source_ids array<string>, ts timestamp, end_ts timestamp, pos bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def placed_messages(messages: DataFrame) -> DataFrame:
    """All messages, blank ones too, as their places count; ready for :class:`TurnsOfTranscript`."""
    has = lambda c, kind="string": F.col(c).cast(kind) if c in messages.columns else F.lit(None).cast(kind)
    who = participant_of(messages)
    author = F.coalesce(filled(has("author_id")), filled(has("username")), who)
    return messages.select(
        F.col("transcript_id").cast("string").alias("transcript_id"),
        F.col("pos").cast("bigint").alias("pos"),
        who.alias("participant"),
        T.clean_text("content").alias("content"),
        F.coalesce(has("id"), F.concat(F.lit("row:"), F.col("pos").cast("string"))).alias("source_id"),
        F.unix_micros(T.parse_iso(has("timestamp"))).alias("us"),
        has("channel_id").alias("channel_id"),
        has("session_id").alias("source_session"),
        author.alias("author_id"),
        F.coalesce(filled(has("display_name")), filled(has("username")), author).alias("author_label"),
    )


class TurnsOfTranscript(StatefulProcessor):
    """The state of one transcript."""

    def __init__(self, turn_gap_seconds: float, session_gap_seconds: float, merge_unknown: bool, wait_ms: int):
        self.turn_gap, self.session_gap, self.merge_unknown, self.wait = turn_gap_seconds * 1e6, session_gap_seconds * 1e6, merge_unknown, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.early = handle.getMapState("early", "pos bigint", _MESSAGE)
        self.parts = handle.getListState("parts", "content string, source_id string")

    def _state(self) -> dict:
        if self.open.exists():
            names = [f.split()[0] for f in _OPEN.split(", ")]
            return dict(zip(names, self.open.get()))
        return {"next": 0, "turn_no": -1, "session_id": -1, "is_open": False, "start_us": None, "end_us": None, "first_pos": None, "deadline": None, **dict.fromkeys(FIXED)}

    def _goes_on(self, s: dict, m: Row) -> bool:
        if not s["is_open"] or any(s[c] != m[c] for c in ("channel_id", "source_session", "participant", "author_id")):
            return False
        if m["us"] is None or s["end_us"] is None:
            return self.merge_unknown and m["us"] is None and s["end_us"] is None
        return m["us"] - s["end_us"] <= self.turn_gap

    def _new_session(self, s: dict, m: Row) -> bool:
        if s["turn_no"] < 0 or s["channel_id"] != m["channel_id"] or s["source_session"] != m["source_session"]:
            return True
        if (m["us"] is None) != (s["end_us"] is None):
            return True
        return m["us"] is not None and m["us"] - s["end_us"] > self.session_gap

    def _take(self, s: dict, m: Row, key: str) -> Iterator[Row]:
        s["next"] = m["pos"] + 1
        if not m["content"]:
            return
        if not self._goes_on(s, m):
            yield from self._close(s, key)
            s["session_id"] += self._new_session(s, m)
            s |= {"turn_no": s["turn_no"] + 1, "is_open": True, "start_us": m["us"], "first_pos": m["pos"], **{c: m[c] for c in FIXED}}
        s["end_us"] = m["us"]
        self.parts.appendValue((m["content"], m["source_id"]))

    def _close(self, s: dict, key: str) -> Iterator[Row]:
        if s["is_open"]:
            parts = list(self.parts.get())
            self.parts.clear()
            s["is_open"] = False
            yield Row(
                transcript_id=key, turn_no=s["turn_no"], session_id=s["session_id"], participant=s["participant"], role=ROLES.get(s["participant"]),
                content="\n".join(p[0] for p in parts), author_id=s["author_id"], author_label=s["author_label"], channel_id=s["channel_id"],
                source_session=s["source_session"], source_ids=[p[1] for p in parts], ts=_time(s["start_us"]), end_ts=_time(s["end_us"]), pos=s["first_pos"],
            )

    def _ready(self, s: dict, key: str) -> Iterator[Row]:
        """Take what comes next for as long as it is there."""
        while self.early.containsKey((s["next"],)):
            at = (s["next"],)
            m = Row(*[f.split()[0] for f in _MESSAGE.split(", ")])(*self.early.getValue(at))
            self.early.removeKey(at)
            yield from self._take(s, m, key)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, names = self._state(), [f.split()[0] for f in _MESSAGE.split(", ")]
        for m in rows:
            # A place that has been passed over, or taken, is too late.
            if m["pos"] >= s["next"]:
                self.early.updateValue((m["pos"],), tuple(m[c] for c in names))
        yield from self._ready(s, key[0])
        if s["deadline"] is not None:
            self.handle.deleteTimer(s["deadline"])
        s["deadline"] = timerValues.getCurrentProcessingTimeInMs() + self.wait
        self.handle.registerTimer(s["deadline"])
        self.open.update(tuple(s.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._state()
        while waiting := sorted(k[0] for k in self.early.keys()):
            s["next"] = waiting[0]
            yield from self._ready(s, key[0])
        yield from self._close(s, key[0])
        s["deadline"] = None
        self.open.update(tuple(s.values()))

    def close(self) -> None:
        pass


def _time(us: int | None):
    from datetime import datetime, timedelta

    return None if us is None else datetime(1970, 1, 1) + timedelta(microseconds=us)


def stream_turns(
    messages: DataFrame,
    turn_gap_seconds: float = 300,
    session_gap_seconds: float = 1800,
    merge_unknown_timestamps: bool = False,
    wait_seconds: float = 60,
) -> DataFrame:
    """Turns with ``session_id`` as :func:`~chatterforge.operators.turns.aggregate_turns` would give them, from a stream in any order.

    Places of a transcript count from 0.  After ``wait_seconds`` without a message, places that are missing are passed over,
    and the open turn is given out; what comes later for a place that was passed over is left out, and what would have gone on with
    a turn that was given out begins a new one.  State is the open turn and what came too early; a transcript
    is handled in one task.  Needs the RocksDB state store, ``STATE_STORE``.
    """
    if turn_gap_seconds < 1 or session_gap_seconds < 1:
        raise ValueError("gaps must be at least 1 second")
    processor = TurnsOfTranscript(turn_gap_seconds, session_gap_seconds, merge_unknown_timestamps, int(wait_seconds * 1000))
    return placed_messages(messages).groupBy("transcript_id").transformWithState(statefulProcessor=processor, outputStructType=_TURN, outputMode="Append", timeMode="ProcessingTime")
