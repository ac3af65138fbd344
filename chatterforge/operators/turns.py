"""Participants, bursts merged into turns, and sessions cut at silences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterforge.functions import text as T
from chatterforge.operators.ordered import scan

SELF, TARGET, OTHER = "self", "target", "other"
# The spellings of a participant, and the older role names.
ALIASES = {
    "self": SELF,
    "target": TARGET,
    "other": OTHER,
    "you": SELF,
    "them": TARGET,
    "user": SELF,
    "assistant": TARGET,
    "human": SELF,
    "gpt": TARGET,
}
ROLES = {SELF: "you", TARGET: "them", OTHER: "other"}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c.cast("string") != "", c)


def participant_of(df: DataFrame) -> Column:
    """self, target or other from ``participant``, else ``role``; null where unknown."""
    raw = F.coalesce(filled(_has(df, "participant")), _has(df, "role"))
    return F.element_at(literal_map(ALIASES), T.fold(T.strip(raw)))


def prepared(messages: DataFrame) -> DataFrame:
    """Usable messages with the columns that turns are made of; the text is cleaned, blank ones are gone."""
    author = F.coalesce(filled(_has(messages, "author_id")), filled(_has(messages, "username")), F.col("participant"))
    return (
        messages.select(
            "transcript_id",
            "pos",
            participant_of(messages).alias("participant"),
            T.clean_text("content").alias("content"),
            F.coalesce(_has(messages, "id").cast("string"), F.concat(F.lit("row:"), F.col("pos").cast("string"))).alias("source_id"),
            T.parse_iso(_has(messages, "timestamp").cast("string")).alias("ts"),
            _has(messages, "channel_id").cast("string").alias("channel_id"),
            _has(messages, "session_id").cast("string").alias("source_session"),
            _has(messages, "author_id").cast("string").alias("author_id"),
            _has(messages, "username").cast("string").alias("username"),
            _has(messages, "display_name").cast("string").alias("display_name"),
        )
        .where("content <> ''")
        .withColumn("author_id", author)
        .withColumn("author_label", F.coalesce(filled(F.col("display_name")), filled(F.col("username")), F.col("author_id")))
        .drop("display_name", "username")
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    return later.cast("double") - earlier.cast("double")


def _starts_turn(gap_seconds: float, merge_unknown_timestamps: bool):
    """1 where a message does not go on with the turn of the message before."""

    def starts(row: Column, last: Column) -> Column:
        close = F.coalesce(seconds_between(row["ts"], last["ts"]) <= gap_seconds, F.lit(False))
        if merge_unknown_timestamps:
            close = close | (row["ts"].isNull() & last["ts"].isNull())
        same = (
            row["channel_id"].eqNullSafe(last["channel_id"])
            & row["source_session"].eqNullSafe(last["source_session"])
            & (row["participant"] == last["participant"])
            & (row["author_id"] == last["author_id"])
        )
        return F.when(last.isNotNull() & F.coalesce(same & close, F.lit(False)), 0).otherwise(1)

    return starts


def _starts_session(gap_seconds: float, end: str = "ts"):
    """1 where what follows the row before is another session."""

    def starts(row: Column, last: Column) -> Column:
        new = (
            last.isNull()
            | ~row["channel_id"].eqNullSafe(last["channel_id"])
            | ~row["source_session"].eqNullSafe(last["source_session"])
            | (row["ts"].isNull() != last[end].isNull())
            | F.coalesce(seconds_between(row["ts"], last[end]) > gap_seconds, F.lit(False))
        )
        return F.when(new, 1).otherwise(0)

    return starts


def message_turns(
    messages: DataFrame,
    turn_gap_seconds: float = 300,
    merge_unknown_timestamps: bool = False,
    spread: bool = False,
    session_gap_seconds: float | None = None,
) -> DataFrame:
    """Prepared messages with their ``turn_no``, from 0 in each transcript, and ``session_id`` where a session gap is given.

    A message goes on with the turn before it if channel, session, speaker and
    author are the same and it came within the gap of the previous message.
    An unknown time is never close, unless both are unknown and that is allowed.
    Messages of one transcript at one place are peers, as in SQL, and belong to one turn; the one with the smallest id comes first.
    With ``spread`` one transcript may hold any share of all messages.
    """
    if turn_gap_seconds < 1:
        raise ValueError("turn_gap_seconds must be at least 1")
    if session_gap_seconds is not None and session_gap_seconds < 1:
        raise ValueError("session_gap_seconds must be at least 1")
    turn = _starts_turn(turn_gap_seconds, merge_unknown_timestamps)
    counts = {"turn_no": turn}
    if session_gap_seconds is not None:
        session = _starts_session(session_gap_seconds)
        # A turn ends with the message before, so its end is that message's time.
        counts["session_id"] = lambda row, last: turn(row, last) * session(row, last)
    columns = ["ts", "channel_id", "source_session", "participant", "author_id"]
    numbered = scan(prepared(messages), "transcript_id", "pos", columns, counts, spread=spread, ties=["source_id"])
    return numbered.withColumns({n: F.col(n) - 1 for n in counts}).drop("previous")


def aggregate_turns(
    messages: DataFrame,
    turn_gap_seconds: float = 300,
    merge_unknown_timestamps: bool = False,
    spread: bool = False,
    session_gap_seconds: float | None = None,
) -> DataFrame:
    """One row per turn: text joined by line ends, source ids, first and last time.

    With a session gap, ``session_id`` comes from the same scan, as :func:`sessionize` would give it.
    """
    rows = message_turns(messages, turn_gap_seconds, merge_unknown_timestamps, spread, session_gap_seconds)
    parts = F.array_sort(F.collect_list(F.struct("pos", "source_id", "content", "ts")))
    fixed = ["participant", "author_id", "author_label", "channel_id", "source_session"] + ["session_id"] * (session_gap_seconds is not None)
    turns = rows.groupBy("transcript_id", "turn_no").agg(parts.alias("parts"), *[F.min_by(c, F.struct("pos", "source_id")).alias(c) for c in fixed])
    return turns.select(
        "transcript_id",
        "turn_no",
        "participant",
        F.element_at(literal_map(ROLES), F.col("participant")).alias("role"),
        F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content"),
        "author_id",
        "author_label",
        "channel_id",
        "source_session",
        F.transform("parts", lambda p: p["source_id"]).alias("source_ids"),
        F.element_at("parts", 1)["ts"].alias("ts"),
        F.element_at("parts", -1)["ts"].alias("end_ts"),
        F.element_at("parts", 1)["pos"].alias("pos"),
        *fixed[5:],
    )


def sessionize(turns: DataFrame, session_gap_seconds: float = 1800, spread: bool = False) -> DataFrame:
    """``turns`` with ``session_id``, from 0 in each transcript.

    A session ends where channel or source session change, where known and
    unknown times meet, and where the silence is longer than the gap.
    """
    if session_gap_seconds < 1:
        raise ValueError("session_gap_seconds must be at least 1")
    columns = ["ts", "end_ts", "channel_id", "source_session"]
    counted = scan(turns, "transcript_id", "turn_no", columns, {"session_id": _starts_session(session_gap_seconds, "end_ts")}, spread=spread)
    return counted.withColumn("session_id", F.col("session_id") - 1).drop("previous")


def known_time_sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of rows whose times are all known: keys, start, end and count, by Spark's session window."""
    grouped = events.groupBy(*keys, F.session_window(ts, f"{gap_seconds} seconds").alias("w"))
    return grouped.agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n")).drop("w")
