"""Context windows that end on a target turn, usable sessions, history trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chatterforge.operators.ordered import scan
from chatterforge.operators.turns import TARGET
from chatterforge.runtime import materialize, sent

TURN_FIELDS = ("participant", "content", "author_id", "author_label", "source_ids")
SESSION = ("transcript_id", "session_id")


#: The number of a turn in its transcript, without gaps, in tables whose windows are dealt in blocks; and turns in a block.
PLACE = "__place"
BLOCK = 1000


def placed(turns: DataFrame) -> DataFrame:
    """``turns``, kept, with their places; windows over them are taken block by block, so that a session may hold any share of all turns."""
    counted = scan(turns, "transcript_id", "turn_no", counts={PLACE: lambda row, last: F.lit(1)}, spread=True)
    return materialize(counted.withColumn(PLACE, F.col(PLACE) - 1).drop("previous"))


def _framed(turns: DataFrame, window_size: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """``turns`` with columns over the last ``window_size`` turns of the session.

    Each block of a table with places begins with copies of the turns before it, which are dropped at the end.
    """
    keys, last = list(SESSION), window_size - 1
    blocks = PLACE in turns.columns
    if blocks:
        # A block is no shorter than what reaches over its edge.
        size = max(BLOCK, last)
        at, own = F.col(PLACE) % size, F.floor(F.col(PLACE) / size)
        mine, copy = (F.struct(b.alias("block"), F.lit(c).alias("copy")) for b, c in ((own, False), (own + 1, True)))
        turns = turns.withColumn("__at", F.explode(F.when(at >= size - last, F.array(mine, copy)).otherwise(F.array(mine))))
        turns = turns.withColumns({"__block": F.col("__at.block"), "__copy": F.col("__at.copy")}).drop("__at")
        keys.append("__block")
    frame = Window.partitionBy(*keys).orderBy("turn_no").rowsBetween(-last, 0)
    framed = turns.withColumns({n: c(frame) for n, c in columns.items()})
    return framed.where(~F.col("__copy")).drop("__block", "__copy", PLACE) if blocks else framed


def with_history(turns: DataFrame, window_size: int = 6, fields: tuple[str, ...] = TURN_FIELDS) -> DataFrame:
    """``turns`` with ``history``: the last turns of the session, from a context turn to the turn itself.

    Null where the turn is not a target's or has no context in reach.
    """
    if window_size < 2:
        raise ValueError("window must be at least 2")
    kept = [f for f in fields if f in turns.columns]
    framed = _framed(turns, window_size, {"history": lambda frame: F.collect_list(F.struct(*kept)).over(frame)})
    first = F.array_position(F.transform("history", lambda t: t["participant"] != TARGET), True)
    usable = (F.col("participant") == TARGET) & (first > 0)
    return framed.withColumn("history", F.when(usable, F.slice("history", first.cast("int"), F.size("history"))))


def build_windows(turns: DataFrame, window_size: int = 6) -> DataFrame:
    """``transcript_id, session_id, turn_no, history``: one row per window."""
    return with_history(turns, window_size).where("history is not null").select(*SESSION, "turn_no", "history")


def usable_sessions(turns: DataFrame, window_size: int = 6) -> DataFrame:
    """The turns of the sessions that give at least one window."""
    context = F.max(F.when(F.col("participant") != TARGET, 1).otherwise(0))
    gives = F.when(F.col("participant") == TARGET, F.col("__context")).otherwise(0)
    if PLACE not in turns.columns:
        reached = _framed(turns, window_size, {"__context": context.over}).withColumn("__usable", F.max(gives).over(Window.partitionBy(*SESSION)))
        return reached.where("__usable = 1").drop("__context", "__usable")
    # The table is at hand, and its sessions may be few: they are sent, so that no session moves as one.
    reached = _framed(turns.select(*SESSION, "turn_no", "participant", PLACE), window_size, {"__context": context.over})
    found = sent(materialize(reached.where(gives == 1).select(F.col("transcript_id").alias("__t"), F.col("session_id").alias("__s")).distinct()))
    return turns.join(found, F.col("transcript_id").eqNullSafe(F.col("__t")) & F.col("session_id").eqNullSafe(F.col("__s")), "left_semi")


def trim_history(messages: DataFrame, cost: Column, budget: int, keys: list[str], order: str = "pos") -> DataFrame:
    """Drop the oldest user and assistant pairs of each chat until the rest fits the budget.

    ``messages`` has role and content; ``cost`` is what one message adds.  System
    messages and the newest message stay; a chat that still does not fit raises an error.
    """
    # Dialogue messages are numbered from the newest; pairs are dropped from the far end.
    spoken = F.when(F.col("role") != "system", 1).otherwise(0)
    behind = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counted = (
        messages.withColumn("__cost", cost)
        .withColumn("__spoken", spoken)
        .withColumn("__nth", F.sum("__spoken").over(behind))
        .withColumn("__tail", F.sum(F.col("__cost") * F.col("__spoken")).over(behind))
        .withColumn("__system", F.sum(F.col("__cost") * (1 - F.col("__spoken"))).over(whole))
        .withColumn("__n", F.sum("__spoken").over(whole))
    )
    # Whole pairs go: what stays has the parity of the whole and at least one message.
    fits = (F.col("__spoken") == 1) & (F.col("__tail") + F.col("__system") <= budget) & ((F.col("__n") - F.col("__nth")) % 2 == 0)
    longest = counted.withColumn("__keep", F.max(F.when(fits, F.col("__nth"))).over(whole))
    failed = F.raise_error(F.lit("The newest message does not fit the context budget")).cast("boolean")
    stays = F.when(F.col("__keep").isNull(), failed).otherwise((F.col("__spoken") == 0) | (F.col("__nth") <= F.col("__keep")))
    return longest.where(stays).drop("__cost", "__spoken", "__nth", "__tail", "__system", "__n", "__keep")
