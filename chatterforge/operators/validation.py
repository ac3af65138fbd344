"""Bad records as rows, and the first of them as an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterforge.functions import text as T
from chatterforge.operators.ordered import scan
from chatterforge.operators.turns import literal_map, participant_of, prepared


# The codes of bad messages, and what an error says of them.
SAYS = {
    "no_author": "text without an author id or name",
    "bad_attachments": "attachments are no list",
    "unknown_participant": "the speaker is none of self, target and other",
    "duplicate_id": "this message id stands above already",
    "order": "this message is older than one above it",
}


def message_violations(messages: DataFrame, spread: bool = False) -> DataFrame:
    """``transcript_id, pos, code, detail`` of unknown participants, repeated ids and times that go back.

    A time goes back where it is before the last known one above.  Where the table has a ``violation`` of
    :func:`~chatterforge.operators.identity.normalize_messages`, it is listed, too; records that have no
    speakers yet are not asked for them.  Blank messages are not looked at.  Of the messages that bear an id, all but one are repeated,
    also where several stand at its first place.  With ``spread`` one transcript, and one id in it, may hold any share of all messages.
    """
    rows = prepared(messages)
    checked = scan(rows, "transcript_id", "pos", ["ts", "pos", "source_id"], known=["ts"], spread=spread, ties=["source_id", "ts"])
    ids = rows.groupBy(F.col("transcript_id").alias("of"), F.col("source_id").alias("id")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Peers of one id stand side by side.
    twin = F.col("previous")["pos"].eqNullSafe(F.col("pos")) & (F.col("previous")["source_id"] == F.col("source_id"))
    places = checked.select("transcript_id", "pos", "source_id", twin.alias("twin"))
    again = places.join(ids, F.col("transcript_id").eqNullSafe(F.col("of")) & (F.col("source_id") == F.col("id"))).where(F.col("twin") | ~F.col("pos").eqNullSafe(F.col("first")))
    found = [
        again.select("transcript_id", "pos", F.lit("duplicate_id").alias("code")),
        checked.where(F.col("ts") < F.col("known_ts")).select("transcript_id", "pos", F.lit("order").alias("code")),
    ]
    if {"participant", "role"} & set(messages.columns):
        found.append(checked.where(F.col("participant").isNull()).select("transcript_id", "pos", F.lit("unknown_participant").alias("code")))
    if "violation" in messages.columns:
        found.append(messages.where("violation is not null").select("transcript_id", "pos", F.col("violation").alias("code")))
    listed = found[0]
    for more in found[1:]:
        listed = listed.unionByName(more)
    return listed.withColumn("detail", F.element_at(literal_map(SAYS), F.col("code")))


def require_valid(messages: DataFrame, spread: bool = False) -> None:
    """Raise an error for the first bad message; of several faults of one message, for the first in the order of ``SAYS``."""
    rank = F.array_position(F.lit(list(SAYS)), F.col("code"))
    bad = message_violations(messages, spread).orderBy("transcript_id", "pos", rank).limit(1).collect()
    if bad:
        raise ValueError(f"Message {bad[0]['pos']}: {bad[0]['detail']}")


def known_participants(messages: DataFrame) -> DataFrame:
    """Messages whose speaker is known and whose text is not blank."""
    return messages.where(participant_of(messages).isNotNull() & (T.clean_text("content") != ""))
