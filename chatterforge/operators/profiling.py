"""Length, marker and duplicate statistics of texts, and summaries of whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterforge.functions import text as T
from chatterforge.operators.sharegpt import answers, canonical
from chatterforge.operators.turns import TARGET, participant_of
from chatterforge.operators.windows import build_windows, usable_sessions


def _measured(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return texts.select(*keys, F.size(T.word_tokens(text_col)).cast("bigint").alias("words"), F.length(F.coalesce(text_col, F.lit(""))).cast("bigint").alias("chars"))


def length_stats(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Counts, means, median, p90 (the value at place int(0.9 n)), largest, share of at most one word.

    Lengths are counted first: a group moves one row per distinct length, and the
    ranks come from running sums over these.
    """
    measured = _measured(texts, keys, text_col)
    sizes = measured.groupBy(*keys, "words").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    order = Window.partitionBy(*keys).orderBy("words")
    ranked = sizes.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("words")))
    n = F.col("all")
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("words") * F.col("n")) / F.sum("n")).alias("mean_words"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median_words"),
        at(F.least(n - 1, F.floor(n * F.lit(0.9).cast("double")))).alias("p90_words"),
        F.max("words").alias("max_words"),
        (F.sum("chars") / F.sum("n")).alias("mean_characters"),
        (F.sum(F.when(F.col("words") <= 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("single_word_share"),
    )


def content_markers(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Links, code blocks and emoji."""
    counted = {"urls": T.count_urls, "code_blocks": T.count_code_blocks, "emoji": T.count_emoji}
    return texts.groupBy(*keys).agg(*[F.coalesce(F.sum(f(text_col)), F.lit(0)).alias(n) for n, f in counted.items()])


def duplicate_counts(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Exact and near-exact repeats, and distinct near-exact forms."""
    text = F.coalesce(text_col, F.lit(""))
    digests = texts.select(*keys, F.sha2(text, 256).alias("exact"), F.sha2(T.duplicate_key(text), 256).alias("near"))
    exact = digests.groupBy(*keys, "near", "exact").agg(F.count(F.lit(1)).alias("n"))
    near = exact.groupBy(*keys, "near").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("e"))
    return near.groupBy(*keys).agg(
        F.sum("e").alias("exact_duplicates"), F.sum(F.col("n") - 1).alias("near_duplicates"), F.count(F.lit(1)).alias("distinct")
    )


def message_counts(messages: DataFrame) -> DataFrame:
    """Per transcript: messages by participant, blank and invalid ones, attachments, times known, first and last."""
    who = participant_of(messages)
    rows = messages.withColumn("__who", who).withColumn("__blank", T.clean_text("content") == "").withColumn("__ts", T.parse_iso(F.col("timestamp").cast("string")))
    usable = F.col("__who").isNotNull() & ~F.col("__blank")
    count = lambda c, name: F.count_if(c).alias(name)
    stamp = F.when(usable & F.col("__ts").isNotNull(), F.col("__ts"))
    attachments = F.size(F.coalesce("attachments", F.array().cast("array<string>"))) if "attachments" in messages.columns else F.lit(0)
    return rows.groupBy("transcript_id").agg(
        count(usable, "total"),
        *[count(usable & (F.col("__who") == p), p) for p in ("self", "target", "other")],
        count(F.col("__who").isNotNull() & F.col("__blank"), "empty"),
        count(F.col("__who").isNull(), "invalid"),
        F.sum(attachments).cast("bigint").alias("attachments"),
        (F.count(stamp) / F.greatest(F.count_if(usable), F.lit(1))).alias("coverage"),
        F.min_by(stamp, F.when(stamp.isNotNull(), F.col("pos"))).alias("first_ts"),
        F.max_by(stamp, F.when(stamp.isNotNull(), F.col("pos"))).alias("last_ts"),
    )


def session_counts(turns: DataFrame, window_size: int = 6) -> DataFrame:
    """Per transcript: turns, target turns, sessions, usable sessions and windows; ``turns`` has session_id."""
    base = turns.groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("participant") == TARGET).alias("target_turns"),
        (F.max("session_id") + 1).alias("sessions"),
    )
    usable = usable_sessions(turns, window_size).groupBy("transcript_id").agg(F.countDistinct("session_id").alias("usable_sessions"))
    windows = build_windows(turns, window_size).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("windows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    joined = base.join(usable, "transcript_id", "left").join(windows, "transcript_id", "left")
    return joined.select("transcript_id", "turns", "target_turns", "sessions", zero("usable_sessions"), zero("windows"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """One row: samples, equal samples, turns per sample; ``samples`` has conversations."""
    turns = F.size("conversations").cast("bigint")
    distinct = samples.groupBy(F.sha2(canonical("conversations"), 256).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(turns).alias("t"), F.max(turns).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return distinct.agg(
        zero(F.sum("n")).alias("samples"),
        zero(F.sum(F.col("n") - 1)).alias("duplicate_samples"),
        zero(F.sum("t") / F.sum("n")).alias("mean_turns"),
        zero(F.max("m")).alias("max_turns"),
    )


def target_responses(samples: DataFrame) -> DataFrame:
    """Every answer of a dataset, one per row, other columns kept."""
    rest = [c for c in samples.columns if c != "conversations"]
    return samples.select(*rest, F.posexplode(answers("conversations")).alias("answer_no", "text"))
