"""Parse, format, inspect, audit and evaluate: files in, files or reports out."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterforge.operators import audit, profiling, style
from chatterforge.operators.identity import assign_participants, normalize_messages
from chatterforge.operators.quality import REASONS, FilterConfig, classify, filter_report
from chatterforge.operators.sharegpt import LABELS, conversations
from chatterforge.operators.splits import SPLITS, drop_duplicate_samples, split_sessions, split_summary
from chatterforge.operators.turns import TARGET, aggregate_turns
from chatterforge.operators.validation import known_participants, require_valid
from chatterforge.operators.windows import SESSION, build_windows, placed, usable_sessions
from chatterforge.runtime import delete_folder, materialize, number_rows, sent
from chatterforge.sources.datasets import file_info, kind_of, publish, read_predictions, read_sharegpt, sharegpt_problems, write_sharegpt
from chatterforge.sources.exports import read_export, read_parsed


@dataclass(frozen=True)
class FormatConfig:
    window_size: int = 6
    turn_gap_seconds: int = 300
    session_gap_seconds: int = 1800
    val_ratio: float = 0.075
    test_ratio: float = 0.075
    strategy: str = "chronological"
    seed: int | None = None
    system_prompt: str = ""
    speaker_labels: str = "none"
    merge_unknown_timestamps: bool = False
    drop_duplicate_samples: bool = True
    #: Order the table over range partitions, for transcripts too large for one task each.
    spread: bool = True
    filters: FilterConfig = field(default_factory=FilterConfig)

    def __post_init__(self) -> None:
        if self.turn_gap_seconds < 1 or self.session_gap_seconds < self.turn_gap_seconds:
            raise ValueError("Require 1 <= turn gap <= session gap")
        if self.speaker_labels not in LABELS:
            raise ValueError(f"speaker labels must be one of {', '.join(LABELS)}")


def parse_export(spark: SparkSession, path: str, self_ref: str | None = None, target_ref: str | None = None, others: str = "context") -> tuple[DataFrame, dict]:
    """Labelled messages of an export, and its summary."""
    raw = read_export(spark, path)
    records = materialize(normalize_messages(raw))
    messages, summary = assign_participants(records, self_ref, target_ref, others)
    names = [r[0] for r in messages.where("username <> ''").select("username").distinct().orderBy("username").collect()]
    channel = raw.select("channel_name").limit(1).collect()
    return messages, {
        "channel": channel[0][0] if channel else "DM",
        "participants": names,
        "total_messages": sum(summary["counts"].values()),
        **summary,
    }


def session_turns(messages: DataFrame, config: FormatConfig) -> DataFrame:
    """Turns with sessions from messages that the filters kept."""
    return aggregate_turns(messages, config.turn_gap_seconds, config.merge_unknown_timestamps, config.spread, config.session_gap_seconds)


def split_samples(turns: DataFrame, config: FormatConfig) -> tuple[DataFrame, DataFrame]:
    """(split turns of usable sessions, their windows with ``split`` and ``duplicate``)."""
    usable = usable_sessions(turns, config.window_size)
    split = materialize(split_sessions(usable, config.val_ratio, config.test_ratio, config.strategy, config.seed))
    places = split.select(*SESSION, "split", "session_no").distinct()
    windows = build_windows(split, config.window_size).join(sent(places), list(SESSION))
    if config.drop_duplicate_samples:
        return split, drop_duplicate_samples(windows, ["session_no", "turn_no"])
    return split, windows.withColumn("duplicate", F.lit(False))


def format_dataset(messages: DataFrame, prefix: str, config: FormatConfig = FormatConfig()) -> dict:
    """Write the three ShareGPT datasets and the manifest; gives the manifest.

    A split that is switched off is written empty, so that no older one is used in its place.  The
    datasets are written beside their places and put there together, the manifest last; what stops the job before leaves
    the older ones and their manifest as they were.
    """
    spark = messages.sparkSession
    marked = materialize(classify(messages, config.filters))
    kept = marked.where("reason is null")
    require_valid(kept, config.spread)
    turns = session_turns(kept, config)
    turns = placed(turns) if config.spread else materialize(turns)
    split, samples = split_samples(turns, config)
    samples = materialize(samples)
    outputs, staged, mark = {}, {}, uuid.uuid4().hex
    for name in SPLITS:
        outputs[name] = f"{prefix}_{name}_sharegpt.jsonl"
        staged[f"{prefix}_{name}.writing-{mark}"] = outputs[name]
    rows = conversations("history", config.system_prompt, config.speaker_labels).alias("conversations")
    try:
        for name, folder in zip(SPLITS, staged):
            mine = samples.where((F.col("split") == name) & ~F.col("duplicate")).orderBy("session_no", "turn_no")
            write_sharegpt(mine.select(rows), folder)
    except BaseException:
        for folder in staged:
            delete_folder(spark, folder)
        raise
    reasons = {r["reason"]: r["n"] for r in filter_report(marked).collect()}
    counts = turns.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct(*SESSION).alias("sessions")).first()
    summary = split_summary(split, samples).collect()
    manifest = {
        "config": {**asdict(config), "output_prefix": prefix},
        "filtering": {
            "kept": reasons.get("kept", 0),
            "removed": sum(n for r, n in reasons.items() if r != "kept"),
            "by_reason": {r: reasons[r] for r in REASONS if r in reasons},
        },
        "turns": counts["turns"],
        "sessions": counts["sessions"],
        "usable_sessions": sum(r["sessions"] for r in summary),
        "splits": {n: {k: v for k, v in r.asDict().items() if k != "split"} for n in SPLITS for r in summary if r["split"] == n},
        "outputs": outputs,
    }
    publish(spark, staged, f"{prefix}_split_manifest.json", manifest)
    return manifest


def _row(df: DataFrame) -> dict:
    """The one row of a table that has at most one."""
    found = df.collect()
    return {k: v for k, v in found[0].asDict().items() if k not in ("transcript_id", "all")} if found else {}


def _text_report(texts: DataFrame) -> dict:
    one = texts.withColumn("all", F.lit(1))
    lengths = _row(profiling.length_stats(one, ["all"]))
    for name, digits in (("mean_words", 2), ("mean_characters", 2), ("single_word_share", 3)):
        if name in lengths:
            lengths[name] = round(lengths[name], digits)
    return {
        "target_responses": lengths or {"count": 0},
        "markers": _row(profiling.content_markers(one, ["all"])) or {"urls": 0, "code_blocks": 0, "emoji": 0},
        "duplicates": _row(profiling.duplicate_counts(one, ["all"])) or {"exact_duplicates": 0, "near_duplicates": 0, "distinct": 0},
    }


def inspect_transcripts(messages: DataFrame, window_size: int = 6, turn_gap_seconds: int = 300, session_gap_seconds: int = 1800) -> DataFrame:
    """One row per transcript: messages by speaker, turns, sessions, target texts, markers, repeats and times."""
    turns = placed(aggregate_turns(known_participants(messages), turn_gap_seconds, spread=True, session_gap_seconds=session_gap_seconds))
    said = turns.where(F.col("participant") == TARGET).select("transcript_id", F.col("content").alias("text"))
    key = ["transcript_id"]
    parts = [profiling.session_counts(turns, window_size), *[f(said, key) for f in (profiling.length_stats, profiling.content_markers, profiling.duplicate_counts)]]
    found = profiling.message_counts(messages)
    for part in parts:
        found = found.join(part, key, "left")
    return found


def inspect_parsed(messages: DataFrame, window_size: int = 6, turn_gap_seconds: int = 300, session_gap_seconds: int = 1800) -> dict:
    """Summary of one parsed transcript; :func:`inspect_transcripts` has those of many."""
    several = messages.select("transcript_id").distinct().limit(2).count()
    if several > 1:
        raise ValueError("more than one transcript; use inspect_transcripts for a row of each")
    counts = _row(profiling.message_counts(messages))
    turns = placed(aggregate_turns(known_participants(messages), turn_gap_seconds, spread=True, session_gap_seconds=session_gap_seconds))
    sessions = _row(profiling.session_counts(turns, window_size))
    iso = lambda t: None if t is None else t.isoformat()
    return {
        "kind": "parsed transcript",
        "messages": {k: counts.get(k, 0) for k in ("total", "self", "target", "other", "empty", "invalid")},
        "turns": {
            "total": sessions.get("turns", 0),
            "target": sessions.get("target_turns", 0),
            "sessions": sessions.get("sessions", 0),
            "usable_sessions": sessions.get("usable_sessions", 0),
        },
        **_text_report(turns.where(F.col("participant") == TARGET).select(F.col("content").alias("text"))),
        "attachments": counts.get("attachments", 0),
        "timestamps": {"coverage": round(counts.get("coverage", 0.0), 3), "first": iso(counts.get("first_ts")), "last": iso(counts.get("last_ts"))},
        "usable_training_samples": sessions.get("windows", 0),
    }


def inspect_sharegpt(spark: SparkSession, path: str) -> dict:
    """Summary of a ShareGPT dataset."""
    samples = materialize(read_sharegpt(spark, path, strict=False))
    info = file_info(spark, path).collect()
    counts = _row(profiling.sample_counts(samples))
    return {
        "kind": "ShareGPT dataset",
        "samples": counts["samples"],
        "invalid_rows": sum(r["invalid_rows"] for r in info),
        "problems": [f"{r['file'].rsplit('/', 1)[-1]}:{r['line_no']}: {r['problem']}" for r in sharegpt_problems(spark, path).collect()],
        "duplicate_samples": counts["duplicate_samples"],
        "turns_per_sample": {"mean": round(counts["mean_turns"], 2), "max": counts["max_turns"]},
        **_text_report(profiling.target_responses(samples).select("text")),
        "sha256": info[0]["sha256"] if len(info) == 1 else None,
    }


def inspect_path(spark: SparkSession, path: str, **gaps: int) -> dict:
    return inspect_sharegpt(spark, path) if kind_of(path) == "sharegpt" else inspect_parsed(read_parsed(spark, path), **gaps)


def audit_dataset(spark: SparkSession, path: str, long_chars: int = audit.LONG_RESPONSE_CHARS, repeated: int = audit.REPEATED_AT_LEAST, most: int = 10) -> dict:
    """Counts of a privacy audit and the places of the first serious findings; values are redacted."""
    samples = _in_order(read_sharegpt(spark, path, strict=False), "sample_no")
    found = materialize(audit.findings(audit.sample_texts(samples)))
    rules = audit.rule_counts(found).collect()
    serious = found.where(F.col("severity").isin("high", "medium")).orderBy("sample_no", "turn_no", "finding_no").limit(most)
    return {
        **_row(audit.audit_totals(samples, long_chars, repeated)),
        "invalid_rows": sum(r["invalid_rows"] for r in file_info(spark, path).collect()),
        "categories": {r["rule"]: {"count": r["n"], "severity": r["severity"]} for r in rules},
        "severity_counts": {r["severity"]: r["n"] for r in audit.severity_counts(found).collect()},
        "findings": [{k: r[k] for k in ("rule", "severity", "sample_no", "role", "redacted")} for r in serious.collect()],
    }


def _in_order(lines: DataFrame, name: str) -> DataFrame:
    """``lines`` with numbers from 1 over all files, by file and line."""
    return number_rows(lines, ["file", "line_no"], name).withColumn(name, F.col(name) + 1)


def evaluate_predictions(spark: SparkSession, dataset: str, predictions: dict[str, str], limit: int | None = None) -> dict:
    """Score prediction files against the last answers of a dataset; both may be folders of part files."""
    samples = read_sharegpt(spark, dataset)
    references = _in_order(samples.select("file", "line_no", F.element_at("conversations", -1)["value"].alias("text")), "ordinal")
    if limit:
        references = references.where(F.col("ordinal") <= limit)
    references = materialize(references.select("ordinal", "text"))
    texts = references.select(F.lit("reference").alias("corpus"), F.col("ordinal").alias("resp_id"), "text")
    for name, path in predictions.items():
        mine = _in_order(read_predictions(spark, path), "ordinal").select("ordinal", "text")
        texts = texts.unionByName(style.pair_predictions(references, mine, name).where(F.col("corpus") != "reference"))
    return style.evaluate(texts, "reference")
