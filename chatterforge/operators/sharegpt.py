"""ShareGPT samples: rendering, validation, parts of a sample, overlap between datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterforge.functions import text as T
from chatterforge.operators.turns import OTHER, TARGET, filled, literal_map

LABELS = ("none", "others", "all")
CONVERSATION = "array<struct<`from`:string,value:string>>"
# Role names of the two spellings of a chat.
CHAT_ROLES = {"system": "system", "human": "user", "gpt": "assistant"}


def render_turn(turn: Column, speaker_labels: str = "none") -> Column:
    """A turn's text, with its speaker's name in front where labels are asked for; never for a target."""
    if speaker_labels not in LABELS:
        raise ValueError(f"speaker labels must be one of {', '.join(LABELS)}")
    if speaker_labels == "none":
        return turn["content"]
    label = T.strip(F.coalesce(filled(turn["author_label"]), filled(turn["author_id"])))
    labelled = turn["participant"] == OTHER if speaker_labels == "others" else turn["participant"] != TARGET
    return F.when(labelled & (label != ""), F.concat(label, F.lit(": "), turn["content"])).otherwise(turn["content"])


def conversations(history: Column | str, system_prompt: str = "", speaker_labels: str = "none") -> Column:
    """A window as ShareGPT turns; only targets answer as ``gpt``."""
    said = lambda who, what: F.struct(who.alias("from"), what.alias("value"))
    turns = F.transform(
        history, lambda t: said(F.when(t["participant"] == TARGET, "gpt").otherwise("human"), render_turn(t, speaker_labels))
    )
    if system_prompt:
        turns = F.concat(F.array(said(F.lit("system"), F.lit(system_prompt))), turns)
    return turns


def describe_problem(c: Column | str) -> Column:
    """Why a conversations array is no usable sample; null if it is."""
    c = F.col(c) if isinstance(c, str) else c
    bad = lambda t: t.isNull() | ~F.coalesce(t["from"].isin("system", "human", "gpt"), F.lit(False)) | (T.strip(t["value"]) == "")
    start = F.when(c[0]["from"] == "system", 2).otherwise(1)
    talk = F.slice(c, start, F.greatest(F.size(c) - start + 1, F.lit(0)))
    wrong = (
        (F.size(talk) == 0)
        | (F.get(talk, F.lit(0))["from"] != "human")
        | (F.element_at(c, -1)["from"] != "gpt")
        | F.exists(talk, lambda t: t["from"] == "system")
    )
    return (
        F.when(c.isNull() | (F.size(c) < 2), "expected a conversation")
        .when(F.exists(c, bad), "invalid role/content")
        .when(wrong, "require user-to-assistant dialogue")
    )


def split_sample(c: Column | str) -> tuple[Column, Column]:
    """Context turns and the answer of a sample."""
    c = F.col(c) if isinstance(c, str) else c
    return F.slice(c, 1, F.size(c) - 1), F.element_at(c, -1)["value"]


def to_chat_messages(c: Column | str) -> Column:
    """ShareGPT turns as role and content."""
    return F.transform(c, lambda t: F.struct(F.element_at(literal_map(CHAT_ROLES), t["from"]).alias("role"), t["value"].alias("content")))


def answers(c: Column | str) -> Column:
    """Every gpt text of a sample, in order."""
    return F.transform(F.filter(c, lambda t: t["from"] == "gpt"), lambda t: t["value"])


def assistant_messages(messages: Column | str) -> Column:
    """Every assistant text of role and content messages, in order."""
    return F.transform(F.filter(messages, lambda t: t["role"] == "assistant"), lambda t: t["content"])


def canonical(c: Column | str) -> Column:
    """A string that is equal for equal samples."""
    return F.to_json(c)


def overlap(train: DataFrame, validation: DataFrame) -> DataFrame:
    """The training samples that are validation samples too."""
    digest = F.sha2(canonical("conversations"), 256)
    return train.join(validation.select(digest.alias("__d")).distinct(), digest == F.col("__d"), "left_semi")


def require_disjoint(train: DataFrame, validation: DataFrame) -> None:
    if not overlap(train, validation).isEmpty():
        raise ValueError("Training and validation datasets overlap")
