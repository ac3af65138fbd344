"""A user's own functions over chats - token counters, chat templates, reply generators - as columns.

Such a function needs something that is costly to set up: a tokenizer, a template, a model.  A hook is named and has a
maker, which each Python worker calls once; the function that it returns is then used for all batches of
rows, which come and go as Arrow arrays.  Rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructType

Chat = list[dict[str, str]]
MESSAGES = "array<struct<role:string,content:string>>"

#: What the makers gave, by the name of the hook; of this worker.
_MADE: dict[str, Any] = {}


@dataclass(frozen=True)
class Hook:
    """``make()`` gives a function of a chat, a list of ``role`` and ``content``; hooks of one name share what was made."""

    name: str
    make: Callable[[], Callable[[Chat], Any]]

    def function(self) -> Callable[[Chat], Any]:
        if self.name not in _MADE:
            _MADE[self.name] = self.make()
        return _MADE[self.name]


def _chats(column: pa.Array) -> Iterator[Chat | None]:
    for chat in column.to_pylist():
        yield None if chat is None else [dict(m) for m in chat]


def apply(hook: Hook, messages: Column, kind: DataType, clean: Callable[[Any], Any]) -> Column:
    """The hook's value for each chat, made fit for the column by ``clean``; null for a null chat."""
    arrow = {LongType: pa.int64(), StringType: pa.string()}[type(kind)]

    @F.arrow_udf(returnType=kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = hook.function()
        for batch in batches:
            yield pa.array([None if c is None else clean(f(c)) for c in _chats(batch)], arrow)

    return run(messages.cast(MESSAGES))


def count_tokens(hook: Hook, messages: Column) -> Column:
    """How many tokens a chat has by the user's counter."""
    return apply(hook, messages, LongType(), int)


def _text(value: Any) -> str:
    if not isinstance(value, str):
        raise ValueError("a chat template must render to text")
    return value


def render(hook: Hook, messages: Column) -> Column:
    """A chat by the user's template, as training would see it."""
    return apply(hook, messages, StringType(), _text)


def generate(hook: Hook, messages: Column) -> Column:
    """The user's generator's reply to each chat; empty where it gives no text."""
    return apply(hook, messages, StringType(), lambda value: value if isinstance(value, str) else "")


# What keeps a chat from being trimmed.
TOO_LONG, NO_PAIRS = "too long", "no pairs"
_TRIMMED = pa.struct([("first", pa.int32()), ("problem", pa.string())])


def _oldest_kept(chat: Chat, count: Callable[[Chat], int], budget: int) -> dict:
    """How many dialogue messages go, a user's and an assistant's at a time, until the counter is content."""
    lead = chat[:1] if chat and chat[0]["role"] == "system" else []
    spoken = chat[len(lead) :]
    gone = 0
    while count(lead + spoken[gone:]) > budget:
        pair = [m["role"] for m in spoken[gone : gone + 2]]
        if len(spoken) - gone < 3:
            return {"first": None, "problem": TOO_LONG}
        if pair != ["user", "assistant"]:
            return {"first": None, "problem": NO_PAIRS}
        gone += 2
    return {"first": gone, "problem": None}


def trim(hook: Hook, messages: Column, budget: int) -> Column:
    """``messages, problem``: the chat without its oldest pairs, so that the user's counter stays within the budget.

    A system message in front and the newest message stay.  The counter sees the whole chat each time, as what it
    counts need not add up from message to message.  Where that cannot be done, ``problem`` says why and messages is null.
    """
    shape = StructType().add("first", IntegerType()).add("problem", StringType())

    @F.arrow_udf(returnType=shape)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = hook.function()
        for batch in batches:
            yield pa.array([None if c is None else _oldest_kept(c, f, budget) for c in _chats(batch)], _TRIMMED)

    found = run(messages.cast(MESSAGES))
    lead = F.when(F.get(messages, F.lit(0))["role"] == "system", 1).otherwise(0)
    kept = F.concat(F.slice(messages, 1, lead), F.slice(messages, lead + found["first"] + 1, F.size(messages)))
    return F.struct(F.when(found["problem"].isNull(), kept).alias("messages"), found["problem"].alias("problem"))
