"""Which characters of a rendered chat keep training loss when only answers count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Four turns whose texts no template holds; user and assistant take turns.
PROBES = tuple(
    {"role": role, "content": f"\x01{name}-{number}\x01"} for number in (1, 2) for role, name in (("user", "asks"), ("assistant", "says"))
)


def turn_marker(render: Callable[..., str], n: int) -> str:
    """What the template puts before the text of the ``n``-th probe turn.

    The chat is rendered with and without its last turn.  What the turn adds in front of its text
    is its marker; where it adds nothing that can be seen, or changes what stood there, the
    marker is all that separates its text from the text before.
    """
    shorter, longer = (render([dict(p) for p in PROBES[:k]], add_generation_prompt=False) for k in (n - 1, n))
    if not isinstance(shorter, str) or not isinstance(longer, str):
        raise ValueError("a chat template must render to text")
    before, text = PROBES[n - 2]["content"], PROBES[n - 1]["content"]
    if longer.count(before) != 1 or longer.count(text) != 1:
        raise ValueError("a chat template must show the text of each turn exactly once")
    start, end = longer.index(before) + len(before), longer.index(text)
    added = longer[max(start, len(shorter)) : end] if longer.startswith(shorter) else ""
    return added if added.strip() else longer[start:end]


def derive_markers(render: Callable[..., str]) -> tuple[str, str]:
    """(instruction, response): what the template puts in front of a user's and an assistant's text.

    ``render(messages, add_generation_prompt=False)`` gives the rendered chat.
    """
    markers = {"instruction": turn_marker(render, 3), "response": turn_marker(render, 4)}
    whole = render([dict(p) for p in PROBES], add_generation_prompt=False)
    for name, marker in markers.items():
        if not marker.strip():
            raise ValueError(f"the chat template has no visible {name} marker")
        if whole.count(marker) * 2 != len(PROBES):
            raise ValueError(f"the {name} marker {marker!r} is not there once for each of its turns")
    first, second = markers.values()
    if first in second or second in first:
        raise ValueError("the markers of user and assistant cannot be told apart")
    return first, second


_SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(numbers: Column, chunk: int = 256) -> Column:
    """For each number of an array the sum of those before it; added up in chunks, as a fold copies what it has so far."""
    zero = F.lit(0).cast("bigint")

    def fold(xs: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("before"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before"))
        return F.aggregate(xs, start, step, lambda a: a["before"])

    def by_chunks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / chunk).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * chunk + 1, chunk))
        total = lambda c: F.aggregate(c, zero, lambda a, x: a + x)
        found = _let(chunks, lambda cs: F.flatten(F.zip_with(cs, fold(F.transform(cs, total)), lambda c, above: F.transform(fold(c), lambda x: x + above))))
        return F.when(F.size(xs) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(numbers, lambda x: x.cast("bigint")), by_chunks)


def masked_spans(rendered: Column, instruction: str, response: str) -> Column:
    """(start, end, text) of each stretch that keeps loss: after a response marker, up to the next instruction.

    Answers that follow each other directly overlap, as the later lies inside the earlier stretch.  All places come from
    one pass over each kind of marker, so the work is linear in a chat but for sorting the places.
    """
    # Pieces begin with each instruction, those that overlap included.
    pieces = F.split(rendered, f"(?={_literal(instruction)})", -1)
    after = F.filter(sums_before(F.transform(pieces, F.length)), lambda x: x > 0)
    places = F.concat(F.when(rendered.startswith(instruction), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), after)
    parts = F.split(rendered, _literal(response), -1)

    def spans(x: Column) -> Column:
        parts, ends = x["parts"], x["ends"]
        before = sums_before(F.transform(parts, lambda p: F.length(p) + len(response)))
        # Where answers begin and instructions begin, in order; an answer comes first where both do.
        begins = F.transform(F.slice(before, 2, F.size(parts)), lambda at: F.struct(at.alias("at"), F.lit(0).alias("kind")))
        merged = F.array_sort(F.concat(begins, F.transform(ends, lambda at: F.struct(at.alias("at"), F.lit(1).alias("kind")))))
        starts = F.filter(F.transform(merged, lambda m, i: F.struct(m["at"].alias("at"), m["kind"].alias("kind"), i.alias("i"))), lambda m: m["kind"] == 0)

        def span(m: Column, n: Column) -> Column:
            # Of what stands before it in order, n are answers and the others instructions.
            end = F.coalesce(F.get(ends, m["i"] - n), F.length(rendered).cast("bigint"))
            own = F.get(parts, n + 1)
            size = (end - m["at"]).cast("int")
            text = F.when(size <= F.length(own), F.substring(own, F.lit(1), size)).otherwise(F.substring(rendered, (m["at"] + 1).cast("int"), size))
            return F.struct(m["at"].alias("start"), end.alias("end"), text.alias("text"))

        return F.transform(starts, span)

    found = _let(F.struct(parts.alias("parts"), places.alias("ends")), spans)
    return F.when(F.contains(rendered, F.lit(response)), found).otherwise(F.array().cast(_SPANS))


def _literal(text: str) -> str:
    """A pattern that matches this text only."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def masking_problems(chats: DataFrame, instruction: str, response: str) -> DataFrame:
    """``chats`` with ``problem``: null where every answer lies in a stretch of its own.

    ``chats`` has rendered and answers, an array of texts.
    """
    spans = masked_spans(F.col("rendered"), instruction, response)
    inside = F.zip_with("__spans", "answers", lambda s, a: (F.trim(a) == "") | s["text"].contains(a))
    n, m = F.size("__spans"), F.size("answers")
    count = F.concat(n.cast("string"), F.lit(" stretches keep loss, but there are "), m.cast("string"), F.lit(" answers"))
    problem = F.when(n != m, count).when(~F.forall(inside, lambda x: x), "an answer lies outside the stretch that keeps loss")
    return chats.withColumn("__spans", spans).withColumn("problem", problem).drop("__spans")


def verify_masking(chats: DataFrame, instruction: str, response: str) -> None:
    bad = masking_problems(chats, instruction, response).where("problem is not null").limit(1).collect()
    if bad:
        raise ValueError(bad[0]["problem"])
