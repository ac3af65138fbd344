r"""Text functions on string columns.

Patterns carry ``(?U)`` where ``\s``, ``\w`` or ``\d`` must follow Unicode, and ``(?s)``
where a dot must match line ends.  A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the text functions.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
URL = r"""(?iU)(?:https?://|www\.)[^\s<>"']+"""
CODE_BLOCK = r"(?s)```.*?```"
EMOJI = r"[\x{1f000}-\x{1faff}\x{2600}-\x{27bf}\x{2b00}-\x{2bff}\x{fe0f}]"
CUSTOM_EMOJI = r"(?U)<a?:\w+:\d+>"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
SENTENCE_END = r"(?U)(?<=[.!?…])\s+|\n+"
PUNCTUATION = ".,!?;:'\"()[]{}-_/\\*~`@#&%+=<>|^$…"
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?([+-]\d{2}(:?\d{2}(:\d{2})?)?|Z)?)?$"
)


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def has_text(c: Column | str) -> Column:
    """Whether anything is left by :func:`strip`."""
    return _text(c).rlike(r"(?U)\S")


def clean_text(c: Column | str) -> Column:
    """Control characters removed, blanks collapsed, at most one empty line in a row, stripped."""
    bare = F.regexp_replace(_text(c), CONTROL, "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def parse_iso(c: Column | str) -> Column:
    """Timestamp of an extended ISO 8601 string; no offset means UTC, anything else is null.

    Needs a session time zone of UTC.
    """
    c = F.col(c) if isinstance(c, str) else c
    dotted = F.regexp_replace(c, ",", ".")
    hours = F.regexp_replace(dotted, r"(:\d{2}(?:\.\d+)?|T\d{2}| \d{2})([+-]\d{2})$", "$1$2:00")
    return F.when(c.rlike(ISO_TIMESTAMP), hours.try_cast("timestamp"))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, inner apostrophes included."""
    return F.transform(F.regexp_extract_all(_text(c), F.lit(WORD), F.lit(0)), F.lower)


def sentences(c: Column | str) -> Column:
    """Pieces between sentence ends and line ends, stripped, without empty ones."""
    return F.filter(F.transform(F.split(_text(c), SENTENCE_END), strip), lambda x: x != "")


def count_emoji(c: Column | str) -> Column:
    t = _text(c)
    return (F.regexp_count(t, F.lit(EMOJI)) + F.regexp_count(t, F.lit(CUSTOM_EMOJI))).cast("bigint")


def count_urls(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(URL)).cast("bigint")


def count_code_blocks(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(CODE_BLOCK)).cast("bigint")


def strip_code_blocks(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), CODE_BLOCK, " ")


def _folds() -> tuple[str, str, dict[str, str], str]:
    """What is left of full case folding after lower case: characters that become one other, those that become several, and a class of both.

    Made from Python's tables.  Letters that came into Unicode after those that the JVM knows are folded here in either case.
    """
    newer = lambda c: ord(c) >= 0xA7C0 or c in "\u1c89\u2c2f"
    every = (chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000)
    left = {c: c.casefold() for c in every if c != "ß" and c.casefold() != c and (c.lower() == c or newer(c))}
    one = {c: f for c, f in left.items() if len(f) == 1}
    ranges: list[list[int]] = []
    for i in map(ord, left):
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    chosen = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
    return "".join(one), "".join(one.values()), {c: f for c, f in left.items() if len(f) > 1}, chosen


_ONE, _BECOMES, _SEVERAL, FOLDED = _folds()


def fold(c: Column | str) -> Column:
    """Full case folding, as Python's ``casefold``; only texts with one of its rarer characters take the longer way."""
    lower = F.replace(F.lower(_text(c)), F.lit("ß"), F.lit("ss"))
    several = "[" + "".join(_SEVERAL) + "]"
    # Characters that become several are replaced one by one, in the texts that have any.
    spread = F.aggregate(
        F.map_entries(F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])),
        lower,
        lambda text, e: F.replace(text, e["key"], e["value"]),
    )
    longer = F.when(lower.rlike(several), spread).otherwise(lower)
    return F.when(lower.rlike(FOLDED), F.translate(longer, _ONE, _BECOMES)).otherwise(lower)


def duplicate_key(c: Column | str) -> Column:
    """Case-folded with white space collapsed: equal for near-exact duplicates."""
    return strip(F.regexp_replace(fold(c), r"(?U)\s+", " "))


def redact(c: Column | str, keep: int = 3) -> Column:
    """The first characters, stars for at most twelve others, and the length."""
    t = strip(c)
    n = F.length(t)
    shown = F.concat(t.substr(1, keep), F.repeat(F.lit("*"), F.least(n - keep, F.lit(12))), F.lit(" ("), n.cast("string"), F.lit(" chars)"))
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(shown)


def mask_token(c: Column | str, token: str) -> Column:
    """The text with every occurrence of a secret token replaced."""
    return F.replace(_text(c), F.lit(token), F.lit("[REDACTED_TOKEN]")) if token else _text(c)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of n consecutive tokens."""
    joined = tokens
    for k in range(2, n + 1):
        left = F.size(tokens) - k + 1
        joined = F.zip_with(F.slice(joined, 1, left), F.slice(tokens, k, left), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def ratio_similarity(a: Column, b: Column) -> Column:
    """min / max of two magnitudes, 1 when both are 0; a negative one raises an error."""
    checked = F.when((a < 0) | (b < 0), F.raise_error(F.lit("a magnitude is below 0")).cast("double"))
    return checked.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(F.least(a, b).cast("double") / F.greatest(a, b))


def rate_similarity(a: Column, b: Column) -> Column:
    """1 minus the difference of two rates, at least 0."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(a - b))


def letters(c: Column | str) -> Column:
    # Stretches of other characters are fewer than letters.
    return F.length(F.regexp_replace(_text(c), r"[^\p{L}]+", "")).cast("bigint")


def upper_letters(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(r"(?=\p{L})\p{IsUppercase}")).cast("bigint")


def is_lowercase(c: Column | str) -> Column:
    """Has letters and equals its lower-cased form."""
    return (_text(c) == F.lower(_text(c))) & _text(c).rlike(r"\p{L}")


def is_shouting(c: Column | str) -> Column:
    """Has letters and, code blocks left out, upper-case ones only."""
    bare = strip_code_blocks(c)
    return _text(c).rlike(r"\p{L}") & bare.rlike(r"\p{IsUppercase}") & ~bare.rlike(r"[\p{IsLowercase}\p{Lt}]")
