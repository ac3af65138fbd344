"""Privacy audit of samples: pattern rules, redacted findings, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterforge.functions import text as T
from chatterforge.operators.sharegpt import answers, canonical


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    pattern: str
    description: str


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# What the audit looks for.
RULES = (
    Rule(
        "api_credential",
        "high",
        r"\b(?:sk-[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}"
        r"|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
        r"|[A-Za-z0-9_-]{24}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,})\b",
        "Potential API credential",
    ),
    Rule(
        "credential_assignment",
        "high",
        r"(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|token|credential)s?\b\s*[:=]\s*\S{6,}",
        "Potential credential assignment",
    ),
    Rule("private_key", "high", r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----", "Potential private key block"),
    Rule("email", "medium", r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b", "Potential email"),
    Rule(
        "phone_number",
        "medium",
        r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]?\d{3,4}(?![\w.])",
        "Potential phone number",
    ),
    Rule("ip_address", "medium", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w.])", "Potential IP address"),
    Rule("filesystem_path", "low", r"(?:/(?:home|Users|root|var|etc)/[\w.@-]+|[A-Za-z]:\\Users\\[\w.@-]+)", "Potential filesystem path"),
    Rule("long_identifier", "low", r"(?<!\d)\d{12,}(?!\d)", "Very long numeric identifier"),
    Rule("url", "low", r"""(?:https?://|www\.)[^\s<>"']+""", "URL"),
)
LONG_RESPONSE_CHARS = 1500
REPEATED_AT_LEAST = 5


def findings(texts: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: int = 3) -> DataFrame:
    """One row per match with rule, severity, its number and the redacted value; other columns are kept.

    The rules run in one pass over the text; the match itself never leaves this step.
    """
    rest = [c for c in texts.columns if c != text_col]
    hits = F.concat(
        *[
            F.transform(
                F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit("(?U)" + r.pattern), F.lit(0)),
                _finding(i, r, keep),
            )
            for i, r in enumerate(rules)
        ]
    )
    return texts.select(*rest, F.posexplode(hits).alias("finding_no", "f")).select(*rest, "finding_no", "f.*")


def _finding(number: int, rule: Rule, keep: int):
    return lambda hit: F.struct(
        F.lit(number).alias("rule_no"),
        F.lit(rule.name).alias("rule"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.description).alias("description"),
        T.redact(hit, keep).alias("redacted"),
    )


def sample_texts(samples: DataFrame) -> DataFrame:
    """Every turn of every sample; ``samples`` has sample_no and conversations."""
    return samples.select("sample_no", F.posexplode("conversations").alias("turn_no", "t")).select(
        "sample_no", "turn_no", F.col("t.from").alias("role"), F.col("t.value").alias("text")
    )


def rule_counts(found: DataFrame) -> DataFrame:
    """``rule, severity, n, first``: most frequent first, ties to the rule seen first."""
    grouped = found.groupBy("rule", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("sample_no", "turn_no", "finding_no")).alias("first")
    )
    return grouped.orderBy(F.desc("n"), "first")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def audit_totals(samples: DataFrame, long_chars: int = LONG_RESPONSE_CHARS, repeated: int = REPEATED_AT_LEAST) -> DataFrame:
    """One row: samples, equal samples, long answers, and texts that many answers repeat."""
    if long_chars < 1 or repeated < 2:
        raise ValueError("long_chars must be at least 1 and repeated at least 2")
    per_sample = samples.groupBy(F.sha2(canonical("conversations"), 256).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    said = samples.select(F.explode(answers("conversations")).alias("text"))
    per_text = said.groupBy(F.sha2(T.duplicate_key("text"), 256).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > long_chars).alias("long")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    a = per_sample.agg(zero(F.sum("n")).alias("samples"), zero(F.sum(F.col("n") - 1)).alias("duplicate_samples"))
    b = per_text.agg(zero(F.sum("long")).alias("long_responses"), F.count_if(F.col("n") >= repeated).alias("repeated_strings"))
    return a.crossJoin(F.broadcast(b))
