import math
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatterforge.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("hello   world\n\n\n\nhey", "hello world\n\nhey"),
        ("hello\x00\x07\x1bworld", "helloworld"),
        (None, ""),
        ("  \t привет \U0001f600\n\n\n\nда ", "привет \U0001f600\n\nда"),
    ],
)
def test_clean_text(spark, value, expected):
    assert one(spark, T.clean_text("t"), value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2026-01-01T00:00:00Z", "2026-01-01 00:00:00"),
        ("2026-01-01T02:00:00+02:00", "2026-01-01 00:00:00"),
        ("2026-01-01T02:00:00+02", "2026-01-01 00:00:00"),
        ("2026-01-01 10:30:00,5", "2026-01-01 10:30:00.5"),
        ("2026-01-01", "2026-01-01 00:00:00"),
        ("2026", None),
        (" 2026-01-01 ", None),
        ("2026-1-1", None),
        ("T10:00", None),
        ("2026-01-01T10:00:00 America/New_York", None),
        ("2026-13-01", None),
        ("garbage", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_iso(spark, value, expected):
    assert one(spark, T.parse_iso("t").cast("string"), value) == expected


@given(st.lists(st.text(alphabet="aZé1 _'’.!?…\n\t-ßÉ`\U0001f600", max_size=30), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_words_and_sentences_against_plain_python(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.word_tokens("t").alias("w"), T.sentences("t").alias("s"), T.duplicate_key("t").alias("k"))
    for r in df.collect():
        assert r["w"] == [w.lower() for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", r["t"])]
        assert r["s"] == [p.strip() for p in re.split(r"(?<=[.!?…])\s+|\n+", r["t"]) if p.strip()]
        assert r["k"] == " ".join(r["t"].casefold().split())


@pytest.fixture(autouse=True)
def session(spark):
    return spark


def test_counts(spark):
    text = "see https://a.b/c and WWW.x.y ```code\nmore``` ok ```z``` \U0001f600❤️ <:wave:123> <a:x:9>"
    assert one(spark, T.count_urls("t"), text) == 2
    assert one(spark, T.count_code_blocks("t"), text) == 2
    assert one(spark, T.count_emoji("t"), text) == 5
    assert one(spark, T.strip_code_blocks("t"), "a ```x``` b") == "a   b"
    assert one(spark, T.count_emoji("t"), None) == 0


@pytest.mark.parametrize("value,expected", [("ab", "**"), ("abcdefghijkl", "abc********* (12 chars)"), (" abc ", "***"), ("a" * 40, "aaa" + "*" * 12 + " (40 chars)")])
def test_redact(spark, value, expected):
    assert one(spark, T.redact("t"), value) == expected


def test_mask_token(spark):
    assert one(spark, T.mask_token("t", "s3.c"), "a s3.c b s3xc") == "a [REDACTED_TOKEN] b s3xc"
    assert one(spark, T.mask_token("t", ""), "a") == "a"


def test_similarities(spark):
    pair = lambda f, a, b: spark.createDataFrame([(a, b)], "a double, b double").select(f(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert pair(T.ratio_similarity, 0.0, 0.0) == 1 and pair(T.ratio_similarity, 2.0, 4.0) == 0.5
    assert math.isclose(pair(T.rate_similarity, 0.2, 0.9), 0.3)
    with pytest.raises(Exception, match="magnitude is below 0"):
        pair(T.ratio_similarity, -1.0, 2.0)


def test_ngrams_and_casing(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>").select(T.ngrams(F.col("t"), 2).alias("r"))
    assert [r["r"] for r in df.collect()] == [["a b", "b c"], [], []]
    assert one(spark, T.is_shouting("t"), "LOUD ```quiet``` 1") and not one(spark, T.is_shouting("t"), "Loud")
    assert one(spark, T.is_lowercase("t"), "quiet é 1") and not one(spark, T.is_lowercase("t"), "123")
    assert one(spark, T.upper_letters("t"), "AbÉ1") == 2 and one(spark, T.letters("t"), "AbÉ1") == 3


def test_full_case_folding_of_every_character(spark):
    """Of every character that Python's Unicode tables know; the JVM's may know more."""
    points = [i for i in range(1, 0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs")]
    rows = [(i, "".join(chr(p) + "\x00" for p in points[i : i + 500])) for i in range(0, len(points), 500)]
    rows += [(-1, "ΑΣ ΣΑΣ. ΣΣ"), (-2, "STRASSE Straße ẞ ﬁ ŉ İI ıi ΐ Ꭰꭰ ſK"), (-3, None), (-4, "plain TEXT"), (-5, "Ǆ" * 50 + "ﬃ" * 50)]
    df = spark.createDataFrame(rows, "i bigint, t string").repartition(4)
    found = {r["i"]: r["f"] for r in df.select("i", T.fold("t").alias("f")).collect()}
    for i, t in rows:
        assert found[i] == (t or "").casefold(), i
