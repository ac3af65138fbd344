"""Phrases as rows without lists, letters and blanks by stretches: the same as term by term."""

from pyspark.sql import functions as F

from chatterforge.functions import text as T
from chatterforge.operators import style

TEXTS = ["", " \t\n", "  ", "one", "one two", "a b c d", "a b a b a", "Ärger, ß und 𝐀𝐁 😀 1x2 don't", "...!?", None, "​", "x\ny  z"]


def test_phrase_rows_equal_lists(spark):
    words = spark.createDataFrame([("c", i, t.split()) for i, t in enumerate(TEXTS) if t is not None], "corpus string, resp_id bigint, tokens array<string>")
    spell = lambda df: sorted(map(tuple, df.collect()))
    assert spell(style._phrase_rows(words)) == spell(style._exploded(style._phrases(words)))


def test_phrases_are_counted_without_lists(spark, capsys):
    words = spark.createDataFrame([("c", 1, ["a", "b", "c"])], "corpus string, resp_id bigint, tokens array<string>")
    style._phrase_rows(words).explain()
    plan = capsys.readouterr().out
    assert "inline" in plan and "zip_with" not in plan and "lambda" not in plan


def test_letters_and_blanks(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    one_by_one = F.regexp_count(F.coalesce("t", F.lit("")), F.lit(r"\p{L}")).cast("bigint")
    for r in rows.select("t", T.letters("t").alias("n"), one_by_one.alias("m"), T.has_text("t").alias("has"), (T.strip("t") != "").alias("had")).collect():
        assert (r["n"], r["has"]) == (r["m"], r["had"]), r
