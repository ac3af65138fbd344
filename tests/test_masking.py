"""Stretches that keep loss, against their rule on one text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chatterforge.operators.masking import masked_spans, sums_before


def model(text, instruction, response):
    found, at = [], text.find(response)
    while at >= 0:
        start = at + len(response)
        end = text.find(instruction, start)
        end = len(text) if end < 0 else end
        found.append((start, end, text[start:end]))
        at = text.find(response, start)
    return found


def spans(spark, texts, instruction, response):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", masked_spans(F.col("t"), instruction, response).alias("s")).orderBy("i").collect()
    return [[tuple(s) for s in r["s"]] for r in rows]


@pytest.mark.parametrize("instruction,response", [("<u>", "<a>"), ("aa", "b"), ("ab", "bc"), ("\U0001f600.", "*+"), ("aba", "cc")])
def test_random_texts(spark, instruction, response):
    rng = random.Random(instruction)
    letters = ["a", "b", "c", "é", "\U0001f600", ".", instruction, response, instruction, response]
    texts = ["", instruction, response, response + instruction, response * 3, instruction + response]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    assert spans(spark, texts, instruction, response) == [model(t, instruction, response) for t in texts]


def test_many_answers_in_one_chat(spark):
    text = "".join(f"<u>question {i} é<a>answer {i} \U0001f600" for i in range(10_000))
    began = time.time()
    assert spans(spark, [text], "<u>", "<a>") == [model(text, "<u>", "<a>")]
    assert time.time() - began < 40


def test_sums_before(spark):
    lists = [[], [5], list(range(255)), list(range(256)), list(range(257)), [1] * 2000]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, x array<int>")
    rows = df.select("i", sums_before(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [[sum(x[:k]) for k in range(len(x))] for x in lists]
