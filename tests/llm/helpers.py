"""Plain models of the operators, and tables with awkward rows."""

import hashlib
import re

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).select("doc_id", "text").collect()}


LONG = "lorem ipsum dolor sit amet " * 40_000
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, digest string, fp string, term string, "
    "shard string, first string, found string, lines string, component string, tag string, base string, dropped_lines string, __id string"
)


def awkward(spark, rows):
    """A documents table of (id, text) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, "s", None, *["x"] * 13) for i, t in rows], SCHEMA)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, LONG),
    (4, SAME),
    (4, SAME),
    (5, SAME),
    (6, SAME),
    (None, SAME),
    (None, None),
    (7, " \n\t\n "),
    (8, "a"),
    (9, "\x00﻿ emoji \U0001f600 é ٣"),
]
EMPTY: list = []
