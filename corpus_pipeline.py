"""A training-corpus pipeline: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatterforge.llm.byte_bpe import encode
from chatterforge.llm.common import shared_checkpoints, table
from chatterforge.llm.decontaminate import drop_contaminated
from chatterforge.llm.line_templates import EXACT, dedup_lines
from chatterforge.llm.quality_qda import keep_quality
from chatterforge.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored by their (all zero) counts, very long ones by counts of the whole text;
    repeated rows and rows without an id are judged by their texts, and other columns pass through.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go, but for their first occurrence; equal texts stay equal.

    Null and empty texts hold no line that goes; very long ones are split whole.  Repeated rows are treated
    alike, rows without an id come first, and of other columns only the text changes.
    """
    kept = dedup_lines(docs, copies=EXACT).drop("dropped_lines")
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    Null and empty texts are copies of each other; very long ones are compared whole.  Rows equal in id and
    text are one document, rows that share an id but not the text are told apart, and rows without an id all stay.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; very long ones are searched whole; repeated rows stay or go together.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and offsets of what is left, with digests of the ids and of the decoded bytes.

    Null and empty texts have no tokens; very long ones are encoded whole; each row gives one row.  An empty
    table gives an empty result, here and in all stages before.
    """
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", tokenize),
]

#: The classifier, the fingerprints and the tokens have no SQL form; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written to the shared folder and read again."""
    import uuid

    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
