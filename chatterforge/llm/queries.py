"""The registered queries of this subpackage, with the tables they read.

Each query applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterforge.llm.common import table
from chatterforge.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.topk_bm25 import query_rows, search

    docs = table(spark, sf_dir, "documents")
    return search(docs, query_rows(docs)).withColumn("score", F.round("score", 6))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.paragraph_dedup import dedup_paragraphs

    return dedup_paragraphs(table(spark, sf_dir, "documents"))


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.pii_disclosure import sanitise, span_report

    return span_report(sanitise(table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chatterforge.llm.byte_bpe import encode

    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    # Digests are taken from the columns themselves; places are code points, spelled as the ids are.
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "starts", "ends")]
    return found.select("doc_id", "n_tokens", *digests, "decoded_sha256")


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.quality_qda import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.line_templates import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("dropped_lines").cast("bigint").alias("n_dropped"),
        F.array_join(F.transform("dropped_lines", lambda i: i.cast("string")), ",").alias("dropped_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.vector_codes import compress, with_label_error

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    found = with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.digest()))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.centroids import cluster, with_inertia

    return with_inertia(*cluster(table(spark, sf_dir, "embeddings"))).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatterforge.llm.secret_scan import find_secrets, secret_report

    return secret_report(find_secrets(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25_topk": op1_bm25_topk,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_pii_disclosure": op3_pii_disclosure,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_qda": op5_quality_qda,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_license_scan": op8_license_scan,
    "op9_line_templates": op9_line_templates,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroids": op12_centroids,
    "op13_secret_scan": op13_secret_scan,
}
