"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A document's fingerprint has 64 bits.  Two documents are linked when their
fingerprints differ in at most ``RADIUS`` bits; components are the classes.

*Covering.*  Each bit is placed on a point of the projective space of dimension
``RADIUS`` over a small field, and each table masks out the bits on one
hyperplane.  Any ``RADIUS`` points lie on a common hyperplane, so every pair
within the radius agrees in at least one table: recall is 1 by construction,
not by chance.  For radius 2 over the field of 3 elements that is 13 tables,
each keeping about 44 bits.

*No pairs inside a bucket.*  Fingerprints alone in all of their buckets cannot
have a partner and leave.  Each survivor is then filed under itself and under
every fingerprint reached by flipping one of the bits its table masked out.  Two
fingerprints at distance 1 or 2 share such a hub and two that share a hub are
at most 2 apart, so hubs carry exactly the links, and a hub can hold no more
than 65 different fingerprints, however large the group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.common import LOWER_TABLE, id_text, materialize, sendable, utf8
from chatterforge.llm.components import connected_components

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Rows of the list of leaving documents that is broadcast, if it has few enough bytes too.
BROADCAST_ROWS = 500_000
#: Shingles whose bits are counted at once, to bound a worker's memory.
BLOCK = 1 << 15


def projective_points(dimension: int, q: int) -> list[tuple[int, ...]]:
    """Points of PG(dimension, q), q prime: vectors whose first non-zero entry is 1."""
    vectors = product(range(q), repeat=dimension + 1)
    return [v for v in vectors if next((x for x in v if x), 0) == 1]


def covering_tables(radius: int = RADIUS, q: int = 3, bits: int = BITS) -> list[list[int]]:
    """For each table, the bits that it masks out."""
    points = projective_points(radius, q)
    place = [points[i % len(points)] for i in range(bits)]
    return [[i for i in range(bits) if sum(x * y for x, y in zip(place[i], h)) % q == 0] for h in points]


def simhash(data: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text: a bit is set if over half of the shingles' XXH64 have it."""
    import xxhash

    words = data.translate(LOWER_TABLE).split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(words) - size + 1
    for start in range(0, n, BLOCK):
        part = words[start : min(start + BLOCK, n) + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size))))
        hashes = np.array(list(map(digest, shingles, repeat(seed))), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t) for t in utf8(batch["text"])], np.uint64).view(np.int64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(prints, pa.int64())], [*kept, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_col: str | None = None) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a signed 64-bit integer; ``digest`` too if its column is named."""
    if digest_col is None:
        return id_text(docs, id_col, text_col).mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(digest_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return named.mapInArrow(_fingerprint_batches, "doc_id bigint, digest binary, fp bigint")


def hamming_edges(prints: DataFrame) -> DataFrame:
    """``src, dst`` edges that connect exactly the fingerprints of column fp linked within RADIUS."""
    tables = covering_tables()
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(np.int64(_signed(~_bits(z))).item()).alias("mask")) for t, z in enumerate(tables)])
    masked_out = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in z]) for z in tables])
    filed = prints.select("fp", F.explode(masks).alias("m")).select(
        "fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bucket")
    )
    shared = filed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = filed.join(shared, ["t", "bucket"]).select("fp", "t")
    hubs = met.select(
        "fp",
        F.explode(
            F.concat(F.array("fp"), F.transform(F.element_at(masked_out, F.col("t") + 1), lambda b: F.col("fp").bitwiseXOR(b)))
        ).alias("hub"),
    ).distinct()
    grouped = hubs.groupBy("hub").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return (
        grouped.select(F.array_min("members").alias("src"), F.explode("members").alias("dst")).where("src <> dst").distinct()
    )


def _bits(places: list[int]) -> int:
    return sum(1 << i for i in places)


def _signed(value: int) -> int:
    value &= (1 << BITS) - 1
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own
    included.  Null and blank texts have fingerprint zero and are linked like any
    other; very long ones are hashed whole, in blocks.  Each repeated row is returned; rows with a null id are returned
    with the component of their fingerprint, and null where no member has an id.  An empty table gives an empty result; columns other than
    the two named ones are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    # Classes of equal fingerprints are looked at, not rows: the largest group is one row until the last join.
    labelled = with_components(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def with_components(classes: DataFrame) -> DataFrame:
    """``classes``, one row per fingerprint ``fp``, with the fingerprint that names its component."""
    labels = connected_components(hamming_edges(classes.select("fp")))
    return classes.join(labels, classes["fp"] == labels["node"], "left").withColumn("component", F.coalesce("component", "fp")).drop("node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    Rows without an id cannot be told apart and all stay.  Rows that repeat an id are told apart by
    their texts: of rows equal in both one stays; rows of one id with different texts stay or go each with
    its own component, and where several of one component have its smallest id, that of the smallest text digest stays.
    Null and empty texts are equal texts here; very long ones are looked at whole.  Only ids and digests are
    compared, and texts move only where an id repeats.  All columns are returned; an empty table gives an empty result.
    """
    spare = "_" * (1 + max(len(c) for c in docs.columns))
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), digest.alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = materialize(fingerprints(rows, "doc_id", "text", "digest").where("doc_id is not null"))
    place = F.struct("doc_id", "digest")
    labelled = with_components(prints.groupBy("fp").agg(F.min(place).alias("least")))
    # Of each component, the smallest id and then the smallest digest.
    heads = labelled.groupBy("component").agg(F.min("least").alias("head"))
    named = labelled.select("fp", "component").join(heads, "component").select("fp", "head")
    pair = lambda df: materialize(df.select(F.col("doc_id").alias(f"{spare}id"), F.col("digest").alias(f"{spare}digest")).distinct())
    gone = pair(prints.join(named, "fp").where(place != F.col("head")))
    again = pair(prints.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    same = (docs[id_col].cast("bigint") == gone[f"{spare}id"]) & (digest == gone[f"{spare}digest"])
    left = docs.join(sendable(gone, BROADCAST_ROWS), same, "left_anti")
    if again.isEmpty():
        return left
    repeats = (docs[id_col].cast("bigint") == again[f"{spare}id"]) & (digest == again[f"{spare}digest"])
    once = left.join(again, repeats, "left_semi").withColumn(f"{spare}digest", digest).dropDuplicates([id_col, f"{spare}digest"]).drop(f"{spare}digest")
    return left.join(again, repeats, "left_anti").unionByName(once)
