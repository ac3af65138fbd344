"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterforge.runtime import materialize, shared_checkpoints

__all__ = ["ALNUM_TABLE", "LOWER_TABLE", "alnum_words", "id_text", "materialize", "sendable", "shared_checkpoints", "table", "utf8"]

#: Lower-cases A-Z and turns every ASCII byte that is neither a digit nor a
#: letter into a space.  Bytes from 0x80 up belong to non-ASCII characters and
#: count as word bytes, so this works on UTF-8 without decoding it.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
#: Lower-cases A-Z only.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def alnum_words(data: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return data.translate(ALNUM_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as bytes; null becomes empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


#: Bytes, as JSON, of a table that is broadcast.
BROADCAST_BYTES = 16 << 20


def sendable(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Broadcast a materialised table of at most so many rows and bytes, else leave the join to shuffles."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    found = df.agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).first()
    fits = found["n"] <= rows and (found["bytes"] or 0) <= (BROADCAST_BYTES if most is None else most)
    return F.broadcast(df) if fits else df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so other columns cannot clash."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
