"""ShareGPT JSONL files, prediction files, manifests."""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterforge.functions import text as T
from chatterforge.operators.sharegpt import CONVERSATION, describe_problem
from chatterforge.runtime import delete_file, delete_folder, materialize, replace, scratch_folder, write_text
from chatterforge.sources.exports import BOM

MOST_PROBLEMS = 20
#: Files that Spark decompresses where it reads lines; their bytes are hashed as one value, which Spark bounds at 2 GB.
COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of every line; files are split, so a file may be of any size.

    Spark reads a stretch of a file in order in one task.  A line's number is its place in its
    stretch and the number of lines in the stretches before, of which there is one count each.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", BOM, "").alias("value"),
    )
    stretches = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select("file", "block", "first", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    placed = lines.join(offsets, ["file", "block"])
    return placed.select("file", (F.col("above") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` of JSON with ``conversations`` and ``problem``; blank ones are left out."""
    filled = lines.where(T.strip("value") != "")
    # A variant tells broken JSON and wrong shapes apart; the struct then has the right type.
    tree = F.try_parse_json("value")
    is_object = F.schema_of_variant(tree).startswith("OBJECT")
    turns = F.get_json_object("value", "$.conversations")
    row = F.from_json("value", f"struct<conversations:{CONVERSATION}>")["conversations"]
    problem = (
        F.when(tree.isNull(), "invalid JSON")
        .when(~is_object, "expected a JSON object")
        .when(~F.coalesce(turns.startswith("["), F.lit(False)), "expected a conversation")
        .otherwise(describe_problem(row))
    )
    return filled.withColumn("conversations", row).withColumn("problem", problem)


def read_sharegpt(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``file, line_no, conversations`` of usable samples.

    With ``strict`` the first bad line raises an error that names it, as does an
    empty dataset; one bounded job looks for it.
    """
    parsed = parse_lines(_numbered_lines(spark, path))
    if strict:
        bad = parsed.where("problem is not null").orderBy("file", "line_no").limit(1).collect()
        if bad:
            raise ValueError(f"{os.path.basename(bad[0]['file'])}:{bad[0]['line_no']}: {bad[0]['problem']}")
        if parsed.isEmpty():
            raise ValueError(f"{path} holds no sample")
    return parsed.where("problem is null").select("file", "line_no", "conversations")


def sharegpt_problems(spark: SparkSession, path: str, most: int = MOST_PROBLEMS) -> DataFrame:
    """The first bad lines with their reasons."""
    parsed = parse_lines(_numbered_lines(spark, path)).where("problem is not null")
    return parsed.orderBy("file", "line_no").limit(most).select("file", "line_no", "problem")


class _Digest:
    """The SHA-256 of a file from its lines.

    Lines come without their ends, without a byte order mark, and without a sign of whether the last one was ended;
    the size of the file tells both at its end, so the digest goes on with and without the mark.
    """

    def __init__(self, file: str, size: int):
        self.file, self.size, self.seen = file, size, -1
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(codecs.BOM_UTF8)

    def add(self, lines: list[bytes]) -> None:
        data = (b"\n" if self.seen >= 0 else b"") + b"\n".join(lines)
        self.seen = max(self.seen, 0) + len(data)
        self.plain.update(data)
        self.marked.update(data)

    def end(self) -> str:
        more = self.size - max(self.seen, 0)
        if more not in (0, 1, 3, 4):
            raise ValueError(f"{self.file}: its lines do not add up to its {self.size} bytes")
        found = self.marked if more >= 3 else self.plain
        if more in (1, 4):
            found.update(b"\n")
        return found.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    told = lambda d: pa.RecordBatch.from_pydict({"file": [d.file], "sha256": [d.end()]})
    for batch in batches:
        files = batch["file"].to_pylist()
        start = 0
        while start < len(files):
            end = start + 1
            while end < len(files) and files[end] == files[start]:
                end += 1
            if now is None or now.file != files[start]:
                if now is not None:
                    yield told(now)
                now = _Digest(files[start], batch["size"][start].as_py())
            now.add(batch["value"].slice(start, end - start).to_pylist())
            start = end
    if now is not None:
        yield told(now)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256`` of each file, of any size: its bytes stream through one task, as the digest goes from byte to byte.

    A second session reads each file as one stretch; no value is larger than a line.
    """
    whole = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        whole.conf.set(f"spark.sql.files.{name}", str(1 << 50))
    lines = whole.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")
    )
    folder = scratch_folder(spark, "digests")
    lines.where(~F.col("file").rlike(COMPRESSED)).mapInArrow(_digests, "file string, sha256 string").write.parquet(folder)
    streamed = spark.read.schema("file string, sha256 string").parquet(folder)
    files = spark.read.format("binaryFile").load(path)
    # Scans leave empty files out, the listing does not.
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", f),) for f in files.inputFiles()], "file string")
    names = listed.join(files.select(F.col("_metadata.file_path").alias("file"), F.col("length")), "file", "left")
    # A file without any line is empty or a byte order mark.
    bare = F.when(F.col("length").isNull(), F.sha2(F.lit(b""), 256)).otherwise(F.sha2(F.lit(codecs.BOM_UTF8), 256))
    hashed = names.where(~F.col("file").rlike(COMPRESSED)).join(streamed, "file", "left").select("file", F.coalesce("sha256", bare).alias("sha256"))
    packed = files.select(F.col("_metadata.file_path").alias("file"), "content").where(F.col("file").rlike(COMPRESSED))
    found = materialize(hashed.unionByName(packed.select("file", F.sha2("content", 256).alias("sha256"))))
    delete_folder(spark, folder)
    return found


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256, samples, invalid_rows`` of each file."""
    counts = parse_lines(_numbered_lines(spark, path)).groupBy("file").agg(
        F.count_if(F.col("problem").isNull()).alias("samples"), F.count_if(F.col("problem").isNotNull()).alias("invalid_rows")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return file_digests(spark, path).join(counts, "file", "left").select("file", "sha256", zero("samples"), zero("invalid_rows"))


def write_sharegpt(samples: DataFrame, path: str) -> None:
    """JSON lines of ``conversations``; an empty table overwrites what was there with nothing."""
    samples.select(F.to_json(F.struct("conversations")).alias("value")).write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, text``: one response per line, a string or an object with response or value."""
    lines = _numbered_lines(spark, path).where(T.strip("value") != "")
    tree = F.try_parse_json("value")
    inner = F.coalesce(F.try_variant_get(tree, "$.response", "variant"), F.try_variant_get(tree, "$.value", "variant"))
    said = F.when(F.schema_of_variant(tree) == "STRING", tree).otherwise(inner)
    text = F.when(F.schema_of_variant(said) == "STRING", F.try_variant_get(said, "$", "string"))
    found = lines.select("file", "line_no", text.alias("text"))
    bad = found.where("text is null").orderBy("file", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0]['line_no']}: expected a string or an object with response or value")
    if found.isEmpty():
        raise ValueError(f"{path} holds no prediction")
    return found


def write_json_atomic(spark: SparkSession, path: str, value: dict) -> None:
    """A small document of the driver, replaced as a whole, wherever Spark writes."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def publish(spark: SparkSession, staged: dict[str, str], manifest: str, value: dict) -> None:
    """Put written folders in their places, then the manifest that stands for all of them.

    ``staged`` maps folders to their places.  The older manifest goes first and the new one comes last, so whoever finds a
    manifest finds the folders that belong to it.  Until all is written, nothing older is touched.
    """
    delete_file(spark, manifest)
    for folder, place in staged.items():
        replace(spark, folder, place)
    write_json_atomic(spark, manifest, value)


def kind_of(path: str) -> str:
    """``sharegpt`` for JSON lines, else ``parsed``."""
    return "sharegpt" if path.lower().endswith(".jsonl") else "parsed"
