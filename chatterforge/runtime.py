"""Session helpers: the shared checkpoint folder, tables kept in it, and numbering rows without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoints(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder and cut the lineage.

    A lost executor costs a re-read of the folder, never a recomputation of what
    came before it.
    """
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """The path of a new folder for intermediate tables, in the shared checkpoint folder."""
    return f"{shared_checkpoints(spark)}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables through the file system that its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text of the driver, put in its place by one rename that replaces what was there, in any file system that Spark writes to."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = place.getFileSystem(conf)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text, "utf-8"))
        out.hsync() if out.hasCapability("hsync") else out.flush()
    finally:
        out.close()
    replace(spark, str(beside), path)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, or a folder, to where there may be an older one."""
    jvm = spark._jvm
    fs_name = jvm.org.apache.hadoop.fs
    old, new = fs_name.Path(source), fs_name.Path(target)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(new) and fs.getFileStatus(new).isDirectory():
        fs.delete(new, True)
    # The class of the options is one inside another, which the gateway names with a dollar sign.
    kind = getattr(fs_name, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    fs_name.FileContext.getFileContext(fs.makeQualified(new).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(old), fs.makeQualified(new), options)


def delete_file(spark: SparkSession, path: str) -> None:
    """Delete a file if it is there."""
    delete_folder(spark, path)


#: Rows of a table that is sent to all tasks; for tables of a few short columns.
SENT_ROWS = 200_000


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """Broadcast a table of a few short columns if it has at most so many rows, else leave the join to shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def number_rows(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """``df`` with numbers from 0 in the given total order.

    The sorted rows are kept in the shared folder with their partition and place;
    only one count per partition is summed up in one place.
    """
    place = F.monotonically_increasing_id()
    placed = materialize(df.orderBy(*order).withColumn("__place", place))
    part = F.shiftright(F.col("__place"), 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["__part"], total))
        total += row["n"]
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("bigint")).drop("__place")
    start = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), part)
    number = start + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, number.cast("bigint")).drop("__place")
