"""Raw chat exports and parsed transcripts: one JSON file is one transcript, split where it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterforge.sources.json_array import read_elements

BOM = r"^\x{feff}"
AUTHOR = "struct<id:string,username:string,name:string,global_name:string,display_name:string,bot:boolean>"
REFERENCE = "struct<message_id:string,messageId:string>"
RAW_MESSAGE = (
    f"struct<id:string,timestamp:string,content:string,bot:boolean,author:{AUTHOR},author_id:string,username:string,"
    f"display_name:string,channel_id:string,attachments:array<string>,message_reference:{REFERENCE},reference:{REFERENCE},reply_to:string>"
)
PARSED_MESSAGE = (
    "struct<id:string,participant:string,role:string,author_id:string,username:string,display_name:string,content:string,"
    "timestamp:string,channel_id:string,session_id:string,bot:boolean,attachments:array<string>,reply_to:string>"
)
AROUND = "struct<channel_id:string,channel:string>"


def _elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``transcript_id, pos, json, export_channel_id, channel_name``; a list and an object with messages both do, of any size."""
    elements, around = read_elements(spark, path)
    members = F.from_json("json", AROUND)
    named = around.select(
        F.col("file").alias("__file"),
        members["channel_id"].alias("export_channel_id"),
        F.coalesce(F.get_json_object(members["channel"], "$.name"), F.lit("DM")).alias("channel_name"),
    )
    # One row for each file; Spark sends it where it is small and shuffles it where there are many files.
    found = elements.join(named, elements["file"] == named["__file"])
    return found.select(F.col("file").alias("transcript_id"), "pos", "json", "export_channel_id", "channel_name")


def _messages(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    found = _elements(spark, path).where(F.ltrim("json").startswith("{")).withColumn("m", F.from_json("json", schema))
    # As JSON: a list, or what should have been one; null where there is none.
    written = F.to_json(F.try_variant_get(F.try_parse_json("json"), "$.attachments", "variant")).alias("attachments_json")
    return found.select("transcript_id", F.col("pos").cast("bigint").alias("pos"), "m.*", written, "export_channel_id", "channel_name")


def read_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw messages of exports in their order; elements that are no objects are skipped."""
    return _messages(spark, path, RAW_MESSAGE)


def read_parsed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of parsed transcripts in their order."""
    return _messages(spark, path, PARSED_MESSAGE).drop("attachments_json", "export_channel_id", "channel_name")


def write_parsed(messages: DataFrame, path: str) -> None:
    """One JSON object per message, in folders by transcript; readable with ``spark.read.json``."""
    messages.write.mode("overwrite").json(path)
