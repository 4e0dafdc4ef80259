"""Readers and writers: whole files, capped heads, hook events, state documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOOK_SCHEMA = "hook_event_name string, tool_name string, cwd string, tool_input string"
READ_SCHEMA = "file_path string, offset int, limit int"
BASH_SCHEMA = "command string, description string"
GREP_SCHEMA = "pattern string, path string, glob string, output_mode string, head_limit int, multiline boolean, `-i` boolean, `-n` boolean, `-A` int, `-B` int, `-C` int"


def read_capped(spark: SparkSession, path: str, limit: int) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, limit).alias("content"), F.col("length"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def hook_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Events, the tool's input as JSON text beside its parsed forms."""
    e = raw.select(F.from_json(value, HOOK_SCHEMA).alias("e")).where("e.tool_name is not null").select("e.*")
    return e.withColumns({"read": F.from_json("tool_input", READ_SCHEMA), "bash": F.from_json("tool_input", BASH_SCHEMA), "grep": F.from_json("tool_input", GREP_SCHEMA)})


def regular_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path, with their sizes and times; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def write_state(df: DataFrame, path: str) -> None:
    """A state document a row; what was there goes once the new one is written."""
    df.write.mode("overwrite").json(path)
