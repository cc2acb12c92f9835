"""Tool-call events: one JSON object per line, parsed leniently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of other types or none at all are tolerated; ``tool_output`` must be a JSON string to count.
SCHEMA = "blob_id bigint, kind string, tool_name string, tool_input struct<command:string>, tool_output string"
MAX_BYTES = 64 * 1024 * 1024


def from_json_lines(raw: Column) -> Column:
    return F.from_json(raw, SCHEMA, {"mode": "PERMISSIVE"})


def to_blobs(events: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(blob_id, kind, tool_name, command, output) of events with the fields of SCHEMA. An output that is too large isn't looked at: its event goes on with none, and is answered so."""
    output = F.when(F.octet_length("tool_output") <= max_bytes, F.col("tool_output"))
    return events.select("blob_id", "kind", F.coalesce("tool_name", F.lit("")).alias("tool_name"), F.coalesce("tool_input.command", F.lit("")).alias("command"), output.alias("output"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blobs from files of JSON lines; a broken line gives a row of nulls, never an error."""
    return to_blobs(spark.read.schema(SCHEMA).json(path))


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return to_blobs(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path))


def write_responses(responses: DataFrame, path: str) -> None:
    """Answers as text, one JSON object per line."""
    responses.select(F.col("response").alias("value")).write.text(path)
