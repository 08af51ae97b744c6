"""Replay logs: JSON lines of ``tool_name, tool_input, content``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terselake.functions.payload import rendered_arguments_udf
from terselake.functions.text import trim_u

RECORD = "struct<tool_name:string,content:string>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """From ``file, pos, value``: ``file, line, tool_name, tool_input, content, malformed``.

    Blank lines and comments are not counted; malformed ones are, and stay flagged. The line
    numbers need the lines of a file in one order: a window by file.
    """
    text = trim_u(F.col("value"))
    kept = lines.withColumn("value", text).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    numbered = kept.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("pos")))
    ok = F.try_parse_json(F.col("value")).isNotNull() & F.col("value").startswith("{") & F.col("value").endswith("}")
    record = F.from_json(F.when(ok, F.col("value")), RECORD)
    arguments = F.get_json_object(F.when(ok, F.col("value")), "$.tool_input")
    return numbered.select(
        "file", "line", record["tool_name"].alias("tool_name"), rendered_arguments_udf(arguments).alias("tool_input"), F.coalesce(record["content"], F.lit("")).alias("content"), (~F.coalesce(ok, F.lit(False))).alias("malformed"))


def read_replay_log(spark: SparkSession, path: str) -> DataFrame:
    """A log as the recorder writes it: one task for each file, so that line numbers are the file's own."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return parse_lines(whole)


def read_split_log(spark: SparkSession, path: str, order: str = "seq") -> DataFrame:
    """A large log whose records carry their own order: splittable, no window. ``order`` names that field."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), trim_u(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    ok = F.try_parse_json(F.col("value")).isNotNull()
    record = F.from_json(F.when(ok, F.col("value")), f"struct<tool_name:string,content:string,{order}:bigint>")
    return lines.select("file", record[order].alias("line"), record["tool_name"].alias("tool_name"), rendered_arguments_udf(F.get_json_object(F.when(ok, F.col("value")), "$.tool_input")).alias("tool_input"), F.coalesce(record["content"], F.lit("")).alias("content"), (~ok).alias("malformed"))
