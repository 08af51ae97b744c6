"""Hook events: raw JSON in, calls out; emissions and captures as sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terselake.functions.payload import cache_key_udf, emission_udf, rendered_arguments_udf, response_is_error_udf, response_text_udf

DEFAULT_SESSION = "default"


def _field(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, path)


def parse_events(raw: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """One row of each well-formed event of a kind (post, pre, stop); malformed ones are passed over.

    post: session, tool, arguments (rendered, and as they are written), response, error flag, text and cache
    key; pre: without the response; stop: ``used_pct``, null if the event has no context window.
    """
    text = F.col(column)
    rows = raw.where(F.try_parse_json(text).isNotNull())
    session = F.coalesce(F.nullif(_field(text, "$.session_id"), F.lit("")), F.lit(DEFAULT_SESSION)).alias("session_id")
    carried = [c for c in raw.columns if c != column]
    if kind == "stop":
        window = _field(text, "$.context_window")
        used = F.when(window.isNotNull(), F.coalesce(_field(text, "$.context_window.used_percentage").cast("double"), F.lit(0.0)))
        return rows.select(*carried, session, used.alias("used_pct"))
    tool, arguments = F.coalesce(_field(text, "$.tool_name"), F.lit("")), _field(text, "$.tool_input")
    base = rows.select(*carried, session, tool.alias("tool_name"), rendered_arguments_udf(arguments).alias("tool_input"), arguments.alias("raw_input"), cache_key_udf(tool, arguments).alias("cache_key"), _field(text, "$.tool_response").alias("tool_response"))
    if kind == "pre":
        return base.drop("tool_response")
    return base.withColumns({"is_error_response": response_is_error_udf("tool_response"), "content": response_text_udf("tool_response")})


def read_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parse_events(spark.read.text(path), kind)


def emissions(df: DataFrame, output: str = "output", event: str = "PostToolUse") -> DataFrame:
    """``emitted``: the answer that puts the output in the place the response's shape has for it."""
    return df.withColumn("emitted", emission_udf("tool_response", F.lit(event), output))


def event_name(name: str) -> str:
    return re.sub("[^a-z0-9-]", "", name.lower()) or "hook"


def event_name_column(name: Column) -> Column:
    kept = F.regexp_replace(F.lower(name), "[^a-z0-9-]", "")
    return F.when(kept == "", F.lit("hook")).otherwise(kept)


def capture(raw: DataFrame, path: str, event: str, column: str = "value") -> None:
    """Keep the raw events that are not empty, as text files in a folder of their event and time."""
    import time

    raw.where(F.col(column) != "").select(column).write.text(f"{path}/{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{time.time_ns()}-{event_name(event)}")
