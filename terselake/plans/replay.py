"""Replay of recorded logs, explanation of one payload, and the savings scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terselake.functions import payload, tokens
from terselake.functions.text import human_bytes, human_tokens
from terselake.operators.analytics import savings_pct
from terselake.plans.compress import compress
from terselake.plans.config import Config
from terselake.sources.logs import read_replay_log


def calls_of_log(parsed: DataFrame) -> DataFrame:
    """A log is one session; the turn never advances in it."""
    good = parsed.where("not malformed")
    return good.select(F.col("file").alias("session_id"), F.col("line").cast("long").alias("seq"), F.lit(0).alias("turn"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), "tool_input", "content")


def replay(parsed: DataFrame, config: Config = Config()) -> DataFrame:
    """``file, line, tool_name, orig_size, final_size, saved, strategies, modified`` of each record."""
    done = compress(calls_of_log(parsed), config)
    return done.select(F.col("session_id").alias("file"), F.col("seq").alias("line"), "tool_name", "orig_size", "final_size", (F.col("orig_size") - F.col("final_size")).alias("saved"), "strategies", "modified")


def replay_totals(parsed: DataFrame, replayed: DataFrame) -> DataFrame:
    """``entries`` counts malformed lines as well."""
    counted = parsed.groupBy("file").agg(F.count("*").alias("entries"), F.count_if("malformed").alias("malformed"))
    sums = replayed.groupBy("file").agg(F.sum(F.col("orig_size").cast("long")).alias("orig_size"), F.sum(F.col("final_size").cast("long")).alias("final_size"))
    joined = counted.join(sums, "file", "left").na.fill(0, ["orig_size", "final_size"])
    return joined.withColumns({"saved": F.col("orig_size") - F.col("final_size"), "saved_pct": savings_pct(F.col("orig_size"), F.col("final_size"))})


def replay_lines(replayed: DataFrame, totals: DataFrame) -> DataFrame:
    """The text report: ``file, line, text``, a line for each record and, after them, the totals."""
    size = lambda name: F.lpad(human_bytes(F.col(name)), 10, " ")
    sizes = F.concat(size("orig_size"), size("final_size"), size("saved"), F.lpad(F.format_string("%.1f%%", "saved_pct"), 8, " "))
    label = F.when(F.size("strategies") > 0, F.array_join("strategies", "+")).otherwise(F.lit("none"))
    rows = replayed.withColumn("saved_pct", savings_pct(F.col("orig_size"), F.col("final_size"))).select("file", "line", F.concat(F.lpad(F.col("line").cast("string"), 6, " "), F.lit("  "), F.rpad("tool_name", 16, " "), sizes, F.lit("  "), label).alias("text"))
    ends = totals.select("file", F.lit((1 << 63) - 1).alias("line"), F.concat(F.lit(" TOTAL  "), F.rpad(F.concat(F.col("entries").cast("string"), F.lit(" ("), F.col("malformed").cast("string"), F.lit(" bad)")), 16, " "), sizes).alias("text"))
    return rows.unionByName(ends).orderBy("file", "line")


def replay_log(spark: SparkSession, path: str, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    parsed = read_replay_log(spark, path)
    done = replay(parsed, config)
    return done, replay_totals(parsed, done)


def explain(spark: SparkSession, raw: str, config: Config = Config()) -> DataFrame:
    """One payload through the pipeline on its own: a post event, or else a replay record. ValueError without text."""
    value = payload.parse(raw)
    value = value if isinstance(value, dict) else {}
    import json

    content = payload.response_text(json.dumps(value["tool_response"])) if "tool_response" in value else ""
    content = content or (value.get("content") if isinstance(value.get("content"), str) else "")
    if not content:
        raise ValueError("the payload holds no text")
    arguments = value.get("tool_input") if isinstance(value.get("tool_input"), dict) else {}
    row = [("explain", 1, 0, value.get("tool_name") or "", {k: payload.rendered(v) for k, v in arguments.items()}, content)]
    call = spark.createDataFrame(row, "session_id string, seq long, turn int, tool_name string, tool_input map<string,string>, content string")
    done = compress(call, config)
    return done.select("tool_name", "orig_size", "final_size", (F.col("orig_size") - F.col("final_size")).alias("saved"), "strategies", "modified", "trace", "output")


def scenario_savings(compressed: DataFrame) -> DataFrame:
    """Per scenario (session): estimated tokens in and out, header included, and the label of the last changed turn."""
    by = compressed.withColumns({"tokens_in": tokens.estimate(F.col("content")).cast("long"), "tokens_out": tokens.estimate(F.col("output")).cast("long")})
    label = F.coalesce(F.max_by(F.when(F.col("modified"), F.array_join("strategies", "+")), F.when(F.col("modified"), F.col("seq"))), F.lit("none"))
    sums = by.groupBy("session_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), label.alias("strategy"))
    return sums.withColumns({"saved": F.col("tokens_in") - F.col("tokens_out"), "saved_pct": savings_pct(F.col("tokens_in"), F.col("tokens_out")), "shown_in": human_tokens(F.col("tokens_in")), "shown_out": human_tokens(F.col("tokens_out"))})


def pre_cache(calls: DataFrame) -> DataFrame:
    """``hit`` and ``cached_seq`` of calls ``session_id, seq, cache_key``: whether an earlier call had the key."""
    by = Window.partitionBy("session_id", "cache_key").orderBy("seq")
    prior = F.lag("seq").over(by)
    return calls.withColumns({"cached_seq": prior, "hit": prior.isNotNull()})
