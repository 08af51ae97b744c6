"""Reports over entries ``session_id, tool_name, original_size, compressed_size, strategies, stored_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terselake.functions.text import human_bytes as human

TOP, TIMELINE, LATEST = 10, 50, 10


def savings_pct(original: Column, compressed: Column) -> Column:
    return F.when(original > 0, (original - compressed) / original * 100.0).otherwise(F.lit(0.0))


def _bucket(df: DataFrame, key: str) -> DataFrame:
    sums = df.groupBy(key).agg(F.count("*").alias("entries"), F.sum(F.col("original_size").cast("long")).alias("original"), F.sum(F.col("compressed_size").cast("long")).alias("compressed"))
    return sums.select(F.col(key).alias("name"), "entries", "original", "compressed", (F.col("original") - F.col("compressed")).alias("saved"), savings_pct(F.col("original"), F.col("compressed")).alias("saved_pct"))


def by_strategy(entries: DataFrame) -> DataFrame:
    """An entry counts fully in each of its strategies; without any, in ``none``."""
    each = F.explode(F.when(F.size("strategies") > 0, F.col("strategies")).otherwise(F.array(F.lit("none"))))
    return _bucket(entries.withColumn("strategy", each), "strategy").orderBy(F.desc("saved"), "name")


def by_tool(entries: DataFrame) -> DataFrame:
    named = entries.withColumn("tool", F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.lit("unknown")))
    return _bucket(named, "tool").orderBy(F.desc("saved"), "name")


def by_session(entries: DataFrame, fallback: str | None = None) -> DataFrame:
    """Totals of each session with its first and last time; fallback: a column for sessions without any."""
    zero = F.col("stored_at") > F.lit("0001-01-02").cast("timestamp")
    at = F.when(zero, F.col("stored_at"))
    ends = [F.min(at).alias("started_at"), F.max(at).alias("ended_at")]
    if fallback:
        ends = [F.coalesce(F.min(at), F.max(fallback)).alias("started_at"), F.coalesce(F.max(at), F.max(fallback)).alias("ended_at")]
    sums = entries.groupBy("session_id").agg(F.count("*").alias("entries"), F.sum(F.col("original_size").cast("long")).alias("original"), F.sum(F.col("compressed_size").cast("long")).alias("compressed"), *ends)
    return sums.withColumn("saved_pct", savings_pct(F.col("original"), F.col("compressed"))).orderBy(F.desc("started_at"), "session_id")


def total(entries: DataFrame) -> DataFrame:
    sums = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.col("original_size").cast("long")), F.lit(0)).alias("original"), F.coalesce(F.sum(F.col("compressed_size").cast("long")), F.lit(0)).alias("compressed"))
    return sums.select(F.lit("TOTAL").alias("name"), "entries", "original", "compressed", savings_pct(F.col("original"), F.col("compressed")).alias("saved_pct"))


def top_outputs(entries: DataFrame, n: int = TOP) -> DataFrame:
    saved = F.col("original_size") - F.col("compressed_size")
    return entries.withColumn("saved", saved).orderBy(F.desc("saved"), "session_id", "hash").limit(n)


def timeline(entries: DataFrame, n: int = TIMELINE) -> DataFrame:
    """The oldest n, as the report keeps them."""
    return entries.orderBy("stored_at", "session_id", "hash").limit(n)


def timeline_latest(entries: DataFrame, n: int = LATEST) -> DataFrame:
    return entries.orderBy(F.desc("stored_at"), "session_id", "hash").limit(n)


def prune_by_size(entries: DataFrame, cap_bytes: int) -> DataFrame:
    """Entries that stay when each session over the cap drops its oldest until half the cap is left.

    removed bytes before an entry r, total t: it goes while t - r > cap / 2.
    """
    session = Window.partitionBy("session_id")
    size = F.octet_length("content").cast("long")
    before = F.coalesce(F.sum(size).over(session.orderBy("stored_at", "hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = entries.withColumns({"_total": F.sum(size).over(session), "_before": before})
    return marked.where((F.col("_total") <= cap_bytes) | (F.col("_total") - F.col("_before") <= cap_bytes // 2)).drop("_total", "_before")


def cache_totals(sessions: DataFrame) -> DataFrame:
    """Hits and misses of the call cache over sessions."""
    return sessions.agg(F.sum("pre_cache_hits").cast("long").alias("hits"), F.sum("pre_cache_misses").cast("long").alias("misses"))


def report(entries: DataFrame, cache: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """All sections as rows of ``section, line`` (JSON), ready for a JSON-lines sink.

    cache: cached calls, with the columns of entries; sessions: ``pre_cache_hits, pre_cache_misses``.
    """
    sections = {"total": total(entries), "tools": by_tool(entries), "strategies": by_strategy(entries), "sessions": by_session(entries), "top": top_outputs(entries), "timeline": timeline(entries)}
    if cache is not None:
        sections["cache"] = top_outputs(cache)
    if sessions is not None:
        sections["pre_cache"] = cache_totals(sessions)
    out = None
    for name, df in sections.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "content"])).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report_lines(entries: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """The fixed-width text view: ``section, line`` of the totals and buckets, the top outputs and cached calls, and the latest of the timeline."""
    cell = lambda name, width: F.rpad(F.col(name).cast("string"), width, " ")
    size = lambda column: F.lpad(human(column), 12, " ")

    def buckets(name: str, df: DataFrame) -> DataFrame:
        line = F.concat(cell("name", 24), F.lpad(F.col("entries").cast("string"), 8, " "), size(F.col("original")), size(F.col("compressed")), F.lpad(F.format_string("%.1f%%", "saved_pct"), 9, " "))
        return df.select(F.lit(name).alias("section"), line.alias("line"))

    def outputs(name: str, df: DataFrame, value) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.concat(cell("tool_name", 24), cell("hash", 34), size(value), F.lpad(F.col("turn").cast("string"), 6, " ")).alias("line"))

    placed = lambda df: df if "turn" in df.columns else df.withColumn("turn", F.lit(0))
    latest = timeline_latest(entries).withColumn("saved", F.col("original_size") - F.col("compressed_size"))
    out = buckets("tools", by_tool(entries)).unionByName(buckets("strategies", by_strategy(entries))).unionByName(outputs("top", top_outputs(placed(entries)), F.col("saved")))
    if cache is not None:
        out = out.unionByName(outputs("cache", top_outputs(placed(cache)), F.col("original_size")))
    stored = F.rpad(F.date_format("stored_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), 26, " ")
    out = out.unionByName(latest.select(F.lit("timeline").alias("section"), F.concat(cell("tool_name", 24), cell("hash", 34), stored, size(F.col("saved"))).alias("line")))
    return out.unionByName(buckets("total", total(entries)))
