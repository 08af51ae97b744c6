"""Sessions at rest: single documents, JSON lines, and their retention.

A folder may hold documents, one JSON file for each session (``session-<id>.json``), and what
``write_sessions`` writes: JSON lines, a session each, with its id as a field. Both are read; anything that is
no JSON is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "struct<hash:string,turn:int,tool_name:string,original_size:int,compressed_size:int,strategies:array<string>,stored_at:timestamp,content:string>"
SESSION = (
    f"turn int, entries map<string,{ENTRY}>, tool_cache map<string,{ENTRY}>, metrics struct<pre_cache_hits:int,pre_cache_misses:int>, "
    "context_used_pct double, compact_requested boolean"
)
#: All names but those of part files, and the latter.
_DOCUMENTS, _LINES = "{p,pa,par,part,[!p]*,p[!a]*,pa[!r]*,par[!t]*,part[!-]*}.json", "part-*.json"


def _read(spark: SparkSession, path: str, glob: str, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(SESSION + ", session_id string, _corrupt string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    files = reader.option("pathGlobFilter", glob).json(path)
    named = files.withColumns({"modified_at": F.col("_metadata.file_modification_time"), "file": F.col("_metadata.file_name")})
    # a query may not read the column of corrupt records alone, as a count would
    return named.where(F.col("_corrupt").isNull() & (F.hash("turn") >= -(1 << 31))).drop("_corrupt")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, modified_at`` and the six fields of every session of a folder; absent fields are those of a fresh session."""
    documents = _read(spark, path, _DOCUMENTS, True).withColumn("session_id", F.regexp_replace("file", r"^session-|\.json$", ""))
    every = documents.unionByName(_read(spark, path, _LINES, False).where("session_id is not null"))
    nothing = F.expr(f"cast(map() as map<string,{ENTRY}>)")
    return every.select(
        "session_id", "modified_at", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("entries", nothing).alias("entries"), F.coalesce("tool_cache", nothing).alias("tool_cache"),
        F.struct(F.coalesce("metrics.pre_cache_hits", F.lit(0)).alias("pre_cache_hits"), F.coalesce("metrics.pre_cache_misses", F.lit(0)).alias("pre_cache_misses")).alias("metrics"),
        F.coalesce("context_used_pct", F.lit(0.0)).alias("context_used_pct"), F.coalesce("compact_requested", F.lit(False)).alias("compact_requested"))


def session_entries(sessions: DataFrame, field: str = "entries") -> DataFrame:
    """One row of each remembered output (or, with ``tool_cache``, of each cached call)."""
    each = sessions.select("session_id", "modified_at", F.explode(field).alias("key", "e"))
    return each.select("session_id", "modified_at", "key", "e.*").withColumn("strategies", F.coalesce("strategies", F.array().cast("array<string>")))


def session_metrics(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", F.coalesce("metrics.pre_cache_hits", F.lit(0)).alias("pre_cache_hits"), F.coalesce("metrics.pre_cache_misses", F.lit(0)).alias("pre_cache_misses"))


def entries_by_turn(entries: DataFrame) -> DataFrame:
    """A session's entries in the order of their turns; of equals the one stored first."""
    return entries.orderBy("session_id", "turn", "stored_at", "hash")


def _packed(entries: DataFrame, key: str, name: str) -> DataFrame:
    fields = F.struct(
        "hash", F.col("turn").cast("int").alias("turn"), "tool_name", F.col("original_size").cast("int").alias("original_size"), F.col("compressed_size").cast("int").alias("compressed_size"),
        "strategies", F.col("stored_at").cast("timestamp").alias("stored_at"), "content")
    # a session is bounded by its cap (analytics.prune_by_size); its entries travel as one document
    return entries.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("k"), fields.cast(ENTRY).alias("v")))).alias(name), F.max("turn").cast("int").alias(f"{name}_turn"))


def as_sessions(entries: DataFrame, cache: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """Session rows with all six fields.

    entries: ``session_id, hash, turn, tool_name, original_size, compressed_size, strategies, stored_at, content``;
    cache: the same and ``key``; state: ``session_id, turn, pre_cache_hits, pre_cache_misses, context_used_pct,
    compact_requested``. A session is written if any of the three knows it.
    """
    nothing = F.expr(f"cast(map() as map<string,{ENTRY}>)")
    made = _packed(entries, "hash", "entries")
    cached = _packed(cache, "key", "tool_cache") if cache is not None else made.select("session_id", nothing.alias("tool_cache"), F.lit(None).cast("int").alias("tool_cache_turn")).limit(0)
    known = state if state is not None else entries.sparkSession.createDataFrame([], "session_id string, turn int, pre_cache_hits int, pre_cache_misses int, context_used_pct double, compact_requested boolean")
    every = made.join(cached, "session_id", "full").join(known, "session_id", "full")
    return every.select(
        "session_id", F.coalesce("turn", F.greatest("entries_turn", "tool_cache_turn"), F.lit(0)).alias("turn"), F.coalesce("entries", nothing).alias("entries"), F.coalesce("tool_cache", nothing).alias("tool_cache"),
        F.struct(F.coalesce("pre_cache_hits", F.lit(0)).alias("pre_cache_hits"), F.coalesce("pre_cache_misses", F.lit(0)).alias("pre_cache_misses")).alias("metrics"),
        F.coalesce("context_used_pct", F.lit(0.0)).alias("context_used_pct"), F.coalesce("compact_requested", F.lit(False)).alias("compact_requested"))


def write_sessions(sessions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, a session each, with all its fields; the committer makes the write atomic.

    Nothing that a folder holds is replaced unless ``mode`` says so.
    """
    sessions.select("session_id", *[c.split()[0] for c in ("turn", "entries", "tool_cache", "metrics", "context_used_pct", "compact_requested")]).write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def state_rows(sessions: DataFrame) -> DataFrame:
    """What a stream starts from: ``session_id, kind, key, turn, seq, tool_name, content, used_pct, nudged, hits, misses``.

    kind is session (one row), entry or cache; the entries of a session are numbered in the order
    they were stored, below every number of an event.
    """
    order = Window.partitionBy("session_id").orderBy("stored_at", "turn", "key")
    null = lambda kind: F.lit(None).cast(kind)
    each = lambda field, kind: session_entries(sessions, field).select(
        "session_id", F.lit(kind).alias("kind"), "key", "turn", (F.row_number().over(order) - F.lit(1 << 40)).alias("seq"), F.coalesce("tool_name", F.lit("")).alias("tool_name"),
        F.coalesce("content", F.lit("")).alias("content"), null("double").alias("used_pct"), null("boolean").alias("nudged"), null("int").alias("hits"), null("int").alias("misses"))
    own = sessions.select(
        "session_id", F.lit("session").alias("kind"), null("string").alias("key"), "turn", null("long").alias("seq"), null("string").alias("tool_name"), null("string").alias("content"),
        F.col("context_used_pct").alias("used_pct"), F.col("compact_requested").alias("nudged"), F.col("metrics.pre_cache_hits").alias("hits"), F.col("metrics.pre_cache_misses").alias("misses"))
    return own.unionByName(each("entries", "entry")).unionByName(each("tool_cache", "cache"))


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clean(spark: SparkSession, path: str, days: int = 30, now_ms: int | None = None) -> int:
    """Delete the session files not changed for ``days`` (all, if that is not positive); how many went."""
    import time

    folder, fs = _file_system(spark, path)
    if not fs.exists(folder):
        return 0
    limit = (now_ms or int(time.time() * 1000)) - days * 86_400_000
    gone = 0
    for status in fs.listStatus(folder):
        if status.isFile() and status.getPath().getName().endswith(".json") and (days <= 0 or status.getModificationTime() < limit):
            gone += bool(fs.delete(status.getPath(), False))
    return gone
