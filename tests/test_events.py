import json
import os

import pytest
from pyspark.sql import functions as F

from terselake.functions import payload as P
from terselake.functions.text import content_hash
from terselake.operators import analytics
from terselake.plans.compress import compress
from terselake.plans.replay import explain, pre_cache, replay_lines, replay_log, scenario_savings
from terselake.plans.scenarios import scenario_calls
from terselake.sources import hooks, sessions
from terselake.streaming import sessions as live

ARRAY = "[" + ",".join(f'{{"part":{k},"bin":"b{k * 3}"}}' for k in range(7)) + "]"
BLOCK = lambda text: {"type": "text", "text": text}


def lines_of(n):
    return "\n".join(f"row {k} of the inventory" for k in range(n))


@pytest.mark.parametrize("shape, text", [
    ({"stdout": lines_of(2), "stderr": "a note"}, lines_of(2)),  # stdout wins, whatever else there is
    ({"stdout": None, "content": "unused"}, ""), ({"stdout": [1], "text": "unused"}, ""), ({"stderr": "alone", "stdout": ""}, ""),
    ({"content": "plain", "text": "unused"}, "plain"), ({"text": "plain", "output": "unused"}, "plain"), ({"content": None, "output": "unused"}, ""),
    ({"content": [BLOCK("one"), {"type": "resource", "text": "unused"}, ["loose", BLOCK("two")], BLOCK("")]}, "one\n\nloose\n\ntwo"),
    ({"content": {"stdout": "inner", "b": "last", "a": {"text": "mid"}}}, "inner\n\nmid\n\nlast"),
    ({"zeta": "z", "alpha": ["a", {"content": "c"}], "count": 3}, "a\n\nc\n\nz"),
    ({"stdout": "null \0 byte"}, ""), ({"output": "q" * 20_001}, ""), ({"output": "q " * 15_000}, "q " * 15_000), ({}, ""),
])
def test_response_text(shape, text):
    assert P.response_text(json.dumps(shape)) == text


@pytest.mark.parametrize("raw", [None, "", "{", '"text"', "[]", "12"])
def test_what_is_no_object_has_no_text(raw):
    assert P.response_text(raw) == "" and P.response_is_error(raw) is False


@pytest.mark.parametrize("shape, error", [
    ({"isError": True, "stdout": "fine"}, True), ({"isError": False, "stdout": "", "stderr": "broken"}, False), ({"isError": None, "stdout": "", "stderr": "broken"}, False),
    ({"stdout": "", "stderr": "broken"}, True), ({"stdout": "fine", "stderr": "broken"}, False), ({"stderr": "broken"}, False), ({"isError": "yes", "stdout": "", "stderr": "broken"}, True),
])
def test_response_is_error(shape, error):
    assert P.response_is_error(json.dumps(shape)) is error


def test_rewriting_keeps_the_shape():
    new = lambda shape: P.rewritten(json.dumps(shape), "NEW")
    assert new({"code": 0, "stdout": "old", "stderr": "note"}) == {"code": 0, "stdout": "NEW", "stderr": "note"}
    assert new({"content": "old", "id": 4}) == {"content": "NEW", "id": 4} and new({"text": 5}) == {"text": "NEW"}
    assert new({"content": [{"type": "audio"}, BLOCK("old"), BLOCK("older"), {"type": "link"}]}) == {"content": [{"type": "audio"}, BLOCK("NEW"), {"type": "link"}]}
    assert new({"content": [{"type": "audio"}]}) == {"content": [{"type": "audio"}, BLOCK("NEW")]}
    assert json.loads(P.emission('{"rows":3}', "AnyEvent", "NEW")) == {"hookSpecificOutput": {"hookEventName": "AnyEvent", "additionalContext": "NEW"}}


def test_rendering_and_keys():
    value = json.loads('{"size":2500000,"tags":[false,null,"t"],"at":{"y":0.25,"x":3e-9},"far":4e22,"near":98765432.5}')
    assert P.rendered(value) == "map[at:map[x:3e-09 y:0.25] far:4e+22 near:9.87654325e+07 size:2.5e+06 tags:[false <nil> t]]"
    assert P.cache_key("Run", {"n": 7.0, "m": [1]}) == P.cache_key("Run", {"m": [1.0], "n": 7}) != P.cache_key("Walk", {"m": [1], "n": 7})


def test_event_sources(spark, tmp_path):
    f = tmp_path / "posts.txt"
    post = {"session_id": "s", "tool_name": "Bash", "tool_input": {"cmd": "ls -l", "n": 3}, "tool_response": {"stdout": ARRAY, "stderr": ""}}
    f.write_text("\n".join([json.dumps(post), "broken", json.dumps({**post, "session_id": "", "tool_response": {"isError": True}})]))
    rows = {r.session_id: r for r in hooks.read_events(spark, str(f), "post").collect()}
    assert rows["s"].content == ARRAY and rows["s"].tool_input == {"cmd": "ls -l", "n": "3"} and not rows["s"].is_error_response
    assert rows["default"].is_error_response and rows["default"].content == ""
    stops = spark.createDataFrame([('{"session_id":"s","context_window":{"used_percentage":0}}',), ('{"session_id":"t"}',)], "value string")
    assert {r.session_id: r.used_pct for r in hooks.parse_events(stops, "stop").collect()} == {"s": 0.0, "t": None}
    out = hooks.emissions(hooks.read_events(spark, str(f), "post").withColumn("output", F.lit("R"))).where("session_id = 's'").head().emitted
    assert json.loads(out)["hookSpecificOutput"]["updatedToolOutput"]["stdout"] == "R"
    assert hooks.event_name("Post Tool/Use") == "posttooluse" and hooks.event_name("??") == "hook"
    hooks.capture(spark.read.text(str(f)), str(tmp_path / "captured"), "Post")
    assert len(os.listdir(tmp_path / "captured")) == 1


def test_replay_and_explain(spark, tmp_path):
    f = tmp_path / "log.jsonl"
    line = json.dumps({"tool_name": "Bash", "tool_input": {"q": "x"}, "content": ARRAY})
    f.write_text(f"# comment\n\n{line}\n{{broken\n  {line}\n")
    done, totals = replay_log(spark, str(f))
    rows = {r.line: r for r in done.collect()}
    assert sorted(rows) == [1, 3] and rows[1].strategies == ["structure"] and rows[3].strategies == ["dedup"]
    t = totals.head()
    assert (t.entries, t.malformed, t.orig_size) == (3, 1, 2 * len(ARRAY))
    text = [r.text for r in replay_lines(done, totals).collect()]
    assert len(text) == 3 and text[0].strip().startswith("1  Bash") and text[0].endswith("structure") and text[-1].startswith(" TOTAL  3 (1 bad)")
    e = explain(spark, json.dumps({"tool_name": "B", "tool_response": {"stdout": ARRAY}})).head()
    assert e.modified and e.trace[:2] == ["dedup: enabled", "dedup: no match"]
    with pytest.raises(ValueError):
        explain(spark, "{}")


def test_session_files(spark, tmp_path):
    entry = {"hash": "h", "turn": 1, "tool_name": "Bash", "original_size": 10, "compressed_size": 4, "strategies": ["dedup"], "stored_at": "2024-01-01T00:00:00Z", "content": "c"}
    (tmp_path / "session-a.json").write_text(json.dumps({"turn": 1, "entries": {"h": entry}, "tool_cache": {}, "metrics": {"pre_cache_hits": 2, "pre_cache_misses": 3}}, indent=1))
    (tmp_path / "session-b.json").write_text("{ not json")
    (tmp_path / "session-c.json.tmp").write_text("{}")
    (tmp_path / "p.json").write_text("{}")
    s = sessions.read_sessions(spark, str(tmp_path))
    assert [(r.session_id, r.original_size) for r in sessions.session_entries(s).collect()] == [("a", 10)]
    assert sorted(r[1:] for r in sessions.session_metrics(s).collect()) == [(0, 0), (2, 3)]  # p is a fresh session
    (tmp_path / "p.json").unlink()
    assert sessions.clean(spark, str(tmp_path), 30) == 0 and sessions.clean(spark, str(tmp_path), 0) == 2 and sessions.clean(spark, str(tmp_path / "none"), 0) == 0


SIX = ["session_id", "turn", "entries", "tool_cache", "metrics", "context_used_pct", "compact_requested"]


def many_sessions(spark, n):
    t = F.timestamp_micros(F.col("id") * 61_000_001 + F.col("k"))
    rows = spark.range(n).withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("id") % 4 + 1).cast("int"))))
    made = rows.select(
        F.format_string("s %d/ü", "id").alias("session_id"), F.concat(F.lit("h"), "k").alias("hash"), F.col("k").alias("turn"), F.when(F.col("k") > 1, F.lit("Tool")).otherwise(F.lit("")).alias("tool_name"), (F.col("id") + 9).cast("int").alias("original_size"),
        F.col("k").alias("compressed_size"), F.array_repeat(F.lit("dedup"), F.col("k") - 1).alias("strategies"), t.alias("stored_at"), F.concat(F.lit('line\n"q" '), "k").alias("content"))
    state = spark.range(0, n, 3).select(F.format_string("s %d/ü", "id").alias("session_id"), (F.col("id") % 50).cast("int").alias("turn"), F.lit(4).alias("pre_cache_hits"), F.lit(5).alias("pre_cache_misses"), (F.col("id") / 8).alias("context_used_pct"), (F.col("id") % 2 == 0).alias("compact_requested"))
    return sessions.as_sessions(made, made.where("turn > 2").withColumn("key", F.concat(F.lit("key"), "hash")), state)


def test_sessions_round_trip(spark, tmp_path):
    before = many_sessions(spark, 1000)
    sessions.write_sessions(before, str(tmp_path / "out"))
    after = sessions.read_sessions(spark, str(tmp_path / "out"))
    flat = lambda df: sorted((r.session_id, r.turn, sorted((k, tuple(v)) for k, v in r.entries.items()).__repr__(), repr(sorted((k, tuple(v)) for k, v in r.tool_cache.items())), tuple(r.metrics), r.context_used_pct, r.compact_requested) for r in df.select(SIX).collect())
    assert flat(before) == flat(after) and after.count() == 1000
    with pytest.raises(Exception, match="already exists"):
        sessions.write_sessions(before, str(tmp_path / "out"))
    sessions.write_sessions(before.limit(2), str(tmp_path / "out"), "append")
    assert sessions.read_sessions(spark, str(tmp_path / "out")).count() == 1002
    turns = [(r.session_id, r.turn) for r in sessions.entries_by_turn(sessions.session_entries(after)).collect()]
    assert turns == sorted(turns) and len(turns) == 2500


def test_reports_show_caches(spark):
    s = many_sessions(spark, 8).withColumn("modified_at", F.current_timestamp())
    made, cache = sessions.session_entries(s), sessions.session_entries(s, "tool_cache")
    rows = {r.section: json.loads(r.line) for r in analytics.report(made, cache, sessions.session_metrics(s)).collect()}
    assert rows["pre_cache"] == {"hits": 12, "misses": 15} and rows["cache"]["key"].startswith("keyh") and set(rows) == {"total", "tools", "strategies", "sessions", "top", "timeline", "cache", "pre_cache"}
    lines = analytics.report_lines(made, cache).collect()
    assert {r.section for r in lines} == {"tools", "strategies", "top", "cache", "timeline", "total"} and sum(r.section == "timeline" for r in lines) == 10


def test_a_stream_starts_from_stored_sessions(spark, tmp_path):
    text = "\n".join(f"known line {k} of a stored text" for k in range(40))
    entry = lambda content: [(content_key(content), 2, "Read", 900, 900, [], None, content)]

    def content_key(content):
        return spark.range(1).select(content_hash(F.lit(content))).head()[0]

    columns = "hash string, turn int, tool_name string, original_size int, compressed_size int, strategies array<string>, stored_at timestamp, content string"
    made = spark.createDataFrame(entry(text), columns).withColumn("session_id", F.lit("old"))
    cache = spark.createDataFrame(entry("an answer"), columns).withColumns({"session_id": F.lit("old"), "key": F.lit("k1")})
    state = spark.createDataFrame([("old", 6, 1, 1, 80.0, False)], "session_id string, turn int, pre_cache_hits int, pre_cache_misses int, context_used_pct double, compact_requested boolean")
    sessions.write_sessions(sessions.as_sessions(made, cache, state), str(tmp_path / "stored"))
    stored = sessions.read_sessions(spark, str(tmp_path / "stored"))
    rows = [("old", 1, "pre", "Read", {}, "k1", None, None, None), ("old", 2, "post", "Read", {}, "k2", text, False, None), ("old", 3, "post", "Read", {}, "k3", text.replace("line 7 ", "row 7 "), False, None), ("new", 1, "pre", "Read", {}, "k1", None, None, None)]
    spark.createDataFrame(rows, live.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.EVENTS).parquet(str(tmp_path / "in"))
    q = live.session_answers(stream, stored=stored).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    got = {(r.session_id, r.seq): r for r in spark.table("restored").collect()}
    assert got["old", 1].cache_hit and got["old", 1].context.endswith("\n\nan answer") and "80%" in got["old", 1].context
    assert "seen 4 turn(s) ago by Read" in got["old", 2].output and "near-match" in got["old", 3].output and got["old", 3].turn == 6
    assert not got["new", 1].cache_hit


def test_published_scenarios(spark):
    done = {r.session_id: r for r in scenario_savings(compress(scenario_calls(spark))).collect()}
    want = {"repeated file read": ("dedup", 70), "repeated status": ("dedup", 45), "json array": ("structure", 75), "stack trace": ("structure", 15), "file tree": ("structure", 75), "test output": ("structure", 75), "log stream": ("structure", 75), "relevance trim": ("relevance", 80), "combined session": ("dedup", 50)}
    assert {name: r.strategy for name, r in done.items()} == {name: s for name, (s, _) in want.items()}
    assert all(done[name].saved_pct >= least for name, (_, least) in want.items()), {n: round(r.saved_pct, 1) for n, r in done.items()}


def test_cache_and_scenarios(spark, calls):
    keys = spark.createDataFrame([("s", 1, "k"), ("s", 2, "k"), ("s", 3, "j")], "session_id string, seq long, cache_key string")
    assert [(r.seq, r.cached_seq) for r in pre_cache(keys).where("hit").collect()] == [(2, 1)]
    text = "\n".join(f"file line {i} with words" for i in range(40))
    r = scenario_savings(compress(calls([("repeat", k, 0, "Read", {}, text) for k in range(5)]))).head()
    assert r.strategy == "dedup" and r.tokens_in == 5 * r.tokens_in // 5 and r.saved_pct > 70


def test_session_stream(spark, tmp_path):
    text = "\n".join(f"x{i} same line here" for i in range(30))
    rows = [("a", 1, "pre", "Bash", {}, "k1", None, None, None), ("a", 2, "post", "Bash", {}, "k1", text, False, None), ("a", 3, "stop", None, None, None, None, None, 80.0), ("a", 4, "pre", "Bash", {}, "k1", None, None, None),
            ("a", 5, "post", "Bash", {}, "k2", text, False, None), ("a", 6, "post", "Bash", {}, "k3", text.replace("x7", "y7"), False, None), ("a", 7, "post", "Bash", {}, "k1", text, False, None), ("a", 8, "post", "Bash", {}, "k9", "x", True, None), ("b", 1, "post", "R", {}, "k", ARRAY, False, None)]
    df = spark.createDataFrame(rows, live.EVENTS)
    folder = str(tmp_path / "in")
    df.where("seq <= 4").coalesce(1).write.mode("append").parquet(folder)
    df.where("seq > 4").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    q = live.session_answers(stream).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    got = {(r.session_id, r.seq): r for r in spark.table("answers").collect()}
    if ("b", 1) in got and ("a", 5) in got and got["a", 5].turn == 1:
        assert not got["a", 1].emitted and got["a", 4].cache_hit and "auto-compact at 80%" in got["a", 4].context and got["a", 4].context.endswith(text)
        assert got["a", 5].strategies == ["dedup"] and "seen 1 turn(s) ago" in got["a", 5].output and got["a", 5].emitted
        assert "near-match" in got["a", 6].output and got["a", 7].modified and not got["a", 7].emitted  # the call was cached
        assert ("a", 8) not in got
    assert got["b", 1].strategies == ["structure"]


def test_hook_events_with_large_ids_agree_with_sql(spark, tmp_path):
    import duckdb

    from terselake.oracle import ORACLE_SQL
    from terselake.queries import QUERIES

    con = duckdb.connect()
    ids = "unnest([0, 999999, 1000000, 1000004, 1234567, 5999998, 123456789012])"
    con.execute(f"COPY (SELECT {ids}::BIGINT AS event_id, 21::BIGINT AS user_id, 'view' AS event_type) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(ORACLE_SQL["hook_events"])
    got = QUERIES["hook_events"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and got.count() == 7
