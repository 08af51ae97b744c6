"""Sessions as a stateful stream: post, pre and stop events in, answers out.

What depends on one event alone (error gate, shape collapse, trimming, header) is computed by Column
functions before the state is touched. The processor keeps, per session, the contents by hash, the
cached outputs by call, the turn and the context use; it adds exact and near dedup, cache hits
and the compaction nudge. State lies in the RocksDB store; a session's contents are bounded by
``max_session_bytes`` and, with ``expire``, by time. Sizes lie apart from contents, so that only
contents of a possible near match are read and aligned. A stream may start from stored sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terselake.functions import similarity, tokens
from terselake.functions.text import content_hash
from terselake.operators.relevance import query_terms
from terselake.plans.compress import after_dedup, with_flags
from terselake.plans.config import Config
from terselake.sources.sessions import state_rows
from terselake.streaming import kernel

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events: kind is post, pre or stop; columns that a kind lacks are null.
EVENTS = "session_id string, seq long, kind string, tool_name string, tool_input map<string,string>, cache_key string, content string, is_error_response boolean, used_pct double"
ANSWERS = "session_id string, seq long, kind string, turn int, output string, context string, emitted boolean, modified boolean, strategies array<string>, cache_hit boolean"


def prepared(events: DataFrame, config: Config) -> DataFrame:
    """Events with what follows from each alone: flags, hash, and the output if it were not deduplicated."""
    calls = events.withColumns({"tool_input": F.coalesce("tool_input", F.expr("cast(map() as map<string,string>)")), "content": F.coalesce("content", F.lit("")), "tool_name": F.coalesce("tool_name", F.lit("")), "session_id": F.coalesce(F.nullif("session_id", F.lit("")), F.lit("default"))})
    flagged = with_flags(calls, config).withColumns({"hash": content_hash(F.col("content")), "deduped": F.lit(None).cast("string"), "terms": query_terms(F.col("tool_input")), "n_tokens": tokens.estimate(F.col("content"))})
    return after_dedup(flagged, config).select(
        "session_id", "seq", "kind", "tool_name", "cache_key", "content", F.coalesce("is_error_response", F.lit(False)).alias("is_error_response"), "used_pct", "is_error", "keeps_raw", "hash", "terms", "n_tokens", "output", "modified", "strategies")


class SessionProcessor(StatefulProcessor):
    def __init__(self, config: Config, expire: bool = False):
        self.config, self.expire = config, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.config.retention_days * 86_400_000 if self.expire and self.config.retention_days > 0 else None
        self.contents = handle.getMapState("contents", "hash string", "turn int, seq long, tool string, content string", ttl)
        self.sizes = handle.getMapState("sizes", "hash string", "turn int, seq long, words int, bytes int", ttl)
        self.cache = handle.getMapState("cache", "key string", "output string", ttl)
        self.session = handle.getValueState("session", "turn int, used_pct double, nudged boolean, hits int, misses int, bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        self.turn, self.used, self.nudged, self.hits, self.misses, self.bytes = self.session.get() if self.session.exists() else (0, None, False, 0, 0, 0)
        # events of a session in their own order, whatever the order of arrival within a batch
        events = sorted((r for part in rows for r in part.to_dict("records")), key=lambda r: r["seq"])
        answers = [a for r in events if (a := {"post": self.post, "pre": self.pre, "stop": self.stop}[r["kind"]](r))]
        self.session.update((self.turn, self.used, self.nudged, self.hits, self.misses, self.bytes))
        columns = [c.split()[0] for c in ANSWERS.split(", ")]
        yield pd.DataFrame([{**dict.fromkeys(columns), "session_id": key[0], **a} for a in answers], columns=columns)

    def handleInitialState(self, key, rows: pd.DataFrame, timer_values) -> None:
        """Rows of ``sources.sessions.state_rows``; a session's rows may come in several parts."""
        self.turn, self.used, self.nudged, self.hits, self.misses, self.bytes = self.session.get() if self.session.exists() else (0, None, False, 0, 0, 0)
        for r in rows.to_dict("records"):
            if r["kind"] == "session":
                self.turn, self.used, self.nudged, self.hits, self.misses = int(r["turn"]), float(r["used_pct"]) or None, bool(r["nudged"]), int(r["hits"]), int(r["misses"])
            elif r["kind"] == "cache":
                self.cache.updateValue((r["key"],), (r["content"],))
            else:
                self._keep(r["key"], int(r["turn"]), int(r["seq"]), r["tool_name"], r["content"])
        self.session.update((self.turn, self.used, self.nudged, self.hits, self.misses, self.bytes))

    def stop(self, r: dict) -> dict | None:
        self.turn += 1
        if r["used_pct"] is not None and r["used_pct"] == r["used_pct"]:
            self.used = float(r["used_pct"])
        self.nudged = False
        return {"seq": r["seq"], "kind": "stop", "turn": self.turn, "emitted": False}

    def nudge(self) -> str:
        c = self.config
        if c.compact_threshold <= 0 or (self.used or 0.0) < c.compact_threshold or self.nudged:
            return ""
        self.nudged = True
        return f"[{c.label}: auto-compact at {self.used:.0f}% context usage]\n{c.compact_message}"

    def pre(self, r: dict) -> dict:
        hit = self.cache.containsKey((r["cache_key"],))
        self.hits, self.misses = self.hits + hit, self.misses + (not hit)
        cached = self.cache.getValue((r["cache_key"],))[0] if hit else None
        nudge = self.nudge()
        context = "\n\n".join(x for x in (nudge, cached) if x is not None and (x or hit)) if hit and nudge else cached if hit else nudge or None
        return {"seq": r["seq"], "kind": "pre", "turn": self.turn, "context": context, "emitted": hit or bool(nudge), "cache_hit": bool(hit)}

    def post(self, r: dict) -> dict | None:
        if r["is_error_response"] or not r["content"]:
            return None
        cached = self.cache.containsKey((r["cache_key"],))
        output, modified, strategies = r["output"], bool(r["modified"]), list(r["strategies"])
        if not r["is_error"]:
            if self.config.enabled("dedup") and (found := self.deduplicated(r)):
                output, modified, strategies = found
            self.remember(r)
        self.cache.updateValue((r["cache_key"],), (output if r["keeps_raw"] else "",))
        return {"seq": r["seq"], "kind": "post", "turn": self.turn, "output": output, "emitted": modified and not cached, "modified": modified, "strategies": strategies, "cache_hit": bool(cached)}

    def deduplicated(self, r: dict) -> tuple[str, bool, list[str]] | None:
        size, text = len(r["content"].encode()), None
        if self.contents.containsKey((r["hash"],)):
            turn, _, tool, _ = self.contents.getValue((r["hash"],))
            text = f"[unchanged — seen {self.turn - turn} turn(s) ago by {tool}]"
        elif best := self.near(r["content"]):
            turn, _, tool, old = best
            text = f"[near-match from {self.turn - turn} turn(s) ago by {tool} — diff only]\n{similarity.unified_diff(old, r['content'])}"
        if text is None or len(text.encode()) >= size:
            return None
        strategies, c = ["dedup"], self.config
        if c.enabled("relevance") and len(r["terms"]):
            shorter = kernel.trim(text, list(r["terms"]), c.token_budget, c.min_relevance_lines)
            if shorter is not None and len(shorter.encode()) < len(text.encode()):
                text, strategies = shorter, ["dedup", "relevance"]
        head = f"[{c.label}: {kernel.number(int(r['n_tokens']))} → {kernel.number(kernel.estimate(text))} tokens | {'+'.join(strategies)}]\n"
        return head + text, True, strategies

    def near(self, content: str) -> tuple | None:
        """The entry of the highest ratio; lengths first, then the words in common, since the ratio can't exceed their bounds."""
        n, least = len(similarity.word_list(content)), self.config.near_match
        best, best_score = None, 0.0
        able = [(turn, seq, h) for (h,), (turn, seq, words, size) in self.sizes.iterator() if size and 2.0 * min(words, n) >= least * (words + n)]
        for turn, seq, h in sorted(able):
            entry = self.contents.getValue((h,))
            score = similarity.ratio_from(entry[3], content, least)
            if score is not None and score >= least and score > best_score:
                best, best_score = entry, score
        return best

    def remember(self, r: dict) -> None:
        self._keep(r["hash"], self.turn, int(r["seq"]), r["tool_name"], r["content"] if r["keeps_raw"] else "")

    def _keep(self, key: str, turn: int, seq: int, tool: str, text: str) -> None:
        if self.sizes.containsKey((key,)):
            self.bytes -= self.sizes.getValue((key,))[3]
        size = len(text.encode())
        self.contents.updateValue((key,), (turn, seq, tool, text))
        self.sizes.updateValue((key,), (turn, seq, len(similarity.word_list(text)), size))
        self.bytes += size
        if self.bytes > self.config.max_session_bytes:  # the oldest go until half of the cap is left
            for (h,), (_, _, _, old) in sorted(self.sizes.iterator(), key=lambda e: e[1][1]):
                if self.bytes <= self.config.max_session_bytes // 2:
                    break
                self.contents.removeKey((h,))
                self.sizes.removeKey((h,))
                self.bytes -= old

    def close(self) -> None:
        pass


def session_answers(events: DataFrame, config: Config = Config(), expire: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """Answers of a stream of ``EVENTS``; set the session's state store provider to ``STATE_STORE``.

    With ``expire``, entries not written for ``retention_days`` leave the state; the stream then runs on
    processing time and does not end by itself. ``stored``: sessions (``sources.sessions.read_sessions``)
    that the stream's first batch starts from.
    """
    mode = "ProcessingTime" if expire else "None"
    initial = state_rows(stored).groupBy("session_id") if stored is not None else None
    return prepared(events, config).groupBy("session_id").transformWithStateInPandas(SessionProcessor(config, expire), outputStructType=ANSWERS, outputMode="Append", timeMode=mode, initialState=initial)
