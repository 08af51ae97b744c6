"""The savings scenarios as calls: nine small sessions, one for each way in which outputs repeat or sprawl.

The texts are made by rule, of the kinds and about the sizes that the published savings speak of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CALLS = "session_id string, seq long, turn int, tool_name string, tool_input map<string,string>, content string"


def _source_file() -> str:
    body = [f"    total += weights[{k}] * inputs[{k}]" for k in range(26)]
    return "\n".join(["def forward(inputs, weights):", "    total = 0.0", *body, "    return total", ""])


def _status() -> str:
    changed = [f"\tmodified:   lib/{name}.rb" for name in ("parser", "lexer", "emitter", "driver", "report", "reader", "writer", "tokens", "symbols")]
    return "\n".join(["On branch release", "Your branch is ahead of 'upstream/release' by 2 commits.", "", "Changes not staged for commit:", *changed, "", "Untracked files:", "\tnotes.txt", "\ttmp/", "", "no changes added to commit"])


def _orders(n: int) -> str:
    return "[" + ", ".join(f'{{"order":{k},"customer":"c{k * 7 % 100}","state":"{("open", "paid", "sent")[k % 3]}","total":{k * 3}.5}}' for k in range(n)) + "]"


def _trace() -> str:
    calls = [(c, m) for c in ("Cart", "Checkout", "Flow", "Server") for m in ("price", "sum", "run")]
    frames = [f"    at com.shop.{c}.{m}({c}.java:{11 * k + 8})" for k, (c, m) in enumerate(calls)]
    return "\n".join(["checkout failed", "Exception in thread main", *frames])


def _tree() -> str:
    return "\n".join(["shop", *(line for folder in ("models", "views", "tests") for line in (f"├── {folder}", *(f"│   ├── part{k:02d}.rb" for k in range(12))))])


def _tests() -> str:
    failed = ["--- FAIL: CheckTotals (0.20s)", "    totals_test.go:17: got 9, want 10", "--- FAIL: CheckLogin (0.04s)", "    login_test.go:61: no cookie"]
    return "\n".join([*(f"--- PASS: Check{k:02d} (0.01s)" for k in range(40)), *failed])


def _log() -> str:
    beats = [f"2023-03-04 08:{k:02d}:30 DEBUG heartbeat from node" for k in range(30)]
    return "\n".join([*beats, *(f"2023-03-04 08:{k:02d}:45 INFO cache refreshed" for k in range(5)), "2023-03-04 08:40:00 WARN disk almost full"])


def _settings() -> str:
    rows = [f"{('mail', 'search', 'billing', 'theme', 'proxy')[k % 5]}.option{k} = {k * 17 % 1009}" for k in range(3000)]
    return "\n".join([*rows, *(f"payment.retry{k} = {k + 1}s" for k in range(15))])


def scenarios() -> list[tuple[str, str, dict[str, str], list[str]]]:
    """(name, tool, arguments, outputs in turn) of each."""
    source, status = _source_file(), _status()
    return [
        ("repeated file read", "Read", {"file_path": "lib/forward.py"}, [source] * 5),
        ("repeated status", "Shell", {"command": "status"}, [status] * 4),
        ("json array", "Fetch", {"url": "orders"}, [_orders(50)]),
        ("stack trace", "Shell", {"command": "run checkout"}, [_trace()]),
        ("file tree", "Shell", {"command": "tree"}, [_tree()]),
        ("test output", "Shell", {"command": "run tests"}, [_tests()]),
        ("log stream", "Shell", {"command": "tail"}, [_log()]),
        ("relevance trim", "Read", {"query": "payment retry"}, [_settings()]),
        ("combined session", "Shell", {"command": "several"}, [source, status, source, status, _orders(20), source]),
    ]


def scenario_calls(spark: SparkSession) -> DataFrame:
    """A session for each scenario; the turn never advances in it."""
    return spark.createDataFrame([(name, k, 0, tool, arguments, text) for name, tool, arguments, texts in scenarios() for k, text in enumerate(texts)], CALLS)
