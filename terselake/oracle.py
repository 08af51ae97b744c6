"""DuckDB SQL for the registered queries of the engine's own operators."""

from __future__ import annotations

# The code points with the Unicode property White_Space, as a string and as an RE2 class.
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
WS_RE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NL = "chr(10)"


def trim(t: str) -> str:
    return f"trim({t}, {WS})"


def hashed(t: str) -> str:
    return f"substr(sha256({trim(t)}), 1, 32)"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS_RE}'), lambda w: w <> '')"


def lines(t: str) -> str:
    return f"string_split({t}, {NL})"


def joined(items: str) -> str:
    return f"array_to_string({items}, {NL})"


def tokens(t: str) -> str:
    """Estimate, with the word list computed in place."""
    w = words(t)
    head = f"({w})[1:40]"
    technical = rf"len(list_filter({head}, lambda x: regexp_matches(x, '[/\\.:()A-Z]') OR (strlen(x) > 4 AND contains(x, '_'))))"
    ratio = f"(0.75::DOUBLE - ({technical}::DOUBLE / len({head})) * 0.15::DOUBLE)"
    marks = f"(length({t}) - length(translate({t}, '{{}}[]', ''))) + (length({t}) - length(translate({t}, ':,;()', '')) + 1) // 2"
    return f"CAST(CASE WHEN len({w}) = 0 THEN 0 ELSE ceil(len({w}) / {ratio}) + {marks} END AS INTEGER)"


def user_lines(line: str) -> str:
    return f"SELECT user_id AS id, list(line ORDER BY event_id) AS l FROM (SELECT user_id, event_id, {line} AS line FROM events) GROUP BY user_id"


def shown(source: str, fires: str, output: str, more: str = "") -> str:
    """id, fires, output over lists of lines l."""
    return f"WITH t AS ({source}), u AS (SELECT *{more} FROM t) SELECT id, ({fires}) AS fires, CASE WHEN {fires} THEN {output} END AS output FROM u"


def rest(items: str, n: int, what: str) -> str:
    return f"list_concat({items}[1:{n}], CASE WHEN len({items}) > {n} THEN ['…and ' || (len({items}) - {n}) || ' more {what}'] ELSE [] END)"


def bucket(key: str, source: str) -> str:
    return f"""SELECT {key} AS name, count(*) AS entries, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed,
        CAST(sum(original_size) - sum(compressed_size) AS BIGINT) AS saved, round(CASE WHEN sum(original_size) > 0 THEN (sum(original_size) - sum(compressed_size))::DOUBLE / sum(original_size) * 100.0 ELSE 0.0 END, 6) AS saved_pct
        FROM ({source}) GROUP BY {key}"""


ENTRIES = """SELECT CAST(user_id % 50 AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS hash, CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type END AS tool_name,
    CAST(event_id % 997 * 13 AS INTEGER) AS original_size, CAST(event_id % 89 * 7 AS INTEGER) AS compressed_size,
    CASE event_id % 4 WHEN 0 THEN ['dedup'] WHEN 1 THEN ['structure', 'relevance'] WHEN 2 THEN ['structure'] ELSE [] END AS strategies, ts AS stored_at, props AS content FROM events"""
BY_LANG = f"SELECT lang AS session_id, doc_id AS seq, CAST(doc_id // 10 AS INTEGER) AS turn, source AS tool_name, text AS content, {hashed('text')} AS hash FROM documents"
PREVIOUS = f"SELECT *, lag(seq) OVER w AS p_seq, lag(turn) OVER w AS p_turn, lag(tool_name) OVER w AS p_tool FROM ({BY_LANG}) WINDOW w AS (PARTITION BY session_id, hash ORDER BY seq)"
LABELLED = f"SELECT *, CASE WHEN p_seq IS NOT NULL AND strlen(label) < strlen(content) THEN label END AS exact_label FROM (SELECT *, '[unchanged — seen ' || (turn - p_turn) || ' turn(s) ago by ' || p_tool || ']' AS label FROM ({PREVIOUS}))"
EVENT_KEYS = """SELECT user_id AS session_id, event_id AS seq, '{"input":' || props || ',"tool":"' || event_type || '"}' AS cache_key FROM events"""
TRACE_LINE = "CASE WHEN event_id % 6 = 0 THEN 'log ' || event_type ELSE '    at ' || event_type || ' (f.js:' || event_id || ')' END"
TREE_LINE = "CASE WHEN event_id % 17 = 0 THEN '' ELSE '│  ├── ' END || event_type || '_' || event_id"
TEST_LINE = "CASE WHEN event_id % 11 = 0 THEN '--- FAIL: ' WHEN event_id % 11 = 1 THEN 'note ' ELSE 'ok  pkg/' END || event_type || ' ' || event_id"
DIFF_LINE = "CASE WHEN event_id % 5 = 0 THEN '@@ hunk' WHEN event_id % 3 = 0 THEN '+' WHEN event_id % 3 = 1 THEN '-' ELSE ' ' END || event_type || ' ' || event_id"
LOG_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type"
PACKAGE_LINE = "CASE event_id % 7 WHEN 0 THEN 'npm WARN deprecated' WHEN 1 THEN 'added 3 packages' WHEN 2 THEN 'removed 1 package' WHEN 3 THEN '2 vulnerabilities' WHEN 4 THEN 'npm ERR! code' ELSE 'fetch' END || ' ' || event_type"
COVERAGE_LINE = "CASE WHEN event_id % 9 = 0 THEN 'total coverage' ELSE event_type END || ' ' || (event_id % 13) || '.5%'"
DIAGNOSTIC_LINE = "CASE WHEN event_id % 4 = 0 THEN 'note ' ELSE 'src/a' END || event_type || '.py:' || event_id || ': bad'"
DIAGNOSTIC = r"^\S+\.(go|ts|tsx|js|jsx|rs|py|java|c|cc|cpp|h):\d+(:\d+)?:"
PASS = r"(?i)^(ok |PASS|--- PASS:|\.+\s*$|test \w+ \.\.\. ok)"
FAIL = r"(?i)(FAIL|Error|panic|--- FAIL|^\s+\S+_test\.go:\d+)"
SUMMARY = r"(?i)(Tests run|passed|failed|skipped|ok\s+\S+\s+[\d.]+s)"
STAMP = r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}|^\d{4}[-/]\d{2}[-/]\d{2}|^\[\d{2}:\d{2}:\d{2}\]|^\d{10,}"


def where(items: str, test: str) -> str:
    return f"list_filter({items}, lambda x: {test})"


def with_any(needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{n}')" for n in needles) + ")"


LOG_ROWS = f"SELECT id, pos, l[pos] AS line, {trim(f'''regexp_replace(l[pos], '{STAMP}', '')''')} AS msg FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS pos FROM ({user_lines(LOG_LINE)}))"
TERMS = ["the", "idiot", "que", "der", "moron"]
DOC_LINES = f"SELECT doc_id, pos - 1 AS pos, l[pos] AS line, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, {lines('text')} AS l FROM documents))"
TRIM_TERMS = "['worthless', 'idiot', 'scum']"

HOOK_SESSION = "CASE WHEN user_id % 10 = 0 THEN 'default' ELSE 'u' || user_id END"
CALL_KEY = """substr(sha256('{"input":{"id":' || event_id || '},"tool":"' || event_type || '"}'), 1, 32)"""


def number(n: str) -> str:
    """With one thousands separator."""
    return f"CASE WHEN {n} >= 1000 THEN ({n} // 1000) || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


ORACLE_SQL: dict[str, str] = {
    "content_hash": f"SELECT doc_id, {hashed('text')} AS hash, CAST(strlen(text) AS INTEGER) AS bytes FROM documents",
    "token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "word_tokens": f"SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS INTEGER) AS n_tokens, CAST(len({words('text')}) AS INTEGER) AS n_words FROM conversations",
    "number_formats": """SELECT doc_id, CASE WHEN n >= 1000 THEN (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS num,
        CASE WHEN n >= 1048576 THEN printf('%.1f', n / 1048576.0::DOUBLE) || 'MB' WHEN n >= 1024 THEN printf('%.1f', n / 1024.0::DOUBLE) || 'KB' ELSE n || 'B' END AS bytes,
        CASE WHEN n >= 1000 THEN (n // 1000) || 'k' ELSE CAST(n AS VARCHAR) END AS tokens FROM (SELECT doc_id, strlen(text) * 37 AS n FROM documents)""",
    "error_gate": "SELECT conv_id, turn, (" + " OR ".join(f"(contains(t, '{k}') AND strlen(t[1:strpos(t, '{k}') - 1]) + {len(k)} <= 200)" for k in ("idiot", "the and", "fatal:")) + ") AS is_error FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)",
    "huge_line_filter": "WITH d AS (SELECT doc_id, text, replace(replace(text, ' ', ''), chr(10), '') AS g FROM documents) SELECT doc_id, " + ", ".join(
        f"(len(list_filter({lines(c)}, lambda x: strlen(x) > 20000 AND len({words('x')}) < 20)) > 0) AS {n}" for c, n in (("text", "plain"), ("g", "glued"))) + " FROM d",
    "event_names": "SELECT page_id, CASE WHEN k = '' THEN 'hook' ELSE k END AS name FROM (SELECT page_id, regexp_replace(lower(url), '[^a-z0-9-]', '', 'g') AS k FROM pages)",
    "exact_dedup": f"SELECT seq AS doc_id, p_seq AS previous, CAST(turn - p_turn AS INTEGER) AS turns_ago, exact_label AS label FROM ({LABELLED})",
    "dedup_savings": f"""SELECT session_id, count(*) AS events, count(exact_label) AS repeats, CAST(sum(strlen(content)) AS BIGINT) AS original, CAST(sum(coalesce(strlen(exact_label), strlen(content))) AS BIGINT) AS final,
        round((sum(strlen(content)) - sum(coalesce(strlen(exact_label), strlen(content))))::DOUBLE / sum(strlen(content)) * 100.0, 6) AS saved_pct FROM ({LABELLED}) GROUP BY session_id""",
    "dedup_last_write": f"SELECT session_id, count(*) AS contents, CAST(sum(seq) AS BIGINT) AS seq_sum, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY session_id, hash ORDER BY seq DESC) AS k FROM ({BY_LANG})) WHERE k = 1 GROUP BY session_id",
    "near_candidates": f"""WITH w AS (SELECT lang AS session_id, doc_id AS seq, unnest({words('text')}) AS w FROM documents), c AS (SELECT session_id, seq, w, count(*) AS c FROM w GROUP BY ALL),
        n AS (SELECT session_id, seq, sum(c) AS n FROM c GROUP BY ALL),
        o AS (SELECT a.session_id, a.seq, b.seq AS old_seq, sum(least(a.c, b.c)) AS o FROM c a JOIN c b ON a.session_id = b.session_id AND a.w = b.w AND b.seq < a.seq GROUP BY ALL)
        SELECT o.session_id, o.seq, o.old_seq, round(2.0::DOUBLE * o / (x.n + y.n), 9) AS bound FROM o JOIN n x ON x.session_id = o.session_id AND x.seq = o.seq JOIN n y ON y.session_id = o.session_id AND y.seq = o.old_seq
        WHERE 2.0::DOUBLE * o / (x.n + y.n) >= 0.85 - 1e-12""",
    "json_array_collapse": f"""WITH t AS (SELECT o_custkey AS id, list('{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}' ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)
        SELECT id, len(l) > 3 AS fires, CASE WHEN len(l) > 3 THEN l[1] || ',' || {NL} || l[2] || ',' || {NL} || '…and ' || (len(l) - 2) || ' more items' END AS output FROM t""",
    "json_object_collapse": f"""WITH t AS (SELECT CAST(n_nationkey % 2 AS INTEGER) AS id, list(n_name || '_' || n_nationkey || ': ' || n_nationkey ORDER BY n_name || '_' || n_nationkey) AS l FROM nation GROUP BY 1)
        SELECT id, len(l) > 8 AS fires, CASE WHEN len(l) > 8 THEN {joined("list_concat(l[1:5], ['…and ' || (len(l) - 5) || ' more keys'])")} END AS output FROM t""",
    "json_lines_collapse": f"""WITH t AS (SELECT l_orderkey AS id, list('{{"part":' || l_partkey || ',"line":' || l_linenumber || ',"flag":"' || l_returnflag || '"}}' ORDER BY l_linenumber, l_partkey, l_suppkey) AS l FROM lineitem GROUP BY l_orderkey)
        SELECT id, len(l) > 3 AS fires, CASE WHEN len(l) > 3 THEN {joined("list_concat(l[1:2], ['…and ' || (len(l) - 2) || ' more JSON records'])")} END AS output FROM t""",
    "csv_collapse": f"""WITH t AS (SELECT l_orderkey AS id, list(l_partkey || ',' || l_linenumber || ',' || l_returnflag || ',' || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS l FROM lineitem GROUP BY l_orderkey)
        SELECT id, len(l) > 3 AS fires, CASE WHEN len(l) > 3 THEN {joined("list_concat(['part,line,flag,status'], l[1:2], ['…and ' || (len(l) - 2) || ' more rows'])")} END AS output FROM t""",
    "unified_diff_collapse": shown(
        user_lines(DIFF_LINE), f"len(l) >= 20 AND contains({joined('l')}, '@@') AND len(p) + len(m) >= 8",
        joined("list_concat(list_transform(list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '@@') OR list_contains(p[1:3], i) OR list_contains(m[1:3], i)), lambda i: l[i]), ['… ' || len(p) || ' additions, ' || len(m) || ' deletions'])"),
        ", list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '+') AND NOT starts_with(l[i], '+++')) AS p, list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '-') AND NOT starts_with(l[i], '---')) AS m"),
    "diagnostics_collapse": shown(user_lines(DIAGNOSTIC_LINE), "len(f) >= 8", joined("list_concat(f[1:5], ['…and ' || (len(f) - 5) || ' more diagnostics'])"), f", {where('l', f'''regexp_matches(x, '{DIAGNOSTIC}')''')} AS f"),
    "coverage_collapse": shown(
        user_lines(COVERAGE_LINE), f"len(l) >= 8 AND contains(lower({joined('l')}), 'coverage') AND (len(w) > 0 OR len(t) > 0)", joined(f"list_concat({rest('w', 5, 'low-coverage entries')}, t[len(t):len(t)])"),
        f", {where('l', '''contains(x, '%') AND (contains(x, ' 0.') OR contains(x, ' 1.') OR contains(x, ' 2.') OR contains(x, ' 3.') OR contains(x, ' 4.'))''')} AS w, {where('l', '''contains(lower(x), 'total')''')} AS t"),
    "package_log_collapse": shown(
        user_lines(PACKAGE_LINE), f"len(l) >= 12 AND contains(lower({joined('l')}), 'npm ') AND len(k) > 0",
        joined("list_concat(['[package-log: npm | ' || " + " || ".join([
            f"len({where('l', with_any(['error', 'err!']))}) || ' error(s), '", f"len({where('l', with_any(['warn']) + ' AND NOT ' + with_any(['error', 'err!']))}) || ' warning(s), '",
            f"len({where('l', with_any(['added ', 'installed ', 'compiling ']))}) || ' install/build line(s), '", f"len({where('l', with_any(['removed ', 'uninstalled ']))}) || ' removal(s), '", f"len({where('l', with_any(['vulnerab']))}) || ' vulnerability line(s)]'",
        ]) + f"], {rest('k', 8, 'package log lines')})"),
        f", {where('l', with_any(['error', 'err!', 'warn', 'added ', 'removed ', 'audited ', 'vulnerab', 'successfully installed', 'compiling ']))} AS k"),
    "markup_summary": f"""WITH t AS (SELECT page_id AS id, {trim('html')} AS h, list_transform(regexp_extract_all({trim('html')}, '<\\s*([a-zA-Z0-9:_-]+)', 1), lambda x: lower(x)) AS g FROM pages),
        k AS (SELECT id, tag, count(*) AS n, min(pos) AS first FROM (SELECT id, unnest(g) AS tag, unnest(range(len(g))) AS pos FROM t) GROUP BY ALL),
        s AS (SELECT id, list(tag || ': ' || n ORDER BY first) AS l FROM k GROUP BY id)
        SELECT t.id, f AS fires, CASE WHEN f THEN {joined(f"list_concat(['[markup: ' || len(g) || ' tags]'], {rest('l', 6, 'tag types')})")} END AS output
        FROM (SELECT *, starts_with(h, '<') AND (contains(h, '</') OR contains(h, '/>')) AND len(g) >= 12 AS f FROM t) t LEFT JOIN s ON s.id = t.id""",
    "tag_counts": f"SELECT page_id, tag, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_at FROM (SELECT page_id, unnest(g) AS tag, unnest(range(len(g))) AS pos FROM (SELECT page_id, list_transform(regexp_extract_all({trim('html')}, '<\\s*([a-zA-Z0-9:_-]+)', 1), lambda x: lower(x)) AS g FROM pages)) GROUP BY page_id, tag",
    "stack_trace_collapse": shown(
        f"SELECT id, list_concat(['start', 'Exception in thread main'], l, ['end']) AS l FROM ({user_lines(TRACE_LINE)})", "len(f) >= 5",
        joined("list_concat(l[1:1], CASE WHEN len(r) > 5 THEN list_concat(r[1:2], ['    … (' || (len(r) - 5) || ' frames omitted)'], r[len(r) - 2:len(r)]) ELSE r END, l[f[len(f)] + 1:len(l)])"),
        r", list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^\s+at \w')) AS f, l[2:list_max(list_filter(range(1, len(l) + 1), lambda i: i = 2 OR regexp_matches(l[i], '^\s+at \w')))] AS r"),
    "file_tree_collapse": f"""WITH t AS ({user_lines(TREE_LINE)}), r AS (SELECT id, pos, l[pos] AS line, len(l) AS n, len(list_filter(l, lambda x: starts_with(x, '│'))) AS b FROM (SELECT *, unnest(range(1, len(l) + 1)) AS pos FROM t)),
        g AS (SELECT id, pos, line, n, b, sum(CASE WHEN pos = 1 OR NOT regexp_matches(line, '^[ \t│├└─]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS grp FROM r),
        a AS (SELECT id, n, b, grp, list(line ORDER BY pos) AS l FROM g GROUP BY ALL),
        o AS (SELECT id, n, b, string_agg(CASE WHEN len(l) > 11 THEN {joined("list_concat(l[1:4], ['  … (' || (len(l) - 4) || ' more items)'])")} ELSE {joined('l')} END, {NL} ORDER BY grp) AS output FROM a GROUP BY ALL)
        SELECT id, n >= 15 AND b >= n * 0.5 AS fires, CASE WHEN n >= 15 AND b >= n * 0.5 THEN output END AS output FROM o""",
    "test_output_collapse": shown(
        user_lines(TEST_LINE), "len(p) >= 5", f"CASE WHEN len(k) = 0 THEN '[' || len(p) || ' tests passed, 0 failures]' ELSE {joined('''list_concat(['[' || len(p) || ' passed, ' || len(f) || ' failures shown below]'], k)''')} END",
        f", {where('l', f'''regexp_matches(x, '{PASS}')''')} AS p, {where('l', f'''regexp_matches(x, '{FAIL}')''')} AS f, {where('l', f'''regexp_matches(x, '{FAIL}') OR regexp_matches(x, '{SUMMARY}')''')} AS k"),
    "log_collapse": f"""WITH r AS ({LOG_ROWS}), g AS (SELECT id, msg, min(pos) AS first, arg_min(line, pos) AS line, count(*) AS n FROM r GROUP BY ALL),
        o AS (SELECT id, string_agg(CASE WHEN n > 1 THEN line || '  [×' || n || ']' ELSE line END, {NL} ORDER BY first) AS output, sum(n) AS n FROM g GROUP BY id),
        t AS (SELECT id, {joined('l')} AS content FROM ({user_lines(LOG_LINE)}))
        SELECT id, f AS fires, CASE WHEN f THEN output END AS output FROM (SELECT o.id, output, n >= 10 AND strlen(output) < strlen(content) AS f FROM o JOIN t ON o.id = t.id)""",
    "log_groups": f"SELECT id, msg, CAST(min(pos) - 1 AS INTEGER) AS first_at, arg_min(line, pos) AS line, count(*) AS n FROM ({LOG_ROWS}) GROUP BY id, msg",
    "tabular_prune": f"""WITH t AS (SELECT CAST(s_suppkey % 7 AS INTEGER) AS id, list(s_suppkey || '  ' || s_name || '  ok' ORDER BY s_suppkey) AS k, list(s_suppkey || '  ' || s_name || '  ' || s_nationkey || '  ok  x' ORDER BY s_suppkey) AS l FROM supplier GROUP BY 1),
        u AS (SELECT id, list_concat(['KEY  NAME  STATE'], k) AS k, len(l) + 1 >= 4 AS f FROM t)
        SELECT id, f AS fires, CASE WHEN f THEN {joined("CASE WHEN len(k) > 6 AND e > 100 THEN list_concat(k[1:4], ['  … (' || (len(k) - 6) || ' rows omitted)'], k[len(k) - 1:len(k)]) ELSE k END")} END AS output FROM (SELECT *, {tokens('j')} AS e FROM (SELECT *, {joined('k')} AS j FROM u))""",
    "yaml_collapse": shown("SELECT p_size AS id, list('part_' || p_partkey || ': ' || p_brand ORDER BY p_partkey) AS l FROM part GROUP BY p_size", "len(l) >= 12", joined(rest("l", 5, "YAML lines"))),
    "toml_collapse": shown("SELECT s_nationkey AS id, list('[' || s_name || ']' ORDER BY s_suppkey) AS l FROM supplier GROUP BY s_nationkey", "3 * len(l) >= 10 AND len(l) >= 2 AND 2 * len(l) >= 6", joined("list_concat(l[1:6], ['… ' || len(l) || ' sections, ' || 2 * len(l) || ' keys'])")),
    "tfidf_lines": f"""WITH r AS (SELECT doc_id, pos, n, regexp_extract_all(lower(line), '[a-z0-9_]+') AS toks FROM ({DOC_LINES})),
        h AS (SELECT doc_id, pos, n, toks, unnest(list_filter({TERMS}, lambda t: list_contains(toks, t))) AS term FROM r),
        d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM h),
        s AS (SELECT doc_id, pos, sum(len(list_filter(toks, lambda x: x = term))::DOUBLE / len(toks) * ln((n + 1)::DOUBLE / (df + 1))) AS score FROM d GROUP BY ALL)
        SELECT r.doc_id, CAST(r.pos AS INTEGER) AS pos, round(coalesce(score, 0.0), 9) AS score FROM r LEFT JOIN s ON s.doc_id = r.doc_id AND s.pos = r.pos""",
    "relevance_trim": f"""WITH d AS (SELECT doc_id, text, {tokens('text')} AS est, len(list_filter({lines('text')}, lambda x: x <> '')) AS filled FROM documents),
        r AS (SELECT doc_id, pos, line, n, {tokens('line')} AS est, pos = 0 OR pos = n - 1 OR len(list_filter({TRIM_TERMS}, lambda t: contains(lower(line), t))) > 0 AS forced,
            list_filter({TRIM_TERMS}, lambda t: list_contains(regexp_extract_all(lower(line), '[a-z0-9_]+'), t)) AS hits FROM ({DOC_LINES}) WHERE doc_id IN (SELECT doc_id FROM d WHERE est > 300 AND filled >= 3)),
        f AS (SELECT doc_id, term, count(*) AS df FROM (SELECT doc_id, unnest(hits) AS term FROM r) GROUP BY ALL),
        p AS (SELECT r.*, EXISTS (SELECT 1 FROM f WHERE f.doc_id = r.doc_id AND list_contains(r.hits, f.term) AND f.df < r.n) AS scored FROM r),
        w AS (SELECT *, forced OR coalesce(sum(est) OVER (PARTITION BY doc_id ORDER BY scored DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300 AS keep FROM p),
        k AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1) - 1 AS gap FROM w WHERE keep),
        j AS (SELECT doc_id, string_agg(CASE WHEN gap > 0 THEN repeat(' ', CAST(length(regexp_extract(line, '^[ \t]*')) + length(regexp_extract(line, '^[ \t]*')) - length(replace(regexp_extract(line, '^[ \t]*'), chr(9), '')) AS BIGINT)) || '[… ' || gap || ' lines omitted …]' || {NL} || line ELSE line END, {NL} ORDER BY pos) AS body, max(pos) AS last, max(n) AS n FROM k GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN j.doc_id IS NOT NULL THEN body || CASE WHEN n - 1 - last > 0 THEN {NL} || '[… ' || (n - 1 - last) || ' lines omitted …]' ELSE '' END END AS trimmed FROM d LEFT JOIN j ON j.doc_id = d.doc_id""",
    "savings_by_strategy": bucket("strategy", f"SELECT *, unnest(CASE WHEN len(strategies) = 0 THEN ['none'] ELSE strategies END) AS strategy FROM ({ENTRIES})"),
    "savings_by_tool": bucket("tool", f"SELECT *, coalesce(nullif(tool_name, ''), 'unknown') AS tool FROM ({ENTRIES})"),
    "savings_by_session": f"""SELECT session_id, count(*) AS entries, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, min(stored_at) AS started_at, max(stored_at) AS ended_at,
        round(CASE WHEN sum(original_size) > 0 THEN (sum(original_size) - sum(compressed_size))::DOUBLE / sum(original_size) * 100.0 ELSE 0.0 END, 6) AS saved_pct FROM ({ENTRIES}) GROUP BY session_id""",
    "savings_total": f"SELECT 'TOTAL' AS name, count(*) AS entries, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, round((sum(original_size) - sum(compressed_size))::DOUBLE / sum(original_size) * 100.0, 6) AS saved_pct FROM ({ENTRIES})",
    "top_outputs": f"SELECT session_id, hash, tool_name, original_size - compressed_size AS saved FROM ({ENTRIES}) ORDER BY saved DESC, session_id, hash LIMIT 10",
    "timeline": f"SELECT session_id, hash, stored_at FROM ({ENTRIES}) ORDER BY stored_at, session_id, hash LIMIT 50",
    "timeline_latest": f"SELECT session_id, hash, stored_at FROM ({ENTRIES}) ORDER BY stored_at DESC, session_id, hash LIMIT 10",
    "prune_by_size": f"""SELECT session_id, hash FROM (SELECT session_id, hash, sum(strlen(content)) OVER (PARTITION BY session_id) AS total,
        coalesce(sum(strlen(content)) OVER (PARTITION BY session_id ORDER BY stored_at, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({ENTRIES})) WHERE total <= 1000 OR total - before <= 500""",
    "pre_cache_hits": f"SELECT session_id, count(*) FILTER (p IS NOT NULL) AS hits, count(*) FILTER (p IS NULL) AS misses FROM (SELECT *, lag(seq) OVER (PARTITION BY session_id, cache_key ORDER BY seq) AS p FROM ({EVENT_KEYS})) GROUP BY session_id",
    "pre_cache_lookup": f"SELECT session_id, seq, p AS cached_seq FROM (SELECT *, lag(seq) OVER (PARTITION BY session_id, cache_key ORDER BY seq) AS p FROM ({EVENT_KEYS})) WHERE p IS NOT NULL",
    "diff_frames": f"""WITH r AS (SELECT id, pos, l[pos] AS line FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS pos FROM ({user_lines(DIFF_LINE)}))),
        s AS (SELECT *, max(CASE WHEN regexp_matches(line, '^[+-]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS shown FROM r),
        g AS (SELECT *, CASE WHEN shown THEN pos - coalesce(max(CASE WHEN shown THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 END AS skipped FROM s)
        SELECT id, count(*) FILTER (shown) AS shown, count(*) FILTER (skipped > 0) AS gaps, CAST(sum(skipped) AS BIGINT) AS skipped FROM g GROUP BY id""",
    "hook_events": f"""SELECT event_id AS seq, {HOOK_SESSION} AS session_id, event_type AS tool_name, CAST(event_id AS VARCHAR) AS id, {CALL_KEY} AS cache_key,
        CASE event_id % 6 WHEN 0 THEN 'out ' || event_id WHEN 1 THEN '' WHEN 2 THEN 'a ' || event_id || chr(10) || chr(10) || 'b' WHEN 3 THEN 'c ' || event_id ELSE 'o ' || event_id || chr(10) || chr(10) || 'p' END AS content,
        event_id % 6 IN (1, 3) AS is_error_response FROM events WHERE event_id % 6 <> 5""",
    "hook_calls": f"SELECT event_id AS seq, {HOOK_SESSION} AS session_id, event_type AS tool_name, {CALL_KEY} AS cache_key FROM events WHERE event_id % 6 <> 5",
    "hook_emissions": """SELECT event_id AS seq, '{"hookSpecificOutput": {"hookEventName": "PostToolUse", ' || CASE event_id % 6
        WHEN 0 THEN '"updatedToolOutput": {"stdout": "R ' || event_id || '", "stderr": ""}' WHEN 1 THEN '"updatedToolOutput": {"stdout": "R ' || event_id || '", "stderr": "bad ' || event_id || '"}'
        WHEN 2 THEN '"updatedToolOutput": {"content": [{"type": "text", "text": "R ' || event_id || '"}, {"type": "image", "source": "x"}]}' WHEN 3 THEN '"updatedToolOutput": {"isError": true, "content": "R ' || event_id || '"}'
        ELSE '"additionalContext": "R ' || event_id || '"' END || '}}' AS emitted FROM events WHERE event_id % 6 <> 5""",
    "stop_events": "SELECT event_id AS seq, 'u' || user_id AS session_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE event_id % 100 + 0.5::DOUBLE END AS used_pct FROM events",
    "replay_log_lines": """SELECT 'log' || user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS line, CASE WHEN event_id % 5 <> 3 THEN event_type END AS tool_name, CASE WHEN event_id % 5 <> 3 THEN 'x ' || event_id END AS q,
        CASE WHEN event_id % 5 <> 3 THEN 'c ' || event_id ELSE '' END AS content, event_id % 5 = 3 AS malformed FROM events WHERE event_id % 5 > 1""",
    "call_flags": """WITH c AS (SELECT conv_id, turn AS seq, role, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l, lower(coalesce(substr(text, 1, 30), '')) AS a FROM conversations),
        f AS (SELECT *, """ + " OR ".join(f"(contains(l, '{k}') AND strlen(l[1:strpos(l, '{k}') - 1]) + {len(k)} <= 200)" for k in ("idiot", "of the")) + """ AS e FROM c)
        SELECT conv_id, seq, e AS is_error, NOT e AND t <> '' AS stores, NOT (contains(lower(role), 'assist') OR contains(a, 'assist') OR contains(lower(role), 'the and') OR contains(a, 'the and')) AS keeps_raw FROM f""",
    "headers": f"SELECT doc_id, '[compressed: ' || {number(tokens('text'))} || ' → ' || {number(tokens('substr(text, 1, 200)'))} || ' tokens | structure+relevance]' || {NL} AS header FROM documents",
    "query_terms": f"SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n, array_to_string(w, ' ') AS terms, CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS INTEGER) AS distinct_terms FROM (SELECT conv_id, turn, list_concat({words('text')}, ['<nil>']) AS w FROM conversations)",
    "session_store": f"""WITH e AS (SELECT session_id, count(*) AS n, count(*) FILTER (CAST(hash AS BIGINT) % 5 = 0) AS c FROM ({ENTRIES}) GROUP BY ALL),
        s AS (SELECT CAST(user_id % 60 AS VARCHAR) AS session_id, max(event_id) AS m, count(*) AS n FROM events GROUP BY ALL)
        SELECT coalesce(s.session_id, e.session_id) AS session_id, CAST(m % 40 AS INTEGER) AS turn, CAST(coalesce(e.n, 0) AS INTEGER) AS entries, CAST(coalesce(c, 0) AS INTEGER) AS cached, CAST(s.n AS INTEGER) AS hits, CAST(s.n % 7 AS INTEGER) AS misses,
        m % 100 / 4.0::DOUBLE AS context_used_pct, m % 2 = 0 AS compact_requested FROM s LEFT JOIN e ON e.session_id = s.session_id""",
    "session_store_entries": f"SELECT session_id, hash AS key, CAST(CAST(hash AS BIGINT) % 30 AS INTEGER) AS turn, tool_name, original_size, compressed_size, array_to_string(strategies, '+') AS strategies, stored_at, content FROM ({ENTRIES})",
    "top_cache": f"SELECT session_id, 'k' || hash AS key, original_size - compressed_size AS saved FROM ({ENTRIES}) WHERE CAST(hash AS BIGINT) % 5 = 0 ORDER BY saved DESC, session_id, hash LIMIT 10",
    "pre_cache_totals": "SELECT CAST(sum(n) AS BIGINT) AS hits, CAST(sum(n % 7) AS BIGINT) AS misses FROM (SELECT user_id % 60 AS g, count(*) AS n FROM events GROUP BY ALL)",
    "session_stream": f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'pre' ELSE 'post' END AS kind, event_type AS tool, event_type || '/' || (event_id % 7) AS key,
            CASE WHEN event_id % 4 > 1 THEN repeat(event_type || (event_id % 5) || ' ', 40) END AS content FROM events),
        t AS (SELECT *, CAST(sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS turn, coalesce(sum(CASE WHEN kind = 'post' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS hit FROM e),
        p AS (SELECT *, lag(turn) OVER w AS p_turn, lag(tool) OVER w AS p_tool FROM t WINDOW w AS (PARTITION BY session_id, content ORDER BY seq)),
        l AS (SELECT *, CASE WHEN kind = 'post' AND p_turn IS NOT NULL THEN '[unchanged — seen ' || (turn - p_turn) || ' turn(s) ago by ' || p_tool || ']' END AS label FROM p)
        SELECT session_id, seq, kind, turn, CASE WHEN kind = 'post' THEN CASE WHEN label IS NULL THEN content ELSE '[compressed: ' || {tokens('content')} || ' → ' || {tokens('label')} || ' tokens | dedup]' || {NL} || label END END AS output,
        CASE kind WHEN 'stop' THEN false WHEN 'pre' THEN hit ELSE label IS NOT NULL AND NOT hit END AS emitted, CASE WHEN kind = 'post' THEN label IS NOT NULL END AS modified, CASE WHEN kind <> 'stop' THEN hit END AS cache_hit FROM l""",
}
