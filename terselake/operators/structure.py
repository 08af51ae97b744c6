"""Shape detectors: each is a pair of Columns, whether it fires and what the text collapses to.

The detectors run in the order of ``DETECTORS``; the first that fires wins. All but the four
parsed shapes are built-in functions; those four share one Arrow UDF, which only sees the
candidate texts (others reach it as null).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terselake.functions import tokens
from terselake.functions.parsed import parsed_shape
from terselake.functions.text import RE2_SPACE, clean_lines, count_where, first_and_rest, has_any, is_root_line, lines, numbered, trim_u, trimmed_lines

S = RE2_SPACE
#: RE2's \S
NS = r"[^\t\n\f\r ]"

# The patterns and word lists of the shapes.
DIAGNOSTIC = rf"^{NS}+\.(go|ts|tsx|js|jsx|rs|py|java|c|cc|cpp|h):\d+(:\d+)?:"
LOW_COVERAGE = (" 0.", " 1.", " 2.", " 3.", " 4.")
PACKAGE_ERROR = ("error", "err!")
PACKAGE_WARNING = ("warn", "warning")
PACKAGE_INSTALL = ("added ", "installed ", "successfully installed", "compiling ")
PACKAGE_REMOVAL = ("removed ", "uninstalled ")
PACKAGE_IMPORTANT = ("error", "err!", "warn", "warning", "added ", "removed ", "audited ", "vulnerab", "successfully installed", "compiling ")
ECOSYSTEMS = (
    ("npm", ("npm ", "npm warn", "npm err")),
    ("pnpm", ("pnpm ", " warn ", " err_pnpm")),
    ("yarn", ("yarn ", "➤ yn")),
    ("pip", ("pip ", "successfully installed")),
    ("cargo", ("cargo ", "compiling ", "finished `")),
)
TAG = r"<[\t\n\f\r ]*([a-zA-Z0-9:_-]+)"
FRAME = rf"^\t{NS}[^\n]*:\d+|^{S}+at \w|^{S}+File \""
TRACE_HEADER = r"(?iu)(panic:|exception in thread|traceback \(most recent|goroutine \d+ \[)"
TREE_LINE = r"^[\t\n\f\r │├└─]+[^\t\n\f\r ]|^[\t\n\f\r ]{2,}[^\t\n\f\r ]"
TEST_PASS = r"(?iu)^(ok |PASS|--- PASS:|\.+[\t\n\f\r ]*\z|test \w+ \.\.\. ok)"
TEST_FAIL = r"(?iu)(FAIL|Error|panic|--- FAIL|^[\t\n\f\r ]+[^\t\n\f\r ]+_test\.go:\d+)"
TEST_SUMMARY = r"(?iu)(Tests run|passed|failed|skipped|ok[\t\n\f\r ]+[^\t\n\f\r ]+[\t\n\f\r ]+[\d.]+s)"
TIMESTAMP = r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}|^\d{4}[-/]\d{2}[-/]\d{2}|^\[\d{2}:\d{2}:\d{2}\]|^\d{10,}"
COLUMN_GAP = r"[\t\n\f\r ]{2,}|\t"
YAML_KEY = rf"^{S}*[A-Za-z0-9_.-]+:{S}+"


@dataclass(frozen=True)
class Shape:
    fires: Column
    output: Column


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is bound by a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_join(items: Column) -> Column:
    return F.array_join(items, "\n")


def num(n: Column) -> Column:
    return n.cast("string")


def unified_diff(text: Column, args: Column, budget: int) -> Shape:
    rows = lines(text)
    is_head = lambda x: x.startswith("diff --git ") | x.startswith("+++ ") | x.startswith("--- ") | x.startswith("@@")
    is_plus = lambda x: x.startswith("+") & ~x.startswith("+++")
    is_minus = lambda x: x.startswith("-") & ~x.startswith("---")
    plus, minus = count_where(rows, is_plus), count_where(rows, is_minus)
    first = lambda test: F.transform(F.slice(F.filter(numbered(rows), lambda s: test(s["line"])), 1, 3), lambda s: s["pos"])
    kept = bind(F.concat(first(is_plus), first(is_minus)), lambda early: F.transform(
        F.filter(numbered(rows), lambda s: is_head(s["line"]) | F.array_contains(early, s["pos"])), lambda s: s["line"]))
    summary = F.concat(F.lit("… "), num(plus), F.lit(" additions, "), num(minus), F.lit(" deletions"))
    return Shape((F.size(rows) >= 20) & F.contains(text, F.lit("@@")) & (plus + minus >= 8), text_join(F.concat(kept, F.array(summary))))


def diagnostics(text: Column, args: Column, budget: int) -> Shape:
    found = F.filter(trimmed_lines(text), lambda x: x.rlike(DIAGNOSTIC))
    kept = F.concat(F.slice(found, 1, 5), F.array(F.concat(F.lit("…and "), num(F.size(found) - 5), F.lit(" more diagnostics"))))
    return Shape(count_where(trimmed_lines(text), lambda x: x.rlike(DIAGNOSTIC)) >= 8, text_join(kept))


def coverage(text: Column, args: Column, budget: int) -> Shape:
    rows = trimmed_lines(text)
    low = F.filter(rows, lambda x: F.contains(x, F.lit("%")) & has_any(x, LOW_COVERAGE))
    totals = F.filter(rows, lambda x: F.contains(F.lower(x), F.lit("total")))
    total = F.slice(totals, -1, 1)
    last = F.when(F.size(totals) > 0, total).otherwise(F.array().cast("array<string>"))
    fires = (F.size(rows) >= 8) & F.contains(F.lower(text), F.lit("coverage")) & ((F.size(low) > 0) | (F.size(totals) > 0))
    return Shape(fires, text_join(F.concat(first_and_rest(low, 5, "low-coverage entries"), last)))


def ecosystem(lowered: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, needles in reversed(ECOSYSTEMS):
        found = F.when(has_any(lowered, needles), F.lit(name)).otherwise(found)
    return found


def package_log(text: Column, args: Column, budget: int) -> Shape:
    rows = trimmed_lines(text)
    count = lambda *needles: num(count_where(rows, lambda x: has_any(F.lower(x), needles)))
    warnings = num(count_where(rows, lambda x: has_any(F.lower(x), PACKAGE_WARNING) & ~has_any(F.lower(x), PACKAGE_ERROR)))
    important = F.filter(rows, lambda x: has_any(F.lower(x), PACKAGE_IMPORTANT))
    head = F.concat(
        F.lit("[package-log: "), ecosystem(F.lower(text)), F.lit(" | "), count(*PACKAGE_ERROR), F.lit(" error(s), "), warnings, F.lit(" warning(s), "),
        count(*PACKAGE_INSTALL), F.lit(" install/build line(s), "), count(*PACKAGE_REMOVAL), F.lit(" removal(s), "), count("vulnerab"), F.lit(" vulnerability line(s)]"),
    )
    fires = (F.size(rows) >= 12) & ecosystem(F.lower(text)).isNotNull() & (F.size(important) > 0)
    return Shape(fires, text_join(F.concat(F.array(head), first_and_rest(important, 8, "package log lines"))))


def tags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(trim_u(text), F.lit(TAG), F.lit(1)), lambda x: F.lower(x))


def markup(text: Column, args: Column, budget: int) -> Shape:
    trimmed = trim_u(text)
    shown = bind(tags(text), lambda every: text_join(F.concat(
        F.array(F.concat(F.lit("[markup: "), num(F.size(every)), F.lit(" tags]"))),
        first_and_rest(F.transform(F.array_distinct(every), lambda t: F.concat(t, F.lit(": "), num(count_where(every, lambda x: x == t)))), 6, "tag types"),
    )))
    closes = F.contains(trimmed, F.lit("</")) | F.contains(trimmed, F.lit("/>"))
    return Shape(trimmed.startswith("<") & closes & (F.size(tags(text)) >= 12), shown)


def stack_trace(text: Column, args: Column, budget: int) -> Shape:
    rows = lines(text)
    marked = F.filter(numbered(rows), lambda s: s["line"].rlike(FRAME) | s["line"].rlike(TRACE_HEADER))

    def collapse(ends: Column) -> Column:
        first, n = ends["first"], ends["last"] - ends["first"] + 1
        region = F.slice(rows, first + 1, n)
        short = F.concat(F.slice(region, 1, 2), F.array(F.concat(F.lit("    … ("), num(n - 5), F.lit(" frames omitted)"))), F.slice(region, -3, 3))
        return text_join(F.concat(F.slice(rows, F.lit(1), first), F.when(n > 5, short).otherwise(region), F.slice(rows, ends["last"] + 2, F.size(rows))))

    ends = bind(marked, lambda m: F.struct(F.element_at(m, 1)["pos"].alias("first"), F.element_at(m, -1)["pos"].alias("last")))
    return Shape(text.rlike(TRACE_HEADER) & (count_where(rows, lambda x: x.rlike(FRAME)) >= 5), bind(ends, collapse))


def file_tree(text: Column, args: Column, budget: int) -> Shape:
    rows = trimmed_lines(text)

    def group(rows: Column, start: Column, stop: Column) -> Column:
        size = stop - start - 1  # below the root line
        short = F.concat(F.slice(rows, start + 1, 4), F.array(F.concat(F.lit("  … ("), num(size - 3), F.lit(" more items)"))))
        return F.when(size > 10, short).otherwise(F.slice(rows, start + 1, size + 1))

    def collapse(b: Column) -> Column:
        # a group starts at the first line and at every line without indentation
        starts = F.transform(F.filter(numbered(b), lambda s: (s["pos"] == 0) | is_root_line(s["line"])), lambda s: s["pos"])
        return bind(starts, lambda st: F.flatten(F.transform(st, lambda at, k: group(b, at, F.coalesce(F.get(st, k + 1), F.size(b))))))

    whole = F.rtrim(text_join(bind(rows, collapse)), F.lit("\n"))
    return Shape((F.size(rows) >= 15) & (count_where(rows, lambda x: x.rlike(TREE_LINE)) >= F.size(rows) * 0.5), whole)


def test_output(text: Column, args: Column, budget: int) -> Shape:
    rows = lines(text)
    passed, failed = count_where(rows, lambda x: x.rlike(TEST_PASS)), count_where(rows, lambda x: x.rlike(TEST_FAIL))
    kept = F.filter(rows, lambda x: x.rlike(TEST_FAIL) | x.rlike(TEST_SUMMARY))
    none = F.concat(F.lit("["), num(passed), F.lit(" tests passed, 0 failures]"))
    head = F.concat(F.lit("["), num(passed), F.lit(" passed, "), num(failed), F.lit(" failures shown below]"))
    return Shape(passed >= 5, F.when(F.size(kept) == 0, none).otherwise(text_join(F.concat(F.array(head), kept))))


def message(line: Column) -> Column:
    """A log line without its timestamp."""
    return trim_u(F.regexp_replace(line, TIMESTAMP, ""))


def collapsed_log(text: Column) -> Column:
    """The first line of each message in order, with its count: sort by message, run lengths, back in order."""
    def runs(rows: Column) -> Column:
        def shown(ordered: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: (k == 0) | (F.get(ordered, k)["msg"] != F.get(ordered, k - 1)["msg"]))
            return bind(at, lambda st: F.array_sort(F.transform(st, lambda a, k: F.struct(
                F.get(ordered, a)["pos"].alias("pos"), F.get(ordered, a)["line"].alias("line"), (F.coalesce(F.get(st, k + 1), F.size(ordered)) - a).alias("n")))))
        return bind(F.array_sort(F.transform(rows, lambda x, k: F.struct(message(x).alias("msg"), k.alias("pos"), x.alias("line")))), shown)

    entry = lambda s: F.when(s["n"] > 1, F.concat(s["line"], F.lit("  [×"), num(s["n"]), F.lit("]"))).otherwise(s["line"])
    return F.rtrim(text_join(F.transform(bind(lines(text), runs), entry)), F.lit("\n"))


def log_stream(text: Column, args: Column, budget: int) -> Shape:
    rows = lines(text)
    is_log = (F.size(rows) >= 10) & (count_where(rows, lambda x: x.rlike(TIMESTAMP)) >= F.size(rows) * 0.5)
    out = F.when(is_log, collapsed_log(text))
    return Shape(is_log & (F.octet_length(out) < F.octet_length(text)), out)


def arg_text(args: Column) -> Column:
    """Keys and values of the arguments."""
    return F.array_join(F.flatten(F.transform(F.map_entries(args), lambda e: F.array(e["key"], e["value"]))), " ")


def tabular(text: Column, args: Column, budget: int) -> Shape:
    rows = trimmed_lines(text)
    columns = F.split(F.element_at(rows, 1), COLUMN_GAP)
    wanted = F.filter(F.split(F.lower(arg_text(args)), r"(?U)\s+"), lambda w: w != "")
    named = lambda col: bind(F.lower(trim_u(col)), lambda c: F.exists(wanted, lambda w: F.contains(c, w) | F.contains(w, c)))
    flags = F.transform(columns, lambda c, k: (k == 0) | F.coalesce(named(c), F.lit(False)))
    aligned = count_where(F.slice(rows, 2, F.size(rows)), lambda x: F.size(F.split(x, COLUMN_GAP)) >= F.size(columns) - 1)
    fires = (F.size(rows) >= 4) & (F.size(columns) >= 4) & (aligned >= (F.size(rows) - 1) * 0.6) & (count_where(flags, lambda x: x) > 1)

    def pruned(keep: Column) -> Column:
        return F.transform(rows, lambda x: F.array_join(F.filter(F.split(x, COLUMN_GAP), lambda p, k: F.coalesce(F.get(keep, k), F.lit(False))), "  "))

    def clipped(kept: Column) -> Column:
        short = F.concat(F.slice(kept, 1, 4), F.array(F.concat(F.lit("  … ("), num(F.size(kept) - 6), F.lit(" rows omitted)"))), F.slice(kept, -2, 2))
        return F.when((F.size(kept) > 6) & (F.lit(budget) > 0) & (tokens.estimate(text_join(kept)) > budget), short).otherwise(kept)

    return Shape(fires, text_join(bind(bind(flags, pruned), clipped)))


def yaml(text: Column, args: Column, budget: int) -> Shape:
    rows = clean_lines(text)
    keys = count_where(rows, lambda x: x.rlike(YAML_KEY))
    return Shape((F.size(rows) >= 12) & (keys >= F.floor(F.size(rows) / 2)), text_join(first_and_rest(rows, 5, "YAML lines")))


def toml(text: Column, args: Column, budget: int) -> Shape:
    rows = clean_lines(text)
    is_section = lambda x: x.startswith("[") & x.endswith("]")
    sections = F.filter(rows, is_section)
    keys = count_where(rows, lambda x: ~is_section(x) & F.contains(x, F.lit("=")))
    summary = F.concat(F.lit("… "), num(F.size(sections)), F.lit(" sections, "), num(keys), F.lit(" keys"))
    return Shape((F.size(rows) >= 10) & (F.size(sections) >= 2) & (keys >= 6), text_join(F.concat(F.slice(sections, 1, 6), F.array(summary))))


#: After the four parsed shapes, in this order.
DETECTORS: tuple[tuple[str, Callable[[Column, Column, int], Shape]], ...] = (
    ("unified_diff", unified_diff), ("diagnostics", diagnostics), ("coverage", coverage), ("package_log", package_log), ("markup", markup), ("stack_trace", stack_trace),
    ("file_tree", file_tree), ("test_output", test_output), ("log_stream", log_stream), ("tabular", tabular), ("yaml", yaml), ("toml", toml),
)


def parse_candidate(text: Column) -> Column:
    """Whether one of the parsed shapes is possible; only such texts go to Python."""
    start = trim_u(text)
    return start.startswith("[") | start.startswith("{") | F.contains(text, F.lit(",")) | start.rlike(r"(?U)^null\s")


def with_shape(df: DataFrame, text_col: str = "content", args_col: str = "tool_input", budget: int = 2000, shape: str = "shape", collapsed: str = "collapsed") -> DataFrame:
    """Two columns more: the name of the first shape that fires, and the collapsed text (both null if none does)."""
    text, args = F.col(text_col), F.col(args_col)
    parsed = df.withColumn("_parsed", parsed_shape(F.when(parse_candidate(text), text)))
    shapes = [(name, detect(text, args, budget)) for name, detect in DETECTORS]
    name = F.when(F.col("_parsed.shape").isNotNull(), F.col("_parsed.shape"))
    for key, s in shapes:
        name = name.when(s.fires, F.lit(key))
    named = parsed.withColumn(shape, F.when(text.isNotNull(), name))
    out = F.when(F.col("_parsed.shape").isNotNull(), F.col("_parsed.output"))
    for key, s in shapes:
        out = out.when(F.col(shape) == key, s.output)
    return named.withColumn(collapsed, out).drop("_parsed")


def collapse_one(df: DataFrame, detect: Callable[[Column, Column, int], Shape], text_col: str = "content", args_col: str = "tool_input", budget: int = 2000) -> DataFrame:
    """``fires`` and ``output`` of one detector alone (output null where it does not fire)."""
    s = detect(F.col(text_col), F.col(args_col), budget)
    return df.withColumn("fires", F.coalesce(s.fires, F.lit(False))).withColumn("output", F.when(F.col("fires"), s.output))
