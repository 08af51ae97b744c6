"""Secret scans: patterns, and sliding-window Shannon entropy, in DataFrame functions only.

Base spans, leftmost non-overlapping per kind (an over-short match is dropped but has used up its
characters):

* assign: a keyword, ``:`` or ``=``, and a value of 6 or more characters;
* access: ``AKIA`` and capitals or digits, 20 or more characters in all;
* hex: 24 or more of ``0-9a-f``.

The method adds spans of the kind ``entropy``: a candidate is a run of 20 or more base64 or
URL-safe characters with a digit and a letter. A window of 20 characters slides over it; the
counts of its characters and the sum of c*log2(c) over them move with it, by the character that
leaves and the one that enters, and the sum gives the Shannon entropy. A candidate whose most random
window reaches the threshold of its character class (hex digits or mixed) is a span,
unless an allow-list pattern (UUIDs, words joined by marks, paths, placeholders) suppresses it
or it overlaps a base span.

Every step is linear in the text, but for the lists of spans, which grow in pieces of the square root
of their length.

Offsets are code points, ends exclusive. Edge cases: null or empty text has no spans; repeated
rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs, so the same as dropping shorter ones
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy in bits of a window: of hex digits at most 4, of mixed characters at most log2(20) = 4.32.
HEX_BITS, MIXED_BITS = 3.2, 3.9
#: Candidates that only look random: UUIDs; words or numbers joined by marks; paths; placeholders.
#: The possessive group changes no match, but it is matched without recursion, whatever the length.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]*[0-9]*(?:[_=/+-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+))*+[_=/+-]*$",
    r"(?i)example|sample|placeholder|xxxx|0{6}|1234567",
)
SPAN = "struct<start:int,rank:int,stop:int,kind:string>"
#: Counts of a window's characters lie in longs, 5 bits each; candidates hold the codes from "+" to "z".
_FIRST_CODE, _CODES, _COUNT_BITS, _PER_LONG = ord("+"), ord("z") - ord("+") + 1, 5, 12
#: c*log2(c) as whole numbers of this many binary places, so that a running sum never drifts.
_PLACES = 40


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once: a lambda variable is not evaluated again."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _starts(n: Column, width: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, width)).otherwise(F.array().cast("array<int>"))


def _width(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))


def running(items: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """What emit(state, item) gives (an array of ``kind``) for all items in turn, the state moved on by step.

    An array grows by copying, so the outputs grow in pieces of about the square root of their number.
    """
    nothing = F.array().cast(f"array<{kind}>")

    def piece(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), nothing.alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], emit(acc["at"], x)).alias("out")))

    def walk(every: Column) -> Column:
        n = F.size(every)
        return F.aggregate(
            _starts(n, _width(n)),
            F.struct(state.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")),
            lambda acc, k: bind(piece(acc["at"], F.slice(every, k + 1, _width(n))), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))),
            lambda acc: F.flatten(acc["out"]),
        )

    return bind(items, walk)


def _span(start: Column, size: Column, rank: int) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + size).alias("stop"), F.lit(KINDS[rank]).alias("kind"))


def _located(text: Column, pattern: str, rank: int, keep) -> Column:
    """array<SPAN> of a pattern's matches: offsets are sums of the lengths of the pieces between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern is ASSIGN else matches
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(matches, lambda x: F.length(x))
    steps = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value"))
    nothing = F.array().cast(f"array<{SPAN}>")
    walked = running(
        steps, F.lit(0),
        # the last piece has no match after it: its size is null
        lambda at, s: at + s["gap"] + F.coalesce(s["size"], F.lit(0)),
        lambda at, s: F.when(s["size"].isNotNull() & keep(s["value"]), F.array(_span(at + s["gap"], s["size"], rank))).otherwise(nothing),
        SPAN,
    )
    return F.when(text.rlike(pattern), walked).otherwise(nothing)


def _whole_clog(c: int) -> int:
    return round(c * math.log2(c) * 2**_PLACES) if c > 1 else 0


def least_clog(candidate: Column) -> Column:
    """The least sum of c*log2(c) over all windows of a candidate.

    The counts of the window's characters are part of the state: a step takes one off the count of
    the character that leaves and adds one to that of the character that enters, and moves the sum by
    the two differences.
    """
    gain = F.array(*[F.lit(_whole_clog(c) - _whole_clog(c - 1)) for c in range(1, WINDOW + 1)])  # of the c-th of equal characters
    longs = -(-_CODES // _PER_LONG)
    word = lambda code: F.floor(code / _PER_LONG).cast("int")
    shift = lambda code: (code % _PER_LONG) * _COUNT_BITS
    unit = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))
    count = lambda counts, code: F.call_function("shiftright", F.get(counts, word(code)), shift(code)).bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)).cast("int")
    moved = lambda counts, code, by: F.transform(counts, lambda w, j: F.when(j == word(code), w + by * unit(code)).otherwise(w))

    def enter(acc: Column, code: Column) -> Column:
        return F.struct((acc["s"] + F.get(gain, count(acc["counts"], code))).alias("s"), moved(acc["counts"], code, 1).alias("counts"))

    def slide(acc: Column, step: Column) -> Column:
        left = F.struct((acc["s"] - F.get(gain, count(acc["counts"], step["leaves"]) - 1)).alias("s"), moved(acc["counts"], step["leaves"], -1).alias("counts"))
        return bind(bind(left, lambda now: enter(now, step["enters"])), lambda now: F.struct(now["s"].alias("s"), now["counts"].alias("counts"), F.least(acc["least"], now["s"]).alias("least")))

    def of(codes: Column) -> Column:
        n = F.size(codes)
        none = F.array(*[F.lit(0).cast("long") for _ in range(longs)])
        first = F.aggregate(F.slice(codes, 1, WINDOW), F.struct(F.lit(0).cast("long").alias("s"), none.alias("counts")), enter)
        steps = F.when(n > WINDOW, F.arrays_zip(F.slice(codes, F.lit(1), n - WINDOW).alias("leaves"), F.slice(codes, F.lit(WINDOW + 1), n - WINDOW).alias("enters")))
        steps = F.coalesce(steps, F.array().cast("array<struct<leaves:int,enters:int>>"))
        return bind(first, lambda f: F.aggregate(steps, F.struct(f["s"].alias("s"), f["counts"].alias("counts"), f["s"].alias("least")), slide, lambda acc: acc["least"]))

    return bind(F.transform(F.split(candidate, ""), lambda ch: F.ascii(ch) - _FIRST_CODE), of) / float(2**_PLACES)


def _random(candidate: Column) -> Column:
    """Whether a candidate's most random window reaches its class's threshold and no allow-list pattern matches."""
    bits = F.when(candidate.rlike("^[0-9A-Fa-f]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    worth = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]") & ~allowed
    # H = log2(w) - S / w; the margin absorbs rounding
    return F.when(worth, least_clog(candidate) <= (math.log2(WINDOW) - bits) * WINDOW + 1e-9).otherwise(F.lit(False))


def spans_of(text: Column) -> Column:
    """array<SPAN> of the base spans, by start, then kind."""
    return F.array_sort(F.concat(
        _located(text, ASSIGN, 0, lambda v: F.length(v) >= 6),
        _located(text, ACCESS, 1, lambda v: F.length(v) >= 20),
        _located(text, HEX, 2, lambda v: F.lit(True)),
    ))


def entropy_spans(text: Column) -> Column:
    return _located(text, CANDIDATE, 3, _random)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _apart(base: Column, added: Column) -> Column:
    """All base spans, and the added ones that overlap none of them, in order: one pass for the base
    spans that start before an added span, one backwards for those that start in it."""
    nothing = F.array().cast(f"array<{SPAN}>")
    is_base = lambda s: s["rank"] < 3
    ahead = running(
        F.array_sort(F.concat(base, added)), F.lit(0), lambda reach, s: F.when(is_base(s), F.greatest(reach, s["stop"])).otherwise(reach),
        lambda reach, s: F.when(is_base(s) | (s["start"] >= reach), F.array(s)).otherwise(nothing), SPAN)
    back = running(
        F.reverse(ahead), F.lit(2**31 - 1), lambda reach, s: F.when(is_base(s), F.least(reach, s["start"])).otherwise(reach),
        lambda reach, s: F.when(is_base(s) | (s["stop"] <= reach), F.array(s)).otherwise(nothing), SPAN)
    return F.when(F.size(added) == 0, base).when(F.size(base) == 0, added).otherwise(F.reverse(back))


def _with_spans(df: DataFrame, text: Column, base: str, every: str) -> DataFrame:
    """Two columns more: the base spans, and all spans."""
    added = f"{every}_added"
    return df.withColumns({base: spans_of(text), added: entropy_spans(text)}).withColumn(every, _apart(F.col(base), F.col(added))).drop(added)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_entropy``."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _with_spans(narrow, F.col("text"), "base", "every").drop("text")
    n = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("base", "assign").alias("n_assign"), n("base", "access").alias("n_access"), n("base", "hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), n("every", "entropy").alias("n_entropy"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span (sorted by start) as ``<kind>``; what overlaps a replaced span goes with it.

    A piece of text is cut from its part of the text, a part holding about the square root of all pieces.
    """
    cut = "struct<since:int,until:int,kind:string>"
    pieces = running(
        spans, F.lit(0), lambda at, s: F.greatest(at, s["stop"]),
        lambda at, s: F.when(s["start"] >= at, F.array(F.struct(at.alias("since"), s["start"].alias("until"), s["kind"].alias("kind")))).otherwise(F.array().cast(f"array<{cut}>")), cut)

    def part(some: Column) -> Column:
        since = F.element_at(some, 1)["since"]
        within = F.substring(text, since + 1, F.element_at(some, -1)["until"] - since)
        return bind(within, lambda t: F.array_join(F.transform(some, lambda p: F.concat(F.substring(t, p["since"] - since + 1, p["until"] - p["since"]), F.lit("<"), p["kind"], F.lit(">"))), ""))

    def whole(every: Column) -> Column:
        n = F.size(every)
        parts = F.transform(_starts(n, _width(n)), lambda k: bind(F.slice(every, k + 1, _width(n)), part))
        return F.array_join(parts, "")

    last = F.array_max(F.transform(spans, lambda s: s["stop"]))
    return F.concat(bind(pieces, whole), F.substring(text, last + 1, F.length(text)))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with every span replaced by ``<kind>``; a length column, if there, is renewed."""
    fields, columns = {f.name: f.dataType for f in docs.schema.fields}, docs.columns
    # the row travels as one struct, so that no column name can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = _with_spans(held, F.col("text"), "base", "every")
    clean = found.withColumn("clean", F.when(F.size("every") > 0, _replaced(F.col("text"), F.col("every"))))
    out = []
    for c in columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = F.coalesce(F.col("clean"), value)
        elif c == length_col:
            value = F.when(F.col("clean").isNotNull(), F.length("clean").cast(fields[c])).otherwise(value)
        out.append(value.cast(fields[c]).alias(c))
    return clean.select(*out)
