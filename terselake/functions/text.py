"""Text kernel as Column expressions.

Sizes are bytes (octet_length), white space is Unicode's White_Space property, and regular
expressions are written so that Java reads them as the RE2 dialect does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 25 code points with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: RE2's \s, which lacks the vertical tab that Java's has.
RE2_SPACE = r"[\t\n\f\r ]"


def trim_u(text: Column) -> Column:
    """Without White_Space at both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """Maximal runs without White_Space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed_lines(text: Column) -> Column:
    return lines(trim_u(text))


def clean_lines(text: Column) -> Column:
    """Trimmed lines of the trimmed text, without empty ones."""
    return F.filter(F.transform(trimmed_lines(text), trim_u), lambda x: x != "")


def content_hash(text: Column) -> Column:
    """32 hex digits: half of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(trim_u(text), 256), 1, 32)


def format_num(n: Column) -> Column:
    """One thousands separator, whatever the size: 1234567 is 1234,567."""
    thousands = F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.when(n >= 1000, thousands).otherwise(n.cast("string"))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", F.bround(n / float(1 << 20), 1)), F.lit("MB")))
        .when(n >= 1 << 10, F.concat(F.format_string("%.1f", F.bround(n / 1024.0, 1)), F.lit("KB")))
        .otherwise(F.concat(n.cast("string"), F.lit("B")))
    )


def human_tokens(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def indent(line: Column) -> Column:
    """Leading blanks; a tab counts two."""
    lead = F.regexp_extract(line, "^[ \t]*", 0)
    tabs = F.length(lead) - F.length(F.translate(lead, "\t", ""))
    return F.length(lead) + tabs


def is_root_line(line: Column) -> Column:
    """Starts with none of blank, tab and the box-drawing characters of trees."""
    return ~line.rlike("^[ \t│├└─]")


def has_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def count_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test))


def numbered(items: Column) -> Column:
    """array<struct<pos, line>>, pos from 0."""
    return F.transform(items, lambda x, k: F.struct(k.alias("pos"), x.alias("line")))


def first_and_rest(items: Column, n: int, more: str) -> Column:
    """The first n items and, if there are others, a line that counts them."""
    left = F.size(items) - n
    tail = F.when(left > 0, F.array(F.concat(F.lit("…and "), left.cast("string"), F.lit(f" more {more}")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(items, 1, n), tail)


def is_error_text(text: Column, keywords: tuple[str, ...]) -> Column:
    """A keyword within the first 200 bytes of the lower-cased text."""
    head = F.substring(F.lower(text).cast("binary"), 1, 200)
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(head, F.lit(word.lower()).cast("binary"))
    return found


def is_binary_or_huge(text: Column) -> Column:
    """A NUL, or a line of over 20,000 bytes with fewer than 20 words."""
    huge = F.exists(lines(text), lambda x: (F.octet_length(x) > 20_000) & (F.size(words(x)) < 20))
    return F.contains(text, F.lit("\0")) | huge
