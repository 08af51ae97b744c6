"""The four shapes that need a strict parser (JSON array and object, JSON lines, CSV), as one Arrow UDF.

JSON members are cut out of the text unchanged, so they keep their spacing; JSON is strict: no
trailing data, no NaN or Infinity. CSV follows RFC 4180 strictly.
"""

from __future__ import annotations

import json
import re

import pandas as pd

from terselake.functions.udf import arrow_udf
from terselake.functions.text import WHITE_SPACE

_GAP = re.compile(r"[ \t\n\r]*")


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)
#: A member is only skipped over, so its value is not built twice.
_scan = _DECODER.scan_once


def _skip(text: str, at: int) -> int:
    return _GAP.match(text, at).end()


def json_value(text: str):
    """The value of a strict JSON text; ValueError otherwise."""
    value, end = _DECODER.raw_decode(text, _skip(text, 0))
    if _skip(text, end) != len(text):
        raise ValueError("trailing data")
    return value


def array_members(text: str) -> list[str]:
    """The members of a JSON array as they are written."""
    members, at = [], _skip(text, 1)
    if text[at:at + 1] == "]":
        at += 1
    else:
        while True:
            _, end = _DECODER.raw_decode(text, at)
            members.append(text[at:end])
            at = _skip(text, end)
            mark, at = text[at:at + 1], at + 1
            if mark == "]":
                break
            if mark != ",":
                raise ValueError("array")
            at = _skip(text, at)
    if _skip(text, at) != len(text):
        raise ValueError("trailing data")
    return members


def object_members(text: str) -> dict[str, str]:
    """Key to value as written; of repeated keys the last counts."""
    members, at = {}, _skip(text, 1)
    if text[at:at + 1] == "}":
        at += 1
    else:
        while True:
            if text[at:at + 1] != '"':
                raise ValueError("key")
            key, at = _DECODER.raw_decode(text, at)
            at = _skip(text, at)
            if text[at:at + 1] != ":":
                raise ValueError("colon")
            at = _skip(text, at + 1)
            _, end = _DECODER.raw_decode(text, at)
            members[key] = text[at:end]
            at = _skip(text, end)
            mark, at = text[at:at + 1], at + 1
            if mark == "}":
                break
            if mark != ",":
                raise ValueError("object")
            at = _skip(text, at)
    if _skip(text, at) != len(text):
        raise ValueError("trailing data")
    return members


def csv_records(text: str) -> list[list[str]]:
    """RFC 4180 records: strict quotes, equal field counts, empty lines skipped; ValueError otherwise."""
    text = text.replace("\r\n", "\n")
    records, at, n = [], 0, len(text)
    while at < n:
        if text[at] == "\n":
            at += 1
            continue
        record = []
        while True:
            if text[at:at + 1] == '"':
                parts, at = [], at + 1
                while True:
                    end = text.find('"', at)
                    if end < 0:
                        raise ValueError("open quote")
                    parts.append(text[at:end])
                    at = end + 1
                    if text[at:at + 1] != '"':
                        break
                    parts.append('"')
                    at += 1
                record.append("".join(parts))
                if at < n and text[at] not in ",\n":
                    raise ValueError("text after a quote")
            else:
                stop = re.compile("[,\n]").search(text, at)
                end = stop.start() if stop else n
                if '"' in text[at:end]:
                    raise ValueError("bare quote")
                record.append(text[at:end])
                at = end
            if at < n and text[at] == ",":
                at += 1
                continue
            at += 1
            break
        if records and len(record) != len(records[0]):
            raise ValueError("ragged")
        records.append(record)
    return records


def collapse_array(trimmed: str) -> str | None:
    if not trimmed.startswith("["):
        return None
    try:
        members = array_members(trimmed)
    except (ValueError, RecursionError):
        return None
    return f"{members[0]},\n{members[1]},\n…and {len(members) - 2} more items" if len(members) > 3 else None


def collapse_object(trimmed: str) -> str | None:
    if not trimmed.startswith("{"):
        return None
    try:
        members = object_members(trimmed)
    except (ValueError, RecursionError):
        return None
    if len(members) <= 8:
        return None
    keys = sorted(members, key=lambda k: k.encode("utf-8", "surrogatepass"))
    return "".join(f"{k}: {members[k]}\n" for k in keys[:5]) + f"…and {len(keys) - 5} more keys"


def collapse_json_lines(trimmed: str) -> str | None:
    rows = [x for x in (line.strip(WHITE_SPACE) for line in trimmed.split("\n")) if x]
    if len(rows) <= 3 or not all(x[0] == "{" or x == "null" for x in rows):
        return None
    try:
        for x in rows:
            json_value(x)
    except (ValueError, RecursionError):
        return None
    return f"{rows[0]}\n{rows[1]}\n…and {len(rows) - 2} more JSON records"


def collapse_csv(trimmed: str) -> str | None:
    if "," not in trimmed:
        return None
    try:
        records = csv_records(trimmed)
    except ValueError:
        return None
    if len(records) <= 4 or len(records[0]) < 3:
        return None
    return "".join(",".join(r) + "\n" for r in records[:3]) + f"…and {len(records) - 3} more rows"


PARSED = (("json_array", collapse_array), ("json_object", collapse_object), ("json_lines", collapse_json_lines), ("csv", collapse_csv))


def first_parsed(text: str) -> tuple[str, str] | None:
    trimmed = text.strip(WHITE_SPACE)
    for name, collapse in PARSED:
        if (out := collapse(trimmed)) is not None:
            return name, out
    return None


@arrow_udf("struct<shape:string,output:string>")
def parsed_shape(texts: pd.Series) -> pd.DataFrame:
    found = [first_parsed(t) if t is not None else None for t in texts]
    return pd.DataFrame({"shape": [f and f[0] for f in found], "output": [f and f[1] for f in found]})
