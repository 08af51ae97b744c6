"""The little of the text kernel that the session processor needs in Python: estimates, and trimming of a diff."""

from __future__ import annotations

import math
import re

from terselake.functions.similarity import word_list

_TECHNICAL = re.compile(r"[/\\.:()A-Z]")
_TOKEN = re.compile("[a-z0-9_]+")


def estimate(text: str) -> int:
    words = word_list(text)
    if not words:
        return 0
    head = words[:40]
    technical = sum(bool(_TECHNICAL.search(w)) or ("_" in w and len(w.encode()) > 4) for w in head)
    heavy = sum(map(text.count, "{}[]"))
    light = sum(map(text.count, ":,;()"))
    return math.ceil(len(words) / (0.75 - technical / len(head) * 0.15)) + heavy + (light + 1) // 2


def number(n: int) -> str:
    return f"{n // 1000},{n % 1000:03d}" if n >= 1000 else str(n)


def trim(text: str, terms: list[str], budget: int, min_lines: int) -> str | None:
    """The trimmed text, or None where the gate does not open."""
    rows = text.split("\n")
    if estimate(text) <= budget or sum(r != "" for r in rows) < min_lines:
        return None
    wanted = set(t.lower() for t in terms)
    hits = [wanted & set(_TOKEN.findall(r.lower())) for r in rows]
    held = {t: sum(t in h for h in hits) for t in wanted}
    scored = [any(held[t] < len(rows) for t in h) for h in hits]
    left = budget - sum(estimate(r) for r, s in zip(rows, scored, strict=True) if s)
    out, gap = [], 0
    for k, r in enumerate(rows):
        fits = not scored[k] and left > 0
        left -= 0 if scored[k] else estimate(r)
        if fits or scored[k] or k in (0, len(rows) - 1) or any(t in r.lower() for t in wanted):
            if gap:
                lead = r[:len(r) - len(r.lstrip(" \t"))]
                out.append(" " * (len(lead) + lead.count("\t")) + f"[… {gap} lines omitted …]")
            out.append(r)
            gap = 0
        else:
            gap += 1
    return "\n".join([*out, *([f"[… {gap} lines omitted …]"] if gap else [])])
