"""Snippets and highlighting: string expressions over a text column."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

WIDTH, LEAD = 150, 40


def operands(query: str) -> list[str]:
    return [p.strip() for p in re.split(r"&&|\|\|", query) if p.strip()]


def patterns(query: str, kind: str) -> list[str]:
    """Java patterns of a query, in order of preference. ``kind``: exact, prefix, phrase or boolean."""
    q = query.replace("*", "").replace("#", "")
    quoted = lambda t: r"\Q" + t.replace(r"\E", "") + r"\E"
    if kind == "prefix":
        return [rf"(?iu)\b{quoted(q)}[a-zA-Z0-9]*\b"]
    if kind == "phrase":
        return [rf"(?iu){quoted(q)}"]
    if kind == "boolean":
        return [rf"(?iu)\b{quoted(t)}\b" for t in operands(q)]
    if kind == "exact":
        return [rf"(?iu)\b{quoted(q)}\b"]
    raise ValueError(f"unknown kind {kind!r}")


def _any(of: list[str]) -> str:
    return "(?iu)(?:" + "|".join(p.removeprefix("(?iu)") for p in of) + ")"


def highlight(text: Column, query: str, kind: str) -> Column:
    """Every match marked, in one pass, so marks are never matched themselves."""
    found = patterns(query, kind)
    return F.regexp_replace(text, _any(found), "<mark>$0</mark>") if found else text


def snippet(text: Column, title: Column, query: str, kind: str) -> Column:
    """The first line with a match, else the first line, cut around the match and highlighted."""
    found = patterns(query, kind)
    lines = F.split(text, "\n", -1)
    line = F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(_any(found))), F.lit(0)), F.get(lines, F.lit(0)))
    at = F.coalesce(*[F.nullif(F.regexp_instr(line, F.lit(p)), F.lit(0)) for p in found], F.lit(0))
    start = F.greatest(at - 1 - LEAD, F.lit(0))
    size = F.least(F.length(line) - start, F.lit(WIDTH))
    body = highlight(F.substring(line, start + 1, size), query, kind)
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(""), body, F.when(start + size < F.length(line), F.lit("...")).otherwise(""))
    head = F.when(F.length(line) <= WIDTH, line).otherwise(F.concat(F.substring(line, 1, WIDTH), F.lit("...")))
    out = F.when(at > 0, cut).otherwise(head)
    return F.when(text.isNull() | (text == ""), F.concat(F.lit("No content available for "), title)).otherwise(out)


def unmark(text: Column) -> Column:
    return F.regexp_replace(text, "</?mark>", "")


def display_score(score: Column, top: Column) -> Column:
    """0 to 100 relative to the best hit; at least 1, and 0 if there is nothing above 0."""
    return F.when(top <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(1.0), score / top * 100)))
