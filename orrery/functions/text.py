"""Regular expressions over source text: counts and extractions as Columns.

Patterns are written once, in a dialect that Java and RE2 share; `(?m)` is always inline.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors

#: A piece of a pattern: a class or place, an escaped character, a set, a bracket, a repetition, another sign, a plain character.
PIECE = re.compile(r"\\(?P<kind>[A-Za-z0-9])|\\(?P<escaped>.)|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<bracket>[()])|(?P<often>[*+?]|\{[^}]*\})|(?P<sign>[.^$|])|(?P<plain>.)", re.S)
#: A word as `\b` sees it: a keyword `\bw\b` occurs as often as `w` is one of these.
WORD = r"\b[a-zA-Z0-9_]+\b"


def java(pattern: str) -> str:
    """As Spark needs it: with (?d), a line ends at a line feed only."""
    return pattern.replace("(?m)", "(?md)", 1) if pattern.startswith("(?m)") else "(?d)" + pattern


def literal(pattern: str) -> str:
    """The longest plain text that is in all matches; empty where the pattern has none."""
    runs, depth = [""], 0
    for m in PIECE.finditer(pattern):
        kind, at = m.lastgroup, m.group()
        if kind == "bracket":
            depth += 1 if at == "(" else -1
        elif depth:
            continue
        elif at == "|":
            return ""
        elif kind in ("plain", "escaped"):
            runs[-1] += m.group(kind)
            continue
        elif at == "\\b":
            continue
        elif kind == "often" and at != "+":
            runs[-1] = runs[-1][:-1]
        runs.append("")
    return max(runs, key=len)


def _lacks(text: Column, pattern: str) -> Column | None:
    """Whether `text` can't match, as it lacks the pattern's literal(); looking for that is far cheaper than matching. Null of null."""
    sign = literal(pattern)
    return ~text.contains(F.lit(sign)) if sign else None


def _unless(lacks: Column | None, none: Column, found: Column) -> Column:
    return found if lacks is None else F.when(lacks, none).otherwise(found)


def count(text: Column, pattern: str) -> Column:
    return _unless(_lacks(text, pattern), F.lit(0), F.regexp_count(text, F.lit(java(pattern))))


def occurrences(text: Column, plain: str) -> Column:
    """How often a plain text occurs, counted from left to right like the matches of a pattern."""
    left = F.octet_length(F.replace(text, F.lit(plain), F.lit("")))
    return ((F.octet_length(text) - left) / len(plain.encode())).cast("int")


def counts(text: Column, patterns: Iterable[str]) -> Column:
    """Matches of all patterns, each counted by itself."""
    out = None
    for p in patterns:
        c = count(text, p)
        out = c if out is None else out + c
    return out


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return _unless(_lacks(text, pattern), none, F.regexp_extract_all(text, F.lit(java(pattern)), group))


def replace_all(text: Column, steps: Iterable[tuple[str, str]]) -> Column:
    """The replacements one after the other."""
    for pattern, by in steps:
        text = vectors.let(text, lambda t, pattern=pattern, by=by: _unless(_lacks(t, pattern), t, F.regexp_replace(t, java(pattern), by)))
    return text


def length_of(parts: Column) -> Column:
    """Characters of all texts of an array."""
    return F.length(F.array_join(parts, ""))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def extension(path: Column) -> Column:
    """With the dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def parent_name(path: Column) -> Column:
    return base_name(parent_path(path))


def percent(x: Column) -> Column:
    """As a whole percentage."""
    return F.format_string("%.0f%%", x * 100)


def beyond(name: str, value: Column, over: float | None = None, under: float | None = None, whole: bool = False) -> Column:
    """"name over limit" or "name under limit" where `value` passes that limit, with the number itself if it is whole; else null."""
    said = lambda way, limit: F.concat(F.lit(f"{name} "), value.cast("string"), F.lit(f" {way} {limit:g}")) if whole else F.lit(f"{name} {way} {limit:g}")
    out = F.when(value < under, said("under", under)) if under is not None else F.when(value > over, said("over", over))
    return out if under is None or over is None else out.when(value > over, said("over", over))


def notes(rules: Iterable[Column], none: str) -> Column:
    """What applies of `rules`, in order; `none` alone where nothing does."""
    found = F.array_compact(F.array(*rules))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(none)))
