"""Regular expressions that mean the same thing in every engine we run on.

Patterns in :mod:`srcloom.dims` are written with plain ASCII semantics: ``\\b``
and ``\\w`` are ASCII, ``$`` is the very end of the text, ``.`` stops at line
ends and ``\\s`` covers the Unicode spaces. Java (Spark) and RE2 (DuckDB, used
for checks only) each deviate somewhere, so a pattern is spelled out per engine.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_DOT = r"[^\n\r\x{2028}\x{2029}]"
_WORD_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def _spell(pattern: str, *, word_edge: str, end: str) -> str:
    # Any character at all: kept apart from the dot, which stops at line ends.
    pattern = pattern.replace(r"[\s\S]", "\0")
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            i += 2
            if pair == r"\s":
                out.append(WS if in_class else f"[{WS}]")
            elif pair == r"\S":
                out.append(f"[^{WS}]")
            elif pair == r"\b" and not in_class:
                out.append(word_edge)
            else:
                out.append(pair)
            continue
        if in_class:
            in_class = c != "]"
            out.append(r"\[" if c == "[" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "\0":
            out.append("(?s:.)")
        elif c == ".":
            out.append(_DOT)
        elif c == "$":
            out.append(end)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """Spell ``pattern`` for Spark. ``flags`` may hold ``i`` and ``m``."""
    end = "$" if "m" in flags else r"\z"
    head = f"(?{flags}{'d' if 'm' in flags else ''})" if flags else ""
    return head + _spell(pattern, word_edge=_WORD_EDGE, end=end)


def re2(pattern: str, flags: str = "") -> str:
    """Spell ``pattern`` for DuckDB."""
    end = "$" if "m" in flags else r"\z"
    head = f"(?{flags})" if flags else ""
    return head + _spell(pattern, word_edge=r"\b", end=end)


def test(col: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(col, F.lit(java(pattern, flags)))


def stems(pattern: str) -> list[str]:
    """What a text that ``\\b(a|b|c)`` or ``\\b(a|b|c)\\b`` is found in holds at least one of, in lower case; none for other patterns."""
    whole = re.fullmatch(r"\\b\(([^()]+)\)(?:\\b)?", pattern)
    if not whole:
        return []
    out = []
    for part in whole[1].split("|"):
        begin = re.match(r"(?:[A-Za-z0-9_ ]|\\\.)*", part)[0]
        # A quantifier may take the last letter away.
        if part[len(begin) : len(begin) + 1] in ("?", "*", "{"):
            begin = begin[:-1].removesuffix("\\")
        out.append(begin.replace("\\.", ".").lower())
    return out if all(out) else []


def test_words(col: Column, low: Column, pattern: str, flags: str = "") -> Column:
    """The same as :func:`test`, given the text in lower case too: the pattern is tried only where one of its :func:`stems` occurs."""
    found = [F.contains(low, F.lit(s)) for s in stems(pattern)]
    whole = test(col, pattern, flags)
    return reduce(lambda a, b: a | b, found) & whole if found else whole


def extract(col: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(col, java(pattern, flags), group)


def extract_all(col: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract_all(col, F.lit(java(pattern, flags)), F.lit(group))


def replace(col: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(col, F.lit(java(pattern, flags)), F.lit(by))


def trim(col: Column) -> Column:
    """Strip the same characters as ``\\s`` from both ends."""
    return F.regexp_replace(col, F.lit(rf"^[{WS}]+|[{WS}]+\z"), F.lit(""))
