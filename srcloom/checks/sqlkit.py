"""Small helpers to write check SQL for DuckDB."""

from __future__ import annotations

from srcloom import rx


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(col: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({col}, {s(rx.re2(pattern, flags))})"


def ex(col: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract({col}, {s(rx.re2(pattern, flags))}, {group})"


def exall(col: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract_all({col}, {s(rx.re2(pattern, flags))}, {group})"


def rep(col: str, pattern: str, by: str, flags: str = "", once: bool = False) -> str:
    tail = "" if once else ", 'g'"
    return f"regexp_replace({col}, {s(rx.re2(pattern, flags))}, {s(by)}{tail})"


def trim(col: str) -> str:
    return rep(col, r"^\s+|\s+$", "")


def arr(items) -> str:
    return "[" + ", ".join(s(i) for i in items) + "]"


def distinct(lst: str) -> str:
    """Distinct list items in first-seen order."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def join(lst: str, sep: str = "|") -> str:
    return f"array_to_string({lst}, {s(sep)})"


def holds(condition, cols: dict[str, str]) -> str:
    def one(test):
        on, pattern, *flags = test
        hit = m(cols[on.lstrip("!")], pattern, *flags)
        return f"NOT {hit}" if on.startswith("!") else hit

    return "(" + " OR ".join("(" + " AND ".join(one(t) for t in alt) + ")" for alt in condition) + ")"


def points(rules, cols: dict[str, str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {holds(r[-1], cols)} THEN {r[0]} ELSE 0 END" for r in rules) + ")"


def reasons(rules, cols: dict[str, str]) -> list[str]:
    return [f"CASE WHEN {holds(r[2], cols)} THEN {s(r[1])} END" for r in rules]


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {s(w)})" for w in words) + ")"


def compact(items) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def basename(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$')"


def dirname(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END"


def ext(p: str) -> str:
    return f"regexp_extract({basename(p)}, '^.+(\\.[^.]*)$', 1)"


def stem(p: str) -> str:
    return f"regexp_replace({basename(p)}, '^(.+)\\.[^.]*$', '\\1')"


def lit_map(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {s(k)} THEN {s(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"
