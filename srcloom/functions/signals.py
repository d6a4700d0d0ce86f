"""Source signals and the two survey scores. Row-local."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom import dims, rules, rx
from srcloom.functions import paths

SIGNAL_TYPE = "array<struct<kind:string,score:int,reason:string>>"


_WORDS = re.compile(r"\\b\((.+)\)\\b")


def _split_words(pattern: str) -> tuple[list[str], list[str]] | None:
    """The plain words and the other alternatives of a pattern of the form ``\\b(a|b|c)\\b``; none for other patterns."""
    whole = _WORDS.fullmatch(pattern)
    if not whole:
        return None
    parts = whole[1].split("|")
    words = [p.lower() for p in parts if re.fullmatch(r"\w+", p)]
    return words, [p for p in parts if not re.fullmatch(r"\w+", p)]


def _has_words(text: Column, low: Column, words: Column, pattern: str) -> Column:
    """The same as ``rx.test(text, pattern, "i")`` for a list of alternatives between word edges.

    Plain words are looked up among the words of the text. Another alternative is only searched for in a text that holds
    the letters it begins with.
    """
    plain, others = _split_words(pattern)
    found = F.arrays_overlap(words, F.array(*[F.lit(w) for w in plain]))
    for other in others:
        stem = re.match(r"(?:\w|::|/|<|\\\.|\\\()+", other)[0].replace("\\", "").lower()
        found = found | (F.contains(low, F.lit(stem)) & rx.test(text, rf"\b({other})\b", "i"))
    return found


def source_signals(path: Column, text: Column) -> Column:
    """Signals that fire for a file, strongest first."""
    # Fixed order of the rules: score descending, then kind.
    ordered = sorted(dims.SIGNAL_RULES, key=lambda r: (-r[1], r[0]))

    def found(of: Column) -> Column:
        on = {"path": path, "text": of["text"]}

        def fires(column, pattern, flags):
            if column == "text" and flags == "i" and _split_words(pattern):
                return _has_words(of["text"], of["low"], of["words"], pattern)
            return rx.test(on[column], pattern, flags)

        signals = [
            F.when(fires(*rule), F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"), F.lit(reason).alias("reason")))
            for kind, score, reason, *rule in ordered
        ]
        return F.array_compact(F.array(*signals))

    words = F.array_distinct(F.transform(F.split(text, "[^0-9A-Za-z_]+", -1), F.lower))
    # The one item of the outer list binds the text and its words; as plain columns they would be made once per rule.
    of = F.struct(text.alias("text"), F.lower(text).alias("low"), words.alias("words"))
    return F.transform(F.array(of), found)[0].cast(SIGNAL_TYPE)


def _capped(parts: list[Column]) -> Column:
    return F.slice(F.array_distinct(F.array_compact(F.concat(*parts))), 1, 8)


def entry_score(path: Column, bytes_: Column, signals: Column) -> Column:
    """struct(score, reasons): how likely a file starts or anchors the program."""
    low = F.lower(paths.normalize(path))
    cols = {"path_lower": low, "stem": paths.stem(low)}
    oversized = bytes_ > dims.MAX_FILE_BYTES

    def has(kind):
        return F.exists(signals, lambda s: s["kind"] == kind)

    bonus = [
        (has("entry_point") & has("file_io"), "entry point with file IO"),
        (has("entry_point") & has("network"), "entry point with network boundary"),
    ]
    score = (
        rules.points(dims.ENTRY_RULES, cols)
        + F.when(oversized, dims.OVERSIZED_ENTRY[0]).otherwise(0)
        + F.aggregate(signals, F.lit(0), lambda acc, s: acc + s["score"])
        + sum((F.when(c, 10).otherwise(0) for c, _ in bonus), F.lit(0))
    )
    own = rules.reasons(dims.ENTRY_RULES, cols) + [F.when(oversized, F.lit(dims.OVERSIZED_ENTRY[1]))]
    why = _capped(
        [
            F.array(*own),
            F.transform(signals, lambda s: s["reason"]),
            F.array(*[F.when(c, F.lit(t)) for c, t in bonus]),
        ]
    )
    return F.struct(score.alias("score"), why.alias("reasons"))


def documentation_score(path: Column, is_doc: Column, text: Column, bytes_: Column) -> Column:
    """struct(score, reasons): how useful a file is as documentation."""
    low = F.lower(paths.normalize(path))
    cols = {"path_lower": low, "base": paths.basename(low), "is_doc": is_doc.cast("string")}
    oversized = bytes_ > dims.MAX_FILE_BYTES
    commented = ~is_doc & rx.test(F.regexp_replace(text, rf"^[{rx.WS}]+", ""), dims.MODULE_COMMENT)
    tail = [(commented, *dims.MODULE_COMMENT_REASON), (oversized, *dims.OVERSIZED_DOC)]
    score = rules.points(dims.DOC_RULES, cols) + sum((F.when(c, p).otherwise(0) for c, p, _ in tail), F.lit(0))
    why = _capped([F.array(*rules.reasons(dims.DOC_RULES, cols), *[F.when(c, F.lit(t)) for c, _, t in tail])])
    return F.struct(score.alias("score"), why.alias("reasons"))
