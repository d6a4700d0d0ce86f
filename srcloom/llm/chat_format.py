r"""Chat formatting with a grammar round trip.

Template, one piece per turn:

* system: ``<<SYS>>\n`` text ``\n<</SYS>>\n``
* user: ``<s>[INST] `` text `` [/INST]``
* assistant: a space, text, ``</s>``; the text alone is under the loss mask
* any other role: ``[ROLE]`` role ``[TEXT]`` text ``[/ROLE]\n``

A rendered turn is read again by a deterministic parser, which knows nothing but the text. It refuses a
control string inside a text, and it takes one backslash out of every control string that has some behind
its first sign. Where the turn that it recovers is not the source, the conflicting text is escaped
(one more backslash behind the first sign of each control string, backslashes or not) and rendered
anew, until both are identical. Every piece begins and ends the grammar's start state, so turns are
rendered before the shuffle; the whole formatted output is parsed once more when it is read back, and
a difference stops the job.

Rows of a conversation are sorted and streamed in parts of about ``PART_CHARS``, never gathered: a
conversation of any number of turns takes the memory of one part and one turn.

Edge cases: null role or text counts as empty; a null turn comes first; turns with equal numbers follow
the byte order of their formatted text; repeated rows are repeated turns; rows with a null conv_id form
one conversation; an empty table gives no row; roles may hold control strings too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.llm import common

#: The conversation that every production run adds: control strings as ordinary text.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
#: Code points after which a part of a formatted conversation ends with the turn at hand.
PART_CHARS = 1 << 20

PARTS = "conv_id long, part long, formatted string, turn_checks array<binary>, mask array<struct<start: long, length: long>>"
SUMMARY = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"
)

#: First sign of a control string, and what may follow it; backslashes in between are escapes.
_SIGNS = {"<": r"/?s>|</?SYS>>", r"\[": r"/?INST\]|/?ROLE\]|TEXT\]"}
_CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[TEXT\]")
_ESCAPED = re.compile("|".join(rf"(?<={sign})\\(?=\\*(?:{tails}))" for sign, tails in _SIGNS.items()))
_ESCAPABLE = re.compile("|".join(rf"(?<={sign})(?=\\*(?:{tails}))" for sign, tails in _SIGNS.items()))
#: Opening and closing string of each role's text.
FRAMES = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>")}


class Conflict(ValueError):
    """Text that the grammar cannot read."""


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def render(role: str, text: str) -> str:
    if role in FRAMES:
        begin, end = FRAMES[role]
        return f"{begin}{text}{end}"
    return f"[ROLE]{role}[TEXT]{text}[/ROLE]\n"


def _body(formatted: str, start: int, end_mark: str) -> tuple[str, int]:
    """Text from ``start`` to the next control string, which must be the one of ``end_mark``."""
    found = _CONTROL.search(formatted, start)
    if not found:
        raise Conflict("text without an end")
    end = found.start() - _CONTROL.search(end_mark).start()
    if end < start or not formatted.startswith(end_mark, end):
        raise Conflict("control string inside a text")
    return formatted[start:end], end + len(end_mark)


def read_turns(formatted: str):
    """(role, text, start and end of the text as written) of all turns of a formatted text."""
    at = 0
    while at < len(formatted):
        for role, (begin, end_mark) in FRAMES.items():
            if formatted.startswith(begin, at):
                start = at + len(begin)
                break
        else:
            if not formatted.startswith("[ROLE]", at):
                raise Conflict("no turn begins here")
            role, start = _body(formatted, at + len("[ROLE]"), "[TEXT]")
            role, end_mark = unescape(role), "[/ROLE]\n"
        text, at = _body(formatted, start, end_mark)
        yield role, unescape(text), start, start + len(text)


def round_trip(role: str, text: str) -> tuple[str, int]:
    """The formatted turn that reads back as (role, text), and how many of its two fields were escaped."""
    forms = ((role, text), (role, escape(text)), (escape(role), text), (escape(role), escape(text)))
    for tried, (r, t) in enumerate(forms):
        piece = render(role if role in FRAMES else r, t)
        try:
            if [turn[:2] for turn in read_turns(piece)] == [(role, text)]:
                return piece, (0, 1, 1, 2)[tried]
        except Conflict:
            pass
    raise AssertionError("escaped turns read back identically")


def turn_check(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{role}\0{text}".encode(), digest_size=8).digest()


_TURNS = "conv_id long, turn long, piece string, turn_check binary"


def format_turns(conversations: DataFrame) -> DataFrame:
    """Every row as a formatted piece, with a digest of its source for the final comparison."""

    def run(batches):
        for batch in common.slices(batches):
            pieces, checks = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                pieces.append(round_trip(role, text)[0])
                checks.append(turn_check(role, text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(pieces, pa.string()), pa.array(checks, pa.binary())],
                names=["conv_id", "turn", "piece", "turn_check"],
            )

    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role"), text_of("text"))
    return rows.mapInArrow(run, _TURNS)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted conversations in parts of whole turns, with the spans under the loss mask.

    Columns: conv_id, part (from 0), formatted, turn_checks (one per turn), mask (start and length in code
    points of the part). The parts of a conversation come together and in order; after another shuffle
    they must be sorted by (conv_id, part) again.
    """

    target = common.arrow_schema(PARTS)

    def run(batches):
        def emit():
            rows = {"conv_id": conv, "part": part, "formatted": "".join(pieces), "turn_checks": checks, "mask": mask}
            return pa.RecordBatch.from_pylist([rows], schema=target)

        conv, part, pieces, checks, mask, size, started = None, 0, [], [], [], 0, False
        for batch in common.slices(batches):
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "piece", "turn_check"))
            for conv_id, piece, check in zip(*columns):
                if started and (conv_id != conv or size >= PART_CHARS):
                    yield emit()
                    part = part + 1 if conv_id == conv else 0
                    pieces, checks, mask, size = [], [], [], 0
                conv, started = conv_id, True
                # A piece of an assistant alone begins with a space.
                if piece.startswith(FRAMES["assistant"][0]):
                    begin, end = map(len, FRAMES["assistant"])
                    mask.append({"start": size + begin, "length": len(piece) - begin - end})
                pieces.append(piece)
                checks.append(check)
                size += len(piece)
        if started:
            yield emit()

    turns = format_turns(conversations)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted parts alone; a turn that differs from its source stops the job."""

    target = common.arrow_schema(SUMMARY)

    def run(batches):
        conv, state = None, None

        def emit():
            turns, loss, counts = state
            row = dict(zip(target.names, (conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), *counts[2:])))
            return pa.RecordBatch.from_pylist([row], schema=target)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["part"] == 0:
                    if state:
                        yield emit()
                    conv, state = row["conv_id"], (hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0])
                turns, loss, counts = state
                formatted, checks = row["formatted"], iter(row["turn_checks"])
                for role, text, start, end in read_turns(formatted):
                    if turn_check(role, text) != next(checks, None):
                        raise ValueError(f"conversation {conv}: a turn does not read back as its source")
                    turns.update(f"{role}\n{text}\n".encode())
                    counts[0] += 1
                    counts[3] += end - start != len(text)
                if next(checks, None) is not None:
                    raise ValueError(f"conversation {conv}: a turn is lost")
                for span in row["mask"]:
                    text = unescape(formatted[span["start"] : span["start"] + span["length"]])
                    loss.update(text.encode())
                    counts[1] += len(text)
                counts[2] += len(formatted)
        if state:
            yield emit()

    return parts.mapInArrow(run, SUMMARY)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The four columns in use, with the rows of ``PROBE``."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    names = ["conv_id", "turn", "role", "text"]
    return conversations.select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, ("long", "long", "string", "string"))]).union(probe)


def oracle_sql() -> str:
    probe = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)
    escaped = "{}"
    for sign, tails in _SIGNS.items():
        escaped = rf"regexp_replace({escaped}, '({sign})(\\*)({tails})', '\1\\\2\3', 'g')"
    cases = " ".join(
        "when '{}' then {} || {} || {}".format(role, *(_sql_text(x) if i != 1 else "t" for i, x in enumerate((f[0], "", f[1]))))
        for role, f in FRAMES.items()
    )
    return f"""
    with source as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select * from (values {probe})),
    written as (select *, {escaped.format("text")} as t, {escaped.format("role")} as r from source),
    pieces as (
      select *, case role {cases} else '[ROLE]' || r || '[TEXT]' || t || '[/ROLE]' || chr(10) end as piece from written)
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, piece)) as turns_sha256,
      cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn nulls first, piece) filter (where role = 'assistant'), '')) as loss_sha256,
      cast(sum(length(piece)) as bigint) as formatted_chars,
      cast(sum(case when t <> text then 1 else 0 end) as bigint) as n_escaped
    from pieces group by conv_id
    """


def _sql_text(text: str) -> str:
    return " || ".join("chr(10)" if p == "\n" else f"'{p}'" for p in re.split("(\n)", text) if p)
