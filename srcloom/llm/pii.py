"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as written. Then transducers rewrite disguised
passages: homoglyphs to ASCII, spelled digits to digits, and "at" / "dot" disguises to
their signs. Each emits, beside every character it writes, the source range it stands
for, so an identifier found in the rewritten text maps back to code points of the source.
Spans that hold a rewritten character are added unless a base span of their kind contains them, so
the rest of a partly disguised identifier is found too; base and added spans may overlap.
Runs with fewer than four digit names are rewritten where that completes a number that a detector confirms.

All searches take linear time in the text, however long its runs of digits or letters.

Edge cases: a null text counts as empty; a null id is kept; offsets are code points, end
exclusive; an empty table gives an empty table; repeated rows give repeated rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re

from pyspark.sql import DataFrame

from srcloom.llm import common

KINDS = ("email", "ip", "card", "phone")
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string, n_added long"
)
Span = tuple[int, int]

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[\x20().0-9-][0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    """Each sign of a local part belongs to the nearest @ on its right, so one step back per sign is enough."""
    found, floor = [], 0
    for match in _AFTER_AT.finditer(text):
        start = match.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            found.append((start, match.end()))
            floor = match.end()
    return found


def part_of_ip(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(map(part_of_ip, m.groups()))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    some_digit = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if some_digit and "." in text else [],
        "card": cards(text) if some_digit else [],
        "phone": phones(text) if some_digit and "+" in text else [],
    }


# ---- transducers -----------------------------------------------------------------------------

#: Letters and signs of other scripts that look like ASCII ones.
LOOK_ALIKE = {
    "a": "\u0430\u03b1", "c": "\u0441", "d": "\u0501", "e": "\u0435", "h": "\u04bb", "i": "\u0456\u03b9", "j": "\u0458",
    "o": "\u043e\u03bf", "p": "\u0440\u03c1", "q": "\u051b", "s": "\u0455", "x": "\u0445", "y": "\u0443",
    "A": "\u0391\u0410", "B": "\u0392\u0412", "C": "\u0421", "E": "\u0395\u0415", "H": "\u0397\u041d", "I": "\u0399\u0406",
    "K": "\u039a\u041a", "M": "\u039c\u041c", "N": "\u039d", "O": "\u039f\u041e", "P": "\u03a1\u0420", "T": "\u03a4\u0422",
    "X": "\u03a7\u0425", "Y": "\u03a5", "Z": "\u0396", "@": "\ufe6b", ".": "\u2024\u3002\ufe52",
    "-": "\u2010\u2011\u2012\u2013", "+": "\ufe62",
}
HOMOGLYPHS = {ord(other): ord(plain) for plain, others in LOOK_ALIKE.items() for other in others}
#: Full-width forms of the printable ASCII characters, and digits of other scripts.
WIDE = {0xFF01 + k: 0x21 + k for k in range(94)} | {
    zero + k: 0x30 + k for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)
}
GLYPHS = WIDE | HOMOGLYPHS
#: Names of digits.
DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_GLYPH = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(GLYPHS)) + "]")
_NAME = "(?:" + "|".join(DIGIT_NAMES) + ")"
_BEYOND_LATIN = re.compile("[^\x00-\u02ff]")
#: Digit names and digits in a row; dots, plus and dashes may be spelled too.
_SIGN_NAMES = {"dot": ".", "point": ".", "dash": "-", "hyphen": "-", "plus": "+"}
_RUN_ITEM = re.compile(rf"(?i)\b(?:{_NAME}|{'|'.join(_SIGN_NAMES)})\b|[0-9]+|[.+()-]")
_RUN_START = re.compile(rf"(?i)\b(?:plus|{_NAME})\b")
_GAP = re.compile(r"[\x20-]{0,2}")
_OPEN, _CLOSE = r"[\[({<]\x20?", r"\x20?[\])}>]"
_AT = rf"(?:\x20?{_OPEN}(?:at|@){_CLOSE}\x20?|\x20at\x20|\x20@\x20)"
_DOT = rf"(?:\x20?{_OPEN}(?:dot|punkt|point|\.){_CLOSE}\x20?|\x20dot\x20)"
_HOST = r"[A-Za-z0-9-]+"
#: A disguised address: a local part, a sign for @, and a host with at least one sign for the dot.
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+){{0,15}}?)"
    rf"(?P<at>{_AT}|@)(?P<host>{_HOST}(?:(?:{_DOT}|\.){_HOST}){{1,16}})(?![A-Za-z0-9])",
    re.I,
)
#: Four groups of digits with at least one disguised dot between them.
_MACHINE = re.compile(rf"(?i)(?<![0-9])[0-9]++(?:(?:{_DOT}|\.)[0-9]++){{3}}")
_DOT_RE, _AT_RE = re.compile(_DOT, re.I), re.compile(_AT, re.I)
_PLAIN_AT = re.compile(r"\x20at\x20", re.I)
#: Literal signs of a disguise; texts without any are not searched further.
_NAME_HINTS = [*DIGIT_NAMES, "plus"]
#: Signs of the numbers that a detector confirms.
_NUMBER_SIGNS = frozenset("0123456789 .()+-")
_AT_HINTS = ["[", "(", "{", "<", " dot ", " @ "]
#: Words that no disguised host begins with.
_NO_HOST = {"the", "a", "an", "this", "that"}


class Tape:
    """Rewritten text with the source range of every character, and which characters were rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), b"\0" * len(text)

    def apply(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace the ranges (ascending, disjoint) by other characters, each standing for its whole range."""
        if not edits:
            return self
        out = Tape("")
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for begin, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:begin])
            starts.extend(self.starts[at:begin])
            ends.extend(self.ends[at:begin])
            changed += self.changed[at:begin]
            if new:
                text.append(new)
                starts.extend([self.starts[begin]] * len(new))
                ends.extend([self.ends[end - 1]] * len(new))
                changed += b"\1" * len(new)
            at = end
        out.text, out.starts, out.ends, out.changed = "".join(text), starts, ends, bytes(changed)
        return out


def fold_glyphs(tape: Tape) -> Tape:
    return tape.apply([(m.start(), m.end(), chr(GLYPHS[ord(m[0])])) for m in _GLYPH.finditer(tape.text)])


def confirmed(window: str, edits: list[tuple[int, int, str]], words: int) -> bool:
    """Whether rewriting makes an address, card or phone number; one lone word does not lengthen a plain one."""
    tape, plain = Tape(window).apply(edits), base_spans(window)
    for kind, spans in base_spans(tape.text).items():
        for start, end in spans if kind != "email" else []:
            if b"\1" in tape.changed[start:end]:
                a, b = tape.starts[start], tape.ends[end - 1]
                if words > 1 or not any(c < b and a < d for c, d in plain[kind]):
                    return True
    return False


def spell_out(tape: Tape) -> Tape:
    """Runs of four digit names become digits, shorter ones where a detector confirms the number."""
    edits, at, text = [], 0, tape.text
    while (begin := _RUN_START.search(text, at)) is not None:
        position, items = begin.start(), []
        while (item := _RUN_ITEM.match(text, position)) is not None:
            items.append(item)
            position = _GAP.match(text, item.end()).end()
        names = sum(i[0].lower() in DIGIT_NAMES for i in items)
        # A short run may continue plain digits beside it.
        first = last = begin.start()
        if names < 4:
            last = position
            while first > at and text[first - 1] in _NUMBER_SIGNS:
                first -= 1
            while last < len(text) and text[last] in _NUMBER_SIGNS:
                last += 1
        if names >= 4 or names + len(_DIGIT.findall(text, first, last)) >= 4:
            while items and (items[-1][0].lower() in _SIGN_NAMES or items[-1][0] in ".+()-"):
                items.pop()
            spelled = names + sum(i[0].lower() in _SIGN_NAMES for i in items)
            written = []
            for k, item in enumerate(items):
                word = item[0].lower()
                new = DIGIT_NAMES.get(word) or _SIGN_NAMES.get(word) or item[0]
                # The blank between two items goes, so that the digits stand together.
                stop = items[k + 1].start() if k + 1 < len(items) else item.end()
                if stop - item.start() != len(new) or new != item[0]:
                    written.append((item.start(), stop, new))
            # Each character stands for its item alone, without the blank behind it.
            if names >= 4 or confirmed(text[first:last], [(a - first, b - first, new) for a, b, new in written], spelled):
                edits += written
        at = max(items[-1].end() if items else begin.end(), begin.end())
    return tape.apply(edits)


def undisguise_addresses(tape: Tape) -> Tape:
    edits = []
    for m in _ADDRESS.finditer(tape.text):
        at, dots = m["at"], [d for part in ("local", "host") for d in _DOT_RE.finditer(tape.text, *m.span(part))]
        host_dots = [d for d in dots if d.start() >= m.start("host")]
        # A plain word "at" counts only before a host whose dots are disguised as well.
        if (at == "@" and not dots) or (_PLAIN_AT.fullmatch(at) and not host_dots):
            continue
        if _PLAIN_AT.fullmatch(at) and re.match("[A-Za-z0-9-]+", m["host"])[0].lower() in _NO_HOST:
            continue
        edits += [(d.start(), d.end(), ".") for d in dots if d.end() <= m.start("at")]
        if at != "@":
            edits.append((m.start("at"), m.end("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in host_dots]
    return tape.apply(edits)


def undisguise_machines(tape: Tape) -> Tape:
    """Disguised dots between groups of digits become dots where the detector then sees an address."""
    edits = []
    for m in _MACHINE.finditer(tape.text):
        dots = list(_DOT_RE.finditer(tape.text, *m.span()))
        if dots and ips(_DOT_RE.sub(".", m[0])):
            edits += [(d.start(), d.end(), ".") for d in dots]
    return tape.apply(edits)


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    tape = Tape(text)
    if not text.isascii() and _BEYOND_LATIN.search(text) and _GLYPH.search(text):
        tape = fold_glyphs(tape)
    low = tape.text.lower().replace("-", " ")
    if any(hint in low for hint in _NAME_HINTS):
        tape = spell_out(tape)
    if any(hint in low for hint in _AT_HINTS):
        tape = undisguise_machines(undisguise_addresses(tape))
    if tape.text is text:
        return {k: [] for k in KINDS}
    out = {}
    for kind, spans in base_spans(tape.text).items():
        own = sorted(base[kind])
        out[kind] = []
        for start, end in spans:
            if b"\1" not in tape.changed[start:end]:
                continue
            source = (tape.starts[start], tape.ends[end - 1])
            # A blank that was folded into the last character is not part of the span.
            while source[1] > source[0] and text[source[1] - 1] == " ":
                source = (source[0], source[1] - 1)
            # Base spans of a kind are disjoint: only the last one that begins so early can contain this one.
            before = bisect.bisect_right(own, (source[0], len(text))) - 1
            if before < 0 or own[before][1] < source[1]:
                out[kind].append(source)
    return out


def find_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    base = base_spans(text)
    return base, added_spans(text, base)


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every whole text."""

    def run(texts):
        out = {c.split()[0]: [] for c in SCHEMA.split(", ")[1:]}
        for text in texts:
            base, added = find_spans(text)
            for kind in KINDS:
                out[f"n_{kind}"].append(len(base[kind]))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written({k: base[k] + added[k] for k in KINDS}))
            out["n_added"].append(sum(map(len, added.values())))
        return out

    return common.id_and_text(docs).mapInArrow(common.per_text(run, SCHEMA), SCHEMA)


def masked(text: str) -> str:
    """The text with every span, base or added, replaced by the name of its kind."""
    base, added = find_spans(text)
    spans = sorted((a, b, kind) for kind in KINDS for a, b in base[kind] + added[kind])
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
