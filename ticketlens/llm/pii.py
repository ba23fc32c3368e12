"""Personal data, also where it is disguised, with offsets into the source text.

Base findings come from the plain text. For disguises, small transducers rewrite the text - look-alike
letters and wide digits, spelled digits, ``(at)`` / ``[dot]`` - and keep for every written character
the source characters it stands for. Identifiers found in the rewritten text are mapped back to
source spans. They add to the base findings and never replace them.

A text is rewritten only if a trigger occurs in it, which every disguise needs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_batches, free_name

# fixed values: kinds in their order, and their patterns
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: the same matches without trying every digit of a run
_FAST = {"ip": re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern)}
_ANY_DIGIT = re.compile("[0-9]")
# what must occur in a text for a kind to be possible; all but email need a digit as well
NEEDS = {
    "email": re.compile("@"),
    "ip": re.compile(r"[0-9]\.[0-9]"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": re.compile(r"\+[0-9]"),
}

#: letters and signs that look like others, both in natural order
LOOK_ALIKE = dict(zip(
    "аеорсухіјѕАВЕКМНОРСТХІЈЅαοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．。․＋－‐‑‒–",
    "aeopcyxijsABEKMHOPCTXIJSaoABEZHIKMNOPTYX@...+-----", strict=True))
LOOK_ALIKE.update({chr(0xFF10 + i): str(i) for i in range(10)})  # wide digits
LOOK_ALIKE.update({chr(0x0660 + i): str(i) for i in range(10)})  # Arabic-Indic digits
LOOK_ALIKE.update({chr(0xFF21 + i): chr(65 + i) for i in range(26)})  # wide capitals
LOOK_ALIKE.update({chr(0xFF41 + i): chr(97 + i) for i in range(26)})  # wide small letters
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_LOOKS = re.compile("[" + "".join(map(re.escape, LOOK_ALIKE)) + "]")
_GAP = re.compile(r"[\t-\r ,-]+")
_SPELLED_WORD = rf"(?ai:{'|'.join(SPELLED)})"
_DIGIT_TOKEN = rf"(?:{_SPELLED_WORD}|[0-9]++)\b"
#: spelled digits and groups of digits in a row, of any length: what they are is left to ``_valid``
_DIGIT_RUN = re.compile(rf"\b{_DIGIT_TOKEN}(?:{_GAP.pattern}{_DIGIT_TOKEN})*+")
_DIGITS = re.compile(_DIGIT_TOKEN)
_SPELLED = re.compile(rf"\b{_SPELLED_WORD}\b")
_BRACKET_AT = re.compile(r"\s{0,4}(?:\[\s{0,4}(?:at|@)\s{0,4}\]|\(\s*(?:at|@)\s*\)|\{\s*(?:at|@)\s*\}|<\s*at\s*>)\s{0,4}",
                         re.IGNORECASE)
_BRACKET_DOT = re.compile(
    r"\s{0,4}(?:\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{\s*(?:dot|\.)\s*\}|<\s*dot\s*>)\s{0,4}",
    re.IGNORECASE)
#: plain words only as a whole address: name at host dot ending
_WORDS = re.compile(
    r"\b[A-Za-z0-9._%+-]{1,64}([\t-\r ]+at[\t-\r ]+)[A-Za-z0-9-]+((?:[\t-\r ]+dot[\t-\r ]+[A-Za-z0-9-]+)+)\b",
    re.IGNORECASE)
_DOT_WORD = re.compile(r"[\t-\r ]+dot[\t-\r ]+", re.IGNORECASE)
#: A-Z lower-cased and gaps made spaces, byte by byte, so that triggers are plain substrings
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 or c in b",-" else c for c in range(256))
_DIGIT_TRIGGERS = [word.encode() for word in SPELLED]

Span = tuple[str, int, int]
Edit = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15


_LOCAL = "".join(c for c in map(chr, range(128)) if c.isalnum()) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern in time linear in the text: a match begins where the run of
    signs before an @ does, after the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            yield start, floor
        at = text.find("@", floor)


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        return _emails(text)
    return (m.span() for m in _FAST.get(kind, PATTERNS[kind]).finditer(text)
            if _valid(kind, m.group()))


def find_plain(text: str) -> list[Span]:
    """Base findings by start, then kind; offsets in code points, end exclusive."""
    found = []
    digit = _ANY_DIGIT.search(text)
    for order, kind in enumerate(KINDS):
        if (digit or kind == "email") and NEEDS[kind].search(text):
            found += [(start, order, end) for start, end in _matches(kind, text)]
    return [(KINDS[order], start, end) for start, order, end in sorted(found)]


class Rewritten:
    """A text after a transducer, with the way back to the text before it."""

    def __init__(self, text: str, edits: list[Edit]):
        pieces, self._at, self._piece, at, out = [], [], [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for source, target, copied in ((at, text[at:start], True), (start, new, False)):
                if target:
                    self._at.append(out)
                    self._piece.append((source, end if not copied else start, copied))
                    pieces.append(target)
                    out += len(target)
            at = end
        self.text = "".join(pieces)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that [start, end) stands for."""

        def place(i: int) -> tuple[int, int]:
            k = bisect_right(self._at, i) - 1
            begin, stop, copied = self._piece[k]
            return (begin + i - self._at[k], begin + i - self._at[k] + 1) if copied else (begin, stop)

        return place(start)[0], place(end - 1)[1]


def _look_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), LOOK_ALIKE[m.group()]) for m in _LOOKS.finditer(text)]


def _digit_edits(text: str) -> list[Edit]:
    """A digit for its word. A gap between single digits becomes one space, which every pattern of
    digits allows; next to a group of digits only one without commas and line ends does."""
    edits = []
    for run in _DIGIT_RUN.finditer(text):
        if not _SPELLED.search(run.group()):
            continue
        last, grouped = run.start(), False
        for w in _DIGITS.finditer(text, run.start(), run.end()):
            digit = SPELLED.get(w.group().lower())
            group = digit is None and len(w.group()) > 1
            gap = text[last:w.start()]
            if gap not in ("", " ", "-") and not (grouped and group) and (
                    not (grouped or group) or not gap.strip(" \t-")):
                edits.append((last, w.start(), " "))
            if digit:
                edits.append((w.start(), w.end(), digit))
            last, grouped = w.end(), group
    return edits


def _mark_edits(text: str) -> list[Edit]:
    edits = [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)]
    edits += [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)]
    for m in _WORDS.finditer(text):
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(text, m.start(2), m.end(2))]
    kept, last = [], 0
    for edit in sorted(edits):
        if edit[0] >= last:
            kept.append(edit)
            last = edit[1]
    return kept


def _looks_trigger(text: str) -> bool:
    try:  # every look-alike lies outside Latin-1
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def _digits_trigger(text: str) -> bool:
    plain = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    return any(word in plain for word in _DIGIT_TRIGGERS)


def _marks_trigger(text: str) -> bool:
    if any(sign in text for sign in "[({<"):
        return True
    plain = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    return b" dot " in plain and b" at " in plain


#: a cheap condition that every edit needs, and the edits
TRANSDUCERS = ((_looks_trigger, _look_edits), (_digits_trigger, _digit_edits),
               (_marks_trigger, _mark_edits))


def find_disguised(text: str, base: list[Span]) -> list[Span]:
    """Findings in the text after each transducer, as source spans by start, then kind, that are not
    a base finding of their kind or a part of one, nor a part of another of them."""
    steps, now, found = [], text, set()
    for trigger, edits_of in TRANSDUCERS:
        if trigger(now) and (edits := edits_of(now)):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
            for kind, start, end in find_plain(now):
                for step in reversed(steps):
                    start, end = step.source(start, end)
                found.add((kind, start, end))
    furthest, added = {}, []
    whole = [(s, -e, 0, k) for k, s, e in base] + [(s, -e, 1, k) for k, s, e in found]
    for start, back, new, kind in sorted(whole):
        if -back > furthest.get(kind, -1):  # else one of its kind that began before contains it
            furthest[kind] = -back
            if new:
                added.append((kind, start, -back))
    return sorted(added, key=lambda span: (span[1], KINDS.index(span[0])))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii`` (struct): base and added, both arrays of kind, start, end by start,
    then kind. A null or empty text has none. Rows are independent: repeated rows, ties and an
    empty table need no rule. If ``docs`` has a column ``pii``, the new one is ``pii_``."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base = find_plain(t) if t else []
                added = find_disguised(t, base) if t else []
                rows.append(([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base],
                             [dict(zip(("kind", "start", "end"), s, strict=True)) for s in added]))
            yield pd.DataFrame(rows, columns=["base", "added"])

    found = F.pandas_udf(scan, f"base {SPANS}, added {SPANS}")
    return bounded_batches(docs).withColumn(free_name(docs, "pii"), found(F.col(text)))


def pii_summary(found: DataFrame, key: str = "doc_id", column: str = "pii") -> DataFrame:
    """Counts of the base findings, the digest of their list, and the list of all findings."""
    base, every = F.col(f"{column}.base"), F.concat(f"{column}.base", f"{column}.added")
    order = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        ranked = F.sort_array(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
            s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(
            ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col(key), *[count(k) for k in KINDS],
                        F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(every).alias("spans"))
