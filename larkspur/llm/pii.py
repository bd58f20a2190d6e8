"""Personal data, also in disguise, with spans in the source text.

Rules find e-mail addresses, IP addresses, card and phone numbers in the text
as it is. A chain of transducers then rewrites disguises: look-alike letters
and digits, invisible characters, spelled digits and *at*/*dot* words. An
*at* or a spaced @ before a domain with plain dots counts where the local part has a letter
and a dot, digit or underscore; *look at example.com* is no address. Each rewriting
records what it replaced, so a span of the rewritten text maps back to the
characters it came from. Rules run again on the rewritten text, and spans that
overlap none of the same kind from the plain text are added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .spans import SPAN_ARROW, SPAN_DDL

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that can't begin an address can't hold the beginning of one either, so it is passed at once
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ outwards so that words without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Rule matches as (kind, start, end), by kind and then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if m[1] and all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Rewritten:
    """A text with replacements applied, and the way back to source positions."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement), by start, not overlapping."""
        self.edited = bool(edits)
        self.at, self.source, parts = [], [], []  # pieces: position here; (source start, source end, kept as it is)
        here = done = 0
        for a, b, new in [*edits, (len(text), len(text), "")]:
            for piece, x, y, kept in ((text[done:a], done, a, True), (new, a, b, False)):
                if piece:
                    self.at.append(here)
                    self.source.append((x, y, kept))
                    parts.append(piece)
                    here += len(piece)
            done = b
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source bounds of what became ``text[start:end]``."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (x, _, kept_x), (y, z, kept_y) = self.source[i], self.source[j]
        return x + (start - self.at[i]) * kept_x, y + (end - self.at[j]) if kept_y else z


# Letters of other scripts that look like Latin ones, and invisible characters.
LOOK_ALIKE = dict(zip("авекмнорстухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαορντικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxijshdqwABEKMHOPCTYXIJSaopvtikABEZHIKMNOPTYX", strict=True))
INVISIBLE = frozenset("­​‌‍⁠﻿")
# Digits spelled in English, French, German and Spanish, from zero to nine.
SPELLED = [
    "zero one two three four five six seven eight nine".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
]
DIGIT_OF = {w: str(i) for words in SPELLED for i, w in enumerate(words)}
#: Spelled digits in a row from which a run is read as a number.
LEAST_SPELLED = 3


class _Plain(dict):
    """For ``str.translate``: the plain form of a character with one, else the character."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if code > 127:
            folded = unicodedata.normalize("NFKC", ch)
            ch = folded if len(folded) == 1 and folded.isascii() and (folded.isalnum() or folded in "@.+-_%()[]{}") else LOOK_ALIKE.get(ch, ch)
        self[code] = ch
        return ch


_PLAIN = _Plain()
_WORD = "|".join(sorted(DIGIT_OF, key=lambda w: (-len(w), w)))
_RUN = re.compile(rf"(?i)(?:\bplus\b[\s,-]*|\+)?(?<![^\W\d_])(?:{_WORD}|dot|point|[0-9]+)(?![^\W\d_])(?:[\s,.()-]{{0,3}}(?<![^\W\d_])(?:{_WORD}|dot|point|[0-9]+)(?![^\W\d_]))+")
_RUN_PART = re.compile(rf"(?i)(plus)\b|(?<![^\W\d_])({_WORD})(?![^\W\d_])|\b(dot|point)\b|([0-9]+)|([\s,.()+-]+)")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*+(at|@|dot|\.)\s*+[\])}>]")
_SAID = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])(\s+at\s+|\s*@\s*)(?=[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*?\s+dot\s+[A-Za-z0-9-])")
_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9-])\s+dot\s+(?=[A-Za-z0-9-])")
# an at or a spaced @ before a domain with plain dots, its ending in one case so that two sentences aren't one name
_AT_NAME = re.compile(r"(?:@|(?<=\s)[Aa][Tt](?=\s))\s*+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*?\.(?:[a-z]{2,}|[A-Z]{2,})(?![A-Za-z0-9-]))")
# what tells an address from a word before a website: a letter, and a dot, digit or underscore in it
_ADDRESS_LIKE = re.compile(r"(?=.*[A-Za-z]).*[._0-9].*")
_TO_SPACE = str.maketrans({c: " " for c in "-,.+()"})


def _plain(text: str) -> Rewritten:
    """Look-alikes to plain characters, one for one, and invisible characters away."""
    if text.isascii():
        return Rewritten(text, [])
    hidden = [(i, i + 1, "") for i, c in enumerate(text) if c in INVISIBLE] if not INVISIBLE.isdisjoint(text) else []
    return Rewritten(text.translate(_PLAIN), hidden)


def _spelled(run: re.Match) -> tuple[int, int, str] | None:
    """A run of digits, some of them spelled, as digits."""
    parts = [(m.lastindex, m[0]) for m in _RUN_PART.finditer(run[0])]
    if sum(kind == 2 for kind, _ in parts) < LEAST_SPELLED:
        return None
    out = []
    for i, (kind, part) in enumerate(parts):
        if kind == 5:
            near = {parts[i - 1][0] if i else 0, parts[i + 1][0] if i + 1 < len(parts) else 0}
            out.append(part.strip(" ,") if near & {1, 2, 3} else part)
        else:
            out.append({1: "+", 2: DIGIT_OF.get(part.lower(), ""), 3: "."}.get(kind, part))
    return run.start(), run.end(), "".join(out)


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    """Bracketed signs with the blanks around them; a run of blanks is passed at most twice."""
    done = 0
    for m in _BRACKETED.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        done = end
        yield start, end, "@" if m[1].lower() in ("at", "@") else "."


def _before_names(text: str) -> Iterator[tuple[int, int, str]]:
    """An at or a spaced @ between what looks like an address and a plain domain."""
    for m in _AT_NAME.finditer(text):
        start = m.start()
        while start and text[start - 1].isspace():
            start -= 1
        local = start
        while local and text[local - 1] in _LOCAL:
            local -= 1
        if (start < m.start() or m.end() > m.start() + 1) and _ADDRESS_LIKE.fullmatch(text[local:start].strip(".")):
            yield start, m.end(), "@"


def _unbracketed(text: str) -> Rewritten:
    """Bracketed signs rewritten."""
    return Rewritten(text, list(_bracketed(text)))


def _undisguised(text: str) -> Rewritten:
    """Spelled digits and at/dot words rewritten."""
    low, edits = text.lower(), []
    if not DIGIT_OF.keys().isdisjoint(low.translate(_TO_SPACE).split()):
        edits += [e for m in _RUN.finditer(text) if (e := _spelled(m))]
    edits += _before_names(text)
    if "dot" in low:
        said = [(m.start(), m.end(), "@") for m in _SAID.finditer(text)]
        edits += said
        if said or any(e[2] == "@" for e in edits) or "@" in text:
            edits += [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]
    taken, end = [], 0
    for e in sorted(edits):
        if e[0] >= end:
            taken.append(e)
            end = e[1]
    return Rewritten(text, taken)


def find(text: str) -> list[tuple[str, int, int, str, bool]]:
    """All personal data of a text: (kind, start, end, source characters, whether plain)."""
    base = base_spans(text)
    out = [(k, a, b, text[a:b], True) for k, a, b in base]
    chain = [_plain(text)]
    for step in (_unbracketed, _undisguised):
        chain.append(step(chain[-1].text))
    if chain[-1].text != text:
        # plain spans of a kind lie one after the other, so only the last that begins before an end can overlap
        plain = {kind: [(x, y) for k, x, y in base if k == kind] for kind in KINDS}
        for kind, a, b in base_spans(chain[-1].text):
            for step in reversed(chain):
                a, b = step.back(a, b)
            at = bisect_left(plain[kind], (b,)) - 1
            if at < 0 or plain[kind][at][1] <= a:
                out.append((kind, a, b, text[a:b], False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``found`` (spans in code points of the source, end exclusive) of each row.

    Null and empty texts have no spans; repeated rows and null ids stay as they
    are; texts of any length are read as a whole, in time proportional to it; an
    empty table gives an empty table; other columns are dropped.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "value", "base"), s, strict=True)) for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, SPAN_ARROW)], [id_col, "found"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, f"`{id_col}` {id_type}, found {SPAN_DDL}")
