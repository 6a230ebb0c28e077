"""Personal data in whole texts, also behind homoglyphs, spelled digits and at/dot disguises.

Plain identifiers are found in the text itself.  Transducers then rewrite the text step by step, each output character
keeping the range of source characters it came from; identifiers found in the rewritten text map back to the source,
and those that lie in no found span of their kind are added.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, rank of the kind, end

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones, and spelled digits.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "٠": "0", "۰": "0",
}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
ARTICLES = frozenset(["a", "an", "the", "this", "that", "my", "your", "our", "their", "his", "her", "its"])  # no host is called so
INVISIBLE = frozenset("­​‌‍⁠﻿")

_ODD = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ſ]")
_WORD_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w))) + ")"
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD_DIGIT}|[0-9]+|plus|\+)(?:[\x20.,-]{{1,3}}(?:{_WORD_DIGIT}|[0-9]+|dot|point|dash))+(?![^\W_])", re.IGNORECASE)
_SPELLED_ITEM = re.compile(rf"{_WORD_DIGIT}|plus|dot|point|dash|[0-9]+|\+", re.IGNORECASE)
_BRACKETED = re.compile(r"\x20?[(\[{<]\x20?(at|dot|@|\.)\x20?[)\]}>]\x20?", re.IGNORECASE)
_WORDED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:\x20(?:dot|DOT)\x20[A-Za-z0-9_%+-]+|\.[A-Za-z0-9_%+-]+){0,4}(?:\x20(?:at|AT)\x20)[A-Za-z0-9-]+(?:\x20?\.\x20?[A-Za-z0-9-]+){0,4}(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]+)+(?![A-Za-z0-9-])")
_WORDED_ITEM = re.compile(r"\x20(at|dot)\x20", re.IGNORECASE)
_HINT = re.compile(rf"[(\[{{<]\x20?(?:at|dot|@|\.)\x20?[)\]}}>]|\x20dot\x20|(?<![^\W_]){_WORD_DIGIT}[\x20.,-]{{1,3}}(?:{_WORD_DIGIT}|[0-9])|[0-9][\x20.,-]{{1,3}}{_WORD_DIGIT}(?![^\W_])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each sign outwards: the part before it starts where its run starts, or behind the previous match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def identifiers(text: str) -> list[Span]:
    """Plain identifiers, leftmost and without overlap within a kind, in order of start and kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


class Traced:
    """A text whose characters know their source ranges."""

    def __init__(self, text: str, begins: list[int] | range, ends: list[int] | range):
        self.text, self.begins, self.ends = text, begins, ends

    @classmethod
    def of(cls, text: str, base: int = 0) -> Traced:
        return cls(text, range(base, base + len(text)), range(base + 1, base + len(text) + 1))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Traced:
        """With each (start, end, new text) put in; new characters share the replaced range."""
        if not edits:
            return self
        out, begins, ends, at = [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            out.append(self.text[at:start])
            begins.extend(self.begins[at:start])
            ends.extend(self.ends[at:start])
            if new:
                out.append(new)
                begins.extend([self.begins[start]] * len(new))
                ends.extend([self.ends[end - 1]] * len(new))
            at = end
        return Traced("".join(out), begins, ends)


def unmask_letters(t: Traced) -> Traced:
    """Homoglyphs, full-width forms and other digits to ASCII; invisible characters go."""
    edits = []
    for m in _ODD.finditer(t.text):
        c = m.group()
        if c in INVISIBLE:
            new = ""
        else:
            new = LOOKALIKES.get(c)
            if new is None:
                folded = unicodedata.normalize("NFKC", c)
                value = unicodedata.digit(c, None)
                new = str(value) if value is not None else folded if folded.isascii() and len(folded) == 1 else None
            if new is None:
                continue
        edits.append((m.start(), m.end(), new))
    return t.rewritten(edits)


def unmask_signs(t: Traced) -> Traced:
    """Bracketed at and dot, and worded ones in the shape of an address, to their signs."""
    sign = {"at": "@", "@": "@", "dot": ".", ".": "."}
    t = t.rewritten([(m.start(), m.end(), sign[m.group(1).lower()]) for m in _BRACKETED.finditer(t.text)])
    edits = []
    for m in _WORDED.finditer(t.text):
        if re.split(r"\x20at\x20", m.group(), maxsplit=1, flags=re.IGNORECASE)[1].split(" ")[0].lower() in ARTICLES:
            continue
        edits.extend((m.start() + k.start(), m.start() + k.end(), sign[k.group(1).lower()]) for k in _WORDED_ITEM.finditer(m.group()))
    return t.rewritten(edits)


def unmask_digits(t: Traced) -> Traced:
    """Runs with at least four spelled digits or three spelled dots to digits without the gaps between them."""
    spoken = {"plus": "+", "dot": ".", "point": ".", "dash": "-"}
    edits = []
    for m in _SPELLED.finditer(t.text):
        items = [(k.start(), k.end(), k.group().lower()) for k in _SPELLED_ITEM.finditer(t.text, m.start(), m.end())]
        if sum(w in DIGIT_WORDS for _, _, w in items) < 4 and sum(w in ("dot", "point") for _, _, w in items) < 3:
            continue
        at = m.start()
        for start, end, word in items:
            if start > at:
                edits.append((at, start, ""))
            new = DIGIT_WORDS.get(word) or spoken.get(word)
            if new:
                edits.append((start, end, new))
            at = end
    return t.rewritten(edits)


WINDOW = 400


def _between_words(text: str, at: int, step: int) -> int:
    """The nearest place from ``at`` in the direction of ``step`` behind a letter and before white space, or the end."""
    while 0 < at < len(text) and not (text[at].isspace() and text[at - 1].isalpha()):
        at += step
    return at


def hidden_windows(text: str) -> list[tuple[int, int]]:
    """Stretches around every sign of a disguise, cut between words and merged; elsewhere rewriting changes nothing."""
    spots = [m.start() for m in _HINT.finditer(text)]
    if not text.isascii():
        spots += [m.start() for m in _ODD.finditer(text) if m.group() in LOOKALIKES or m.group() in INVISIBLE or unicodedata.normalize("NFKC", m.group()).isascii() or unicodedata.digit(m.group(), None) is not None]
    out: list[tuple[int, int]] = []
    for spot in sorted(spots):
        if out and spot + WINDOW <= out[-1][1]:
            continue
        lo, hi = _between_words(text, max(0, spot - WINDOW), -1), _between_words(text, min(len(text), spot + WINDOW), 1)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: the plain ones and the unmasked ones that lie in none of their kind."""
    text = text or ""
    base = identifiers(text)
    every = list(base)
    for lo, hi in hidden_windows(text):
        traced = unmask_digits(unmask_signs(unmask_letters(Traced.of(text[lo:hi], lo))))
        if traced.text == text[lo:hi]:
            continue
        for a, rank, b in identifiers(traced.text):
            start, end = traced.begins[a], traced.ends[b - 1]
            if not any(k == rank and s <= start and end <= e for s, k, e in every):
                every.append((start, rank, end))
    return base, sorted(every)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[rank]}:{a}:{b}" for a, rank, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text, in code points.

    A null or empty text has none.  Repeated rows each get their row.
    """
    from hashlib import sha256

    def one(text):
        base, every = spans_of(text)
        counts = [sum(1 for s in base if s[1] == k) for k in range(len(KINDS))]
        return (*counts, sha256(joined(base).encode()).hexdigest(), joined(every))

    return map_texts(docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", lambda: lambda texts: map(one, texts))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``; each stretch covered by spans is replaced by its kind in capitals, in brackets."""
    def one(text):
        if not text:
            return (text,)
        out, at = [], 0
        for a, rank, b in spans_of(text)[1]:
            if a >= at:
                out += [text[at:a], f"[{KINDS[rank].upper()}]"]
            at = max(at, b)
        return ("".join([*out, text[at:]]),)

    found = map_texts(docs, "clean string", lambda: lambda texts: map(one, texts), whole=True)
    return found.select(*[F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
