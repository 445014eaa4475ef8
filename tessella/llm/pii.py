"""Personal data with offset-preserving deobfuscation.

Base: e-mail addresses, IPv4 addresses, payment card numbers and phone numbers as written, by the patterns below.
Method: transducers rewrite a text to a plain form and keep, for every character of that form, the span of the source that
it stands for. Look-alike characters become ASCII, invisible ones go, `[at]` and `(dot)` become @ and ., spoken `name at
host dot tld` becomes an address, and runs of spelled digits become digits. The same detectors run on the plain form; what
they find is mapped back to source characters. A found span is added if a transducer changed something within it and no base
span of its kind overlaps it; base spans always stay.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Detectors and transducers have no bounds on the
length of a name, host, number or space between, and are linear in the text. Each row is judged by its own text: rows that
repeat have the same spans, and other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import utf8

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """A match holds one @: what stands before it reaches back to the last match, or the first character that can't."""
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end and (host := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                end = host.end()
                yield "email", start, end
        at = text.find("@", at + 1)


def detect(text: str) -> list[Span]:
    """All spans as written, by kind and then start."""
    found = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ι": "i", "ϲ": "c", "Ο": "O", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "∙": ".", "․": ".", "。": ".", "·": ".", "•": ".",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

# Spelled digits, English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits in a row that count as a number.
LEAST_RUN = 4


def _single_ascii() -> dict[int, str]:
    """Characters that compatibility forms or digit values turn into one ASCII character, by rule; accented letters stay."""
    found = {}
    for code in (*range(0x660, 0x2000), *range(0x2100, 0x2500), *range(0xFE50, 0xFE70), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        char = chr(code)
        plain = str(unicodedata.decimal(char)) if unicodedata.category(char) == "Nd" else unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and plain.isascii() and plain != char:
            found[code] = plain
    return found


_MAP = _single_ascii() | {ord(k): v for k, v in LOOK_ALIKES.items()}
# apart: a set of characters is looked up at once only if none is beyond the first plane
_ODD = re.compile("[" + "".join(re.escape(chr(k)) for k in sorted(_MAP) if k < 0x10000) + INVISIBLE + "]")
_ODD_BEYOND = re.compile(f"[{chr(0x10000)}-{chr(0x10FFFF)}]")
_AT, _DOT = r"at|arroba|aroba|ät", r"dot|punkt|punto|point"
# A run of white space is entered at its first character only, and runs are taken whole: no bound, and linear.
_EDGE = r"(?:(?<!\s)\s++)?+"
_BRACKETED = re.compile(rf"{_EDGE}(?:\[\s*+(?:({_AT})|({_DOT}))\s*+\]|\(\s*+(?:({_AT})|({_DOT}))\s*+\)|\{{\s*+(?:({_AT})|({_DOT}))\s*+\}}|<\s*+(?:({_AT})|({_DOT}))\s*+>)\s*+", re.I)
_BRACKET = re.compile(r"[\[({<]\s*+[aädp]", re.I)
# no address: `at` before a number, time or price, which is a host of literal dots whose last label starts with a digit
_NUMBER = rf"(?:[A-Za-z0-9-]++\.)+[0-9][A-Za-z0-9-]*+(?!\.[A-Za-z0-9-]|\s++(?:{_DOT})\s)"
_SPOKEN = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]++(\s++(?:{_AT})\s++(?!{_NUMBER})|@)[A-Za-z0-9-]++(?:(?:\s++(?:{_DOT})\s++|\.)[A-Za-z0-9-]++)++", re.I)
#: What any match of _SPOKEN has from its @ on, and what a match needs for an edit.
_SPOKEN_HOST = re.compile(rf"(?:\s(?:{_AT})\s++|@)[A-Za-z0-9-]++(?:\s++(?:{_DOT})\s++|\.)[A-Za-z0-9-]", re.I)
_SPOKEN_PART = re.compile(rf"\s++(?:({_AT})|({_DOT}))\s++", re.I)
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = rf"(?:[\s,]*+\b(?:{_DOT})\b[\s,]*+|[\s,.-]++)"
_SPELLED = re.compile(rf"(?:\bplus[\s,]++)?\b(?:{_WORD})\b(?:{_GAP}(?:{_WORD})\b){{{LEAST_RUN - 1},}}", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_DOTS = frozenset(_DOT.split("|"))
_SPELLED_WORDS = _DOTS | frozenset(DIGIT_WORDS)
_LOWER = {"\u017f": "s", "\u0130": "i", "\u0131": "i"}
_SPELLED_PART = re.compile(rf"(plus)|\b({_WORD})\b|\b({_DOT})\b|.", re.I | re.S)


def _lower(text: str) -> str:
    """Lower case as patterns that ignore case see it: they also take long s and the two Turkish i."""
    if not text.isascii():
        for odd, plain in _LOWER.items():
            text = text.replace(odd, plain)
    return text.lower()


# Cheap tests, each of the text that its transducer would get; none may refuse a text that the transducer would edit.
def _may_bracket(text: str) -> bool:
    return _BRACKET.search(text) is not None


def _may_spell(text: str) -> bool:
    """Whether enough words in a row could be part of a spelled number; much cheaper than the pattern."""
    return bytes([1] * LEAST_RUN) in bytes(map(_SPELLED_WORDS.__contains__, _WORDS.findall(_lower(text))))


def _may_speak(text: str) -> bool:
    """Whether what follows a name in a spoken address is there."""
    return _SPOKEN_HOST.search(text) is not None


def _back(text: str, at: int, least: int, wanted: Callable[[str], bool]) -> int:
    """Where the run of wanted characters that ends before `at` begins."""
    while at > least and wanted(text[at - 1]):
        at -= 1
    return at


def _spoken(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of spoken addresses. Spoken dots of a name are sought backwards, no further than the address before."""
    least = 0
    for m in _SPOKEN.finditer(text):
        dots, start = [], m.start()
        while True:
            end = _back(text, start, least, str.isspace)
            dot = _back(text, end, least, str.isalpha)
            last = _back(text, dot, least, str.isspace)
            first = _back(text, last, least, _LOCAL_CHARS.__contains__)
            if text[dot:end].lower() not in _DOTS or end == start or last == dot or first == last:
                break
            dots.append((last, start, "."))
            start = first
        yield from reversed(dots)
        for p in _SPOKEN_PART.finditer(m[0]):
            yield m.start() + p.start(), m.start() + p.end(), "@" if p[1] else "."
        least = m.end()


class Plain:
    """A rewritten text; character k stands for source[starts[k]:ends[k]], and changed[k] says that it isn't as written."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | range = range(len(text))
        self.ends: list[int] | range = range(1, len(text) + 1)
        self.changed = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, replacement of at most one character), in order and apart."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            changed += self.changed[at:a]
            if new:
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
                changed.append(1)
            elif changed:
                changed[-1] = 1
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.changed = starts + list(self.starts[at:]), ends + list(self.ends[at:]), changed + self.changed[at:]


def deobfuscated(text: str) -> Plain | None:
    """The plain form; None if no transducer changes anything."""
    plain = Plain(text)
    if not text.isascii() and (_ODD.search(text) or _ODD_BEYOND.search(text)):
        plain.rewrite([(k, k + 1, "" if c in INVISIBLE else _MAP[ord(c)]) for k, c in enumerate(text) if c in INVISIBLE or ord(c) in _MAP])
    if _may_bracket(plain.text):
        plain.rewrite([(m.start(), m.end(), "@" if any(m.groups()[::2]) else ".") for m in _BRACKETED.finditer(plain.text)])
    if _may_spell(plain.text):
        edits = []
        for m in _SPELLED.finditer(plain.text):
            for p in _SPELLED_PART.finditer(m[0]):
                new = "+" if p[1] else DIGIT_WORDS[_lower(p[2])] if p[2] else "." if p[3] else ""
                edits.append((m.start() + p.start(), m.start() + p.end(), new))
        plain.rewrite(edits)
    if _may_speak(plain.text):
        plain.rewrite(list(_spoken(plain.text)))
    return plain if any(plain.changed) else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans)."""
    base = detect(text)
    plain = deobfuscated(text)
    if plain is None:
        return base, []
    added = []
    for kind, a, b in detect(plain.text):
        if not any(plain.changed[a:b]) or kind == "email" and a and plain.text[a - 1].isalnum():
            continue
        start, end = plain.starts[a], plain.ends[b - 1]
        if all(k != kind or end <= s or e <= start for k, s, e in base):
            added.append((kind, start, end))
    return base, added


def written(spans: list[Span]) -> str:
    """kind:start:end, by kind and then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def redacted(text: str) -> str:
    """Every span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    base, added = find(text)
    for kind, a, b in sorted([*base, *added], key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for raw in batch:
            base, added = find(raw.decode("utf-8", "replace"))
            kinds = [x[0] for x in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written([*base, *added]), len(added)))
        yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def spans(text: Column) -> Column:
    """Struct of the numbers of base spans by kind, the digest of base spans, all spans, and the number of added ones, of a column of bytes."""
    kind = "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base_sha256: string, spans: string, n_added: bigint>"
    return F.pandas_udf(_spans, kind)(text)


def _redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([redacted(raw.decode("utf-8", "replace")) for raw in batch], dtype=object)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data in a text column replaced; null stays null."""
    clean = F.pandas_udf(_redact, "string")(utf8(text))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), clean))
