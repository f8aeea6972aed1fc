"""Personal data in text, with disguises undone: every span is given in source code points.

Base patterns run on the raw text. Then three transducers rewrite the text piece by piece, each piece
keeping the source range that it came from: homoglyphs to ASCII, spelled digits to digits, and
at/dot/plus disguises to their signs. Detectors run on the rewritten text, and their spans are mapped back. A
span from the rewritten text is added only where no base span of its kind overlaps it.

Edge cases: a null text is empty and has no spans; repeated rows give repeated results; an empty
table gives no rows; extra columns are ignored. Texts of any length are scanned whole, and no pattern can start at
each of a run of spaces or digits, so time grows with the length of the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits can match only where the run's own start does, so only those are tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base pattern, found from each at-sign outwards."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _homoglyphs() -> dict[int, str]:
    table = {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {0x3000: " ", 0xFE6B: "@", 0xFE52: ".", 0x3002: ".", 0xFF61: ".", 0x2024: ".", 0x00A0: " ", 0x2007: " ", 0x202F: " "}
    # fixed values: dashes that stand for a hyphen
    table |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212, 0xFE63)}
    # fixed values: Cyrillic and Greek letters that look like Latin ones, in the order of the Latin ones below
    table |= dict(zip(map(ord, "аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ"), "aeopcyxijsdhqwABEKMHOPCTXIJS", strict=True))
    table |= dict(zip(map(ord, "οαινρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"), "oaivpABEZHIKMNOPTYX", strict=True))
    # decimal digits of other scripts and styles
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {zero + i: str(i) for i in range(10)}
    return table


HOMOGLYPHS = _homoglyphs()
ODD = re.compile("[" + "".join(map(re.escape, map(chr, HOMOGLYPHS))) + "]")
#: Characters that show nothing; they are taken out.
HIDDEN = re.compile("[​‌‍⁠﻿­]")

#: fixed values: the English digit words
DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
WORD = "|".join(DIGITS)
#: Two or more digit words (or digits among them) in a row, apart by spaces or hyphens; "oh" never stands first.
SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ -]+)?(?!oh\b)(?:{WORD})(?:[ -]+(?:(?:{WORD})\b|[0-9]+(?![^\W_])))+(?![^\W_])", re.I)
SPELLED_WORD = re.compile(rf"\b(plus|{WORD})\b|([0-9]+)|[ -]+", re.I)
OPEN, CLOSE = r"[(\[{<]", r"[)\]}>]"
#: Spaces around the brackets are taken in afterwards: a pattern that starts with spaces would be tried at each of them.
BRACKETED = re.compile(rf"{OPEN}[ ]*(?:(at|@)|(dot|punkt|punto|point|\.))[ ]*{CLOSE}", re.I)
LABEL = r"[A-Za-z0-9-]+"
#: "name at host dot tld", bare words: only as a whole; "name@host dot tld" with one at-sign; numbers "1 dot 2 dot 3 dot 4".
BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9_%+-]*(?:(?:\.|[ ]+dot[ ]+)[A-Za-z0-9_%+-]+){{0,3}}(?:[ ]+at[ ]+|[ ]?@[ ]?){LABEL}(?:[ ]+dot[ ]+{LABEL})+", re.I)
NUMBERS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:[ ]+dot[ ]+|[ ]\.[ ])[0-9]{1,3}){3}(?![0-9])", re.I)
BARE_SIGN = re.compile(r"[ ]+(at)[ ]+|[ ]+(dot)[ ]+|[ ]?(@)[ ]?|[ ](\.)[ ]", re.I)
#: What any of the transducers needs: the first part is the start that every SPELLED match has.
TRIGGER = re.compile(rf"(?<![^\W_])(?:{WORD})[ -]+(?:(?:{WORD})\b|[0-9])|\bdot\b|{OPEN}[ ]*(?:at|@|dot|punkt|punto|point|\.)[ ]*{CLOSE}|[ ]\.[ ][0-9]", re.I)


class Rewrite:
    """A text with, for each character, the source range that it stands for."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges by strings; each new character stands for the whole source range."""
        if not edits:
            return
        text, first, last, at = [], [], [], 0
        for lo, hi, new in edits:
            text += [self.text[at:lo], new]
            first += self.first[at:lo] + [self.first[lo]] * len(new)
            last += self.last[at:lo] + [self.last[hi - 1]] * len(new)
            at = hi
        self.text = "".join([*text, self.text[at:]])
        self.first, self.last = first + self.first[at:], last + self.last[at:]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in SPELLED.finditer(text):
        for w in SPELLED_WORD.finditer(m[0]):
            new = "+" if w[1] and w[1].casefold() == "plus" else DIGITS[w[1].casefold()] if w[1] else w[2] if w[2] else ""
            if new != w[0]:
                edits.append((m.start() + w.start(), m.start() + w.end(), new))
    return edits


def signs(text: str) -> list[tuple[int, int, str]]:
    edits, floor = [], 0
    for m in BRACKETED.finditer(text):
        lo, hi = m.span()
        while lo > floor and text[lo - 1] == " ":
            lo -= 1
        while hi < len(text) and text[hi] == " ":
            hi += 1
        edits.append((lo, hi, "@" if m[1] else "."))
        floor = hi
    return [e for e in edits if e[0] > 0 and e[1] < len(text)]


def bare_signs(text: str) -> list[tuple[int, int, str]]:
    spans = sorted([*((m.start(), m.end()) for m in BARE.finditer(text)), *((m.start(), m.end()) for m in NUMBERS.finditer(text))])
    edits, floor = [], 0
    for lo, hi in spans:
        if lo >= floor:
            edits += [(lo + m.start(), lo + m.end(), "@" if m[1] or m[3] else ".") for m in BARE_SIGN.finditer(text[lo:hi])]
            floor = hi
    return edits


def hidden_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source code points."""
    odd = not text.isascii() and (ODD.search(text) is not None or HIDDEN.search(text) is not None)
    if not odd and not TRIGGER.search(text):
        return []
    r = Rewrite(text.translate(HOMOGLYPHS) if odd else text)
    if odd:
        r.replace([(m.start(), m.end(), "") for m in HIDDEN.finditer(r.text)])
    for step in (spelled_digits, signs, bare_signs):
        r.replace(step(r.text))
    return [(kind, r.first[lo], r.last[hi - 1]) for kind, lo, hi in find(r.text)]


def detect(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base = find(text)
    more = []
    for kind, lo, hi in hidden_spans(text):
        if not any(k == kind and a < hi and lo < b for k, a, b in base):
            more.append((kind, lo, hi))
    if not more:
        return base, base
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_hidden long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, all spans, how many they are and how many of them were disguised."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = detect(text or "")
                rows.append((doc, *(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 9, kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), SPANS)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by ``[KIND]``."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if not text:
                return text
            out, floor = [], 0
            for kind, lo, hi in sorted(detect(text)[1], key=lambda s: (s[1], -s[2])):
                if lo >= floor:
                    out += [text[floor:lo], f"[{kind.upper()}]"]
                    floor = hi
            return "".join([*out, text[floor:]])

        return texts.map(one)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
