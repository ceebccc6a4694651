"""Personal data, found also where it is disguised, with spans in the source text's own code points.

Base identifiers are found in the text as it is. Then transducers rewrite homoglyphs and invisible characters,
disguised "at" and "dot" and spelled digits; each keeps for every character that it writes the source range that
the character stands for. The same detectors run on what they wrote, and a span found there that rests on a rewritten
character is mapped back and added, unless a base span of its kind overlaps it. Base spans always stay.

A null or empty text has no spans. All detectors take linear time, so one very long word or digit run costs no
more than other text. Rows are independent: repeated rows give repeated results, and no row leaves its task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.shared import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search

#: Letters that look like Latin ones (Cyrillic, then Greek), and characters without width.
_LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһӏ", "ABESIJKMHOPCTYXaesijopcyxdhl")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧινορυ", "ABEZHIKMNOPTYXivopu"))
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_OTHER_SIGNS = dict(zip("‐‑‒–—−․。•﹒＠﹫", "------....@@"))
#: Digits as words, by language, zero to nine.
_SPELLED = ("zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve")
_VALUE = {w: str(i) for line in _SPELLED for i, w in enumerate(line.split())} | {"oh": "0"}


def _char_table() -> dict[int, str]:
    wide = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    return {ord(k): v for k, v in (_LOOKALIKE | wide | _OTHER_SIGNS | dict.fromkeys(_INVISIBLE, "")).items()}


_CHARS = _char_table()
_odd_char = re.compile("[" + "".join(map(re.escape, map(chr, _CHARS))) + "]").search
_WORD = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_plus = re.compile(r"(?i)\bplus\s{1,2}(?=[0-9])")
_OPEN, _CLOSE = r"\s{0,3}[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]\s{0,3}"
#: Between groups of spelled digits: a spelled or bracketed dot, or a dash between blanks.
_SPELLED_DOT, _SPACED_DASH = rf"(?:\s{{1,3}}dot\s{{1,3}}|{_OPEN}(?:dot|\.){_CLOSE})", r"\s{1,2}-\s{1,2}"
_JOIN = rf"(?:{_SPELLED_DOT}|{_SPACED_DASH})"
_spelled = re.compile(rf"(?i)\b(?:{_WORD}|[0-9]{{1,4}}(?={_JOIN}))(?:(?:[\s,.-]{{1,2}}(?:{_WORD}|[0-9])\b)|{_JOIN}(?:{_WORD}|[0-9]{{1,4}})\b){{3,}}")
_spelled_part = re.compile(rf"(?i)(?P<digit>{_WORD})|(?P<number>[0-9]+)|(?P<dot>{_SPELLED_DOT})|(?P<dash>{_SPACED_DASH})|[\s,.-]{{1,2}}").finditer
_disguised = re.compile(
    rf"(?i)(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9])\s{{1,3}}at\s{{1,3}}(?=[A-Za-z0-9-]+(?:\s{{1,3}}dot\s{{1,3}}|{_OPEN}dot{_CLOSE})[A-Za-z0-9]))"
    rf"|(?P<dot>{_OPEN}(?:dot|\.){_CLOSE}|(?<=[A-Za-z0-9])\s{{1,3}}dot\s{{1,3}}(?=[A-Za-z0-9]))"
)
#: Words that start no domain and end none where plain words "at" and "dot" were read as signs.
_NO_DOMAIN = frozenset("the this that these those a an each every any one its his her their our your my which what some no another".split())
_NO_LAST_LABEL = frozenset("product products plot plots matrix notation size".split())
_hint = re.compile(r"(?i)[(\[{<]\s{0,3}(?:at|dot|[@.])\s{0,3}[)\]}>]|\sdot\s").search


#: Bytes that start a character which the table may know, and bytes that are no part of a word.
_odd_lead = re.compile(rb"[\xcd-\xff]|\xc2\xad").search
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_RARE = frozenset(w.encode() for w in _VALUE if w != "un")


def _has_digit_words(data: bytes) -> bool:
    """Whether a digit's word occurs. "un" alone doesn't count: it is in every French text, and no number is all ones."""
    return not _RARE.isdisjoint(data.translate(_BLANKED).split())


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN(text, at + 1) if begin < at else None
        if m:
            done = m.end()
            out.append(("email", begin, done))
        at = text.find("@", max(done, at + 1))
    return out


def _ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED(text):
        if m[0].count(".") < 3:
            continue
        parts = m[0].split(".")
        begin = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append(("ip", begin, end))
            begin = end + 1
    return out


def detect(text: str) -> list[Span]:
    """The base spans, in the order of KINDS and then of their starts."""
    out = _emails(text)
    if not _DIGIT(text):
        return out
    out += _ips(text)
    for m in _CARD(text):
        if len(m[0]) >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


class Rewritten:
    """A text with, for each of its characters, the source range it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.begin, self.end, self.changed = text, range(len(text)), range(1, len(text) + 1), None

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges of the text, given in order; all characters put in stand for the whole range taken out."""
        if not edits:
            return
        text, begin, end, changed, at = [], [], [], [], 0
        was = self.changed or bytes(len(self.text))
        for b, e, new in edits:
            text += [self.text[at:b], new]
            begin += [*self.begin[at:b], *[self.begin[b]] * len(new)]
            end += [*self.end[at:b], *[self.end[e - 1]] * len(new)]
            changed += [*was[at:b], *[1] * len(new)]
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.begin, self.end, self.changed = [*begin, *self.begin[at:]], [*end, *self.end[at:]], bytes([*changed, *was[at:]])


def _digits(run: re.Match) -> list[tuple[int, int, str]]:
    """Edits that write a run's spelled digits as digits, its spelled dots and spaced dashes as signs, and take out other separators."""
    parts = list(_spelled_part(run[0]))
    if not any(m["digit"] for m in parts):
        return []
    at = run.start()
    return [(at + m.start(), at + m.end(), _VALUE[m[0].lower()] if m["digit"] else "." if m["dot"] else "-" if m["dash"] else "") for m in parts if not m["number"]]


def rewrite(text: str) -> Rewritten | None:
    """Runs the transducers; None where none of them has anything to do."""
    low = text.lower()
    data = low.encode("utf-8", "replace")
    odd = not text.isascii() and (_odd_lead(data) and _odd_char(text))
    hint = "dot" in low or any(c in low for c in "([{<")
    if not (odd or hint and _hint(text) or "plus" in low and _plus.search(text) or _has_digit_words(data) and _spelled.search(text)):
        return None
    r = Rewritten(text)
    if odd:
        r.apply([(i, i + 1, _CHARS[ord(c)]) for i, c in enumerate(text) if ord(c) in _CHARS])
    r.apply([edit for m in _spelled.finditer(r.text) for edit in _digits(m)])
    r.apply([(*m.span(), "+") for m in _plus.finditer(r.text)])
    r.apply([(*m.span(), "@" if m["at"] else ".") for m in _disguised.finditer(r.text)])
    return r if r.changed else None


def _plausible(email: str, source: str) -> bool:
    """An added email ends in letters; where plain words "at" and "dot" were read as signs, its domain has no words of plain sentences."""
    last = email.rpartition(".")[2]
    bare = re.search(r"(?i)\s(at|dot)\s", source) and not re.search(r"[(\[{<]", source)
    first = email.partition("@")[2].partition(".")[0]
    return len(last) > 1 and last.isalpha() and not (bare and (first.lower() in _NO_DOMAIN or last.lower() in _NO_LAST_LABEL))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that only the rewritten text shows; both in the order of KINDS and starts."""
    base = detect(text)
    r = rewrite(text)
    if r is None:
        return base, []
    added, ends = [], dict.fromkeys(KINDS, 0)
    for kind, b, e in detect(r.text):
        begin, end = r.begin[b], r.end[e - 1]
        if not any(r.changed[b:e]) or kind == "email" and not _plausible(r.text[b:e], text[begin:end]):
            continue
        if begin >= ends[kind] and not any(k == kind and begin < y and x < end for k, x, y in base):
            added.append((kind, begin, end))
            ends[kind] = end
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b >= at:
            out += [text[at:b], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, *, text: str = "text", keep: Sequence[str] | None = None, redacted: bool = True) -> DataFrame:
    """The columns ``keep`` (None: all) in the struct doc, then n_email, n_ip, n_card, n_phone and base_sha256 of the
    base spans, n_added, spans (base and added) and, if asked for, the text with all spans replaced (null for null)."""

    def compute(batch, _):
        texts = batch.column(1).to_pylist()
        found = [find(t or "") for t in texts]
        out = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        out.append(pa.array([len(added) for _, added in found], pa.int64()))
        out.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]))
        out.append(pa.array([joined(base + added) for base, added in found]))
        if redacted:
            out.append(pa.array([t and redact(t, base + added) for t, (base, added) in zip(texts, found)], pa.string()))
        return out

    fields = "".join(f"n_{k} bigint, " for k in KINDS) + "n_added bigint, base_sha256 string, spans string" + ", redacted string" * redacted
    return map_texts(docs, compute, fields, keep=keep, text=text)


def redact_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data replaced in the text; a null text stays null."""
    others = [c for c in docs.columns if c != text]
    found = find_pii(docs, text=text, keep=others or None)
    return found.select(*[F.col("redacted").alias(text) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
