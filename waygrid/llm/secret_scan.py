"""Secrets, found with a trigram inverted index.

1. Each rule's regular expression is compiled into a Boolean query over trigrams: what a text must hold for the
   expression to match at all. The compiler follows the parsed expression and knows of each part the strings that it
   can be, or else the strings that it begins and ends with, as long as they are few.
2. Texts are indexed in runs of some 512 KB, inside the task that reads them: for each trigram that some rule asks
   for, the sorted numbers of the run's texts that hold it. Other trigrams are not posted, so an index has at most
   (trigrams of the rules) x (texts of the run) entries.
3. A rule's query intersects and unites these lists; the rule's expression is run over the whole of each text that
   is left. A rule without any mandatory trigram (a run of hex digits) goes over every text.

Postings and queries fold A-Z to a-z, so they can only let through too much, never too little; the expression decides.
Bytes are those of UTF-8, and a rule's letters other than ASCII are matched in their own case.

Spans are ``kind:start:end`` in code points, leftmost and non-overlapping within a kind. The base kinds are assign,
access and hex; the other kinds are added. Spans of different kinds may overlap. A null or empty text has no spans.
Rows are independent: repeated rows give repeated results, an empty table an empty one, and no row leaves its task.
Expressions try each place once, so one very long word costs no more than other text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as ops
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.shared import map_texts

#: A query over trigrams: True (any text), a trigram's bytes, ("and", queries) or ("or", queries).
Query = bool | bytes | tuple
Span = tuple[str, int, int]
#: Strings that a part of an expression is followed by, and characters of a class that are followed one by one.
MOST_STRINGS, MOST_CLASS, MOST_TURNS = 32, 8, 4


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and how long it must be at least; shorter matches are dropped.
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


#: The base kinds, in the order that ties are listed in.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}+"),  # a run of [0-9a-f]+ with 32 characters or more
)
#: Published formats of keys. A look-behind gives each run of characters one try.
ADDED = (
    Rule("github", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{60,255})"),
    Rule("gitlab", r"(?<![A-Za-z0-9_-])glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
    Rule("npm", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----(?:\r?\n[A-Za-z0-9+/=]*+)*+(?:-----END [A-Z ]{3,40}-----)?"),
    Rule("basic_auth", r"(?i:https?|ftp|amqps?|postgres(?:ql)?|mysql|mongodb|redis)://[A-Za-z0-9._~%-]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9]"),
)


def fold(data: bytes) -> bytes:
    """A-Z as a-z; other bytes as they are (bytes.lower does just that)."""
    return data.lower()


# --- from expressions to queries ---


def both(*queries: Query) -> Query:
    """All of the queries hold."""
    parts = {part for q in queries if q is not True for part in (q[1] if q[0] == "and" else (q,))}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", tuple(sorted(parts, key=repr)))


def either(*queries: Query) -> Query:
    """One of the queries holds."""
    if any(q is True for q in queries):
        return True
    asks = {q: set(q[1] if q[0] == "and" else (q,)) for q in queries}
    parts = [q for q in asks if not any(asks[other] < asks[q] for other in asks)]  # one that asks for more adds nothing
    return parts[0] if len(parts) == 1 else ("or", tuple(sorted(parts, key=repr)))


def of_strings(strings: set[bytes]) -> Query:
    """One of the strings occurs; a string of less than three bytes asks for nothing."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)) if strings else True


@dataclass
class Part:
    """What is known of a part of an expression: all strings that it can be (None: not known), what each of its matches
    begins and ends with, and a query that holds wherever it matches."""

    exact: set[bytes] | None
    begins: set[bytes]
    ends: set[bytes]
    query: Query = True

    @classmethod
    def strings(cls, strings: set[bytes]) -> Part:
        return cls(strings, strings, strings)

    @classmethod
    def anything(cls) -> Part:
        return cls(None, {b""}, {b""})

    def needs(self) -> Query:
        own = (self.exact,) if self.exact is not None else (self.begins, self.ends)
        return both(self.query, *map(of_strings, own))


def _joined(left: set[bytes], right: set[bytes]) -> set[bytes] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MOST_STRINGS else None


def _in_turn(a: Part, b: Part) -> Part:
    """a, then b."""
    if a.exact is not None and b.exact is not None and (exact := _joined(a.exact, b.exact)) is not None:
        return Part(exact, exact, exact, both(a.query, b.query))
    # Each of a's ends meets each of b's beginnings; two bytes of either are enough for the trigrams across.
    across = _joined({s[-2:] for s in (a.exact or a.ends)}, {s[:2] for s in (b.exact or b.begins)})
    query = both(a.needs(), b.needs(), of_strings(across) if across is not None else True)
    begins = (_joined(a.exact, b.begins) if a.exact is not None else None) or a.begins
    ends = (_joined(a.ends, b.exact) if b.exact is not None else None) or b.ends
    return Part(None, begins, ends, query)


def _one_of(parts: Sequence[Part]) -> Part:
    exact = set().union(*(p.exact for p in parts)) if all(p.exact is not None for p in parts) else None
    if exact is not None and len(exact) <= MOST_STRINGS:
        return Part(exact, exact, exact, either(*(p.query for p in parts)))
    begins, ends = ({s for p in parts for s in getattr(p, side)} for side in ("begins", "ends"))
    return Part(None, begins if len(begins) <= MOST_STRINGS else {b""}, ends if len(ends) <= MOST_STRINGS else {b""}, either(*(p.needs() for p in parts)))


def _class(items: Sequence[tuple]) -> Part:
    """One character of a class, followed one by one where they are few."""
    codes: set[int] = set()
    for kind, value in items:
        if kind is ops.LITERAL:
            codes.add(value)
        elif kind is ops.RANGE and value[1] - value[0] < MOST_CLASS:
            codes.update(range(value[0], value[1] + 1))
        else:
            return Part.anything()
    return Part.strings({fold(chr(c).encode("utf-8", "replace")) for c in codes}) if 0 < len(codes) <= MOST_CLASS else Part.anything()


def _sequence(items: Sequence[tuple]) -> Part:
    out = Part.strings({b""})
    for kind, value in items:
        out = _in_turn(out, _part(kind, value))
    return out


def _part(kind, value) -> Part:
    """What is known of one node of a parsed expression; of an unknown kind of node, nothing."""
    if kind is ops.LITERAL:
        return Part.strings({fold(chr(value).encode("utf-8", "replace"))})
    if kind is ops.IN:
        return _class(value)
    if kind is ops.BRANCH:
        return _one_of([_sequence(x) for x in value[1]])
    if kind is ops.SUBPATTERN:
        return _sequence(value[3])
    if kind is ops.ATOMIC_GROUP:
        return _sequence(value)
    if kind in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        return Part.strings({b""})  # takes no characters; what it looks at is not asked for
    if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        part = _sequence(inner)
        if (least, most) == (0, 1):
            return _one_of([part, Part.strings({b""})])
        if least == 0:
            return Part.anything()
        out = part
        for _ in range(min(least, MOST_TURNS) - 1):
            out = _in_turn(out, part)
        return out if least == most <= MOST_TURNS else Part(None, out.begins, out.ends, out.needs())
    return Part.anything()


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What trigrams, with A-Z as a-z, a text must hold for the expression to match in it; True if none are mandatory."""
    return _sequence(list(_parser.parse(pattern, flags))).needs()


def trigrams(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(trigrams, query[1]))


# --- the index of a run of texts ---


class Index:
    """Posting lists of the trigrams that are asked for, over one run of texts."""

    def __init__(self, asked: Sequence[bytes]):
        self.asked = list(asked)
        codes = np.array([int.from_bytes(t, "big") for t in self.asked], np.int64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.leads = np.zeros(1 << 16, bool)
        self.leads[codes >> 8] = True

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """For each trigram asked for, the sorted numbers of the texts that hold it. data: the texts' bytes, folded."""
        none = dict.fromkeys(self.asked, np.empty(0, np.int64))
        if len(data) < 3 or not self.asked:
            return none
        pairs = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
        at = np.flatnonzero(self.leads[pairs[:-1]])
        code = pairs[at].astype(np.int64) << 8 | data[at + 2]
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[place] == code
        at, place = at[hit], place[hit]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        seen = np.unique(place[inside] * np.int64(len(offsets)) + text[inside])
        place, text = np.divmod(seen, len(offsets))
        cuts = np.searchsorted(place, np.arange(len(self.codes) + 1))
        return none | {self.asked[k]: text[cuts[i] : cuts[i + 1]] for i, k in enumerate(self.order)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The texts of a run that satisfy a query: lists intersected, shortest first, and united."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings[query]
    lists = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    out = lists[0]
    for other in lists[1:]:
        if query[0] == "or":
            out = np.union1d(out, other)
        elif len(out):
            out = np.intersect1d(out, other, assume_unique=True)
    return out


class Scanner:
    """One task's rules, compiled, with their queries."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(rule, re.compile(rule.pattern, rule.flags).finditer, trigram_query(rule.pattern, rule.flags)) for rule in rules]
        self.index = Index(sorted(set().union(*(trigrams(q) for _, _, q in self.rules))))

    def scan(self, column: pa.Array) -> tuple[list[list[Span]], np.ndarray]:
        """The spans of each text by start, then in the rules' order; and how many expressions were run over it."""
        texts = [t or "" for t in column.to_pylist()]
        coded = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(fold(b"".join(coded)), np.uint8)
        postings = self.index.postings(data, np.cumsum([0, *map(len, coded)]))
        found: list[list[tuple]] = [[] for _ in texts]
        tried = np.zeros(len(texts), np.int64)
        for turn, (rule, matches, query) in enumerate(self.rules):
            chosen = candidates(query, postings, len(texts))
            tried[chosen] += 1
            for k in chosen.tolist():
                for m in matches(texts[k]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[k].append((m.start(), turn, m.end()))
        return [[(self.rules[turn][0].kind, b, e) for b, turn, e in sorted(spans)] for spans in found], tried


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def redact(text: str, spans: Sequence[Span]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b >= at:
            out += [text[at:b], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = ADDED, *, text: str = "text", keep: Sequence[str] | None = None, redacted: bool = True) -> DataFrame:
    """The columns ``keep`` (None: all) in the struct doc, then n_assign, n_access, n_hex and base_sha256 of the base
    spans, n_added and spans (base ones and those of ``rules``), n_tried (expressions that were run over the text) and, if asked
    for, the text with all spans replaced (null for null)."""
    every = (*BASE, *rules)
    base = [r.kind for r in BASE]

    def compute(batch, state):
        scanner = state.get("scanner") or state.setdefault("scanner", Scanner(every))
        spans, tried = scanner.scan(batch.column(1))
        plain = [[s for s in own if s[0] in base] for own in spans]
        out = [pa.array([sum(s[0] == kind for s in own) for own in plain], pa.int64()) for kind in base]
        out.append(pa.array([len(a) - len(b) for a, b in zip(spans, plain)], pa.int64()))
        out.append(pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in plain], pa.string()))
        out += [pa.array([joined(own) for own in spans], pa.string()), pa.array(tried)]
        if redacted:
            out.append(pa.array([t and redact(t, own) for t, own in zip(batch.column(1).to_pylist(), spans)], pa.string()))
        return out

    fields = "".join(f"n_{k} bigint, " for k in base) + "n_added bigint, base_sha256 string, spans string, n_tried bigint" + ", redacted string" * redacted
    return map_texts(docs, compute, fields, keep=keep, text=text)


def redact_secrets(docs: DataFrame, rules: Sequence[Rule] = ADDED, *, text: str = "text") -> DataFrame:
    """The same rows and columns, with secrets replaced in the text; a null text stays null."""
    others = [c for c in docs.columns if c != text]
    found = find_secrets(docs, rules, text=text, keep=others or None)
    return found.select(*[F.col("redacted").alias(text) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
