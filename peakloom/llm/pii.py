"""Personal data in whole texts: plain patterns, and disguised ones through offset-preserving normalisation.

The normalising transducers read the whole text and write plain characters, each with the source place it came from:
look-alike letters and full-width forms become ASCII, invisible characters vanish, spelled digits become digits,
``[at]`` and ``(dot)`` disguises and bare words between name parts become ``@`` and ``.``. Identifiers are looked for in
all that they wrote, and a span found goes back to source characters by the places. Plain spans always stay; a disguised
span that touches one of its own kind is left out. Every step is linear in the text: patterns take a bounded stretch or
one run of characters, and whether a bare word counts is settled from the right, each mark by the one after it.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Look-alikes of ASCII letters in Cyrillic, Greek and Armenian, and other forms of digits and marks.
_LOOKS = dict(x.split(":") for x in "а:a с:c е:e о:o р:p х:x у:y і:i ј:j ѕ:s һ:h ԁ:d ԛ:q ԝ:w А:A В:B Е:E К:K М:M Н:H О:O Р:P С:C Т:T У:Y Х:X І:I Ј:J Ѕ:S α:a ο:o ρ:p ν:v ι:i κ:k υ:u Α:A Β:B Ε:E Ζ:Z Η:H Ι:I Κ:K Μ:M Ν:N Ο:O Ρ:P Τ:T Υ:Y Χ:X ս:u ո:n օ:o".split())
_LOOKS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_LOOKS |= {chr(base + k): str(k) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
_LOOKS |= {chr(base + k): chr(start + k) for base, start in ((0x1D400, 65), (0x1D5A0, 65), (0x1D5D4, 65), (0x1D670, 65)) for k in range(26)}
_LOOKS |= {chr(base + k): chr(start + k) for base, start in ((0x1D41A, 97), (0x1D5BA, 97), (0x1D5EE, 97), (0x1D68A, 97)) for k in range(26)}
_LOOKS |= {chr(c): "." for c in (0x2024, 0x3002, 0xFF61, 0xFE52)} | {chr(c): "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)}
_LOOKS |= {chr(0xFE6B): "@"} | {chr(c): " " for c in (0xA0, 0x2007, 0x202F, 0x3000)}
_LOOK_TABLE = str.maketrans(_LOOKS)
_VOID = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e]")
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAME = "(?:" + "|".join(_DIGITS) + ")"
#: A run of spelled or plain digits that begins with a spelled one. Patterns from here on are for small letters.
_SPELLED = re.compile(rf"(?<![a-z]){_NAME}(?:[\s,.·-]{{1,2}}(?:{_NAME}|[0-9]))*(?![a-z])")
_ONE_DIGIT = re.compile(rf"{_NAME}|[0-9]")
_PLUS = re.compile(rf"(?<![a-z])plus[\s,.-]{{1,2}}(?={_NAME}(?![a-z]))")
_TLD = re.compile("(?:com|org|net|edu|gov|mil|info|biz|io|co|ai|app|dev|me|tv|us|uk|eu|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|ru|cn|jp|kr|in|br|mx|ca|au|nz|za)(?![a-z0-9])")
#: Marks: at or dot in brackets, and as bare words between name parts.
_MARK = re.compile(r"[\[({<]\s{0,2}(?:(at|arroba|@)|dot|punto|punkt|point|\.)\s{0,2}[\])}>]|(?<=[a-z0-9])(?:\s{1,2}|[_-])(?:(at)|(dot))(?:\s{1,2}|[_-])(?=[a-z0-9])")
_LABEL = re.compile(r"[a-z0-9-]+")
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*")
_LOCAL_RUN = re.compile(r"[a-z0-9._%+-]*")
_DIGIT_BEFORE = re.compile(rf"(?:{_NAME}|[0-9])$")
_DIGIT_AFTER = re.compile(rf"{_NAME}(?![a-z])|[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@``: what stands before it is one run of local
    characters, so the leftmost start is where that run begins or the last address ended."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _ips(text: str) -> list[tuple[int, int]]:
    if text.count(".") < 3:
        return []
    return [m.span() for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain spans, by kind as in KINDS, then start."""
    return [(kind, a, b) for kind in KINDS for a, b in _FINDERS[kind](text)]


def _small(text: str) -> str:
    """Small letters, one a character of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _marks(low: str) -> list[tuple[int, int, str]]:
    """(from, to, ``@`` or ``.``) of at and dot disguises. In brackets they always count. A bare ``dot`` counts before a
    known top level, before a name part that a dot that counts follows, in the local part of an address, and between
    digits; a bare ``at`` counts before a host name that ends in a known top level or goes on with a dot that counts."""
    found: list[tuple[int, int, str, bool]] = []
    for m in _MARK.finditer(low):
        a, b = m.span()
        bare = m[2] is not None or m[3] is not None
        if not bare:  # up to two spaces on both sides
            least = max(found[-1][1] if found else 0, a - 2)
            while a > least and low[a - 1].isspace():
                a -= 1
            most = min(len(low), b + 2)
            while b < most and low[b].isspace():
                b += 1
        found.append((a, b, "@" if m[1] or m[2] else ".", bare))
    out: list[tuple[int, int, str]] = []
    follows, start = "", len(low)  # the mark after this one, if it counts, and where it or the text's end is
    for a, b, sign, bare in reversed(found):
        good = not bare
        if bare and sign == ".":
            run = _LABEL.match(low, b, start)
            good = bool(_TLD.match(low, b)) or (follows == "." and run is not None and run.end() == start)
            if not good:
                end = _LOCAL_RUN.match(low, b, start).end()
                good = (end == start and follows == "@") or (end < len(low) and end < start and low[end] == "@")
            good = good or bool(_DIGIT_AFTER.match(low, b) and _DIGIT_BEFORE.search(low[max(0, a - 5) : a]))
        elif bare:
            run = _HOST.match(low, b, start)
            if run is not None:
                good = (follows == "." and run.end() == start) or any(_TLD.match(part) for part in run[0].split(".")[1:])
        if good:
            out.append((a, b, sign))
        follows, start = sign if good else "", a
    return out[::-1]


def _rewrites(low: str) -> list[tuple[int, int, str]]:
    """(from, to, written) of all that the transducers change, in order and without overlaps."""
    out = _marks(low)
    dots = {x for a, b, sign in out if sign == "." for x in (a, b)}
    for m in _SPELLED.finditer(low):
        digits = list(_ONE_DIGIT.finditer(m[0]))
        # fewer than three digits are words of a sentence, unless a dot mark makes them part of an address
        if len(digits) >= 3 or m.start() in dots or m.end() in dots:
            at = 0
            for d in digits:
                if d.start() > at:
                    out.append((m.start() + at, m.start() + d.start(), ""))
                if d.end() - d.start() > 1:
                    out.append((m.start() + d.start(), m.start() + d.end(), _DIGITS[d[0]]))
                at = d.end()
    out += [(m.start(), m.end(), "+") for m in _PLUS.finditer(low)]
    return sorted(out)


class _Written:
    """The normalised text, with the way back to places in the source."""

    def __init__(self, text: str):
        self.kept: list[int] | None = None
        low = text
        if not text.isascii():
            low = text.translate(_LOOK_TABLE)
            if _VOID.search(low):
                self.kept = [i for i, c in enumerate(low) if not _VOID.match(c)]
                low = "".join([low[i] for i in self.kept])
        changes = _rewrites(_small(low))
        self.same = not changes and low == text
        parts, at, size = [], 0, 0
        #: piece -> where it begins in the normalised text, and from where to where it was; what was copied has its length
        self.begins: list[int] = []
        self.places: list[tuple[int, int]] = []
        for a, b, new in [*changes, (len(low), len(low), "")]:
            for piece, x, y in ((low[at:a], at, a), (new, a, b)):
                if piece:
                    parts.append(piece)
                    self.begins.append(size)
                    self.places.append((x, y))
                    size += len(piece)
            at = b
        self.begins.append(size)
        self.text = "".join(parts)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """Where the characters from ``a`` to ``b`` of the normalised text came from."""

        def place(i: int) -> tuple[int, int]:
            k = bisect.bisect_right(self.begins, i) - 1
            x, y = self.places[k]
            copied = self.begins[k + 1] - self.begins[k] == y - x
            return (x + i - self.begins[k], x + i - self.begins[k] + 1) if copied else (x, y)

        s, e = place(a)[0], place(b - 1)[1]
        return (s, e) if self.kept is None else (self.kept[s], self.kept[e - 1] + 1)


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that show only in the normalised text and touch no plain span of their kind."""
    written = _Written(text)
    if written.same:
        return []
    out = []
    for kind in KINDS:
        own = [(a, b) for k, a, b in plain if k == kind]
        starts, free = [a for a, _ in own], 0
        for a, b in _FINDERS[kind](written.text):
            s, e = written.source(a, b)
            k = bisect.bisect_left(starts, e)
            # what was plain already is not a new find
            if s >= free and not (k and own[k - 1][1] > s):
                out.append((kind, s, e))
                free = e
    return out


def spans_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), each by kind and start."""
    if not text:
        return [], []
    plain = base_spans(text)
    more = disguised_spans(text, plain)
    return plain, plain if not more else sorted(plain + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with ``<kind>`` for each span; of overlapping ones the first and longest counts."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256, spans (all spans, joined),
    n_disguised and n_spans (all spans). A null text is empty; rows that repeat stay; further columns are ignored; no row gives no row."""
    fields = [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_disguised", pa.int64()), ("n_spans", pa.int64())]

    def find(_, row):
        doc_id, text = row
        plain, every = spans_of(text)
        counts = [sum(k == kind for k, _, _ in plain) for kind in KINDS]
        yield (doc_id, *counts, hashlib.sha256(listed(plain).encode()).hexdigest(), listed(every), len(every) - len(plain), len(every)), 200

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_disguised long, n_spans long"
    return common.mapped(source, find, ["doc_id", "text"], pa.schema(fields), ddl)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with each span in ``text_col`` replaced by ``<kind>``, and ``length_col``, where there
    is one, set to the new length of texts that changed. Null texts stay null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for big in batches:
            for first in range(0, big.num_rows, 1024):
                batch = big.slice(first, 1024)
                columns = list(batch.columns)
                old = columns[at].to_pylist()
                new = [redacted(t, spans_of(t)[1]) for t in old]
                columns[at] = pa.array(new, columns[at].type)
                if length_col in names:
                    k = names.index(length_col)
                    columns[k] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(columns[k].to_pylist(), old, new, strict=True)], columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; see :func:`detect`."""
    return detect(common.corpus(spark, sf_dir))
