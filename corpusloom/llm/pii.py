"""Operator 10: personal data, also where it is disguised, with spans of the source text."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.shared import map_rows

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like a Latin letter or a sign of an identifier.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i",
    "․": ".", "。": ".", "‧": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "﹢": "+",
}
# Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
HIDDEN = "­​‌‍⁠﻿"


def _letters() -> dict[int, str]:
    """Look-alikes, and every sign whose compatibility form is one visible ASCII sign (full width, mathematical, circled)."""
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    for c in (*range(0x2070, 0x2800), *range(0xFE50, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and "!" <= plain <= "~":
            table.setdefault(c, plain)
    return table


LETTERS = _letters()
ODD = re.compile("[" + "".join(map(re.escape, map(chr, LETTERS))) + HIDDEN + "]")
_DIGIT = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"\b(?:{_DIGIT})(?:[ \t,-]{{1,2}}(?:{_DIGIT}|[0-9]))+\b", re.IGNORECASE)
ONE = re.compile(rf"({_DIGIT})|[0-9]", re.IGNORECASE)
#: Numbers and spelled digits in a row, also across dots; in such a row a lone spelled digit counts as well.
NUMBERS = re.compile(rf"(?:\b(?:{_DIGIT})|(?<![0-9])[0-9]++)(?:(?:[ \t,-]{{1,2}}|\x20dot\x20|\.|\x20?[\[({{<]\x20?dot\x20?[\])}}>]\x20?)(?:(?:{_DIGIT})\b|[0-9]++))++", re.IGNORECASE)
LONE = re.compile(rf"\b(?:{_DIGIT})\b", re.IGNORECASE)
# Endings that a domain given in bare words must have.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|dev|app|io|ai|co|me|tv|uk|de|fr|es|it|nl|ch|at|eu|us|ca|au|jp|cn|in|br|ru|pl|se"
#: Brackets around at or dot need no more proof; the bare words count only in a domain with a known ending, and at only if a dot of that domain is disguised too.
SIGNS = re.compile(r"\x20?[\[({<]\x20?(at|dot)\x20?[\])}>]\x20?", re.IGNORECASE)
BARE = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:@|\x20at\x20)", re.IGNORECASE)
BARE_DOT = re.compile(r"\x20dot\x20", re.IGNORECASE)
DOTTED = re.compile(rf"(?:[A-Za-z0-9-]{{1,63}}(?:\x20dot\x20|\.))+(?:{ENDINGS})\b", re.IGNORECASE)
IP_DOT = re.compile(r"(?<=[0-9])\x20dot\x20(?=[0-9])", re.IGNORECASE)

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The spans that a leftmost search finds, started from each @ so that long runs of letters cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the four rules find, leftmost and without overlap within a kind."""
    out = [(0, a, b) for a, b in emails(text)]
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 1000) and max(map(len, m[0].split("."))) < 1000]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def may_hold_odd(text: str) -> bool:
    """False only if no sign can be a look-alike or hidden: of the first 256 only the soft hyphen is."""
    try:
        return b"\xad" in text.encode("latin-1")
    except UnicodeEncodeError:
        return True


def stands_alone(low: str, word: str) -> bool:
    """Whether the word occurs with no letter on either side."""
    at, n = low.find(word), len(word)
    while at >= 0:
        if not low[at - 1 : at].isalpha() and not low[at + n : at + n + 1].isalpha():
            return True
        at = low.find(word, at + n)
    return False


def signs(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes and hidden signs of the source: (start, end, replacement), in order."""
    if not may_hold_odd(text):
        return []
    return [(m.start(), m.end(), "" if m[0] in HIDDEN else m[0].translate(LETTERS)) for m in ODD.finditer(text)]


def words(text: str, real_dot) -> list[tuple[int, int, str]]:
    """Spelled digits and at/dot disguises: (start, end, replacement), in order and without overlap.

    ``real_dot`` tells of a place whether its dot is one of the source.
    """
    low, found = text.lower(), []
    if any(stands_alone(low, d) for d in DIGITS):
        for m in SPELLED.finditer(text):
            found.append((m.start(), m.end(), "".join(DIGITS.get(d[0].lower(), d[0]) for d in ONE.finditer(m[0]))))
        for run in NUMBERS.finditer(text):
            found += [(m.start(), m.end(), DIGITS[low_word]) for m in LONE.finditer(text, *run.span()) if (low_word := m[0].lower()) in DIGITS]
    if any(c in text for c in "])}>"):
        found += [(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in SIGNS.finditer(text)]
    dots = " dot " in low
    if dots:
        found += [(m.start(), m.end(), ".") for m in IP_DOT.finditer(text)]
    if " at " in low or dots and "@" in low:
        for m in BARE.finditer(text):
            run = DOTTED.match(text, m.end())
            if run and (m[0] == "@" or BARE_DOT.search(run[0]) or any(c == "." and not real_dot(i) for i, c in enumerate(run[0], m.end()))):
                found += [(m.start(), m.end(), "@")] if m[0] != "@" else []
                found += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, m.end(), run.end())]
    out, done = [], 0
    for a, b, new in sorted(found, key=lambda f: (f[0], -f[1])):
        if a >= done:
            out.append((a, b, new))
            done = b
    return out


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Identifiers of the rewritten texts as spans of the source: from the first rewritten sign's start to the last one's end.

    Signs are rewritten first, then words until nothing changes. Every step's identifiers count, as
    a later one may run on into what follows; those that another one of their kind holds are left out.
    """
    found, changes, spelled = set(), signs(text), False
    plain, starts, ends = text, range(len(text)), range(1, len(text) + 1)
    while changes or not spelled:
        if changes:
            plain, first, last = rewrite(plain, changes)
            starts, ends = [starts[i] for i in first], [ends[i - 1] for i in last]
            found |= {(k, starts[a], ends[b - 1]) for k, a, b in identifiers(plain)}
        changes, spelled = words(plain, lambda i: text[starts[i]] == "."), True
    out, reach = [], [-1] * len(KINDS)
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if b > reach[k]:
            out.append((k, a, b))
            reach[k] = b
    return out


def rewrite(text: str, changes: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """The rewritten text, and for each of its signs the source span: its start and end."""
    parts, starts, ends, at = [], [], [], 0
    for a, b, new in [*changes, (len(text), len(text), "")]:
        parts += [text[at:a], new]
        starts += range(at, a)
        ends += range(at + 1, a + 1)
        starts += [a] * len(new)
        ends += [b] * len(new)
        at = b
    return "".join(parts), starts, ends


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans as (kind, start, end), sorted; the disguised ones that no base span of their kind holds are added."""
    text = text or ""
    base = sorted(identifiers(text))
    more = [s for s in disguised(text) if not any(k == s[0] and a <= s[1] and s[2] <= b for k, a, b in base)]
    return base, sorted({*base, *more})


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans count as one, named by the first."""
    out, at = [], 0
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, mask: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row, each an array of (kind, start, end) in code points, end exclusive;
    with ``mask`` also the text with these spans replaced by ``<kind>``.

    Base spans are those the plain rules find in the text as it is. Then transducers rewrite
    look-alike letters, hidden signs, spelled digits and at/dot disguises; what the rules find in the
    rewritten text is mapped back and added unless a base span of its kind holds it; so an identifier
    of which the plain rules see a fragment has both spans. Words are rewritten until nothing changes,
    so combined disguises count. Out of bounds in all texts alike: a bare ' at ' before a domain with
    none but real dots ('john at example.com', as pages are named like that too: 'look at
    example.com'), bare words with a domain ending that is not one of ``ENDINGS``, spelled numbers from
    ten on, and a spelled digit with no number or spelled digit beside it. A null text counts as empty
    (its masked form stays null), repeated rows give repeated results, other columns are left out, an
    empty table gives an empty one. Nothing is shuffled; each row is worked on by itself.
    """
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            both = [spans(t) for t in texts]
            columns = [batch.column(0)]
            columns += [pa.array([[(KINDS[k], a, b) for k, a, b in pair[i]] for pair in both], item) for i in (0, 1)]
            if mask:
                columns.append(pa.array([None if t is None else masked(t, found) for t, (_, found) in zip(texts, both)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "spans", "masked"][: len(columns)])

    found = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = f"doc_id long, base {found}, spans {found}" + (", masked string" if mask else "")
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text}` text").mapInArrow(run, schema)


def without_pii(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with all its columns, every span in ``text`` replaced by ``<kind>`` and ``length`` set to the new number of code points.

    A null text stays null, and so does its length.
    """
    at, size = docs.columns.index(text), docs.columns.index(length)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked(t, spans(t)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.types[at])
            columns[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.types[size])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_rows(docs, run)
