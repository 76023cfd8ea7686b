"""Operator 5: secrets, found through an inverted index of trigrams. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group and number of characters a match must have, and whether it is one of the base kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The patterns of the base kinds and of further kinds by their public prefixes. A run of hex digits, or of what
# follows AKIA, is taken whole, so asking for its least length in the pattern drops the same matches as a test afterwards.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE = tuple(r.kind for r in RULES if r.base)


#: Signs of a class, and alternatives of a literal, beyond which a place counts as anything.
CLASS_SIGNS, ALTERNATIVES = 8, 64


def spelled(items) -> set[str] | None:
    """All strings, in lower case, that a part of a parsed pattern can match; None where they are too many."""
    out = {""}
    for kind, value in items:
        if kind is parser.LITERAL:
            one = {chr(value).lower()} if value < 128 else None
        elif kind is parser.IN:
            one = set()
            for k, v in value:
                signs = [v] if k is parser.LITERAL else range(v[0], v[1] + 1) if k is parser.RANGE else None
                one = None if one is None or signs is None or len(signs) > CLASS_SIGNS or max(signs) > 127 else one | {chr(c).lower() for c in signs}
            one = None if one is None or len(one) > CLASS_SIGNS else one
        elif kind is parser.SUBPATTERN:
            one = spelled(value[3])
        elif kind is parser.BRANCH:
            parts = [spelled(x) for x in value[1]]
            one = None if any(x is None for x in parts) else set().union(*parts)
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[1] <= 4:
            part = spelled(value[2])
            one = None if part is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(part, repeat=n)}
        else:
            one = {""} if kind is parser.AT else None
        out = None if one is None or len(out) * len(one) > ALTERNATIVES else {a + b for a in out for b in one}
        if out is None:
            return None
    return out


def literals(items) -> list[set[str]]:
    """What every match of a parsed pattern holds: of each group of alternatives one.

    Neighbouring parts that can be spelled out are joined as long as that gives few alternatives; a part that can
    match too much stands between two groups, and its own groups count if it must occur.
    """
    groups, run = [], {""}
    for item in items:
        kind, value = item
        one = spelled([item])
        if one is not None and len(run) * len(one) <= ALTERNATIVES:
            run = {a + b for a in run for b in one}
            continue
        groups.append(run)
        run = one or {""}
        if one is None:
            inner = value[3] if kind is parser.SUBPATTERN else value[2] if kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0 else []
            groups += literals(inner)
    return [*groups, run]


def trigrams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def trigram_query(rule: Rule) -> list[list[list[str]]]:
    """The rule as AND of ORs of ANDs of trigrams, derived from its pattern; empty if it has none that every match must hold.

    Alternatives that hold another one add nothing to it, and a group with an alternative of under three signs says nothing.
    """
    query = []
    for group in literals(parser.parse(rule.pattern)):
        least = sorted(x for x in group if not any(y != x and y in x for y in group))
        if all(len(x) >= 3 for x in least) and [trigrams(x) for x in least] not in query:
            query.append([trigrams(x) for x in least])
    return query


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id) for the trigrams, numbered as in ``wanted``, that some rule asks for, in lower case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)])
    return low.select(F.explode(F.array_compact(found)).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...], wanted: list[str]) -> DataFrame:
    """(doc_id, rules): the bits of the rules whose trigram query a document's postings satisfy.

    Postings are brought together by document, at most one per wanted trigram; a literal holds where
    all its trigrams have one, a rule where every group of alternatives has a literal that holds.
    """
    place = {t: i for i, t in enumerate(wanted)}
    by_doc = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    bits = F.lit(0)
    for b, rule in enumerate(rules):
        holds = F.lit(True)
        for group in trigram_query(rule):
            literals = [F.size(F.array_intersect("held", F.array(*[F.lit(place[t]) for t in x]))) == len(x) for x in group]
            holds = holds & F.greatest(*literals, F.lit(False))
        if trigram_query(rule):
            bits = bits + F.when(holds, 1 << b).otherwise(0)
    return by_doc.select("doc_id", bits.alias("rules")).filter("rules > 0")


def matches(text: str, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches in code points, leftmost and without overlap; failing ones dropped.

    The text is split at the matches, so each start is the length of what lies before.
    """
    pattern = F.lit(rule.pattern)
    between, found = F.split(F.col(text), rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.zip_with(found, tested, lambda m, t: F.struct(F.length(m).alias("len"), F.length(t).alias("size")))
    steps = F.zip_with(between, steps, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.len.alias("len"), m.size.alias("size")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(done, x):
        start = done.at + x.gap
        item = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x.len).alias("end")))
        return F.struct((start + F.coalesce(x.len, F.lit(0))).alias("at"), F.when(x.size >= rule.least, F.concat(done.out, item)).otherwise(done.out).alias("out"))

    return F.aggregate(steps, begin, add, lambda done: done.out)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: an array of (start, kind, end), kind by its place in ``rules``, sorted.

    Each rule's mandatory trigrams are derived from what its pattern must contain. Their postings are
    intersected per document, and a rule's pattern runs over the whole text of its candidates only; a
    rule without such trigrams runs over all texts.

    A null text counts as empty. Rows that share an id share their candidate rules, which are verified
    on each text; a row without id is tried by every rule. Other columns are left out; an empty table gives an empty one.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = sorted({t for r in rules for group in trigram_query(r) for literal in group for t in literal})
    picked = candidates(postings(given.filter("doc_id is not null"), wanted), rules, wanted)
    rows = given.join(picked, "doc_id", "left")
    bits = F.when(F.col("doc_id").isNull(), (1 << len(rules)) - 1).otherwise(F.coalesce("rules", F.lit(0)))
    none, found = F.array().cast(SPANS), []
    for b, rule in enumerate(rules):
        tried = bits.bitwiseAND(F.lit(1 << b)) > 0 if trigram_query(rule) else F.rlike("text", F.lit(rule.pattern))
        found.append(F.when(tried, matches("text", rule, b)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))
