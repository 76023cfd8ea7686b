"""Text expressions. Everything here is a Column built from native functions unless noted."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as C

# Blank characters as a regex class body: ASCII blanks plus the Unicode separators.
BLANK_CLASS = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Spark shares repeated expressions only in some places (not in filters, CASE branches or
    lambdas), and lower-casing a long text once per use is what costs most.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_any(col: Column, words: Iterable[str]) -> Column:
    """True when any literal word occurs, case ignored: plain substring searches over one
    lower-cased copy, which is far cheaper than a case-insensitive alternation."""
    lowered = [w.lower() for w in words]

    def search(text: Column) -> Column:
        test = F.contains(text, F.lit(lowered[0]))
        for word in lowered[1:]:
            test = test | F.contains(text, F.lit(word))
        return test

    return F.coalesce(let(F.lower(col), search), F.lit(False))


def strip(col: Column, chars: str = C.BLANKS) -> Column:
    """Remove leading and trailing characters of a set (blanks, tabs and newlines by default)."""
    return F.trim(col, F.lit(chars))


def lstrip(col: Column, chars: str = C.BLANKS) -> Column:
    return F.ltrim(col, F.lit(chars))


def rstrip(col: Column, chars: str = C.BLANKS) -> Column:
    return F.rtrim(col, F.lit(chars))


def matches_any(col: Column, patterns: Iterable[str], flags: str = "") -> Column:
    """True when any regular expression is found; one combined pattern, one pass over the text."""
    return F.coalesce(col.rlike(flags + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def decode_url(col: Column) -> Column:
    """Percent-decode; a plus sign stays a plus sign, a bad escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def wiki_slug(url: Column) -> Column:
    """Decoded text after the last ``/wiki/``; null when the URL has none."""
    return F.when(
        F.contains(url, F.lit("/wiki/")), decode_url(F.substring_index(url, "/wiki/", -1))
    )


def clean_markdown(col: Column) -> Column:
    """Drop images and rule lines, collapse three or more newlines, strip."""
    text = F.regexp_replace(col, r"!\[[^\]]*\]\([^)]+\)", "")
    text = F.regexp_replace(text, rf"(?md)^---+[{BLANK_CLASS}]*$", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_text(col: Column) -> Column:
    """Drop template remains, squeeze blanks, trim line ends, collapse newlines, strip."""
    text = F.regexp_replace(col, r"\{\{[^}]*\}\}", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"(?md) +$", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def _section(section: Column, content: Column) -> Column:
    return F.struct(section["title"].alias("title"), section["level"].alias("level"), content.alias("content"))


def parse_sections(col: Column) -> Column:
    """Clean each section's markdown, drop a leading heading line and drop empty sections."""

    def one(section: Column) -> Column:
        body = clean_markdown(strip(F.coalesce(section["markdown"], F.lit(""))))
        rest = F.when(
            F.startswith(body, F.lit("#")), strip(F.regexp_replace(body, r"^[^\n]*\n?", ""))
        ).otherwise(body)
        return F.struct(
            strip(F.coalesce(section["title"], F.lit(""))).alias("title"),
            F.coalesce(section["level"], F.lit(0)).alias("level"),
            rest.alias("content"),
        )

    return F.filter(F.transform(col, one), lambda s: s["content"] != "")


def clean_sections(col: Column, skip_titles: Iterable[str] = C.SKIPPED_SECTIONS) -> Column:
    """Drop sections by title, normalise the rest and drop those left empty."""
    kept = F.filter(col, lambda s: ~s["title"].isin(list(skip_titles)))
    return F.filter(
        F.transform(kept, lambda s: _section(s, normalize_text(s["content"]))),
        lambda s: s["content"] != "",
    )


def strip_tags(col: Column) -> Column:
    """Plain text of an HTML fragment: no scripts, styles, comments or tags; entities resolved."""
    text = F.regexp_replace(col, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def html_sections(col: Column) -> Column:
    """Sections of an HTML page: the part before the first heading, then one per heading."""
    body = F.regexp_replace(col, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    pieces = F.split(body, r"(?i)<(?=h[1-6][^a-z0-9])")

    def one(piece: Column) -> Column:
        headed = piece.rlike(r"(?i)^h[1-6][^a-z0-9]")
        level = F.when(headed, F.substring(piece, 2, 1).cast("int")).otherwise(0)
        title = F.when(headed, strip_tags(F.regexp_extract(piece, r"(?is)^h[1-6][^>]*>(.*?)</h[1-6]", 1))).otherwise("")
        content = F.when(headed, F.regexp_replace(piece, r"(?is)^h[1-6][^>]*>.*?</h[1-6]\s*>", " ")).otherwise(piece)
        return F.struct(title.alias("title"), level.alias("level"), strip_tags(content).alias("content"))

    return F.filter(F.transform(pieces, one), lambda s: (s["content"] != "") | (s["title"] != ""))


def slug(col: Column) -> Column:
    return F.lower(F.replace(col, F.lit(" "), F.lit("_")))


def first_sentence(col: Column, limit: int = 200) -> Column:
    """Text before the first full stop, else the first ``limit`` characters."""
    return F.when(F.contains(col, F.lit(".")), F.substring_index(col, ".", 1)).otherwise(F.left(col, F.lit(limit)))


def script_lang(col: Column) -> Column:
    """``zh`` when the text has a Han or Kana character, else ``en``."""
    return F.when(col.rlike(r"[一-鿿぀-ヿ]"), "zh").otherwise("en")


def estimate_tokens(col: Column) -> Column:
    return F.floor(F.length(col) / C.CHARS_PER_TOKEN)


def tagged_block(col: Column, tag: str = "summary") -> Column:
    """Content of the first ``<tag>`` block, stripped; the whole text when there is none."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(col.rlike(pattern), strip(F.regexp_extract(col, pattern, 1))).otherwise(col)


def count_literal(text: Column, literal: Column) -> Column:
    """Non-overlapping occurrences of a literal, by length difference (no regex)."""
    hits = (F.length(text) - F.length(F.replace(text, literal, F.lit("")))) / F.length(literal)
    return F.when(F.length(literal) > 0, hits.cast("long")).otherwise(F.length(text).cast("long") + 1)


def ascii_id(col: Column) -> Column:
    """Compatibility decomposition without the non-ASCII characters.

    Spark has no normal-form function, so this runs over Arrow batches.
    """

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))

    return fold(col)


def valid_alias(col: Column, stopwords: Iterable[str] = C.ALIAS_STOPWORDS) -> Column:
    """The alias without surrounding blanks and quotes, or null when it is not usable."""

    def check(alias: Column) -> Column:
        letters = F.length(F.regexp_replace(alias, rf"[^\p{{L}}{BLANK_CLASS}]", ""))
        usable = (
            F.length(alias).between(2, 50)
            & ~F.lower(alias).isin(list(stopwords))
            & (letters / F.length(alias) >= 0.7)
        )
        return F.when(usable, alias)

    return let(strip(strip(col), "\"'"), check)
