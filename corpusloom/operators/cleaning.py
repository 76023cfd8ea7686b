"""Documents to clean documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import text as X
from corpusloom.operators.parsing import with_hash
from corpusloom.operators.ranking import dedup_exact


def with_canonical(df: DataFrame, alias_table: dict[str, str] | None = None, title: str = "title") -> DataFrame:
    """Canonical name and alias list of a title; the alias table is a short literal map."""
    table = C.TITLE_ALIASES if alias_table is None else alias_table
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(title)]
    return df.withColumn("canonical_name", F.coalesce(known, F.col(title))).withColumn(
        "aliases", F.when(known.isNotNull(), F.array(title)).otherwise(F.array().cast("array<string>"))
    )


def min_length(df: DataFrame, col: str = "content", n: int = C.MIN_CONTENT_CHARS) -> DataFrame:
    return df.filter(F.length(col) >= n)


def clean_documents(docs: DataFrame, order_by: str = "doc_id") -> DataFrame:
    """Deduplicate by hash, normalise, drop short documents, resolve the title."""
    docs = dedup_exact(docs, order_by=[order_by])
    docs = docs.withColumn("content", X.normalize_text(F.col("content")))
    docs = docs.withColumn("sections", X.clean_sections(F.col("sections")))
    docs = docs.withColumn("content_length", F.length("content"))
    return with_canonical(min_length(docs))


def clean_counters(df: DataFrame, text: str = "content", hash_col: str = "content_hash", order_by: str = "doc_id") -> DataFrame:
    """Input, duplicate, too-short and kept counts of the clean step."""
    first = df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("copies"), F.min(order_by).alias(order_by))
    sized = df.select(F.col(order_by), F.length(X.normalize_text(F.col(text))).alias("size"))
    short = F.col("size") < C.MIN_CONTENT_CHARS
    return first.join(sized, order_by).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(short).alias("too_short"),
        F.count_if(~short).alias("kept"),
    )


def clip_document(df: DataFrame, limit: int = C.EXTRACT_PROMPT_CHARS, marker: str = C.EXTRACT_MARKER,
                  content: str = "content") -> DataFrame:
    """Content cut at a prompt size, with a marker where something was cut."""
    col = F.col(content)
    return df.withColumn(
        "clipped", F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), F.lit(marker))).otherwise(col)
    )


def oracle_document(df: DataFrame, limit: int = C.ORACLE_PROMPT_CHARS) -> Column:
    """Header line with type and title, then the head of the content."""
    return F.concat(
        F.lit("### ["), F.coalesce("entity_type", F.lit("")), F.lit("] "),
        F.coalesce(F.when(F.col("canonical_name") != "", F.col("canonical_name")), F.lit("Unknown")),
        F.lit("\n"), F.left(F.col("content"), F.lit(limit)),
    )


def source_preview(df: DataFrame, chars: int = 500) -> DataFrame:
    """Preview row of a source: head of the text and the first region."""
    return df.withColumn("preview", F.left(F.col("full_text"), F.lit(chars))).withColumn(
        "region", F.get(F.col("regions"), F.lit(0))
    )


__all__ = [
    "with_canonical", "min_length", "clean_documents", "clean_counters", "clip_document",
    "oracle_document", "source_preview", "with_hash",
]
