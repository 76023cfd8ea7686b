"""Topic filters, relation filters, graph and conversation search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import text as X


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def on_topic(regions: Column, categories: Column, title: Column, content: Column,
             keywords: Sequence[str] = C.TOPIC_KEYWORDS, region: str = C.TOPIC_REGION, head_chars: int | None = None) -> Column:
    """Region tag, or any keyword in the joined categories, the title or the content, or its first ``head_chars`` characters."""
    return (
        F.array_contains(regions, region)
        | X.has_any(F.concat_ws(" ", categories), keywords)
        | X.has_any(title, keywords)
        | X.has_any(_head(content, head_chars), keywords)
    )


def topic_filter(docs: DataFrame, keywords: Sequence[str] = C.TOPIC_KEYWORDS, region: str = C.TOPIC_REGION,
                 head_chars: int | None = None) -> DataFrame:
    return docs.filter(on_topic(F.col("regions"), F.col("categories"), F.col("title"), F.col("content"), keywords, region, head_chars))


def raw_on_topic(categories: Column, url: Column, markdown: Column, keywords: Sequence[str] = C.RAW_TOPIC_KEYWORDS,
                 category_terms: Sequence[str] = C.RAW_TOPIC_CATEGORIES, head_chars: int | None = None) -> Column:
    """Category terms, then keywords in the URL, then keywords in the page, or its first ``head_chars`` characters."""
    return (
        F.exists(categories, lambda c: X.has_any(c, category_terms))
        | X.has_any(url, keywords)
        | X.has_any(_head(markdown, head_chars), keywords)
    )


def topic_filter_raw(pages: DataFrame, keywords: Sequence[str] = C.RAW_TOPIC_KEYWORDS,
                     category_terms: Sequence[str] = C.RAW_TOPIC_CATEGORIES, head_chars: int | None = None) -> DataFrame:
    return pages.filter(raw_on_topic(F.col("category"), F.col("url"), F.col("markdown"), keywords, category_terms, head_chars))


def split_relations(edges: DataFrame, allowed: Sequence[str] = C.VALID_RELATIONS) -> tuple[DataFrame, DataFrame]:
    """Edges of a known relation, and counts of the unknown relations left out."""
    known = F.coalesce(F.col("relation").isin(list(allowed)), F.lit(False))
    return edges.filter(known), edges.filter(~known).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


def neighbours_by_relation(edges: DataFrame, relation: str, tail: str) -> DataFrame:
    """Heads of the edges of one relation that end in a named node."""
    return edges.filter((F.col("relation") == relation) & (F.col("tail") == tail)).select(F.col("head").alias("name")).distinct()


def match_hops(nodes: DataFrame, edges: DataFrame, hops: Sequence[tuple[str, str, str]], end: Column | None = None) -> DataFrame:
    """Typed chain pattern: each hop is (type of the start, relation, type of the end).

    ``end`` is a predicate over the last node, written on the column ``end_name``. Returns the
    distinct pairs of first node and the node before the last.
    """
    kinds = nodes.select(F.col("name"), F.col("type"))
    result = None
    for i, (from_type, relation, to_type) in enumerate(hops):
        step = edges.filter(F.col("relation") == relation).select(F.col("head").alias(f"n{i}"), F.col("tail").alias(f"n{i + 1}"))
        step = step.join(kinds.filter(F.col("type") == to_type).select(F.col("name").alias(f"n{i + 1}")), f"n{i + 1}", "left_semi")
        if i == 0:
            starts = kinds.filter(F.col("type") == from_type).select(F.col("name").alias("n0"))
            result = step.join(starts, "n0", "left_semi")
        else:
            result = result.join(step, f"n{i}")
    last = len(hops)
    if end is not None:
        result = result.withColumn("end_name", F.col(f"n{last}")).filter(end)
    return result.select(F.col("n0").alias("start"), F.col(f"n{last - 1}").alias("via")).distinct()


def filter_graph(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the active types and the edges with both ends among them."""
    kept = nodes.filter(F.col("type").isin(list(types)))
    names = kept.select("name")
    inside = edges.join(names.withColumnRenamed("name", "head"), "head", "left_semi").join(
        names.withColumnRenamed("name", "tail"), "tail", "left_semi"
    )
    return kept, inside


def search_nodes(nodes: DataFrame, text: str, limit: int | None = 10) -> DataFrame:
    """Nodes whose name contains the text, case ignored; the first ``limit`` by name are shown."""
    found = nodes.filter(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name")
    return found if limit is None else found.limit(limit)


def search_conversations(messages: DataFrame, text: str) -> DataFrame:
    """Conversations with the text in any message."""
    hits = messages.filter(F.contains(F.lower("text"), F.lit(text.lower())))
    return hits.groupBy("conv_id").agg(F.count(F.lit(1)).alias("hits"))


def search_answers(entries: DataFrame, text: str, head: int | None = None) -> DataFrame:
    """Entries with the text in the question or in the answer, or its first ``head`` characters."""
    needle = F.lit(text.lower())
    return entries.filter(
        F.contains(F.lower("question"), needle) | F.contains(F.lower(_head(F.col("answer"), head)), needle)
    )


def select_questions(questions: DataFrame, tiers: Sequence[int] | None = None, limit: int | None = None, order_by: str = "k") -> DataFrame:
    """Questions of some tiers, and the first ``limit`` of them where the caller asks for a trial run."""
    if tiers is not None:
        questions = questions.filter(F.col("tier").isin(list(tiers)))
    return questions if limit is None else questions.orderBy(order_by).limit(limit)
