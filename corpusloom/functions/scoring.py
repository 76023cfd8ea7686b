"""Scores for relations, passages, titles and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import text as X


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 when either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def relation_score(evidence: Column, relation: Column, target: Column, entities: Column,
                   weights: dict[str, float] | None = None) -> Column:
    """Evidence length, relation weight and target relevance, rounded to 3 places."""
    size = F.length(evidence)
    quality = (
        F.when(evidence.isNull() | (size == 0), 0.0)
        .when(size >= 100, 0.4).when(size >= 50, 0.3).when(size >= 20, 0.2).otherwise(0.1)
    )
    table = F.create_map(*[F.lit(x) for pair in (weights or C.RELATION_WEIGHTS).items() for x in pair])
    weight = F.coalesce(table[F.coalesce(relation, F.lit("RELATED_TO"))], F.lit(C.DEFAULT_RELATION_WEIGHT))
    name = F.lower(F.coalesce(target, F.lit("")))
    wanted = F.transform(entities, lambda e: F.lower(e))
    exact = (name != "") & F.array_contains(wanted, name)
    partial = F.exists(wanted, lambda e: F.contains(name, e) | F.contains(e, name))
    relevance = F.when(exact, 0.3).when(partial, 0.15).otherwise(0.0)
    return F.round(quality + weight * 0.3 + F.coalesce(relevance, F.lit(0.0)), 3)


def passage_score(similarity: Column, text: Column, title: Column, section: Column,
                  entities: Column, query_type: Column) -> Column:
    """Similarity, mention density, title or section hit and question-type words."""
    wanted = F.transform(entities, lambda e: F.lower(e))
    mentions = X.let(F.lower(text), lambda low: F.aggregate(
        wanted, F.lit(0).cast("long"), lambda acc, e: acc + X.count_literal(low, e)))
    heads = F.array(F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(section, F.lit(""))))
    in_head = F.exists(wanted, lambda e: F.exists(heads, lambda h: F.contains(h, e)))
    return passage_score_from(similarity, mentions, F.length(text), in_head, X.has_any(text, C.RELATIONSHIP_WORDS),
                              X.has_any(text, C.FACTUAL_WORDS), query_type)


def passage_score_from(similarity: Column, mentions: Column, text_length: Column, in_head: Column, relational: Column,
                       factual: Column, query_type: Column) -> Column:
    """The passage score from figures that were taken from the text beforehand."""
    density = F.when(text_length > 0, F.least(mentions / (text_length / 500) * 0.15, F.lit(0.3))).otherwise(0.0)
    bonus = (
        F.when((query_type == "RELATIONSHIP") & relational, 0.1)
        .when((query_type == "FACTUAL") & factual, 0.1)
        .otherwise(0.0)
    )
    return F.round(F.least(similarity, F.lit(1.0)) * 0.4 + density + F.when(in_head, 0.2).otherwise(0.0) + bonus, 3)


def title_match(entity: Column, title: Column) -> Column:
    """3 for equal names, 2 when one contains the other, else 0 (case and outer blanks ignored)."""
    e, t = X.strip(F.lower(entity)), X.strip(F.lower(title))
    return F.when(e == t, 3).when(F.contains(t, e) | F.contains(e, t), 2).otherwise(0)


def path_steps(nodes: Column, relations: Column) -> Column:
    """``a -[REL]-> b`` for each hop."""
    return F.transform(
        relations,
        lambda rel, i: F.concat(
            F.get(nodes, i), F.lit(" -["), rel, F.lit("]-> "), F.get(nodes, i + 1)
        ),
    )
