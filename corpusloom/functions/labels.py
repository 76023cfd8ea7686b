"""Small display labels: relevance bands, date labels, question types, search depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import text as X


def relevance_band(score: Column) -> Column:
    """Band of a score by its rounded percentage."""
    percent = F.floor(score * 100 + 0.5)
    (first, label), *rest = C.RELEVANCE_BANDS
    chain = F.when(percent >= first, label)
    for bound, name in rest:
        chain = chain.when(percent >= bound, name)
    return chain.otherwise(C.RELEVANCE_REST)


def date_bucket(ts: Column, reference_ts: Column) -> Column:
    """``Today``, ``Yesterday`` or a short date, seen from a reference time."""
    days = F.datediff(reference_ts, ts)
    return (
        F.when(ts.isNull() | (days == 0), "Today")
        .when(days == 1, "Yesterday")
        .otherwise(F.date_format(ts, "MMM d"))
    )


def relative_age(ts: Column, reference_ts: Column) -> Column:
    """Clock time within a day, ``Nd ago`` within a week, else a short date."""
    days = F.floor(F.timestamp_diff("MICROSECOND", ts, reference_ts) / 86_400_000_000)
    return (
        F.when(ts.isNull(), "")
        .when(days == 0, F.date_format(ts, "hh:mm a"))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d"))
    )


def classify_query(col: Column, patterns=None, default: str = C.DEFAULT_QUESTION_TYPE) -> Column:
    """Question type by the first pattern group found in the lower-cased question."""

    def choose(question: Column) -> Column:
        chain = None
        for name, group in patterns or C.QUESTION_PATTERNS:
            hit = X.matches_any(question, group, "(?U)")
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain.otherwise(default)

    return X.let(F.lower(col), choose)


def search_depth(query: Column, entities: Column, query_type: Column) -> Column:
    """Hops and number of paths to search for, with the parts that led there."""
    base = F.coalesce(
        F.create_map(*[F.lit(x) for pair in C.DEPTH_BY_TYPE.items() for x in pair])[query_type],
        F.lit(C.DEPTH_DEFAULT),
    )
    entity_bonus = F.when(F.size(entities) >= 3, 2).when(F.size(entities) == 2, 1).otherwise(0)
    keyword_bonus = F.when(X.has_any(query, C.DEPTH_KEYWORDS), 1).otherwise(0)
    low, high = C.DEPTH_RANGE
    hops = F.greatest(F.lit(low), F.least(base + entity_bonus + keyword_bonus, F.lit(high)))
    return F.struct(
        hops.alias("hops"),
        F.when(hops <= 2, 2).otherwise(5).alias("paths"),
        base.alias("base"),
        entity_bonus.alias("entity_bonus"),
        keyword_bonus.alias("keyword_bonus"),
    )
