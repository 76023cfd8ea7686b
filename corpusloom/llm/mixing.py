"""Operator 2: mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import WORD, ordered, stored

#: Words to take, as a share of all words; most copies of a word; weights of the sources in turn.
SHARE, MOST, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, first, target) of every source, from (source, source_size, first).

    Sources by code point, null last, weigh ``weights`` in turn. Targets are proportional to weight,
    stop at ``most`` times their source's size, and the excess is shared again by weight until none
    is above: each round reads two sums, and there are as many rounds as a further source reaches
    its stop, at most one per source.
    """
    turn = ordered(sizes, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    turn = stored(turn.withColumn("weight", weight).drop("idx"))
    stop, size = most * F.col("source_size"), F.col("source_size")
    total, level = turn.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"], 0.0
    while True:
        full = F.col("weight") * level > stop
        held, free = turn.agg(F.sum(F.when(full, size).otherwise(0)).alias("a"), F.sum(F.when(~full, F.col("weight"))).alias("b")).first()
        raised = (share * total - most * (held or 0)) / free if free else level
        if raised == level:
            break
        level = raised
    return turn.withColumn("target", F.least(F.col("weight") * level, stop)).drop("weight")


def offset(seed: str):
    """A number in [0, 1) drawn for each source: the first 20 bits of a digest of seed and source."""
    text = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 5), 16, 10).cast("double") / float(1 << 20)


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix",
        id_col: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(doc_id, source, copies, size, source_size, target, taken) of every row of ``docs``, and its number ``row`` where a
    column of row numbers is named.

    A row's size is its number of words. Within a source every document is expected target / size of
    the source times. Documents stand in order of size, then id; their expected copies are summed up
    to each document's end, one random offset is added, and a document is taken once for each whole number
    crossed. Standing in order of size makes the words taken come near the target. No sum runs through one task: places come
    from a range partitioning over all sources at once, so a source with most rows is spread like the rest.

    Null texts have no words; a null source is a source of its own, the last; a source without words has
    target 0. Repeated rows take their own places (which of several equal rows is taken doesn't matter, but the ids
    of rows that tie in size, id and text do not differ either). Other columns are left out; an empty table gives an empty one.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    number = [F.col(row).alias("row")] if row else []
    sized = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), *number))
    placed = ordered(sized, [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), *(["row"] if row else [])])
    per_source = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("idx").alias("first"))
    goal = targets(per_source, share, most, weights)
    known = placed.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place, shift = (F.col("idx") - F.col("first")).cast("double"), offset(seed)
    copies = (F.floor((place + 1) * each + shift) - F.floor(place * each + shift)).cast("int")
    known = known.withColumn("copies", copies)
    return known.select("doc_id", "source", "copies", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row else []))
