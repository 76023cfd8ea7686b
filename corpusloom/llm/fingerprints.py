"""Operator 1: threshold-scaled document fingerprints. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import WORD, ordered

#: One hash in so many is retained, a power of two; words of a shingle.
SCALE, SHINGLE = 8, 5
#: Neighbouring ids whose rows meet in one window, a power of two.
BLOCK = 64


def sketch(text: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the text's shingles that lie below 1 / scale of their range.

    A hash is the first 16 hex digits of the shingle's MD5; a text with fewer words is one shingle,
    a text without words has none. Sketches of parts merge: the sketch of a union is the union.
    """
    bound = format((1 << 64) // scale, "016x")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
    hashes = lambda w: F.transform(starts(w), lambda i: F.md5(F.array_join(F.slice(w, i, shingle), " ").cast("binary")))
    kept = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.filter(hashes(w), lambda h: h < bound)))
    return F.array_sort(F.array_distinct(F.transform(kept[0], lambda h: F.substring(h, 1, 16))))


def printed(text: Column, hashes: Column) -> Column:
    """The fingerprint as text: 16 digits that tell equal texts, then the sketch."""
    return F.concat(F.substring(F.md5(text.cast("binary")), 1, 16), F.lit(":"), F.array_join(hashes, ","))


def hashes_of(fingerprint: Column) -> Column:
    """The sketch of a printed fingerprint."""
    return F.filter(F.split(F.substring(fingerprint, F.lit(18), F.length(fingerprint)), ","), lambda h: h != "")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard similarity of two sketches: 1 for equal texts, else 0 where neither retains a hash."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(equal, 1.0).when(every == 0, 0.0).otherwise(both / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds, whatever the two sizes; null if ``a`` retains none."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def chained(ids: DataFrame) -> DataFrame:
    """(block, top, above) of every block of ids: its largest id, and the block whose smallest id that id follows.

    By descending id a block's smallest id is followed by the largest id of the next lower block; the
    lowest block is followed by the highest.
    """
    tops = ids.filter("doc_id is not null").groupBy("block").agg(F.max("doc_id").alias("top"))
    placed = ordered(tops, [F.col("block")])
    n = placed.count()
    follow = placed.select(F.col("block").alias("above"), F.pmod(F.col("idx") - 1, F.lit(max(n, 1))).alias("idx"))
    return placed.join(follow, "idx").select("block", "top", "above")


def fingerprint_edits(docs: DataFrame, scale: int = SCALE, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited) of every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many (or
    all) of the start of the next document, by descending id, the last followed by the first. Texts
    are shuffled once, by blocks of ``BLOCK`` neighbouring ids, and meet the next text in a window over
    the block; only the top row of each block is sent on to the block above. A block holds the rows of
    ``BLOCK`` ids, so no task grows with the input unless one id repeats.

    A null text is empty; an empty text has an empty sketch. Of rows that share an id, the least text
    is the next one of others. A row without id has an empty next text. Other columns are left out;
    an empty table gives an empty one.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows without id are dealt out by text, under numbers that no block of ids has.
    alone = F.lit(-(1 << 63)) + F.xxhash64("text").bitwiseAND(F.lit((1 << 20) - 1))
    block = F.shiftright("doc_id", BLOCK.bit_length() - 1)
    chain = chained(given.select("doc_id", block.alias("block")))
    mine = printed(F.col("text"), sketch(F.col("text"), scale, shingle))
    # Both uses take all columns and rows of this exchange and join by its key alone, so Spark runs it once and reads it twice.
    dealt = given.withColumn("block", F.coalesce(block, alone)).repartition("block")
    at_top = (F.col("block") == F.col("of")) & (F.coalesce(F.col("doc_id").bitwiseXOR(F.col("top")), F.lit(1)) == 0)
    tops = dealt.join(chain.withColumnRenamed("block", "of"), at_top)
    tops = tops.select("above", F.struct("text", mine.alias("fingerprint")).alias("entering")).groupBy("above").agg(F.min("entering").alias("entering"))
    rows = dealt.join(tops, F.col("block") == F.col("above"), "left").withColumn("fingerprint", mine)
    by_id = Window.partitionBy("block").orderBy("doc_id", F.desc("text"))
    of_id = Window.partitionBy("block", "doc_id").orderBy(F.desc("text"))
    rows = rows.withColumn("before", F.lag(F.struct("text", "fingerprint")).over(by_id)).withColumn("before", F.first("before").over(of_id))
    rows = rows.withColumn("next", F.when(F.col("doc_id").isNotNull(), F.coalesce("before", "entering")))
    start = F.coalesce(F.col("next.text"), F.lit(""))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - half)"), F.substring(start, F.lit(1), F.col("half"))))
    rows = rows.withColumn("edited_fingerprint", printed(F.col("edited"), sketch(F.col("edited"), scale, shingle)))
    rows = rows.withColumn("next_fingerprint", F.coalesce(F.col("next.fingerprint"), F.lit("")))
    mine, edited, after = (hashes_of(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    head = lambda c: F.substring(c, 1, 16)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(mine, edited, head("fingerprint") == head("edited_fingerprint")).alias("near_edited"),
        likeness(mine, after, head("fingerprint") == head("next_fingerprint")).alias("near_next"),
        containment(mine, edited).alias("in_edited"),
    )
