"""Finding dictionary names in texts."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.tables import spread

_WORD = re.compile(r"[^\W_]+")
SLICE_NAMES = 20_000    # names counted in one pass over the texts
BLOCK_CHARS = 1 << 22   # of the texts that one task looks through together
SIEVE_BITS = 1 << 25    # of the fixed-size table that tells runs of words which cannot be a name


def _resolve(candidates: list[tuple[int, int, str]]) -> list[tuple[str, int]]:
    """(start, end, name) candidates to accepted names: longest first, no overlaps, first start."""
    candidates.sort(key=lambda c: (c[0] - c[1], c[2].lower(), c[0]))
    taken = bytearray(max((c[1] for c in candidates), default=0))
    kept: dict[str, int] = {}
    for start, end, name in candidates:
        # Every accepted span is at least as long, so an overlap covers an end of this one.
        if not taken[start] and not taken[end - 1]:
            taken[start:end] = b"\x01" * (end - start)
            kept[name] = min(start, kept.get(name, start))
    return list(kept.items())


def _stands_free(text: str, low: str, start: int) -> bool:
    """A name with outer punctuation needs that punctuation, and a free border, in the text."""
    end = start + len(low)
    return (
        start >= 0 and text.startswith(low, start)
        and (start == 0 or not text[start - 1].isalnum())
        and (end >= len(text) or not text[end].isalnum())
    )


class _Names:
    """Dictionary entries by core, and the word counts of the cores that start with a word."""

    def __init__(self, rows: Iterable[tuple[str, str, str, int, int]]):
        self.by_core: dict[str, list[tuple[str, str, int]]] = {}
        self.lengths: dict[str, set[int]] = {}
        for core, name, low, lead, words in rows:
            self.by_core.setdefault(core, []).append((name, low, lead))
            self.lengths.setdefault(_WORD.search(core).group(), set()).add(words)

    def find(self, text: str) -> list[tuple[str, int]]:
        spans = [m.span() for m in _WORD.finditer(text)]
        hits = []
        for i, (start, end) in enumerate(spans):
            for words in self.lengths.get(text[start:end], ()):
                if i + words > len(spans):
                    continue
                for name, low, lead in self.by_core.get(text[start:spans[i + words - 1][1]], ()):
                    if _stands_free(text, low, start - lead):
                        hits.append((start - lead, start - lead + len(low), name))
        return _resolve(hits)


_ENTRY = ["core", "name", "low", "lead", "words"]


def _shared_finder(dictionary: DataFrame):
    """UDF from a text to its mentions, for a dictionary that its caller knows to be small."""
    shared = dictionary.sparkSession.sparkContext.broadcast(_Names(tuple(r) for r in dictionary.select(*_ENTRY).collect()))

    @F.pandas_udf("array<struct<name:string,start:int>>")
    def find(lowered: pd.Series) -> pd.Series:
        known = shared.value
        return lowered.map(lambda t: [] if t is None else known.find(t))

    return find


def _sieve(dictionary: DataFrame) -> tuple[int, bytes]:
    """Words of the longest core, and one bit for the checksum of each core and of its first word.

    The table has the same size for any dictionary: its tasks build blocks of 32,768 bits, and only the
    ``SIEVE_BITS / 32768`` blocks reach the driver.
    """
    entry = F.explode(F.array(F.concat(F.lit("="), F.col("core")), F.concat(F.lit("^"), F.regexp_extract("core", r"^[\p{L}\p{N}]+", 0))))
    places = dictionary.select("words", entry.alias("entry")).withColumn("at", F.pmod(F.crc32(F.col("entry").cast("binary")), F.lit(SIEVE_BITS)))
    blocks = places.groupBy(F.floor(F.col("at") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"), F.max("words").alias("words")).collect()
    table = bytearray(SIEVE_BITS // 8)
    for r in blocks:
        table[r["block"] * 4096 : (r["block"] + 1) * 4096] = r["bits"]
    return max((r["words"] for r in blocks), default=1), bytes(table)


def _found_in_blocks(lowered: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions (text_id, name, start) of texts dealt over blocks, each with the dictionary entries that occur in it.

    A block hands in each run of words once, and only runs that start like a name and whose checksum is that of a name;
    next to none of them miss. So what meets the dictionary grows with blocks and their distinct words, not with every
    place where a frequent word stands, and a task holds one block and the entries found in it.
    """
    longest, table = _sieve(dictionary)
    shared = lowered.sparkSession.sparkContext.broadcast(table)  # SIEVE_BITS / 8 bytes
    chars = lowered.agg(F.coalesce(F.sum(F.length("low_text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(lowered.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / BLOCK_CHARS))
    dealt = lowered.filter(F.col("low_text").isNotNull()).withColumn("block", F.pmod(F.xxhash64("text_id"), F.lit(blocks)).cast("int"))

    def runs(texts: pd.DataFrame) -> pd.DataFrame:
        bits, size, crc = shared.value, SIEVE_BITS, zlib.crc32
        hat, is_core, found = crc(b"^"), crc(b"="), set()
        for text in texts["low_text"]:
            spans = [m.span() for m in _WORD.finditer(text)]
            for i, (start, end) in enumerate(spans):
                at = crc(text[start:end].encode(), hat) % size
                if bits[at >> 3] >> (at & 7) & 1:
                    for j in range(i, min(i + longest, len(spans))):
                        run = text[start : spans[j][1]]
                        if run not in found:
                            at = crc(run.encode(), is_core) % size
                            if bits[at >> 3] >> (at & 7) & 1:
                                found.add(run)
        return pd.DataFrame({"block": texts["block"].iloc[0], "core": sorted(found)})

    def find(texts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        known = _Names(entries[_ENTRY].itertuples(index=False, name=None))
        rows = [(key, name, start) for key, text in zip(texts["text_id"], texts["low_text"]) for name, start in known.find(text)]
        return pd.DataFrame(rows, columns=["text_id", "name", "start"])

    seen = dealt.select("block", "low_text").groupBy("block").applyInPandas(runs, "block int, core string")
    met = seen.join(dictionary, "core").select("block", *_ENTRY)
    out = f"text_id {lowered.schema['text_id'].dataType.simpleString()}, name string, start int"
    return dealt.groupBy("block").cogroup(met.groupBy("block")).applyInPandas(find, out)


def find_mentions(texts: DataFrame, names: DataFrame, text_col: str = "text", key: str = "text_id",
                  share: bool = False) -> DataFrame:
    """Names found in texts: whole words, case ignored, longest first, no overlaps; first
    occurrence of each name: (key, name, start).

    A name is looked up by its core (first to last letter or digit) among the word runs of the text. A table of fixed
    size, whatever the number of names, holds back runs that cannot be a name, and what is left of a block of texts, each run
    once, meets the dictionary in a hash join, so no task and no driver ever holds the dictionary. A caller
    who knows that it is small can ``share`` it with the tasks instead. Both give the same rows.
    """
    dictionary = (
        names.select(F.col("name")).filter(F.col("name").rlike(r"[\p{L}\p{N}]"))
        .groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
        .withColumn("core", F.regexp_extract("low", r"[\p{L}\p{N}](?s:.*[\p{L}\p{N}])?", 0))
        .withColumn("words", F.size(F.regexp_extract_all("core", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))
        .withColumn("lead", F.expr("locate(core, low) - 1"))
    )
    lowered = texts.select(F.col(key).alias("text_id"), F.lower(text_col).alias("low_text"))
    if share:
        found = spread(lowered).select("text_id", F.explode(_shared_finder(dictionary)(F.col("low_text"))).alias("m"))
        found = found.select("text_id", "m.name", "m.start")
    else:
        found = _found_in_blocks(lowered, dictionary)
    return found.withColumnRenamed("text_id", key)


def mention_counts(docs: DataFrame, names: DataFrame, text_col: str = "content", key: str = "doc_id",
                   slice_names: int = SLICE_NAMES) -> DataFrame:
    """How often each name occurs in each text as a substring, case ignored: (key, name, n).

    Names are distinct and few next to the texts. They are shared with the tasks in slices of a
    checked size, each a pass over the texts; usually there is one slice.
    """
    low = names.select(F.lower("name").alias("name")).filter("name <> ''").distinct()
    slices = max(1, math.ceil(low.count() / slice_names))
    texts = spread(docs.select(F.col(key).alias("key"), F.lower(text_col).alias("low_text")))
    out = f"key {docs.schema[key].dataType.simpleString()}, name string, n bigint"
    result = None
    for s in range(slices):
        part = low if slices == 1 else low.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == s)
        shared = docs.sparkSession.sparkContext.broadcast(sorted(r["name"] for r in part.collect()))

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            present = _finder(shared.value)
            for batch in batches:
                rows = [
                    (k, name, text.count(name))
                    for k, text in zip(batch["key"], batch["low_text"]) if text is not None
                    for name in present(text)
                ]
                yield pd.DataFrame(rows, columns=["key", "name", "n"])

        one = texts.mapInPandas(count, out)
        result = one if result is None else result.unionByName(one)
    return result.withColumnRenamed("key", key)


def _finder(names: list[str]):
    """Function from a text to the names that occur in it."""
    if len(names) <= 200:
        return lambda text: [n for n in names if n in text]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [n for n in names if n in text]
    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(name, name)
    automaton.make_automaton()
    return lambda text: sorted({name for _, name in automaton.iter(text)})


def resolve_aliases(mentions: DataFrame, aliases: DataFrame, col: str = "name") -> DataFrame:
    """Canonical name of a mention by its lower-cased alias, else the mention itself."""
    known = aliases.select(F.lower("alias").alias("__low"), "canonical_name").groupBy("__low").agg(
        F.max("canonical_name").alias("__canonical"))
    joined = mentions.join(known, F.lower(col) == F.col("__low"), "left")
    return joined.withColumn("canonical", F.coalesce("__canonical", F.col(col))).drop("__low", "__canonical")


