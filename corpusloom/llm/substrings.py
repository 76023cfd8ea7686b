"""Operator 6: repeated passages by level-wise doubling of windows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import WORD, stored

#: Fixed odd multipliers of the two rolling hashes.
FACTORS = (6364136223846793005, 2862933555777941757)
#: Words whose hash a Python worker keeps.
KEPT_WORDS = 200_000
WORDS = re.compile(WORD)


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > KEPT_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A hash of every window of so many words, by doubling: a window's hash comes from its two halves.

    The halves overlap where the length is odd. The last step mixes the bits.
    """
    if len(hashes) < length:
        return np.empty(0, dtype=np.uint64)
    at, have, f = hashes, 1, np.uint64(factor)
    while have < length:
        step = min(have, length - have)
        at, have = (at[: len(at) - step] * f) ^ (at[step:] + (at[step:] >> np.uint64(31))), have + step
    at = (at ^ (at >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return at ^ (at >> np.uint64(32))


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    if len(hashes) < width:
        return hashes[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        hashes, have = np.minimum(hashes[: len(hashes) - step], hashes[step:]), have + step
    return hashes


def levels(length: int, start: int) -> list[int]:
    """Window lengths, each at most twice the one before, up to ``length``."""
    out = [length]
    while out[-1] > start:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def anchors(hashes: np.ndarray, short: int, length: int) -> np.ndarray:
    """For every window of ``length`` words the least hash of the windows of ``short`` words in it."""
    return smallest(window_hashes(hashes, short, FACTORS[0]), length - short + 1)


def class_of(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, r, n_words, whole): the number of words and the digest of their sequence; r tells texts under one id apart."""

    def run(batches):
        for batch in batches:
            n, whole = [], []
            for t in batch.column(2):
                words = WORDS.findall(t.as_py() or "")
                n.append(len(words))
                whole.append(hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(whole, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "r", "n_words", "whole"])

    return docs.mapInArrow(run, "doc_id long, r int, n_words long, whole binary")


def without_repeats(docs: DataFrame, length: int = 50, start: int = 25, digests: bool = False,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every word covered by a window of ``length`` words goes if
    that sequence of words also starts in a document with a smaller id.

    Level by level, windows repeated at one length alone are tried at twice that length, until the
    wanted one is reached or none is left. At the first level, windows are chosen by their content:
    every window of the next length hands in the least hash in it, so two equal long windows hand in
    the same one, and about two windows in a dozen words are counted instead of all. Documents with equal
    words are counted once, by their smallest id; the others lose all words if they have ``length`` or
    more. Two independent 64-bit hashes stand for a window at the last level. ``kept`` is the text
    left, its words joined by one blank, or its SHA-256 with ``digests``.

    A null text has no words. Rows that share an id are not earlier than each other; a row without id
    is kept whole and makes nothing repeat. Other columns are left out; an empty table gives an empty one.
    """
    given = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"hash(`{text}`) r", f"`{text}` text")
    sizes = levels(length, start)
    if len(sizes) == 1:
        raise ValueError("start must be shorter than length")
    sums = stored(measured(given))
    firsts = sums.filter("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("first"))
    sums = sums.join(firsts, "whole", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    worked = sums.filter((F.col("n_words") >= length) & ~F.col("copy") & F.col("doc_id").isNotNull())
    worked = worked.select(F.col("doc_id").alias("id"), "r").distinct()

    def first(batches):
        known: dict[str, int] = {}
        for batch in batches:
            out = [[], [], [], []]
            for i, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = WORDS.findall(t.as_py())
                a = np.unique(anchors(word_hashes(words, known), sizes[0], sizes[1])).view(np.int64)
                for k, v in enumerate((i, r, class_of(words), a)):
                    out[k].append(a if k == 3 else np.full(len(a), v, dtype=np.int32 if k == 1 else np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["id", "r", "c", "h"])

    def longer(level: int):
        """Windows of this level that hold a window repeated at the level before."""

        def run(batches):
            known: dict[str, int] = {}
            for batch in batches:
                out = [[], [], [], [], [], []]
                for i, r, t, had in zip(*[batch.column(k).to_pylist() for k in (0, 1)], batch.column(2), batch.column(3)):
                    words = WORDS.findall(t.as_py())
                    hashes, had = word_hashes(words, known), had.values.to_numpy().view(np.uint64)
                    if level == 1:
                        held = np.isin(anchors(hashes, sizes[0], sizes[1]), had)
                    else:
                        short = np.isin(window_hashes(hashes, sizes[level - 1], FACTORS[0]), had)
                        held = short[: len(hashes) - sizes[level] + 1] & short[sizes[level] - sizes[level - 1] :]
                    at = np.flatnonzero(held)
                    h = window_hashes(hashes, sizes[level], FACTORS[0])[at].view(np.int64)
                    g = window_hashes(hashes ^ np.uint64(FACTORS[1]), sizes[level], FACTORS[1])[at].view(np.int64)
                    full = [np.full(len(at), v, dtype=np.int32 if k == 1 else np.int64) for k, v in enumerate((i, r, class_of(words)))]
                    for k, v in enumerate((*full, h, g, at.astype(np.int32))):
                        out[k].append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["id", "r", "c", "h", "g", "at"])

        return run

    rows = stored(given.filter("doc_id is not null and text is not null").mapInArrow(first, "id long, r int, c long, h long"))
    for level in range(1, len(sizes)):
        seen = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"))
        held = rows.join(seen.filter("low < high").select("h"), "h").join(worked, ["id", "r"], "left_semi")
        held = held.groupBy("id", "r").agg(F.collect_set("h").alias("had")).withColumnRenamed("r", "q")
        near = given.join(held.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.col("r") == F.col("q")))
        near = near.select("id", "r", "text", "had").mapInArrow(longer(level), "id long, r int, c long, h long, g long, at int")
        rows = stored(near)

    lowest = rows.groupBy("h", "g").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("h", "g", "low")
    gone = rows.join(lowest, ["h", "g"]).filter("low < id").groupBy("id", F.col("r").alias("q")).agg(F.collect_set("at").alias("starts"))
    gone = stored(gone)

    def cut(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for t, starts in zip(batch.column(1), batch.column(2)):
                words = WORDS.findall(t.as_py())
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                starts = starts.values.to_numpy()
                edge[starts] += 1
                edge[starts + length] -= 1
                stays = np.cumsum(edge)[:-1] == 0
                n.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                left = " ".join([w for w, s in zip(words, stays.tolist()) if s])
                kept.append(hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest() if digests else left)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    here = (F.col("doc_id") == F.col("id")) & (F.col("r") == F.col("q"))
    touched = given.join(gone.hint("shuffle_hash"), here).select("doc_id", "text", "starts")
    touched = touched.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
    whole_copy = F.col("copy") & (F.col("n_words") >= length)
    dropped = sums.filter(whole_copy).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), (F.sha2(F.lit(""), 256) if digests else F.lit("")).alias("kept"))
    none = F.lit(0).cast("long").alias("n_removed")
    if digests:
        same = sums.filter(~whole_copy).join(gone.select("id", "q"), here, "left_anti")
        same = same.select("doc_id", "n_words", none, F.lower(F.hex("whole")).alias("kept"))
    else:
        away = gone.select("id", "q").unionByName(sums.filter(whole_copy).select(F.col("doc_id").alias("id"), F.col("r").alias("q")).distinct())
        same = given.join(away.hint("shuffle_hash"), here, "left_anti")
        count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
        words = F.coalesce(F.array_join(F.regexp_extract_all("text", F.lit(WORD), 0), " "), F.lit(""))
        same = same.select("doc_id", count, none, words.alias("kept"))
    return touched.unionByName(dropped).unionByName(same)
