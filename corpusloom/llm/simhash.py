"""Operator 7: SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import components, forest, stored
from corpusloom.tables import by_key

#: Blocks of a fingerprint; keys of a table join more rows than this in tiles, of this many rows each.
BLOCKS, CROWD, TILE = 7, 64, 1024


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits, signed: a bit is 1 if set in over half the shingles' hashes; no words give zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(words, len(found)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(line[a:b], seed) for a, b in zip(starts.tolist(), last)], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; null and blank texts have fingerprint zero."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fingerprint"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, fingerprint long")


def masks(blocks: int, distance: int) -> list[int]:
    """For each choice of ``blocks - distance`` blocks the signed mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def links(prints: DataFrame, distance: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) fingerprints that connect what ``distance`` or fewer differing bits connect.

    Two fingerprints that differ in at most ``distance`` bits agree in at least
    ``blocks - distance`` blocks, so each choice of so many blocks is a table of keys and a close
    pair meets in one of them. A key with few fingerprints meets in a join. A crowded key is dealt
    over tiles of about ``TILE`` rows; every two tiles meet in one small group that hands on a
    spanning forest, not the pairs. Both ways are exact, and no group grows with the crowd.

    Keys are dealt, never sent whole: Spark takes them for as large as the fingerprints that they are made of.
    """
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(blocks, distance))])
    keyed = prints.select(F.col("fingerprint").alias("f")).distinct().select("f", F.explode(table).alias("x")).select("f", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(by_key(sizes), ["t", "k"])

    few = met.filter(F.col("n") <= CROWD).drop("n")
    other = few.withColumnRenamed("f", "g")
    close = few.join(by_key(other), ["t", "k"]).filter((F.col("f") < F.col("g")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= distance))
    close = close.select(F.col("f").alias("a"), F.col("g").alias("b"))

    crowd = met.filter(F.col("n") > CROWD).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    crowd = crowd.withColumn("mine", F.pmod(F.xxhash64("f"), F.col("tiles")).cast("int"))
    crowd = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    crowd = crowd.select("t", "k", "f", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def span(group: pa.Table) -> pa.Table:
        f = group.column("f").to_numpy()
        bits = f.view(np.uint64)  # signed numbers would be counted without their sign
        pairs = forest(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance) if len(f) else []
        ends = [pa.array(f[[p[side] for p in pairs]] if pairs else [], pa.int64()) for side in (0, 1)]
        return pa.Table.from_arrays(ends, names=["a", "b"])

    return close.unionByName(crowd.groupBy("t", "k", "i", "j").applyInArrow(span, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42, blocks: int = BLOCKS,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows with equal fingerprints form one class, stood for by its smallest id; classes whose
    fingerprints differ in at most ``distance`` bits link, and component_id is the smallest id that
    links reach. Null and blank texts have fingerprint zero and link like any other. Repeated rows
    are returned as often as given; a row without id belongs to its class but gives it no name (null
    if the class has no other); other columns are left out; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, words, seed, id_col, text))
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("name"))
    roots = components(links(classes, distance, blocks))
    named = roots.join(classes, roots.node == classes.fingerprint).select("node", "root", "name")
    smallest = named.groupBy("root").agg(F.min("name").alias("component_id"))
    found = named.join(smallest, "root").select(F.col("node").alias("fingerprint"), "component_id")
    found = classes.join(found, "fingerprint", "left")
    found = found.select("fingerprint", F.coalesce("component_id", "name").alias("component_id"))
    found = stored(found)  # so that Spark may split the rows of a fingerprint that very many share
    return prints.join(found, "fingerprint").select("doc_id", "fingerprint", "component_id")
