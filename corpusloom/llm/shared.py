"""Helpers that several of these operators use: words, a global order and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_folder

#: A word: a run of anything but the six ASCII blanks. The same text works in Spark, DuckDB and ``re``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that the cluster names in ``spark.checkpoint.dir`` and read
    again: what follows starts from these files, whichever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def no_cycles() -> Iterator[None]:
    """For task code that makes many lasting objects but no reference cycles: they are not searched for cycles again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def give_back() -> None:
    """Return what this worker has freed to the system: it stays alive between tasks, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def numbered(df: DataFrame) -> tuple[DataFrame, str, list[Column]]:
    """``df`` stored with a number per row, the name of that column (none that ``df`` has) and the columns of ``df``."""
    name = "__row"
    while name in (c.lower() for c in df.columns):
        name += "_"
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return stored(df.select(*own, F.monotonically_increasing_id().alias(name))), name, own


def map_rows(df: DataFrame, run) -> DataFrame:
    """``df.mapInArrow`` with the columns of ``df`` in and out, by position, so that any column names will do."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``idx``: the row's position 0, 1, 2, ... in the given order over all rows.

    Rows are dealt out by range and sorted inside their partition, so no task holds more than its
    share. The partition number and the row's place in it are fixed by a checkpoint; then only one
    count per partition is summed up. Rows that tie in the order get some positions of their own.
    """
    names = [f"__order_{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    dealt = keyed.repartitionByRange(*[F.col(n).asc_nulls_last() for n in names])
    dealt = dealt.sortWithinPartitions(*[F.col(n).asc_nulls_last() for n in names]).drop(*names)
    dealt = stored(dealt.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    sizes = {r["__part"]: r["__rows"] for r in sizes.collect()}  # one number per partition
    starts, total = {}, 0
    for k in sorted(sizes):
        starts[k], total = total, total + sizes[k]
    if not starts:
        return dealt.withColumn("idx", F.lit(0).cast("long")).drop("__row")
    start = F.array(*[F.lit(starts.get(k, 0)).cast("long") for k in range(max(starts) + 1)])
    place = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("idx", F.element_at(start, (part + 1).cast("int")) + place).drop("__row")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node that links reach.

    In each round every node points to its smallest neighbour, pointers are followed one step
    further, edges are rewritten to the nodes pointed to, and those that became loops or repeats go.
    Every node with a smaller neighbour leaves, so rounds grow with the logarithm of the longest
    chain. Minima are taken before the shuffle, and a hub meets only joins, which Spark can split.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    live = edges.select(low.alias("a"), high.alias("b")).filter("a <> b").distinct()
    live = stored(live)
    roots = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        down = down.select("u", F.least("u", "m").alias("p"))
        further = down.select(F.col("u").alias("p"), F.col("p").alias("q"))
        down = stored(down.join(further, "p").select("u", "q"))
        at_a = down.select(F.col("u").alias("a"), F.col("q").alias("qa"))
        at_b = down.select(F.col("u").alias("b"), F.col("q").alias("qb"))
        moved = live.join(at_a, "a").join(at_b, "b").filter("qa <> qb")
        live = stored(moved.select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b")).distinct())
        step = down.select(F.col("u").alias("root"), "q")
        roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("q", "root").alias("root")))
    return roots


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of row numbers that connect what the symmetric boolean matrix connects, without circles."""
    unseen, pairs = np.ones(len(near), dtype=bool), []
    for first in range(len(near)):
        if not unseen[first]:
            continue
        unseen[first], stack = False, [first]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(near[at] & unseen)
            unseen[found] = False
            pairs += [(at, int(x)) for x in found]
            stack += found.tolist()
    return pairs
