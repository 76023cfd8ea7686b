"""Counts, yields, samples, manifests and stage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def count_by_array(df: DataFrame, col: str, out: str = "value") -> DataFrame:
    return count_by(df.select(F.explode(col).alias(out)), out)


def filter_yield(df: DataFrame, kept: Column) -> DataFrame:
    """Kept rows, all rows and the percentage."""
    hits = F.count_if(F.coalesce(kept, F.lit(False)))
    rows = F.count(F.lit(1))
    return df.agg(
        hits.alias("kept"), rows.alias("total"),
        F.when(rows > 0, F.round(hits * 100.0 / rows, 1)).otherwise(0.0).alias("percent"),
    )


def text_stats(df: DataFrame, col: str) -> DataFrame:
    size = F.length(col)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.floor(F.sum(size) / F.count(F.lit(1))).alias("avg_length"),
        F.max(size).alias("max_length"),
        F.min(size).alias("min_length"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunk figures per entity type and, with a null type, over all."""
    per_doc = chunks.groupBy("entity_type", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("text_length").alias("chars"))
    return per_doc.rollup("entity_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("n").alias("chunks"),
        F.sum("chars").alias("total_length"),
        F.round(F.sum("n") / F.count(F.lit(1)), 1).alias("chunks_per_document"),
        F.round(F.sum("chars") / F.sum("n"), 1).alias("avg_length"),
    )


def quota_sample(df: DataFrame, pred: Column, n_true: int = 120, n_false: int = 80, order_by: str = "doc_id") -> DataFrame:
    """First rows that match and first rows that do not, in input order, matches first."""
    flag = F.coalesce(pred, F.lit(False))
    hits = df.filter(flag).orderBy(order_by).limit(n_true).withColumn("matched", F.lit(True))
    rest = df.filter(~flag).orderBy(order_by).limit(n_false).withColumn("matched", F.lit(False))
    return hits.unionByName(rest)


def dataset_manifest(df: DataFrame, text: str, category: str, order_by: str, first_n: int = 100) -> DataFrame:
    """Record count, byte size and the categories seen in the first records."""
    size = df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("bytes"))
    head = df.select(order_by, category).orderBy(order_by).limit(first_n)
    seen = head.select(F.explode(category).alias("c")).agg(
        F.array_join(F.array_sort(F.collect_set("c")), "|").alias("categories"))
    return size.withColumn("one", F.lit(1)).join(seen.withColumn("one", F.lit(1)), "one").drop("one")


def stage_report(df: DataFrame, metrics: dict[str, Column], group_by: Sequence[str] = ()) -> DataFrame:
    """Named figures of a stage as columns and as one JSON text."""
    figures = df.groupBy(*group_by).agg(*[c.alias(n) for n, c in metrics.items()])
    return figures.withColumn("report", F.to_json(F.struct(*metrics)))


def union_distinct(*dfs: DataFrame) -> DataFrame:
    result = dfs[0]
    for df in dfs[1:]:
        result = result.unionByName(df)
    return result.distinct()


def pending(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work whose key is not done yet; rows that ended in an error count as done."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")

