"""Approximate vector top-k over inverted lists that are kept as a table."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ranking import top_per_key
from corpusloom.operators.similarity import _best, _output_type, _unit_rows
from corpusloom.session import written
from corpusloom.tables import beside

#: Rows that the centres are fitted on at most (the first by a hash of their ids), and rounds of the fit.
SAMPLE, ROUNDS = 16_384, 12
#: Rows of a list that one task scores, and queries that it scores them for; longer lists, and more queries of a list, are dealt over several.
TASK_ROWS, TASK_QUERIES = 20_000, 32_768


def fit_centres(vectors: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centres; a centre that lost all rows starts again at the row that is worst off."""
    rows = vectors[np.abs(vectors).sum(axis=1) > 0]
    if not len(rows):
        return np.zeros((1, vectors.shape[1]))
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:lists]]
    for _ in range(rounds):
        near = rows @ centres.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        lost = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[lost] = rows[np.argsort(best, kind="stable")[: len(lost)]]
        centres = _unit_rows(sums)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centres of each vector, nearest first."""
    n = min(n, len(centres))
    return np.argsort(-np.round(vectors @ centres.T, 12), axis=1, kind="stable")[:, :n]


class VectorIndex:
    """Vectors under their nearest centre, one folder per list, with the centres and list sizes beside them.

    The centres come from a bounded sample; every row of the corpus is in exactly one list. A query scores the
    rows of its ``probes`` nearest lists exactly, and only the folders of lists that some query asks for are read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, corpus: DataFrame, lists: int | None = None, item_id: str = "item_id", item_vec: str = "embedding", sample: int = SAMPLE) -> VectorIndex:
        """Fit the centres (by default about the root of the sample's size) and write every row under its list."""
        rows = corpus.select(F.col(item_id).alias("item_id"), F.col(item_vec).cast("array<double>").alias("item_vec")).filter(F.col("item_vec").isNotNull())
        some = rows.orderBy(F.xxhash64("item_id"), "item_id").limit(sample).collect()
        vectors = _unit_rows([r.item_vec for r in some]) if some else np.zeros((1, 1))
        centres = fit_centres(vectors, lists or max(1, round(math.sqrt(len(vectors)))))
        shared = self.spark.sparkContext.broadcast(centres)  # lists x width figures

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = nearest(_unit_rows(batch.column(1).to_pylist()), shared.value, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["item_id", "item_vec", "list"])

        kind = rows.schema["item_id"].dataType.simpleString()
        placed = written(rows.mapInArrow(place, f"item_id {kind}, item_vec array<double>, list int"))
        sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        placed.repartition("list", F.pmod(F.xxhash64("item_id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/lists")
        sizes.write.mode("overwrite").parquet(f"{self.path}/sizes")
        table = [(i, json.dumps(c.tolist())) for i, c in enumerate(centres)]
        self.spark.createDataFrame(table, "list int, centre string").write.mode("overwrite").parquet(f"{self.path}/centres")
        return self

    def _probed(self, queries: DataFrame, probes: int, query_id: str, query_vec: str) -> DataFrame:
        """(query_id, query_vec, list) for the lists that each query looks at."""
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()
        shared = self.spark.sparkContext.broadcast(np.array([json.loads(r.centre) for r in rows]))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = nearest(_unit_rows(batch.column(1).to_pylist()), shared.value, probes)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.int32()))], names=["query_id", "query_vec", "lists"])

        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("query_vec")).filter(F.col("query_vec").isNotNull())
        kind = asked.schema["query_id"].dataType.simpleString()
        found = written(asked.mapInArrow(look, f"query_id {kind}, query_vec array<double>, lists array<int>"))
        return found.select("query_id", "query_vec", F.explode("lists").alias("list"))

    def _met(self, asked: DataFrame, task_rows: int, task_queries: int) -> tuple[DataFrame, DataFrame]:
        """The queries of ``_probed`` and the rows of the lists that they look at, each under the (list, salt, block) of the tasks where they meet.

        A query goes to each salt of a list and a row to each block of its queries, so a task has about ``task_rows`` rows
        and ``task_queries`` queries at most, however many look at one list.
        """
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        visits = asked.groupBy("list").agg(F.count(F.lit(1)).alias("visits"))
        counted = sizes.join(visits, "list").select(
            "list", F.ceil(F.col("n") / task_rows).cast("int").alias("salts"), F.ceil(F.col("visits") / task_queries).cast("int").alias("blocks"))
        counted = beside(counted)  # a row per list
        left = asked.join(counted, "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        left = left.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(11)), F.col("blocks")).cast("int"))
        right = self.spark.read.parquet(f"{self.path}/lists").join(counted, "list")
        right = right.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.col("salts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["list", "salt", "block"]
        return left.select("query_id", "query_vec", *keys), right.select("item_id", "item_vec", *keys)

    def topk(self, queries: DataFrame, k: int = 8, probes: int = 8, query_id: str = "query_id", query_vec: str = "embedding", task_rows: int = TASK_ROWS,
             task_queries: int = TASK_QUERIES) -> DataFrame:
        """(query_id, item_id, score, rank): the ``k`` best rows of the probed lists by exact cosine, ids breaking ties.

        A list longer than ``task_rows`` is dealt over as many tasks as it needs, and its queries visit each; more queries than
        ``task_queries`` are dealt in blocks, each of which meets the list. A task multiplies tiles and hands on ``k`` rows per query.
        """
        left, right = self._met(self._probed(queries, probes, query_id, query_vec), task_rows, task_queries)
        out = _output_type(queries, right, query_id, "item_id")

        def score(asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(items):
                return pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "item_id": items["item_id"].iloc[:0], "score": np.zeros(0)})
            at, item, value = _best(_unit_rows(asked["query_vec"]), np.zeros(len(asked), dtype=object), items, (), k)
            return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[at], "item_id": item, "score": value})

        keys = ["list", "salt", "block"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, out)
        return top_per_key(met, ["query_id"], [F.desc("score"), F.col("item_id")], k, "rank")

    def share(self, queries: DataFrame, probes: int = 8, query_id: str = "query_id", query_vec: str = "embedding") -> float:
        """The share of all pairs of a query and a row that ``topk`` scores."""
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        scored = self._probed(queries, probes, query_id, query_vec).join(sizes, "list").agg(F.sum("n")).first()[0] or 0
        return scored / max(1, queries.count() * (sizes.agg(F.sum("n")).first()[0] or 0))
