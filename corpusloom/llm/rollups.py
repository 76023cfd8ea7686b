"""Operator 3: token totals kept up to date by signed changes."""

from __future__ import annotations

import re
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import BLOCK_ROWS, words_of
from corpusloom.llm.shared import WORD, no_cycles
from corpusloom.sources.writers import latest_version

KEYS = ("source", "lang", "version")
SUMS = "source string, lang string, version string, docs long, tokens long"
LOG = "batch string, place string, at long"
STATE = "doc_id long, source string, lang string, version string, tokens long"


def token_counts(docs: DataFrame, vocabulary: str | None = None, version: str = "words", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, lang, version, tokens) of every row: tokens of a vocabulary file, or words without one.

    A null text has no tokens; null sources and languages stay null, a group of their own.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text).alias("text"))
    if vocabulary is None:
        words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        return given.select("doc_id", "source", "lang", F.lit(version).alias("version"), words.alias("tokens"))
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        coder = words_of(spec.value)
        try:
            with no_cycles():
                for batch in batches:
                    for at in range(0, batch.num_rows, BLOCK_ROWS):
                        block = batch.slice(at, BLOCK_ROWS)
                        counts = coder.count_texts([t or "" for t in block.column(3).to_pylist()])
                        columns = [*block.columns[:3], pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "lang", "version", "tokens"])
        finally:
            coder.forget()

    return given.mapInArrow(run, STATE)


def inserted(state: DataFrame) -> DataFrame:
    """Changes that add every row of a state."""
    return state.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deleted(state: DataFrame) -> DataFrame:
    """Changes that take every row of a state away."""
    return state.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from one count of documents to another: the old one goes, the new one comes."""
    return deleted(before).unionByName(inserted(after))


class TokenRollup:
    """Additive totals by source, language and tokenizer version in a folder that all executors share.

    Each batch of changes is summed up by key, written to a folder of its own and then named in a log, so a batch counts
    as a whole or not at all, and readers miss nothing while it is written again: of several entries of a batch the
    newest counts. ``fold`` adds the open batches to the maintained totals, which keep the ids of the batches
    they hold; a late retry of one of those is passed over. So totals read one row per key and what came since, however long
    the history is. Batches commute, so late ones may come in any order. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, fold_after: int = 16):
        self.spark, self.folder, self.fold_after = spark, folder.rstrip("/"), fold_after

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch, or put it in the place of an earlier try; folds once ``fold_after`` batches are open."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch id has letters, digits, - and _ only")
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        place = f"{self.folder}/sums/{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(place)
        entry = self.spark.createDataFrame([(batch, place, time.time_ns())], LOG)
        entry.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        if len(self.open_batches()) >= self.fold_after:
            self.fold()

    def base(self) -> int | None:
        """Version of the maintained totals."""
        return latest_version(self.spark, f"{self.folder}/base_ids")

    def open_batches(self) -> dict[str, str]:
        """Batches that the maintained totals do not hold, and where their sums are; fewer than ``fold_after`` in the long run."""
        log, base = self.spark.read.schema(LOG).parquet(f"{self.folder}/log"), self.base()
        newest = log.groupBy("batch").agg(F.max_by("place", "at").alias("place"))
        if base is not None:
            newest = newest.join(self.spark.read.schema("batch string").parquet(f"{self.folder}/base_ids/v={base:06d}"), "batch", "left_anti")
        return {r.batch: r.place for r in newest.collect()}

    def sums(self, places: list[str]) -> DataFrame:
        base = self.base()
        folders = places + ([] if base is None else [f"{self.folder}/base_sums/v={base:06d}"])
        rows = self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def fold(self) -> None:
        """Add the open batches to the maintained totals; readers switch once the ids are written too."""
        batches, base = self.open_batches(), self.base()
        if not batches:
            return
        version = (base or 0) + 1
        self.sums(list(batches.values())).filter("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/base_sums/v={version:06d}")
        ids = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        if base is not None:
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.folder}/base_ids/v={base:06d}"))
        ids.write.mode("overwrite").parquet(f"{self.folder}/base_ids/v={version:06d}")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens); keys whose documents are all gone are left out."""
        sums = self.sums(list(self.open_batches().values())).withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})
        return sums.filter("n_docs <> 0 or n_tokens <> 0")
