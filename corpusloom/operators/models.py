"""Batch calls of an injected model client, the default embedding, and extraction results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.tables import spread


def map_model(df: DataFrame, client_factory: Callable[[], Callable[[list[dict]], list[dict]]], out_schema: str,
              key: str, batch: int = 100) -> DataFrame:
    """Call a client on batches of rows: the key, the client's fields and an error column.

    One client is made per task. A batch that fails yields its rows with the error and no
    values, so they count as done. Write the result before anything reads it twice: a task that
    is retried repeats its calls.
    """
    fields = [part.strip().split()[0] for part in out_schema.split(",")]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for frame in batches:
            for start in range(0, len(frame), batch):
                rows = frame.iloc[start:start + batch].to_dict("records")
                try:
                    answers, error = client(rows), None
                except Exception as exc:  # noqa: BLE001 - any client failure is recorded, not raised
                    answers, error = [{}] * len(rows), f"{type(exc).__name__}: {exc}"
                yield pd.DataFrame(
                    [{key: r[key], **{f: a.get(f) for f in fields}, "error": error} for r, a in zip(rows, answers)])

    kind = df.schema[key].dataType.simpleString()
    return df.mapInPandas(call, f"{key} {kind}, {out_schema}, error string")


def embed(df: DataFrame, col: str, width: int = 64, out: str = "embedding") -> DataFrame:
    """Default embedding without a provider: hashed word counts of length one."""
    words = RegexTokenizer(inputCol=col, outputCol="__words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1)
    hashed = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=width)
    unit = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0)
    model = Pipeline(stages=[words, hashed, unit]).fit(df.limit(0))
    return model.transform(spread(df)).withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


EXTRACTION_SCHEMA = (
    "entities array<struct<name:string,type:string,description:string>>, "
    "triples array<struct<head:string,relation:string,tail:string,evidence:string>>"
)


def split_extractions(results: DataFrame, col: str = "parsed", doc: str = "doc_id", title: str = "title") -> tuple[DataFrame, DataFrame]:
    """Entity rows and triple rows with their source document; missing keys get defaults."""
    origin = [F.col(doc).alias("source_doc_id"), F.col(title).alias("source_title")]

    def text(name: str, default: str = ""):
        return F.coalesce(F.col(f"x.{name}"), F.lit(default)).alias(name)

    entities = results.select(*origin, F.explode(F.col(f"{col}.entities")).alias("x")).select(
        text("name"), text("type", "Unknown"), text("description"), "source_doc_id", "source_title")
    triples = results.select(*origin, F.explode(F.col(f"{col}.triples")).alias("x")).select(
        text("head"), text("relation"), text("tail"), text("evidence"), "source_doc_id", "source_title")
    return entities, triples
