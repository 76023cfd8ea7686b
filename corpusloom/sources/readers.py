"""Readers for line-delimited, mixed and keyed JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """One JSON object per line under a declared schema; blank lines are skipped. A bad line fails
    the job (``FAILFAST``) or is dropped (``DROPMALFORMED``)."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_mixed_json(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of differing shapes as variants with their origin; a top-level array becomes
    ``{"turns": [...]}`` and lines that are neither object nor array are dropped.

    Source type and language come from file names such as ``talk_npc_EN.jsonl``, or from the name of a
    folder of part files.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("source_file"), F.col("value"))
    parsed = lines.withColumn("line", F.try_parse_json("value"))
    shape = F.schema_of_variant("line")
    wrapped = F.when(
        F.startswith(shape, F.lit("ARRAY")),
        F.try_parse_json(F.concat(F.lit('{"turns": '), "value", F.lit("}"))),
    ).when(F.startswith(shape, F.lit("OBJECT")), F.col("line"))
    stem = F.regexp_extract("source_file", r"([^/]+)\.jsonl?(?:/[^/]*)?$", 1)
    return parsed.select(
        "source_file",
        F.regexp_extract(stem, r"^(.*)_[^_]+$", 1).alias("source_type"),
        F.regexp_extract(stem, r"_([^_]+)$", 1).alias("language"),
        wrapped.alias("data"),
    ).filter(F.col("data").isNotNull())


def explode_keyed_json(df: DataFrame, col: str, value_schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON object keyed by name to one row per name with the value's fields. A value that is
    no object gives a row with null fields."""
    entries = F.from_json(F.col(col), "map<string,string>")
    rows = df.select(*keep, F.explode(entries).alias("name", "__value"))
    return rows.withColumn("__fields", F.from_json("__value", value_schema)).select(*keep, "name", "__fields.*")
