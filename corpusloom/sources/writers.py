"""Writers: dated publication, resumable append, summary file, staged replacement of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, date_tag: str) -> DataFrame:
    """Write under a date tag and return the manifest of the written files: size, digest, rows."""
    spark = df.sparkSession
    df.withColumn("date_tag", F.lit(date_tag)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("date_tag").parquet(path)
    target = f"{path}/date_tag={date_tag}"
    rows = spark.read.parquet(target).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(target).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    counted = rows.select(F.element_at(F.split("file", "/"), -1).alias("name"), "rows")
    return files.join(counted, "name", "left").withColumn("date_tag", F.lit(date_tag))


def append_done(df: DataFrame, path: str) -> None:
    """Append finished work; with the anti-join on its key this makes a run resumable."""
    df.write.mode("append").parquet(path)


def write_summary_csv(df: DataFrame, path: str, columns: Sequence[str], order_by: str = "config") -> None:
    """Summary file with a header and a fixed column order; it has one row per configuration."""
    df.select(*columns).orderBy(order_by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def replace_table(df: DataFrame, path: str, version: int) -> str:
    """Write the next version of a table beside the current one and return its folder. Readers
    of the current version are not disturbed, and a retried write simply starts over."""
    target = f"{path}/v={version:06d}"
    df.write.mode("overwrite").parquet(target)
    return target


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Highest version that was written completely."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    done = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(marker):
            done.append(int(name[2:]))
    return max(done) if done else None
