"""A table that is dealt into parts by a hash of its key, so that an upsert rewrites only the parts it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.writers import latest_version

PARTS = 64


class PartedTable:
    """Rows under ``rows/v=N/part=P`` and, per version, a list of which version holds each part.

    An upsert reads the parts that its keys fall in, merges them, writes them under the next version and then the next list;
    all other parts keep their files. Readers follow the newest complete list, so they see a version as a whole, and a
    writer that was lost leaves only files that no list names. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], parts: int = PARTS):
        self.spark, self.path, self.schema, self.key, self.parts = spark, path.rstrip("/"), schema, list(key), parts

    def part_of(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def places(self) -> dict[int, int]:
        """The version that holds each part; at most one entry per part."""
        version = latest_version(self.spark, f"{self.path}/lists")
        if version is None:
            return {}
        return {r.part: r.version for r in self.spark.read.parquet(f"{self.path}/lists/v={version:06d}").collect()}

    def folders(self, parts: Sequence[int] | None = None) -> list[str]:
        found = sorted(self.places().items())
        return [f"{self.path}/rows/v={v:06d}/part={p}" for p, v in found if parts is None or p in parts]

    def read(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows of all parts, or of some."""
        folders = self.folders(parts)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched parts by ``merge(their rows, new)`` and return their numbers."""
        touched = sorted(r.part for r in new.select(self.part_of().alias("part")).distinct().collect())
        if not touched:
            return touched
        places = self.places()
        version = (latest_version(self.spark, f"{self.path}/lists") or 0) + 1
        merged = merge(self.read(touched), new)
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = merged.select(*columns).withColumn("part", self.part_of()).filter(F.col("part").isin(touched))
        target = f"{self.path}/rows/v={version:06d}"
        rows.repartition(min(self.parts, len(touched)), "part").write.mode("overwrite").partitionBy("part").parquet(target)
        filled = {r.part for r in self.spark.read.parquet(target).select("part").distinct().collect()}
        places = {p: v for p, v in places.items() if p not in touched} | {p: version for p in filled}
        listed = self.spark.createDataFrame(sorted(places.items()), "part int, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/v={version:06d}")
        return touched
