"""A set of keys that grows by batches and is asked without reading its history."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import written
from corpusloom.sources.writers import latest_version

#: Parts that keys are dealt over by hash; bits and probes per key of the filters.
PARTS, BITS, PROBES = 64, 12, 6
FILTER = "part int, n long, bits binary"


def probes(digest: np.ndarray, size: int) -> np.ndarray:
    """Places of each key in a filter of ``size`` bits, from one 64-bit digest."""
    digest = digest.astype(np.uint64)
    step = (digest >> np.uint64(32)) | np.uint64(1)
    return (digest[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(size)


def fill(digest: np.ndarray) -> bytes:
    """Bloom filter of some keys."""
    size = max(64, BITS * len(digest) + 7 & ~7)
    held = np.zeros(size, bool)
    held[probes(digest, size).ravel()] = True
    return np.packbits(held).tobytes()


def may_hold(bits: bytes, digest: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[probes(digest, len(held))].all(axis=1)


class KeyStore:
    """Keys dealt over parts by hash, one folder per batch and part, with a Bloom filter for each.

    A question for some keys reads the filters of their parts and then only those part folders that may
    hold one of them; what it reads there is compared exactly. New keys find next to nothing to read, however long the
    history is. A batch that is added again replaces itself; ``compact`` folds batches into one folder per part.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _store(self, keys: DataFrame, keys_folder: str, filters_folder: str) -> None:
        """Keys first, then their filters: a folder without filters is not read."""
        placed = written(self._placed(keys))
        rows = placed.select("key", "part").repartition(min(self.parts, 64), "part").sortWithinPartitions("part", "key")
        rows.write.mode("overwrite").partitionBy("part").parquet(keys_folder)

        def build(group: pa.Table) -> pa.Table:
            digest = group.column("digest").to_numpy()
            return pa.Table.from_arrays([group.column("part").slice(0, 1), pa.array([len(digest)], pa.int64()), pa.array([fill(digest)], pa.binary())], names=["part", "n", "bits"])

        placed.groupBy("part").applyInArrow(build, FILTER).write.mode("overwrite").parquet(filters_folder)

    def _placed(self, keys: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(self.parts)).cast("int")
        return keys.select("key").filter(F.col("key").isNotNull()).distinct().withColumn("part", part).withColumn("digest", F.xxhash64("key"))

    def add(self, keys: DataFrame, batch: int) -> None:
        """Store the values of column ``key`` under a batch number."""
        self._store(keys, f"{self.path}/keys/batch={batch:09d}", f"{self.path}/filters/batch={batch:09d}")

    def _base(self, before: int | None) -> int | None:
        """The newest base, unless a batch that it holds already is done again."""
        base = latest_version(self.spark, f"{self.path}/base_filters")
        return None if base is None or before is not None and base >= before else base

    def _filters(self, before: int | None) -> DataFrame:
        """(part, n, bits, batch) of the base (batch -1) and of the batches after it, up to a number."""
        base, schema = self._base(before), f"{FILTER}, batch long"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/filters").filter(F.col("batch") > (-1 if base is None else base))
            rows = rows if before is None else rows.filter(F.col("batch") < before)
        else:
            rows = self.spark.createDataFrame([], schema)
        if base is not None:
            old = self.spark.read.schema(FILTER).parquet(f"{self.path}/base_filters/v={base:06d}")
            rows = rows.unionByName(old.withColumn("batch", F.lit(-1).cast("long")))
        return rows

    def candidates(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """(key, part, batch) where the filter of a part of a batch may hold the key."""
        asked = self._placed(keys)
        kind = asked.schema["key"].dataType.simpleString()

        def test(wanted: pa.Table, known: pa.Table) -> pa.Table:
            digest = wanted.column("digest").to_numpy()
            asked = wanted.select(["key", "part"])
            found = [asked.slice(0, 0).append_column("batch", pa.array([], pa.int64()))]
            for batch, bits in zip(known.column("batch").to_pylist(), known.column("bits").to_pylist()):
                if len(digest):
                    hit = asked.filter(pa.array(may_hold(bits, digest)))
                    found.append(hit.append_column("batch", pa.array([batch] * hit.num_rows, pa.int64())))
            return pa.concat_tables(found)

        return asked.groupBy("part").cogroup(self._filters(before).groupBy("part")).applyInArrow(test, f"key {kind}, part int, batch long")

    def held(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the keys that are stored, each once."""
        found = written(self.candidates(keys, before))
        places = found.select("part", "batch").distinct().collect()  # at most one row per part and batch since the base
        if not places:
            return keys.select("key").limit(0)
        base = self._base(before)
        folder = lambda b: f"{self.path}/base_keys/v={base:06d}" if b < 0 else f"{self.path}/keys/batch={b:09d}"
        kind = found.schema["key"].dataType.simpleString()
        stored = self.spark.read.schema(f"key {kind}").parquet(*[f"{folder(p.batch)}/part={p.part}" for p in places])
        return stored.join(found.select("key").distinct(), "key", "left_semi").distinct()

    def compact(self, upto: int) -> None:
        """Fold all batches up to a number into a new base; readers switch once it is complete."""
        base = self._base(upto + 1)
        rows = self.spark.read.parquet(f"{self.path}/keys").filter((F.col("batch") > (-1 if base is None else base)) & (F.col("batch") <= upto)).select("key")
        if base is not None:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/base_keys/v={base:06d}").select("key"))
        self._store(rows, f"{self.path}/base_keys/v={upto:06d}", f"{self.path}/base_filters/v={upto:06d}")
