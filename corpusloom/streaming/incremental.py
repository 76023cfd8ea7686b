"""Tables kept current by micro-batches: clean documents, the graph, the answer cache.

Every batch writes into a folder named after its id, so a batch that is retried after a failure
replaces its own output and nothing else.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom import constants as C
from corpusloom.functions import text as X
from corpusloom.operators import graph
from corpusloom.operators.parsing import with_hash
from corpusloom.operators.ranking import cap_newest, first_per_key, top_per_key
from corpusloom.operators.similarity import cache_lookup
from corpusloom.session import written
from corpusloom.sources.writers import latest_version
from corpusloom.streaming.keys import KeyStore
from corpusloom.tables import by_key


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id:09d}"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None, after: int = -1) -> DataFrame:
    """Rows of the batches in (after, before), with their batch number; empty when there are none."""
    full = f"{schema}, batch long"
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path).filter(F.col("batch") > after)
    return rows if before is None else rows.filter(F.col("batch") < before)


def _start(stream: DataFrame, handle, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---------------------------------------------------------------- documents

CLEAN_SCHEMA = "doc_id long, content string, content_hash string"


#: Bytes of text that a task is dealt.
TASK_BYTES = 64 << 20


def tasks_for_texts(rows: DataFrame, col: str) -> int:
    """Tasks over which texts are dealt: the session's number, or more, so that none is dealt over ``TASK_BYTES`` however large the batch is."""
    total = rows.agg(F.sum(F.octet_length(col))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))


def clean_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Unseen documents of a batch: first per hash, not stored by an earlier batch, long enough.

    Hashes seen before live in a key store beside the table, not in operator state: neither the memory
    of the stream nor what a batch reads grows with the corpus. Short documents are stored with an empty
    content, as their hash counts as seen.
    """
    store = seen_hashes(batch.sparkSession, path)
    rows = with_hash(batch.select("doc_id", F.col("text").alias("content"))).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.select("row", "doc_id", "content", "content_hash"))
    # Hashes are sorted out by themselves; a text is moved once, to be met by the number of its row.
    first = written(rows.groupBy("content_hash").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("content_hash", "first.row"))
    keys = first.select(F.col("content_hash").alias("key"))
    seen = store.held(keys, before=batch_id).withColumnRenamed("key", "content_hash")
    fresh = first.join(seen, "content_hash", "left_anti").select("row")
    parts = tasks_for_texts(rows, "content")
    fresh = rows.repartition(parts, "row").join(by_key(fresh.repartition(parts, "row")), "row", "left_semi")
    fresh = fresh.withColumn("content", X.normalize_text(F.col("content")))
    short = F.length("content") < C.MIN_CONTENT_CHARS
    kept = fresh.withColumn("content", F.when(short, F.lit(None)).otherwise(F.col("content")))
    kept.select("doc_id", "content", "content_hash").write.mode("overwrite").parquet(_batch_folder(path, batch_id))
    store.add(keys, batch_id)


def seen_hashes(spark: SparkSession, path: str) -> KeyStore:
    """Hashes of all documents that a clean table has met; ``compact`` it now and then."""
    return KeyStore(spark, f"{path}_seen")


def incremental_clean(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Clean documents (doc_id, text) as they arrive."""
    return _start(stream, lambda batch, i: clean_batch(batch, i, path), checkpoint, once)


def clean_table(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, CLEAN_SCHEMA).filter(F.col("content").isNotNull()).drop("batch")


# ---------------------------------------------------------------- graph

NODE_SCHEMA = "name string, type string, description string, source_doc_id string, source_title string, pos long"
EDGE_SCHEMA = "head string, relation string, tail string, evidence string, source_doc_id string, pos long"


class GraphStore:
    """Nodes and edges as small batches over a compacted base.

    A batch costs what it holds: it is appended as it is, and the rules of the load (first type
    and source, longest description, first evidence) are applied when the graph is read. They
    do not depend on how rows are grouped into batches, so ``compact`` may fold any number of
    batches into a new base at any time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.names = KeyStore(spark, f"{path}/names")

    def _rows(self, kind: str, schema: str, before: int | None) -> DataFrame:
        base = latest_version(self.spark, f"{self.path}/{kind}_base")
        after = -1 if base is None else base
        rows = read_batches(self.spark, f"{self.path}/{kind}", schema, before, after)
        if base is not None:
            old = self.spark.read.parquet(f"{self.path}/{kind}_base/v={base:06d}")
            rows = rows.unionByName(old)
        return rows

    def nodes(self, before: int | None = None) -> DataFrame:
        rows = self._rows("nodes", NODE_SCHEMA, before)
        first = first_per_key(rows, ["name"], ["batch", "pos"]).drop("description")
        size = F.length(F.coalesce("description", F.lit("")))
        longest = first_per_key(rows, ["name"], [size.desc(), "batch", "pos"]).select("name", "description")
        return first.join(longest, "name")

    def edges(self, before: int | None = None) -> DataFrame:
        return first_per_key(self._rows("edges", EDGE_SCHEMA, before), graph.EDGE_KEY, ["batch", "pos"])

    def add(self, mentions: DataFrame, triples: DataFrame, batch_id: int) -> None:
        """Store a batch. Triples with a blank part or an end that is unknown by now are left out.

        Known names are asked of a key store, so a batch reads the parts that may hold its own ends and not all nodes.
        """
        graph.dedup_entities(mentions).select("name", "type", "description", "source_doc_id", "source_title", "pos").write.mode(
            "overwrite").parquet(_batch_folder(f"{self.path}/nodes", batch_id))
        self.names.add(mentions.select(F.col("name").alias("key")), batch_id)
        ends = triples.select(F.explode(F.array("head", "tail")).alias("key"))
        known = self.names.held(ends, batch_id + 1).withColumnRenamed("key", "name")
        fresh = first_per_key(graph.existing_edges(triples.filter(graph.complete_triple()), known), graph.EDGE_KEY, ["pos"])
        fresh.select("head", "relation", "tail", "evidence", "source_doc_id", "pos").write.mode("overwrite").parquet(
            _batch_folder(f"{self.path}/edges", batch_id))

    def compact(self, upto: int) -> None:
        """Fold all batches up to a number into a new base; readers switch once it is complete."""
        for kind, rows in (("nodes", self.nodes(upto + 1)), ("edges", self.edges(upto + 1))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{kind}_base/v={upto:06d}")
        self.names.compact(upto)


def incremental_graph(stream: DataFrame, store: GraphStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Graph batches from extraction records: kind (node or edge) and the fields of both."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        mentions = batch.filter("kind = 'node'").select("name", "type", "description", "source_doc_id", "source_title", "pos")
        triples = batch.filter("kind = 'edge'").select("head", "relation", "tail", "evidence", "source_doc_id", "pos")
        store.add(mentions, triples, batch_id)

    return _start(stream, handle, checkpoint, once)


# ---------------------------------------------------------------- answer cache

CACHE_SCHEMA = "entry_id long, lang string, embedding array<double>, ts_s long"


#: Misses that one task decides on in order, from the vectors held before them.
STRETCH = 512


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors scaled to length one; those without length stay as they are."""
    rows = np.array(vectors, dtype=np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def decide(held: list, vectors: list, threshold: float, size: int) -> list[bool]:
    """Which vectors are stored, one after the other: those not similar to any of the ``size`` newest held by then."""
    if not vectors:
        return []
    rows = unit_rows([*held, *vectors])
    kept, out = list(range(len(held)))[-size:], []
    for i in range(len(held), len(rows)):
        fresh = not kept or float((rows[kept] @ rows[i]).max()) < threshold
        out.append(fresh)
        if fresh:
            kept = [*kept, i][-size:]
    return out


def store_misses(misses: DataFrame, cache: DataFrame, threshold: float = C.CACHE_THRESHOLD, size: int = C.CACHE_SIZE, stretch: int = STRETCH) -> DataFrame:
    """Questions that are stored one after the other unless a similar one of their language is among the ``size`` newest by then.

    Each decision depends on those before it, but only through the vectors that are held. So misses are cut by range of
    (language, time) into stretches of about ``stretch`` rows that are decided at the same time, at first from the
    cache alone. Then each stretch is given the ``size`` vectors held before it by these decisions, and stretches that
    are given others than before decide again, until none is. The first stretch that is wrong comes right in every
    round, so the result is that of the sequential pass. A task holds a stretch and ``size`` vectors,
    never a language, and a round sends ``size`` vectors per stretch that decides.
    """
    key = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("-")).alias("lang")  # no language is one of its own
    rows = misses.select("query_id", F.col("lang").alias("language"), key, "embedding", "ts_s")
    parts = max(1, -(-rows.count() // stretch))
    order = ["lang", "ts_s", "query_id"]
    placed = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("ts_s", "query_id"))
    placed = written(placed.withColumn("place", place))
    old = cache.select(F.col("entry_id").alias("query_id"), key, "embedding", "ts_s")
    old = top_per_key(old, ["lang"], [F.desc("ts_s"), F.desc("query_id")], size, "__age")
    # ranks of the entries from before end at 0; those stored now go on from there
    old = written(old.select("lang", "query_id", "embedding", (F.lit(1) - F.col("__age")).cast("long").alias("rank")))
    stretches = placed.select("lang", "part").distinct()
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def run(fresh: pa.Table, held: pa.Table) -> pa.Table:
        fresh, held = fresh.sort_by("place"), held.sort_by("rank")
        kept = decide(held.column("embedding").to_pylist(), fresh.column("embedding").to_pylist(), threshold, size)
        return fresh.select(["lang", "part", "place"]).append_column("kept", pa.array(kept, pa.bool_()))

    def decided(given: DataFrame, held: DataFrame) -> DataFrame:
        found = given.groupBy("lang", "part").cogroup(held.groupBy("lang", "part")).applyInArrow(
            run, f"lang {kinds['lang']}, part int, place int, kept boolean")
        return written(found)

    def given_to(held: DataFrame) -> DataFrame:
        """For each stretch a digest of the vectors it is given."""
        seen = held.groupBy("lang", "part").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "query_id"))).cast("array<string>"), ",").cast("binary")).alias("given"))
        return stretches.join(seen, ["lang", "part"], "left").fillna({"given": ""})

    held = written(stretches.join(old, "lang").select("lang", "part", "query_id", "embedding", "rank"))  # the cache, for every stretch
    known = decided(placed, held)
    given = written(given_to(held))
    while parts > 1:
        kept = known.filter("kept")
        within = F.row_number().over(Window.partitionBy("lang", "part").orderBy("place"))
        counts = kept.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = stretches.join(counts, ["lang", "part"], "left").select("lang", "part", F.coalesce(before, F.lit(0)).alias("before"))
        new = kept.withColumn("within", within).join(starts, ["lang", "part"]).join(placed.select("lang", "part", "place", "query_id"), ["lang", "part", "place"])
        new = new.select("lang", (F.col("before") + F.col("within")).alias("rank"), "query_id", F.col("part").alias("from"), "place")
        ranked = new.unionByName(old.select("lang", "rank", "query_id", F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("place")))
        # a stretch is given ranks above before - size up to before; both lie in two neighbouring bands of that width
        band = F.floor(F.col("before") / size)
        wanted = starts.select("lang", "part", "before", F.explode(F.array(band, band - 1)).alias("band"))
        held = wanted.join(ranked.withColumn("band", F.floor(F.col("rank") / size)), ["lang", "band"])
        held = written(held.filter((F.col("rank") <= F.col("before")) & (F.col("rank") > F.col("before") - size)).drop("band", "before"))
        now = written(given_to(held))
        changed = now.join(given.withColumnRenamed("given", "was"), ["lang", "part"]).filter("given <> was").select("lang", "part")
        if changed.isEmpty():
            break
        held = held.join(changed, ["lang", "part"], "left_semi")
        vectors = placed.select("lang", F.col("part").alias("from"), "place", "embedding")
        stored_now = held.filter(F.col("from").isNotNull()).join(vectors, ["lang", "from", "place"])
        from_before = held.filter(F.col("from").isNull()).join(old.select("lang", "rank", F.col("embedding")), ["lang", "rank"])
        columns = ["lang", "part", "query_id", "embedding", "rank"]
        held = written(stored_now.select(*columns).unionByName(from_before.select(*columns)))
        again = decided(placed.join(changed, ["lang", "part"], "left_semi"), held)
        known = written(known.join(changed, ["lang", "part"], "left_anti").unionByName(again))
        given = now
    stored = placed.join(known.filter("kept").select("lang", "part", "place"), ["lang", "part", "place"], "left_semi")
    return stored.select(F.col("query_id").alias("entry_id"), F.col("language").alias("lang"), "embedding", "ts_s")


def cache_batch(batch: DataFrame, cache: DataFrame, threshold: float = C.CACHE_THRESHOLD, size: int = C.CACHE_SIZE) -> tuple[DataFrame, DataFrame]:
    """Lookups of a batch against the snapshot, and the next snapshot."""
    found = cache_lookup(batch, cache, threshold)
    missed = batch.join(found.filter("NOT hit").select("query_id"), "query_id", "left_semi")
    stored = store_misses(missed, cache, threshold, size)
    grown = cache.select("entry_id", "lang", "embedding", "ts_s").unionByName(stored)
    return found, cap_newest(grown, "ts_s", size, "entry_id")


def incremental_cache(stream: DataFrame, path: str, checkpoint: str, threshold: float = C.CACHE_THRESHOLD, size: int = C.CACHE_SIZE,
                      once: bool = True) -> StreamingQuery:
    """Cache over a stream of questions (query_id, lang, embedding, ts_s): writes lookups and the
    snapshot after each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        snapshots = f"{path}/snapshot"
        before = batch_id - 1
        if before >= 0 and _exists(spark, f"{snapshots}/v={before:06d}"):
            cache = spark.read.schema(CACHE_SCHEMA).parquet(f"{snapshots}/v={before:06d}")
        else:
            cache = spark.createDataFrame([], CACHE_SCHEMA)
        found, grown = cache_batch(batch, cache, threshold, size)
        found.write.mode("overwrite").parquet(_batch_folder(f"{path}/lookups", batch_id))
        grown.write.mode("overwrite").parquet(f"{snapshots}/v={batch_id:06d}")

    return _start(stream, handle, checkpoint, once)
