"""Queries that write the given tables as files, tables or batches to the shared folder and read them back through
the library's sources, sinks and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.operators import graph, similarity
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.plans.catalog import CATALOG, d_normalize, query
from corpusloom.plans.conversation_queries import _fold_sql
from corpusloom.plans.evaluation_queries import _SUMMARY, _summary
from corpusloom.plans.retrieval_queries import _rounded, vector_loads
from corpusloom.session import shared_folder
from corpusloom.sources import readers, writers
from corpusloom.sources.parted import PartedTable
from corpusloom.streaming import incremental
from corpusloom.streaming.sessions import session_state
from corpusloom.tables import DEALT_ROWS


def fresh_folder(t) -> str:
    return f"{shared_folder(t.spark)}/query-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks


@query("S01_read_jsonl", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def s01(t):
    """All documents as JSON lines, one blank line after every fifth."""
    path = fresh_folder(t)
    line = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "text"))
    lines = F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(line, F.lit(""))).otherwise(F.array(line)))
    t.documents.select(lines.alias("value")).write.text(path)
    return readers.read_jsonl(t.spark, path, "doc_id long, lang string, source string, n_chars long, text string")


@query("S02_read_mixed_json", """
SELECT CASE WHEN lang = 'en' THEN 'page_text' ELSE 'page' END AS source_type, CASE WHEN lang = 'en' THEN 'EN' ELSE 'OTHER' END AS language,
  doc_id AS key, CAST(NULL AS BIGINT) AS turns, n_chars AS chars FROM documents
UNION ALL
SELECT 'talk_turns', 'EN', NULL, count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations GROUP BY conv_id""")
def s02(t):
    """Documents as objects, conversations as arrays, and lines that are neither, in folders named like files."""
    path = fresh_folder(t)
    one = F.to_json(F.struct("doc_id", "n_chars", F.struct("source", "lang").alias("meta")))
    stray = F.explode(F.when(F.col("doc_id") % 7 == 0, F.array(one, F.lit("17"), F.lit("{broken"))).otherwise(F.array(one)))
    t.documents.filter("lang = 'en'").select(stray.alias("value")).write.text(f"{path}/page_text_EN.jsonl")
    t.documents.filter("lang <> 'en' OR lang IS NULL").select(stray.alias("value")).write.text(f"{path}/page_OTHER.json")
    turn = F.struct("turn", "role", F.length("text").alias("chars"))
    talks = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    talks.select(F.to_json("turns").alias("value")).write.text(f"{path}/talk_turns_EN.jsonl")
    rows = readers.read_mixed_json(t.spark, [f"{path}/{n}" for n in ("page_text_EN.jsonl", "page_OTHER.json", "talk_turns_EN.jsonl")])
    said = F.from_json(F.to_json(F.variant_get("data", "$.turns", "variant")), "array<struct<turn:int,chars:bigint>>")
    return rows.select("source_type", "language", F.variant_get("data", "$.doc_id", "bigint").alias("key"), said.alias("said"), F.variant_get("data", "$.n_chars", "bigint").alias("n")).select(
        "source_type", "language", "key", F.when(F.col("said").isNotNull(), F.size("said")).cast("long").alias("turns"),
        F.coalesce(F.aggregate("said", F.lit(0).cast("long"), lambda a, x: a + x["chars"]), "n").alias("chars"))


@query("S06_publish", """
SELECT date_tag, n_nationkey, customers, CAST(sum(customers) OVER (PARTITION BY date_tag) AS BIGINT) AS listed, 64 AS digest_chars FROM (
  SELECT '2024-01-01' AS date_tag, c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey
  UNION ALL SELECT '2024-01-02', c_nationkey, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey)""")
def s06(t):
    """Customers under two date tags, the first published twice, read back with what the manifests list."""
    path = fresh_folder(t)
    writers.publish(t.customer.filter("c_acctbal > 100"), path, "2024-01-01")
    lists = writers.publish(t.customer, path, "2024-01-01").unionByName(writers.publish(t.customer.filter("c_acctbal > 0"), path, "2024-01-02"))
    listed = lists.groupBy("date_tag").agg(F.sum("rows").alias("listed"), F.min(F.length("sha256")).alias("digest_chars"))
    back = t.spark.read.parquet(path).groupBy(F.col("date_tag").cast("string").alias("date_tag"), F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return back.join(listed, "date_tag").select("date_tag", "n_nationkey", "customers", "listed", "digest_chars")


@query("S13_summary_csv", f"SELECT config, overall, rank_no FROM (SELECT config, overall, CAST(row_number() OVER (ORDER BY config) AS INT) AS rank_no FROM ({_SUMMARY}))", ["runs", "gold"])
def s13(t):
    """The score summary as a file, read back with the place of each line."""
    path = fresh_folder(t)
    writers.write_summary_csv(_summary(t), path, ["config", "overall"])
    rows = t.spark.read.schema("config string, overall double").option("header", True).csv(path)
    place = F.monotonically_increasing_id() + 1  # one file, one line per configuration
    return rows.select("config", "overall", place.cast("int").alias("rank_no"))


# ---------------------------------------------------------------- streams


def files_of_a_batch(df, batches: int) -> int:
    """Files that a batch is dealt over, so that a task writes and reads a fixed number of rows however large the table is."""
    return max(1, math.ceil(df.count() / (batches * DEALT_ROWS)))


def _streamed(t, df, batches: int):
    """The rows as files of a folder, as a stream of ``batches`` batches."""
    path = fresh_folder(t)
    each = files_of_a_batch(df, batches)
    df.repartition(batches * each).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


@query("R02_session_state", f"""
SELECT session_id, CAST(least(turns, {C.TURNS_CAP}) AS INT) AS turns, CAST(chars AS INT) AS chars, least(turns, {C.TURNS_CAP}) >= {C.COMPRESS_MIN_TURNS} AND chars >= {C.COMPRESS_MIN_CHARS} AS compress,
  array_to_string(known, '|') AS entities FROM (
  SELECT session_id, count(*) AS turns, sum(length(question) + length(answer)) FILTER (r <= {C.TURNS_CAP}) AS chars, {_fold_sql("list(entities ORDER BY turn_no)", C.ENTITY_CAP)} AS known
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS r FROM turns) GROUP BY session_id)""", ["turns"])
def r02(t):
    """All turns as one batch of a stream, and the state of every session after it."""
    path = fresh_folder(t)
    rows = t.turns.select("session_id", "turn_no", "question", "answer", "entities", F.timestamp_seconds("ts_s").alias("ts"))
    rows.write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    out = session_state(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    out.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).start().awaitTermination()
    states = t.spark.read.parquet(f"{path}/out").filter("NOT expired")
    return states.select("session_id", "turns", "chars", "compress", F.array_join("entities", "|").alias("entities"))


@query("R03_incremental_clean", f"""
SELECT content_hash, length(content) AS chars, md5(content) AS digest FROM (SELECT DISTINCT sha256(text) AS content_hash, {d_normalize('text')} AS content FROM documents)
WHERE length(content) >= {C.MIN_CONTENT_CHARS}""")
def r03(t):
    """All documents in four batches, copies in different ones included."""
    path = fresh_folder(t)
    incremental.incremental_clean(_streamed(t, t.documents.select("doc_id", "text"), 4), f"{path}/clean", f"{path}/checkpoint").awaitTermination()
    clean = incremental.clean_table(t.spark, f"{path}/clean")
    return clean.select("content_hash", F.length("content").cast("long").alias("chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("R04_incremental_graph", """
SELECT 'node' AS kind, name AS head, NULL AS relation, NULL AS tail, CAST(max(length(coalesce(description, ''))) AS BIGINT) AS chars FROM kg_mentions GROUP BY name
UNION ALL
SELECT DISTINCT 'edge', head, relation, tail, 0 FROM kg_triples WHERE head <> '' AND relation <> '' AND tail <> ''
  AND head IN (SELECT name FROM kg_mentions) AND tail IN (SELECT name FROM kg_mentions)""", ["kg_mentions", "kg_triples"])
def r04(t):
    """Mentions in three batches, then triples in three more, under one checkpoint."""
    path = fresh_folder(t)
    mentions = t.kg_mentions.select(F.lit("node").alias("kind"), "name", "type", "description", "source_doc_id", "source_title", "pos")
    triples = t.kg_triples.select(F.lit("edge").alias("kind"), "head", "relation", "tail", "evidence", "source_doc_id", "pos")
    columns = mentions.unionByName(triples, allowMissingColumns=True).schema
    store = incremental.GraphStore(t.spark, f"{path}/graph")
    for rows in (mentions.unionByName(triples.limit(0), allowMissingColumns=True), mentions.limit(0).unionByName(triples, allowMissingColumns=True)):
        each = files_of_a_batch(rows, 3)
        rows.repartition(3 * each).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(columns).option("maxFilesPerTrigger", each).parquet(f"{path}/in")
        incremental.incremental_graph(stream, store, f"{path}/checkpoint").awaitTermination()
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    nodes = store.nodes().select(F.lit("node").alias("kind"), F.col("name").alias("head"), none.alias("relation"), none.alias("tail"), F.length(F.coalesce("description", F.lit(""))).cast("long").alias("chars"))
    return nodes.unionByName(store.edges().select(F.lit("edge").alias("kind"), "head", "relation", "tail", zero.alias("chars")))


@query("R05_incremental_cache")
def r05(t):
    """All lookups in four batches against a cache that starts empty: what each found, and whether it is stored in the end."""
    path = fresh_folder(t)
    asked = t.cache_lookups.withColumn("ts_s", F.lit(1704067200).cast("long") + F.col("query_id") * 60)
    for part in range(4):
        asked.filter(F.pmod("query_id", F.lit(4)) == part).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(asked.schema).parquet(f"{path}/in")
        incremental.incremental_cache(stream, f"{path}/cache", f"{path}/checkpoint").awaitTermination()
    found = t.spark.read.parquet(f"{path}/cache/lookups")
    newest = t.spark.read.parquet(f"{path}/cache/snapshot").select(F.col("entry_id").alias("query_id"), F.lit(True).alias("stored")).distinct()
    return found.join(newest, "query_id", "left").select("query_id", "lang", "hit", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("T02_inverted_lists")
def t02_lists(t):
    """Top-k of all lookups from inverted lists that are kept as a table; 20 of 32 lists are looked at, as these vectors have no clusters."""
    index = VectorIndex(t.spark, fresh_folder(t)).build(t.embeddings, lists=32, item_id="vec_id")
    return _rounded(index.topk(t.cache_lookups, 8, 20))


# ---------------------------------------------------------------- tables in parts


def _same_as(name: str) -> tuple[str, tuple[str, ...]]:
    return CATALOG[name].sql, CATALOG[name].views


@query("S08_parted_upsert", *_same_as("S08_node_upsert"))
def s08_parted(t):
    """The node upsert on a table in parts, mentions in two batches."""
    table = PartedTable(t.spark, fresh_folder(t), "name string, type string, description string, source_doc_id string, source_title string", ["name"])
    current = t.kg_nodes.filter(F.col("type").isin("Location", "Organization", "Character", "Event"))
    table.upsert(current, lambda old, new: new)
    # both readings of an entity fall into one batch, as its name decides
    for half in (0, 1):
        table.upsert(t.kg_mentions.filter(F.pmod(F.xxhash64("name", F.lit(3)), F.lit(2)) == half), graph.upsert_nodes)
    return table.read().select("name", "type", "description", "source_doc_id")


@query("S09_parted_upsert", *_same_as("S09_edge_upsert"))
def s09_parted(t):
    """The edge upsert on a table in parts."""
    table = PartedTable(t.spark, fresh_folder(t), "head string, relation string, tail string, evidence string, source_doc_id string", graph.EDGE_KEY)
    table.upsert(t.core_edges, lambda old, new: new)
    table.upsert(t.kg_triples, lambda old, new: graph.upsert_edges(old, new, t.kg_nodes))
    return table.read()


@query("S07_parted_upsert", *_same_as("S07_vector_upsert"))
def s07_parted(t):
    """The vector upsert on a table in parts."""
    old, new = vector_loads(t)
    table = PartedTable(t.spark, fresh_folder(t), ", ".join(f"{n} {k}" for n, k in old.dtypes), ["chunk_id"])
    table.upsert(old, lambda none, rows: rows)
    table.upsert(new, similarity.upsert_vectors)
    return table.read()
