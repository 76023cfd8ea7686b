"""Streams against their batch twins and against hand-made cases."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import conversations as K
from corpusloom.operators import graph
from corpusloom.operators.cleaning import clean_counters
from corpusloom.operators.parsing import with_hash
from corpusloom.streaming import incremental as I
from corpusloom.streaming.availability import availability_stream
from corpusloom.streaming.keys import KeyStore
from corpusloom.streaming.sessions import fold_session, session_state, sessionize_stream


def written(df, path, parts, order):
    """The rows as ``parts`` parquet files in order, so a file stream sees several batches."""
    rows = df.orderBy(order).collect()
    size = max(1, -(-len(rows) // parts))
    for i in range(0, len(rows), size):
        df.sparkSession.createDataFrame(rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_sessions_match_batch_twin(spark, tables, tmp_path):
    events = tables.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = written(events, str(tmp_path / "in"), 3, "event_id")
    got = {(r.user_id, r.started_at, r.events) for r in run(sessionize_stream(stream), "sessions_out", "append").collect()}
    batch = {(r.user_id, r.started_at, r.events) for r in K.session_summary(events).collect()}
    last = events.agg(F.max("ts")).first()[0]
    assert got and got <= batch
    # Only sessions the watermark has not closed yet may be missing.
    assert all((last - started).total_seconds() < 4 * 3600 + 3600 * n for _, started, n in batch - got)


def test_session_state_caps_and_flags(spark, tmp_path):
    rows = [(1, i, "q", "a" * 10, [f"e{i}"], 1_700_000_000 + i) for i in range(55)]
    rows += [(2, i, "q", "short", ["x", "y"], 1_700_000_000 + i) for i in range(3)]
    rows += [(3, i, "q" * 10, "b" * 800, ["z"], 1_700_000_000 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "session_id long, turn_no long, question string, answer string, entities array<string>, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    out = run(session_state(written(df, str(tmp_path / "in"), 4, "turn_no")), "state_out", "update").collect()
    last = {}
    for r in out:
        last[r.session_id] = r
    assert last[1].turns == 50 and len(last[1].entities) == 30 and last[1].entities[-1] == "e54"
    assert last[2].turns == 3 and not last[2].compress and list(last[2].entities) == ["x", "y"]
    assert last[3].turns == 8 and last[3].compress


def test_fold_session_is_order_of_first_mention():
    sizes, entities = fold_session(([], []), [(5, ["a", "b", "a"]), (7, ["b", "c"])], turn_cap=1, entity_cap=2)
    assert (sizes, entities) == ([7], ["b", "c"])


def test_availability_stream_matches_batch(spark, tables, tmp_path):
    calls = tables.events.select(F.col("user_id").alias("service"), F.col("event_id").alias("call_id"),
                                 F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    got = run(availability_stream(written(calls, str(tmp_path / "in"), 3, "call_id")), "avail_out", "append").collect()
    batch = K.availability(calls, service="service", tie="call_id", failed=F.col("failed")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_breaker_walk():
    breaker = K.Breaker(3, 0.2)
    assert breaker.call(0.0, False)[1] == "closed"
    assert [breaker.call(t, True)[1] for t in (1.0, 1.01)] == ["closed", "closed"]
    assert breaker.call(1.02, True)[1] == "open"
    assert breaker.call(1.1, False) == ("open", "open", True)
    assert breaker.call(1.3, False) == ("half_open", "closed", False)


def test_incremental_clean_matches_batch(spark, tables, tmp_path):
    docs = tables.documents.select("doc_id", "text")
    stream = written(docs, str(tmp_path / "in"), 3, "doc_id")
    path = str(tmp_path / "out")
    I.incremental_clean(stream, path, str(tmp_path / "cp")).awaitTermination(120)
    got = I.clean_table(spark, path)
    expected = clean_counters(with_hash(docs.withColumnRenamed("text", "content"))).first()
    assert got.count() == expected.kept and got.select("content_hash").distinct().count() == expected.kept
    # A retried batch replaces itself.
    I.clean_batch(docs.limit(5), 1, path)
    assert I.read_batches(spark, path, I.CLEAN_SCHEMA).filter("batch = 1").count() <= 5


def test_incremental_graph_matches_batch(spark, tables, tmp_path):
    mentions = tables.kg_mentions.select(F.lit("node").alias("kind"), "name", "type", "description", "source_doc_id", "source_title", "pos")
    triples = tables.kg_triples.select(F.lit("edge").alias("kind"), "head", "relation", "tail", "evidence", "source_doc_id", "pos")
    rows = mentions.unionByName(triples, allowMissingColumns=True).withColumn("part", F.when(F.col("kind") == "node", 0).otherwise(1))
    stream = written(rows, str(tmp_path / "in"), 3, ["part", "pos"]).drop("part")
    store = I.GraphStore(spark, str(tmp_path / "graph"))
    I.incremental_graph(stream, store, str(tmp_path / "cp")).awaitTermination(180)
    nodes = graph.dedup_entities(tables.kg_mentions)
    edges = graph.upsert_edges(tables.core_edges.limit(0), tables.kg_triples, nodes)

    def contents():
        return (sorted((r.name, r.description or "") for r in store.nodes().collect()),
                sorted((r.head, r.relation, r.tail, r.evidence or "") for r in store.edges().collect()))

    expected = (sorted((r.name, r.description or "") for r in nodes.collect()),
                sorted((r.head, r.relation, r.tail, r.evidence or "") for r in edges.collect()))
    assert contents() == expected
    store.compact(1)
    assert contents() == expected


def test_key_store_reads_little_and_exactly(spark, tmp_path):
    """Over many batches new keys open next to no part, old ones only their own; a retry and a base change nothing."""
    store, keys = KeyStore(spark, str(tmp_path / "keys"), parts=8), lambda names: spark.createDataFrame([(n,) for n in names], "key string")
    names = lambda b: [f"{b}-{i}" for i in range(60)]
    opened = []
    for b in range(12):
        fresh = names(b) + names(b)[:5] + [None]
        opened.append(store.candidates(keys(fresh), b).select("part", "batch").distinct().count())
        assert store.held(keys(fresh), b).count() == 0
        store.add(keys(fresh), b)
    assert max(opened) <= 8  # of up to 88 folders
    mixed = names(3)[:7] + names(50) + names(9)[-2:]
    want = sorted(names(3)[:7] + names(9)[-2:])
    found = lambda before=None: sorted(r.key for r in store.held(keys(mixed), before).collect())
    assert found() == want and found(9) == sorted(names(3)[:7]) and found(3) == []
    store.add(keys(names(9)), 9)
    store.compact(8)
    assert found() == want and found(9) == sorted(names(3)[:7]) and found(5) == sorted(names(3)[:7])
    store.compact(11)
    assert found() == want and store.candidates(keys(names(3)), None).filter("batch >= 0").count() == 0


def in_turn(held, fresh, threshold, size):
    """The plain sequential pass over (id, vector), from the vectors held before it."""
    out, held = [], [np.array(v) for v in held][-size:]
    for i, v in fresh:
        cosines = [float(np.dot(v, h) / ((np.linalg.norm(v) * np.linalg.norm(h)) or 1)) for h in held]
        if not any(c >= threshold for c in cosines):
            out.append(i)
            held = [*held, np.array(v)][-size:]
    return out


def test_stored_misses_equal_the_sequential_pass(spark):
    """Many random orders at once, one per language; stretches are shorter than a language, and vectors leave the cache."""
    rng = np.random.default_rng(5)
    angles = np.cumsum(rng.normal(0, 0.12, 40))  # neighbours are alike, so decisions hang on one another
    shapes = [[float(np.cos(a)), float(np.sin(a)), 0.0] for a in angles] + [[0.0, 0.0, 0.0]] * 2
    cache, misses, want = [], [], set()
    for k in range(50):
        lang = None if k == 0 else f"l{k:03d}"
        held = [shapes[i] for i in rng.integers(0, 40, k % 4)]
        cache += [(-100 * k - i, lang, v, i) for i, v in enumerate(held)]
        fresh = [(1000 * k + n, shapes[i]) for n, i in enumerate(rng.permutation(np.arange(42)).tolist())]
        misses += [(i, lang, v, 100 + i // 2) for i, v in fresh]
        want |= set(in_turn(held, fresh, 0.95, 6))
    schema = "query_id long, lang string, embedding array<double>, ts_s long"
    given = spark.createDataFrame(cache, schema.replace("query_id", "entry_id"))
    got = I.store_misses(spark.createDataFrame(misses, schema), given, 0.95, 6, stretch=20).collect()
    assert {r.entry_id for r in got} == want and len(got) == len(want) > 100
    assert {r.lang for r in got if r.entry_id < 1000} == {None}


def test_one_long_chain_of_misses(spark):
    """Each question is like the one before it only, over twenty stretches of one language."""
    steps = [[float(np.cos(0.3 * i)), float(np.sin(0.3 * i))] for i in range(10)]
    chain = [(i, "en", [*([0.0] * (2 * (i // 10))), *steps[i % 10], *([0.0] * (40 - 2 * (i // 10)))], i) for i in range(200)]
    schema = "query_id long, lang string, embedding array<double>, ts_s long"
    none = spark.createDataFrame([], schema.replace("query_id", "entry_id"))
    got = I.store_misses(spark.createDataFrame(chain, schema), none, 0.95, 500, stretch=10)
    assert sorted(r.entry_id for r in got.collect()) == in_turn([], [(i, v) for i, _, v, _ in chain], 0.95, 500)


def test_incremental_cache(spark, tables, tmp_path):
    base = [1.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(1, "en", base, 1), (2, "en", [0.99, 0.1, 0.0, 0.0, 0.0], 2), (3, "en", [0.0, 1.0, 0.0, 0.0, 0.0], 3),
            (4, "zh", base, 4), (5, "en", base, 5), (6, "en", [0.0, 0.99, 0.1, 0.0, 0.0], 6)]
    df = spark.createDataFrame(rows, "query_id long, lang string, embedding array<double>, ts_s long")
    stream = written(df, str(tmp_path / "in"), 2, "ts_s")
    path = str(tmp_path / "cache")
    I.incremental_cache(stream, path, str(tmp_path / "cp"), size=3).awaitTermination(180)
    last = spark.read.schema(I.CACHE_SCHEMA).parquet(f"{path}/snapshot/v=000001")
    assert sorted(r.entry_id for r in last.collect()) == [1, 3, 4]
    hits = spark.read.parquet(f"{path}/lookups").filter("hit").orderBy("query_id").collect()
    assert [(r.query_id, r.entry_id) for r in hits] == [(5, 1), (6, 3)]


def test_texts_of_a_batch_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "TASK_BYTES", 4000)
    docs = spark.range(400).selectExpr("id doc_id", "repeat(concat('word', id % 300, ' '), 60) text")
    path = str(tmp_path / "out")
    I.clean_batch(docs, 0, path)
    kept = I.read_batches(spark, path, I.CLEAN_SCHEMA)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))  # of equal texts the first
    assert kept.select(F.input_file_name()).distinct().count() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
