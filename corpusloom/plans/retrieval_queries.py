"""Queries for questions: aliases, mentions, vectors, cache, document fetch, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import labels, scoring
from corpusloom.functions import text as X
from corpusloom.operators import aliases, context, fetching, graph, mentions, ranking, reports, similarity
from corpusloom.plans import graph_queries as G
from corpusloom.plans.catalog import d_quote, query
from corpusloom.plans.retrieve import RetrievalConfig, Stores, question_paths, retrieve
from corpusloom.plans.text_queries import d_valid_alias
from corpusloom.session import written
from corpusloom.tables import by_key, in_shares

# ---------------------------------------------------------------- aliases

_MATCHES = " UNION ALL ".join(
    f"SELECT name AS canonical, unnest(regexp_extract_all(description, {d_quote('(?i)' + p)}, 1)) AS raw FROM alias_texts"
    for p in C.ALIAS_PATTERNS)
EXTRACTED_SQL = f"""SELECT DISTINCT canonical, alias FROM (SELECT canonical, {d_valid_alias('raw')} AS alias FROM ({_MATCHES}))
WHERE alias IS NOT NULL AND lower(alias) <> lower(canonical)"""
_LISTED_SQL = f"""SELECT DISTINCT canonical, alias FROM (SELECT canonical_name AS canonical, {d_valid_alias('raw')} AS alias FROM (
  SELECT canonical_name, unnest(aliases) AS raw FROM clean_wiki)) WHERE alias IS NOT NULL AND lower(alias) <> lower(canonical)"""
_TURNED_SQL = "SELECT DISTINCT unnest([tail, head]) AS canonical, unnest([head, tail]) AS alias FROM kg_edges WHERE relation = 'TRANSFORMED_INTO' AND head <> tail"
_ALL_SQL = f"SELECT canonical, alias FROM ({EXTRACTED_SQL}) UNION SELECT canonical, alias FROM ({_LISTED_SQL}) UNION SELECT canonical, alias FROM ({_TURNED_SQL})"


def _all_aliases(t):
    from corpusloom.operators.graph import symmetric_aliases

    return aliases.collect_aliases(
        aliases.extract_aliases(t.alias_texts, "description"), aliases.listed_aliases(t.clean_wiki), symmetric_aliases(t.kg_edges))


@query("X07_extracted_aliases", EXTRACTED_SQL, ["alias_texts"])
def x07(t):
    return aliases.extract_aliases(t.alias_texts, "description")


@query("A09_collected_aliases", f"SELECT canonical, count(*) AS n, string_agg(alias, '|' ORDER BY alias) AS aliases FROM ({_ALL_SQL}) GROUP BY canonical",
       ["alias_texts", "clean_wiki", "kg_edges"])
def a09(t):
    rows = _all_aliases(t).groupBy("canonical")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"))


@query("U01_alias_union", _ALL_SQL, ["alias_texts", "clean_wiki", "kg_edges"])
def u01(t):
    from corpusloom.operators.graph import symmetric_aliases

    return reports.union_distinct(
        aliases.extract_aliases(t.alias_texts, "description"), aliases.listed_aliases(t.clean_wiki), symmetric_aliases(t.kg_edges))


RESOLVED_SQL = """
SELECT alias, canonical AS canonical_name, alias_count FROM (
  SELECT f.alias, f.canonical, c.n AS alias_count, row_number() OVER (PARTITION BY f.alias ORDER BY c.n DESC, f.canonical) AS r
  FROM final f JOIN (SELECT canonical, count(*) AS n FROM final GROUP BY canonical) c USING (canonical))
WHERE r = 1"""


def _resolved_sql(source: str) -> str:
    return f"""
WITH a AS MATERIALIZED ({source}), n AS (SELECT canonical, count(*) AS n FROM a GROUP BY canonical),
final AS (SELECT DISTINCT CASE WHEN o.n > n.n THEN a.alias ELSE a.canonical END AS canonical,
    CASE WHEN o.n > n.n THEN a.canonical ELSE a.alias END AS alias
  FROM a JOIN n ON n.canonical = a.canonical LEFT JOIN n o ON o.canonical = a.alias)
{RESOLVED_SQL}"""


@query("A10_alias_conflicts", _resolved_sql(_ALL_SQL), ["alias_texts", "clean_wiki", "kg_edges"])
def a10(t):
    return aliases.resolve_alias_conflicts(_all_aliases(t))


@query("J01_alias_resolution", f"""
SELECT question_id, name, coalesce(canonical, name) AS canonical FROM (SELECT question_id, unnest(entities) AS name FROM questions) q
LEFT JOIN (SELECT lower(alias) AS low, max(canonical_name) AS canonical FROM (
  SELECT unnest(['nation_' || n_nationkey, 'Red Widget']) AS alias, unnest(['Realm ' || n_nationkey, 'Widget']) AS canonical_name FROM nation
  WHERE n_regionkey < 3) GROUP BY 1) a ON lower(name) = low""", ["questions"])
def j01(t):
    return _resolved_names(t, t.nation.filter("n_regionkey < 3"))


@query("J01_alias_resolution_all_nations", """
SELECT question_id, name, coalesce(canonical, name) AS canonical FROM (SELECT question_id, unnest(entities) AS name FROM questions) q
LEFT JOIN (SELECT lower(alias) AS low, max(canonical_name) AS canonical FROM (
  SELECT unnest(['nation_' || n_nationkey, 'Red Widget']) AS alias, unnest(['Realm ' || n_nationkey, 'Widget']) AS canonical_name FROM nation) GROUP BY 1) a
  ON lower(name) = low""", ["questions"])
def j01_all(t):
    return _resolved_names(t, t.nation)


def _resolved_names(t, nations):
    known = nations.select(F.explode(F.array(
        F.struct(F.expr("'nation_' || n_nationkey").alias("alias"), F.expr("'Realm ' || n_nationkey").alias("canonical_name")),
        F.struct(F.lit("Red Widget").alias("alias"), F.lit("Widget").alias("canonical_name")))).alias("a")).select("a.*")
    asked = t.questions.select("question_id", F.explode("entities").alias("name"))
    return mentions.resolve_aliases(asked, known).select("question_id", "name", "canonical")


# ---------------------------------------------------------------- mentions

_MENTION_SQL = """
WITH names AS (SELECT min(name) AS name, lower(name) AS low FROM ({names}) GROUP BY lower(name)),
hits AS (SELECT {key} AS text_id, name, low, unnest(list_filter(generate_series(1, length(body)), lambda i:
    substr(lower(body), i, length(low)) = low
    AND (i = 1 OR NOT regexp_matches(substr(body, i - 1, 1), '[\\p{{L}}\\p{{N}}]'))
    AND NOT regexp_matches(substr(body, i + length(low), 1), '[\\p{{L}}\\p{{N}}]'))) AS s
  FROM ({texts}) t JOIN names ON contains(lower(body), low)),
top AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.text_id = h.text_id AND length(o.low) > length(h.low)
    AND o.s < h.s + length(h.low) AND h.s < o.s + length(o.low)))
SELECT text_id, name, CAST(min(s) - 1 AS INT) AS start FROM top GROUP BY text_id, name"""

_NAMES_SQL = """SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT p_name FROM part UNION ALL SELECT p_name || ' #' || p_partkey FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part"""


def _names(t):
    part = t.part
    lists = [t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")),
             t.supplier.select(F.col("s_name").alias("name")), part.select(F.col("p_name").alias("name")),
             part.select(F.expr("p_name || ' #' || p_partkey").alias("name")),
             part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))]
    names = lists[0]
    for other in lists[1:]:
        names = names.unionByName(other)
    return names


@query("J03_mentions", _MENTION_SQL.format(names=_NAMES_SQL, key="question_id", texts="SELECT question_id, question AS body FROM questions"), ["questions"])
def j03(t):
    return mentions.find_mentions(t.questions.select(F.col("question_id").alias("text_id"), F.col("question").alias("text")), _names(t))




@query("J03_mentions_in_documents")
def j03_documents(t):
    """Words and word pairs of the benchmark passages, looked up in whole documents."""
    words = t.benchmark.select(F.split("text", " ").alias("w"))
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    names = words.select(F.explode(F.concat("w", pairs)).alias("name")).filter("name <> ''").distinct()
    return mentions.find_mentions(t.documents.select(F.col("doc_id").alias("text_id"), "text"), names)


# ---------------------------------------------------------------- vectors

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _topk_sql(k: int, queries: str, corpus: str, extra: str = "") -> str:
    return f"""
SELECT query_id, item_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS r
  FROM (SELECT q.query_id, c.item_id, {_COS.format(a='q.v', b='c.v')} AS score FROM ({queries}) q, ({corpus}) c {extra}))
WHERE r <= {k}"""


_Q_SQL = "SELECT query_id, lang, embedding AS v FROM cache_lookups"
_C_SQL = "SELECT vec_id AS item_id, embedding AS v FROM embeddings"


def _rounded(df):
    return df.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("T01_vector_topk", _topk_sql(8, _Q_SQL, _C_SQL), ["cache_lookups"])
def t01(t):
    return _rounded(similarity.vector_topk(t.cache_lookups, t.embeddings, 8, item_id="vec_id"))


@query("T01_vector_topk_blocked", _topk_sql(8, _Q_SQL, _C_SQL), ["cache_lookups"])
def t01_blocked(t):
    """The two-sided block plan, which large query sets take, on the same input."""
    return _rounded(similarity.vector_topk(t.cache_lookups, t.embeddings, 8, item_id="vec_id", query_limit=64))


@query("F05_filtered_topk", _topk_sql(8, _Q_SQL, _C_SQL + " WHERE label IN (1, 4, 7)"), ["cache_lookups"])
def f05(t):
    return _rounded(similarity.vector_topk(t.cache_lookups, t.embeddings, 8, where=F.col("label").isin(1, 4, 7), item_id="vec_id"))


@query("T02_vector_topk_approx")
def t02(t):
    return _rounded(similarity.vector_topk_approx(t.cache_lookups, t.embeddings, 8, item_id="vec_id"))


@query("X01_cosine", f"""
SELECT l.query_id, round({_COS.format(a='l.embedding', b='e.embedding')}, 6) AS score
FROM cache_lookups l JOIN embeddings e ON e.vec_id = l.query_id""", ["cache_lookups"])
def x01(t):
    pairs = t.cache_lookups.join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("other")), "query_id")
    return pairs.select("query_id", F.round(scoring.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def _band(percent: str) -> str:
    return "CASE " + " ".join(f"WHEN {percent} >= {b} THEN '{n}'" for b, n in C.RELEVANCE_BANDS) + f" ELSE '{C.RELEVANCE_REST}' END"


@query("P22_relevance_band", f"""
SELECT query_id, item_id, {_band('floor(score * 100 + 0.5)')} AS band
FROM ({_topk_sql(4, _Q_SQL, _C_SQL)})""", ["cache_lookups"])
def p22(t):
    top = _rounded(similarity.vector_topk(t.cache_lookups, t.embeddings, 4, item_id="vec_id"))
    return top.select("query_id", "item_id", labels.relevance_band(F.col("score")).alias("band"))


_ENTRY_SQL = "SELECT entry_id AS item_id, lang AS clang, embedding AS v FROM cache_entries"
_LOOKUP_SQL = f"""
SELECT l.query_id, lang, CASE WHEN score >= 0.95 THEN item_id END AS entry_id, round(coalesce(score, 0.0), 6) AS score,
  coalesce(score, 0.0) >= 0.95 AS hit
FROM cache_lookups l LEFT JOIN (
  SELECT query_id, item_id, score FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS r
    FROM (SELECT q.query_id, c.item_id, {_COS.format(a='q.v', b='c.v')} AS score FROM ({_Q_SQL}) q JOIN ({_ENTRY_SQL}) c ON c.clang = q.lang)) WHERE r = 1) b
  ON b.query_id = l.query_id"""


@query("J13_cache_lookup", _LOOKUP_SQL, ["cache_lookups", "cache_entries"])
def j13(t):
    return similarity.cache_lookup(t.cache_lookups, t.cache_entries).withColumn("score", F.round("score", 6))


@query("A24_cache_stats", f"""
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 3) AS hit_rate,
  (SELECT count(*) FROM cache_entries) AS size FROM ({_LOOKUP_SQL})""", ["cache_lookups", "cache_entries"])
def a24(t):
    entries = t.cache_entries
    return similarity.cache_stats(similarity.cache_lookup(t.cache_lookups, entries), entries)


@query("S07_vector_upsert", """
WITH old AS (SELECT 'v' || vec_id AS chunk_id, 'old ' || vec_id AS text, 1 AS written, vec_id FROM embeddings),
new AS (SELECT strip_accents('é' || 'v')[2:] || (vec_id + 100) AS chunk_id, left(repeat('new ' || vec_id || ' ', 200), 1000) AS text, 2 + vec_id % 2 AS written, vec_id FROM embeddings)
SELECT chunk_id, text, written, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY written DESC) AS r
  FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) WHERE r = 1""")
def s07(t):
    return similarity.upsert_vectors(*vector_loads(t))


def vector_loads(t):
    """Vectors held and vectors that come in, every id of the old ones but a few among them."""
    old = t.embeddings.select(F.expr("'v' || vec_id").alias("chunk_id"), F.expr("'old ' || vec_id").alias("text"),
                              F.lit(1).cast("long").alias("written"), "vec_id")
    # Ids are folded to ASCII before they are compared.
    new = t.embeddings.select(X.ascii_id(F.expr("' v' || (vec_id + 100)")).alias("raw"), F.expr("repeat('new ' || vec_id || ' ', 200)").alias("text"),
                              F.expr("2 + vec_id % 2").cast("long").alias("written"), "vec_id")
    return old, new.withColumn("chunk_id", X.strip(F.col("raw"))).drop("raw").select(*old.columns)


@query("W09_newest_entries", "SELECT event_id, ts_text FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def w09(t):
    newest = ranking.cap_newest(t.events.select("event_id", "ts"), "ts", C.CACHE_SIZE, "event_id")
    return newest.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


@query("J02_enriched_matches", f"""
SELECT m.query_id, m.item_id, length(coalesce(nullif(d.text, ''), 'preview ' || m.item_id)) AS text_length
FROM ({_topk_sql(8, _Q_SQL, _C_SQL)}) m LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents) d ON d.doc_id = m.item_id * 3""",
       ["cache_lookups"])
def j02(t):
    from corpusloom.plans.retrieve import enrich_text

    top = similarity.vector_topk(t.cache_lookups, t.embeddings, 8, item_id="vec_id").withColumn(
        "preview", F.expr("'preview ' || item_id")).withColumn("chunk", F.col("item_id") * 3)
    chunks = t.documents.select(F.col("doc_id").alias("chunk"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")).alias("text"))
    return enrich_text(top, chunks, "chunk").select("query_id", "item_id", F.length("full_text").cast("long").alias("text_length"))


# ---------------------------------------------------------------- questions

def _classify_sql() -> str:
    branches = [f"WHEN regexp_matches(lower(question), {d_quote('|'.join(p))}) THEN '{n}'" for n, p in C.QUESTION_PATTERNS]
    return "CASE " + " ".join(branches) + " ELSE 'FACTUAL' END"


@query("X04_question_type", f"SELECT question_id, {_classify_sql()} AS query_type FROM questions", ["questions"])
def x04(t):
    return t.questions.select("question_id", labels.classify_query(F.col("question")).alias("query_type"))


_DEPTH_SQL = f"""
SELECT question_id, query_type, CAST(least(greatest(base + extra + bonus, 1), 5) AS INT) AS hops,
  CASE WHEN least(greatest(base + extra + bonus, 1), 5) <= 2 THEN 2 ELSE 5 END AS paths
FROM (SELECT question_id, query_type,
    CASE query_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in C.DEPTH_BY_TYPE.items())} ELSE 2 END AS base,
    CASE WHEN len(entities) >= 3 THEN 2 WHEN len(entities) = 2 THEN 1 ELSE 0 END AS extra,
    CASE WHEN len(list_filter({list(C.DEPTH_KEYWORDS)}, lambda w: contains(lower(question), w))) > 0 THEN 1 ELSE 0 END AS bonus
  FROM (SELECT *, {_classify_sql()} AS query_type FROM questions))"""


@query("X05_search_depth", _DEPTH_SQL, ["questions"])
def x05(t):
    typed = t.questions.withColumn("query_type", labels.classify_query(F.col("question")))
    depth = labels.search_depth(F.col("question"), F.col("entities"), F.col("query_type"))
    return typed.select("question_id", "query_type", depth.alias("d")).select("question_id", "query_type", "d.hops", "d.paths")


# ---------------------------------------------------------------- document fetch

_NAMES_OF = "SELECT doc_id, unnest(list_concat([canonical_name], aliases)) AS name FROM clean_wiki"
_SCORE = """CASE WHEN trim(lower(entity)) = trim(lower(name)) THEN 3
  WHEN contains(trim(lower(name)), trim(lower(entity))) OR contains(trim(lower(entity)), trim(lower(name))) THEN 2 ELSE 0 END"""
_TITLE_BEST = f"""
SELECT entity, doc_id, score FROM (SELECT entity, doc_id, score, row_number() OVER (PARTITION BY entity ORDER BY score DESC, doc_id) AS r
  FROM (SELECT entity, doc_id, max({_SCORE}) AS score FROM (SELECT DISTINCT unnest(entities) AS entity FROM questions) e, ({_NAMES_OF}) n GROUP BY entity, doc_id)
  WHERE score > 0) WHERE r = 1"""
_LAYER_A = f"""
SELECT question_id, doc_id, CAST(min(entity_no) AS INT) AS place, max(score) AS score FROM (
  SELECT question_id, unnest(entities) AS entity, generate_subscripts(entities, 1) - 1 AS entity_no FROM questions) q
JOIN ({_TITLE_BEST}) b USING (entity) GROUP BY question_id, doc_id"""


@query("J09_title_layer", _LAYER_A, ["questions", "clean_wiki"])
def j09(t):
    return fetching.layer_title(t.questions, t.clean_wiki)


@query("X10_title_match", f"""
SELECT entity, name, {_SCORE} AS score FROM (
  SELECT DISTINCT 'NATION_' || doc_id % 25 AS entity, canonical_name AS name FROM clean_wiki)""", ["clean_wiki"])
def x10(t):
    pairs = t.clean_wiki.select(F.expr("'NATION_' || doc_id % 25").alias("entity"), F.col("canonical_name").alias("name")).distinct()
    return pairs.select("entity", "name", scoring.title_match(F.col("entity"), F.col("name")).alias("score"))


# A question takes the vector whose number is its own, modulo their count; two vectors make one document.
_VQ = "SELECT question_id, e.embedding AS v FROM questions q JOIN embeddings e ON e.vec_id = q.k % (SELECT count(*) FROM embeddings)"
_VQ_ASKED = "SELECT e.vec_id AS query_id, e.embedding AS v FROM embeddings e"
_LAYER_B_ALL = f"""
SELECT question_id, doc_id, rank FROM (SELECT q.question_id, t.item_id // 2 AS doc_id, min(rank) AS rank
  FROM (SELECT question_id, k % (SELECT count(*) FROM embeddings) AS vec FROM questions {{where}}) q JOIN ({_topk_sql(20, _VQ_ASKED, _C_SQL)}) t ON t.query_id = q.vec
  GROUP BY q.question_id, t.item_id // 2) f"""
_LAYER_B = f"""
SELECT question_id, doc_id, CAST(place AS INT) AS place FROM (
  SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place
  FROM ({_LAYER_B_ALL}) b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.question_id = b.question_id AND a.doc_id = b.doc_id))
WHERE place <= 8"""


def _with_vectors(t):
    n = t.embeddings.count()
    return by_key(t.wide.questions.withColumn("vec_id", F.col("k") % n)).join(t.embeddings.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def _vectors(t):
    return t.embeddings.select("vec_id", F.expr("vec_id div 2").alias("doc_id"), "embedding")


@query("J10_semantic_layer", f"WITH a AS MATERIALIZED ({_LAYER_A}) {_LAYER_B.format(where='')}", ["questions", "clean_wiki"])
def j10(t):
    held = fetching.layer_title(t.questions, t.clean_wiki)
    return fetching.layer_semantic(_with_vectors(t), _vectors(t), held).select("question_id", "doc_id", "place")


# Documents that name their nations, so that pairs are mentioned together.
_TOLD = """SELECT doc_id, entity_type, canonical_name, aliases,
  content || ' nation_' || doc_id % 25 || ' met NATION_' || (doc_id * 7 + 3) % 25 || repeat(' and NATION_' || (doc_id * 7 + 3) % 25, CAST(doc_id % 4 AS INT))
    || CASE WHEN doc_id % 3 = 0 THEN ' with a red widget' ELSE '' END AS content FROM clean_wiki"""


def _told(t):
    tail = F.expr("""' nation_' || doc_id % 25 || ' met NATION_' || (doc_id * 7 + 3) % 25 || repeat(' and NATION_' || (doc_id * 7 + 3) % 25, CAST(doc_id % 4 AS INT))
      || CASE WHEN doc_id % 3 = 0 THEN ' with a red widget' ELSE '' END""")
    return t.clean_wiki.withColumn("content", F.concat("content", tail))


_COMENTION = """
pairs AS (SELECT DISTINCT lower(x.e) AS a, lower(y.e) AS b FROM (SELECT question_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM questions) x
  JOIN (SELECT question_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM questions) y ON x.question_id = y.question_id AND x.i < y.i),
names AS (SELECT DISTINCT unnest([a, b]) AS name FROM pairs),
counts AS MATERIALIZED (SELECT doc_id, name, entity_type, (length(low) - length(replace(low, name, ''))) // length(name) AS n
  FROM (SELECT doc_id, entity_type, lower(content) AS low FROM told) d JOIN names ON contains(low, name)),
scored AS MATERIALIZED (SELECT a, b, x.doc_id, x.n + y.n + CASE WHEN x.entity_type IN ('Quest', 'Event', 'Character', 'NPC') THEN 10 ELSE 0 END AS score
  FROM pairs JOIN counts x ON x.name = a JOIN counts y ON y.name = b AND y.doc_id = x.doc_id)"""


@query("J11_comention_scores", f"""
WITH told AS MATERIALIZED ({_TOLD}), {_COMENTION}
SELECT a, b, doc_id, CAST(score AS BIGINT) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 3""",
       ["questions", "clean_wiki"])
def j11(t):
    pairs = fetching.entity_pairs(t.questions).select("a", "b")
    return fetching.comention_scores(pairs, _told(t), 3)


_PICK = """SELECT p.question_id, p.pair_no, s.doc_id, row_number() OVER (PARTITION BY p.question_id ORDER BY s.score DESC, s.doc_id) AS r
  FROM qpairs p JOIN scored s ON s.a = p.a AND s.b = p.b WHERE p.pair_no = {no}
  AND NOT EXISTS (SELECT 1 FROM held h WHERE h.question_id = p.question_id AND h.doc_id = s.doc_id) {also}"""

_FETCHED = f"""
WITH told AS MATERIALIZED ({_TOLD}), a AS MATERIALIZED ({_LAYER_A}),
b AS MATERIALIZED ({_LAYER_B.format(where="WHERE list_contains(layers, 'B')").replace("WHERE NOT EXISTS", "WHERE b.doc_id IN (SELECT doc_id FROM clean_wiki) AND NOT EXISTS")}), {_COMENTION},
held AS (SELECT question_id, doc_id FROM a UNION ALL SELECT question_id, doc_id FROM b),
qpairs AS (SELECT x.question_id, lower(x.e) AS a, lower(y.e) AS b, row_number() OVER (PARTITION BY x.question_id ORDER BY x.i, y.i) - 1 AS pair_no
  FROM (SELECT question_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM questions WHERE list_contains(layers, 'C')) x
  JOIN (SELECT question_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM questions) y ON x.question_id = y.question_id AND x.i < y.i),
c0 AS MATERIALIZED (SELECT * FROM ({_PICK.format(no=0, also='')}) WHERE r = 1),
c1 AS MATERIALIZED (SELECT * FROM ({_PICK.format(no=1, also='AND NOT EXISTS (SELECT 1 FROM c0 WHERE c0.question_id = p.question_id AND c0.doc_id = s.doc_id)')}) WHERE r = 1),
c2 AS MATERIALIZED (SELECT * FROM ({_PICK.format(no=2, also='AND NOT EXISTS (SELECT 1 FROM c0 WHERE c0.question_id = p.question_id AND c0.doc_id = s.doc_id) AND NOT EXISTS (SELECT 1 FROM c1 WHERE c1.question_id = p.question_id AND c1.doc_id = s.doc_id)')}) WHERE r = 1),
every AS (SELECT question_id, doc_id, 'A' AS layer, place FROM a UNION ALL SELECT question_id, doc_id, 'B', place FROM b
  UNION ALL SELECT question_id, doc_id, 'C', row_number() OVER (PARTITION BY question_id ORDER BY pair_no) - 1
    FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2))"""


@query("U02_fetched_documents", f"""
{_FETCHED} SELECT question_id, doc_id, layer, CAST(r AS INT) AS doc_no FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY layer, place, doc_id) AS r FROM every) WHERE r <= 20""", ["questions", "clean_wiki"])
def u02(t):
    docs, _ = fetching.fetch_layers(_with_vectors(t), _told(t), _vectors(t))
    return docs.select("question_id", "doc_id", "layer", "doc_no")


@query("U02_fetch_counts", f"""
{_FETCHED} SELECT q.question_id, count(*) FILTER (layer = 'A') AS layer_a, count(*) FILTER (layer = 'B') AS layer_b,
  count(*) FILTER (layer = 'C') AS layer_c, CAST(least(count(layer), 20) AS BIGINT) AS total
FROM questions q LEFT JOIN every e ON e.question_id = q.question_id GROUP BY q.question_id""", ["questions", "clean_wiki"])
def u02_counts(t):
    return fetching.fetch_layers(_with_vectors(t), _told(t), _vectors(t))[1].select("question_id", "layer_a", "layer_b", "layer_c", "total")


@query("A28_source_registry", f"""
SELECT a.doc_id, canonical_name AS title, entity_type, regions[1] AS region, count(*) AS uses
FROM ({_LAYER_A}) a JOIN clean_wiki USING (doc_id) GROUP BY ALL""", ["questions", "clean_wiki"])
def a28(t):
    from corpusloom.operators.conversations import source_registry

    docs = t.clean_wiki.select("doc_id", F.col("canonical_name").alias("title"), "entity_type", F.get("regions", F.lit(0)).alias("region"))
    return source_registry(fetching.layer_title(t.questions, t.clean_wiki).join(docs, "doc_id"))


# ---------------------------------------------------------------- context

_PASSAGES = f"""
SELECT q.question_id, q.entities, {_classify_sql()} AS query_type, t.rank, t.score, d.doc_id, d.text AS full_text, 'Page NATION_' || d.doc_id % 25 AS title,
  CASE WHEN d.doc_id % 3 = 0 THEN 'Story of NATION_' || (d.doc_id + 1) % 25 ELSE '' END AS section_title,
  CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'https://h.example/' || d.doc_id END AS source_url
FROM questions q JOIN ({_topk_sql(8, _VQ_ASKED, _C_SQL)}) t ON t.query_id = q.k % (SELECT count(*) FROM embeddings)
JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' is a friend of nation_' || doc_id % 25 || ', related to NATION_3.' ELSE text END AS text FROM documents) d
  ON d.doc_id = t.item_id"""


def _texts(t):
    text = F.when(F.col("doc_id") % 5 == 0, F.expr("text || ' is a friend of nation_' || doc_id % 25 || ', related to NATION_3.'")).otherwise(F.col("text"))
    return t.documents.select(
        F.col("doc_id").alias("item_id"), "doc_id", text.alias("full_text"), F.expr("'Page NATION_' || doc_id % 25").alias("title"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Story of NATION_' || (doc_id + 1) % 25 ELSE '' END").alias("section_title"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://h.example/' || doc_id END").alias("source_url"))


def _reranked(t):
    top = similarity.vector_topk(_with_vectors(t), t.embeddings, 8, query_id="question_id", item_id="vec_id").withColumnRenamed("query_id", "question_id")
    # As in SQL, passages are scored, and their relevance shown, from the score with six places.
    return context.rerank_passages(top.withColumn("score", F.round("score", 6)), _texts(t), _typed(t))


def _typed(t):
    return t.questions.withColumn("query_type", labels.classify_query(F.col("question")))


_PASSAGE_SCORE = f"""round(least(score, 1.0) * 0.4
  + CASE WHEN length(full_text) > 0 THEN least(list_sum(list_transform(entities, lambda e:
      (length(lower(full_text)) - length(replace(lower(full_text), lower(e), ''))) // length(e))) / (length(full_text) / 500.0) * 0.15, 0.3) ELSE 0 END
  + CASE WHEN len(list_filter(entities, lambda e: contains(lower(title), lower(e)) OR contains(lower(section_title), lower(e)))) > 0 THEN 0.2 ELSE 0 END
  + CASE WHEN query_type = 'RELATIONSHIP' AND regexp_matches(lower(full_text), '{'|'.join(C.RELATIONSHIP_WORDS)}') THEN 0.1
      WHEN query_type = 'FACTUAL' AND regexp_matches(lower(full_text), '{'|'.join(C.FACTUAL_WORDS)}') THEN 0.1 ELSE 0 END, 3)"""

_RERANKED = f"""SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank) AS place
FROM (SELECT *, CAST({_PASSAGE_SCORE} AS DOUBLE) AS rerank_score FROM ({_PASSAGES}))"""


@query("X03_passage_score", f"SELECT question_id, doc_id, rerank_score, CAST(place AS INT) AS place FROM ({_RERANKED})", ["questions"])
def x03(t):
    return _reranked(t).select("question_id", F.col("item_id").alias("doc_id"), "rerank_score", "place")


_PACKED = f"""
WITH RECURSIVE p AS MATERIALIZED ({_RERANKED}), n AS (SELECT question_id, count(*) AS n FROM p GROUP BY question_id),
pack AS (
  SELECT question_id, 0 AS i, 0 AS taken, CAST(6 AS BIGINT) AS used, false AS done, '## Relevant Wiki Passages' AS body FROM n
  UNION ALL
  SELECT question_id, i + 1, CASE WHEN take THEN taken + 1 ELSE taken END, CASE WHEN take THEN used + length(passage) // 4 ELSE used END, NOT take,
    body || CASE WHEN take THEN chr(10) || passage || CASE WHEN source_url <> '' THEN chr(10) || '[Source: ' || source_url || ']' ELSE '' END
      WHEN used >= 4500 THEN chr(10) || chr(10) || '[' || (n - taken) || ' more passages truncated due to token limit]' ELSE '' END
  FROM (SELECT *, used < 4500 AND (fits OR room > 200) AS take,
      CASE WHEN fits THEN whole ELSE head || chr(10) || left(full_text, CAST(room - 50 AS INT)) || '... [truncated]' END AS passage
    FROM (SELECT *, used + length(whole) // 4 <= 4500 AS fits, (4500 - used) * 4 AS room
      FROM (SELECT *, head || chr(10) || full_text AS whole FROM (
        SELECT k.*, p.full_text, p.source_url, n.n, chr(10) || '### [' || (taken + 1) || '] ' || title
          || CASE WHEN section_title <> '' THEN ' > ' || section_title ELSE '' END || ' (relevance: ' || printf('%.2f', score) || ')' AS head
        FROM pack k JOIN p ON p.question_id = k.question_id AND p.place = k.i + 1 JOIN n ON n.question_id = k.question_id WHERE NOT done)))))
SELECT question_id, md5(body) AS digest, used AS tokens, taken, n AS offered FROM (
  SELECT k.*, n.n, row_number() OVER (PARTITION BY k.question_id ORDER BY i DESC) AS r FROM pack k JOIN n ON n.question_id = k.question_id) WHERE r = 1"""


@query("W08_packed_passages", _PACKED, ["questions"])
def w08(t):
    placed, texts = written(_reranked(t)), _texts(t)

    def digests(cut):
        packed = context.pack_passages(cut(placed).join(texts, "item_id"))
        return packed.select("question_id", F.md5(F.col("text_context").cast("binary")).alias("digest"), "tokens", "taken",
                             F.col("offered").cast("long").alias("offered"))

    return in_shares(t.spark, "question_id", context.text_shares(placed, texts), digests)


_LINES = f"""
WITH ranked AS MATERIALIZED ({G.RANKED_SQL}), lines AS (
  SELECT DISTINCT question_id, entity_no, 0 AS line_no, chr(10) || '### ' || entity || ' (' || coalesce(entity_type, 'None') || ')'
    || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || left(description, 200) || CASE WHEN length(description) > 200 THEN '...' ELSE '' END ELSE '' END AS line
  FROM ({G.QUESTION_AROUND})
  UNION ALL
  SELECT question_id, entity_no, place, '  • ' || CASE direction WHEN 'outgoing' THEN entity ELSE other END || ' —[' || relation || ']→ '
    || CASE direction WHEN 'outgoing' THEN other ELSE entity END
    || CASE WHEN coalesce(evidence, '') <> '' THEN chr(10) || '    Evidence: "' || left(evidence, 220) || CASE WHEN length(evidence) > 220 THEN '...' ELSE '' END || '"' ELSE '' END
  FROM ranked)
SELECT question_id, entity_no, CAST(line_no AS INT) AS line_no, line, tokens_before FROM (
  SELECT *, coalesce(CAST(sum(length(line) // 4) OVER (PARTITION BY question_id ORDER BY entity_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS tokens_before
  FROM lines) WHERE tokens_before < 700"""


@query("W07_packed_graph_lines", _LINES, ["questions", "kg_edges", "kg_nodes"])
def w07(t):
    lists, around = graph.entity_lists(t.questions), written(G.around(t))
    lines = context.pack_graph_context(graph.rank_relations(around, lists, key="entities"), budget=700, key="entities", around=around)
    return graph.per_question(lines, t.questions).select("question_id", "entity_no", "line_no", "line", "tokens_before")


@query("U04_hybrid_rows", f"""
SELECT question_id, part, CAST(item_no AS INT) AS item_no, item, block FROM (
  SELECT question_id, 'text' AS part, place AS item_no, CAST(doc_id AS STRING) AS item, CASE query_type WHEN 'RELATIONSHIP' THEN 3 ELSE 1 END AS block FROM ({_RERANKED})
  UNION ALL
  SELECT r.question_id, 'graph', entity_no * 1000 + place, entity || ' ' || direction || ' ' || relation || ' ' || other, CASE {_classify_sql()} WHEN 'RELATIONSHIP' THEN 2 ELSE 3 END
  FROM ({G.RANKED_SQL}) r JOIN questions q ON q.question_id = r.question_id)""", ["questions", "kg_edges", "kg_nodes"])
def u04(t):
    typed = _typed(t)
    none = t.spark.createDataFrame([], "question_id string, path_rank int, path_steps array<string>")
    rows = context.hybrid_rows(_reranked(t).withColumn("doc_id", F.col("item_id")), G.ranked(t), none, typed)
    return rows.select("question_id", "part", "item_no", "item", "block")


_PATH_PARTS = f"""
  SELECT question_id, 'path', r, array_to_string(list_transform(generate_series(1, n), lambda i: nodes[i] || ' -[' || rels[i] || ']-> ' || nodes[i + 1]), '; '), CASE query_type WHEN 'RELATIONSHIP' THEN 1 ELSE 2 END
  FROM asked JOIN (
    SELECT source, target, n, nodes, rels, row_number() OVER (PARTITION BY source, target ORDER BY n, nodes, rels, dirs) AS r
    FROM (SELECT DISTINCT source, target FROM asked) JOIN walk ON start = source AND here = target WHERE n >= 1) p USING (source, target) WHERE r <= 3"""


@query("U04_hybrid_with_paths", f"""
WITH RECURSIVE asked AS (
  SELECT question_id, entities[1] AS source, entities[2] AS target, {_classify_sql()} AS query_type FROM questions WHERE len(entities) >= 2 AND {_classify_sql()} IN ('RELATIONSHIP', 'MULTI_HOP')),
sym AS MATERIALIZED (
  SELECT head AS a, tail AS b, relation, head || '|' || relation || '|' || tail AS k, true AS forward FROM kg_edges
  UNION ALL SELECT tail, head, relation, head || '|' || relation || '|' || tail, false FROM kg_edges WHERE head <> tail),
walk AS (
  SELECT source AS start, source AS here, [source] AS nodes, CAST([] AS VARCHAR[]) AS rels, CAST([] AS VARCHAR[]) AS ks, CAST([] AS BOOLEAN[]) AS dirs, 0 AS n FROM (SELECT DISTINCT source FROM asked)
  UNION ALL
  SELECT start, b, list_append(nodes, b), list_append(rels, relation), list_append(ks, k), list_append(dirs, forward), n + 1
  FROM walk JOIN sym ON a = here WHERE n < 3 AND NOT list_contains(ks, k))
SELECT question_id, part, CAST(item_no AS INT) AS item_no, item, block FROM (
  SELECT question_id, 'text' AS part, place AS item_no, CAST(doc_id AS STRING) AS item, CASE query_type WHEN 'RELATIONSHIP' THEN 3 ELSE 1 END AS block FROM ({_RERANKED})
  UNION ALL
  SELECT r.question_id, 'graph', entity_no * 1000 + place, entity || ' ' || direction || ' ' || relation || ' ' || other, CASE {_classify_sql()} WHEN 'RELATIONSHIP' THEN 2 ELSE 3 END
  FROM ({G.RANKED_SQL}) r JOIN questions q ON q.question_id = r.question_id
  UNION ALL {_PATH_PARTS})""", ["questions", "kg_edges", "kg_nodes"])
def u04_paths(t):
    """Passages, relations and real paths (whole graph, three hops) of every question."""
    typed = _typed(t)
    stores = Stores(vectors=t.embeddings, passages=t.documents, nodes=t.kg_nodes, edges=t.kg_edges)
    found = question_paths(typed, stores, RetrievalConfig(adaptive_depth=False))
    rows = context.hybrid_rows(_reranked(t).withColumn("doc_id", F.col("item_id")), G.ranked(t), found, typed)
    return rows.select("question_id", "part", "item_no", "item", "block")


@query("D07_judge_blocks", """
SELECT question_id, array_to_string(list_transform(key_facts, lambda f, i: '[' || (i - 1) || '] ' || f.fact), chr(10)) AS facts_block,
  CASE WHEN len(hallucination_traps) = 0 THEN '(none defined)' ELSE array_to_string(list_transform(hallucination_traps, lambda x, i:
    '[' || (i - 1) || '] TRAP: ' || x.trap || chr(10) || '    CORRECT: ' || x.correct), chr(10)) END AS traps_block FROM gold""", ["gold"])
def d07(t):
    return context.judge_blocks(t.gold).select("question_id", "facts_block", "traps_block")


@query("D07_user_message", """
SELECT session_id, CASE WHEN turn_no > 0 THEN '## Conversation History' || chr(10) || answer || chr(10) || chr(10) ELSE '' END
  || '## Context' || chr(10) || answer || chr(10) || chr(10) || '## Question' || chr(10) || question AS prompt, turn_no FROM turns""", ["turns"])
def d07_message(t):
    history = F.when(F.col("turn_no") > 0, F.col("answer")).otherwise("")
    return t.turns.select("session_id", context.user_message(F.col("answer"), F.col("question"), history).alias("prompt"), "turn_no")


@query("D08_retrieve")
def d08(t):
    """Whole retrieval for all questions on the whole graph, as configured by default: vectors, graph, paths, reranking, budgets, context."""
    passages = t.documents.select(
        F.col("doc_id").alias("item_id"), F.col("doc_id"), F.expr("'Page ' || doc_id").alias("title"), F.lit("").alias("section_title"),
        F.expr("'https://h.example/' || doc_id").alias("source_url"), F.col("text").alias("full_text"))
    stores = Stores(vectors=t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding"), passages=passages,
                    nodes=t.kg_nodes, edges=t.kg_edges)
    asked = _with_vectors(t).select("question_id", "question", "entities", "embedding")
    return retrieve(asked, stores, RetrievalConfig(keep=lambda contexts: contexts.select(
        "question_id", "query_type", "graph_tokens", "text_tokens", "total_tokens", F.md5(F.col("full_context").cast("binary")).alias("digest"))))


