"""Queries over messages, turns, sessions, the answer cache, service calls and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import conversations as K
from corpusloom.operators import filtering, profiling
from corpusloom.plans.catalog import query
from corpusloom.tables import spread

# ---------------------------------------------------------------- messages and turns


@query("J16_paired_turns", """
SELECT conv_id, turn, CASE WHEN before_role = 'user' THEN before_text ELSE '(unknown)' END AS question, text AS answer FROM (
  SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant'""", ["messages"])
def j16(t):
    return K.pair_turns(t.messages).select("conv_id", "turn", "question", "answer")


@query("S16_session_history", """
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_no) - 1 AS INT) AS index, question, answer, query_type, ts_s,
  min(ts_s) OVER (PARTITION BY session_id) AS created_at, max(ts_s) OVER (PARTITION BY session_id) AS last_activity FROM turns""", ["turns"])
def s16(t):
    return K.session_history(t.turns)


_SUMMARIES = "SELECT DISTINCT session_id, 'so far ' || session_id AS summary FROM turns WHERE session_id % 2 = 0"


@query("P18_history_context", f"""
SELECT session_id, right(coalesce('[Summary of earlier conversation]' || chr(10) || summary || chr(10) || chr(10), '') || body, 600) AS history FROM (
  SELECT session_id, string_agg('[User]: ' || question || chr(10) || '[Assistant]: ' || rtrim(left(answer, 300), ' ' || chr(10)) ||
    CASE WHEN length(answer) > 300 THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY turn_no) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS r FROM turns) WHERE r <= 2 GROUP BY session_id) h
LEFT JOIN ({_SUMMARIES}) s USING (session_id)""", ["turns"])
def p18(t):
    summaries = t.turns.filter("session_id % 2 = 0").select("session_id", F.expr("'so far ' || session_id").alias("summary")).distinct()
    return K.history_context(t.turns, summaries, total_chars=600)


@query("W05_recent_turns", "SELECT session_id, turn_no FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS r FROM turns) WHERE r <= 2", ["turns"])
def w05(t):
    return K.recent_turns(t.turns, 2).select("session_id", "turn_no")


def _fold_sql(said: str, cap: int) -> str:
    """Entities known after a list of turns: the new ones of a turn go last, then the list is cut to its last ``cap``."""
    return f"""list_reduce({said}, lambda known, named: list_reverse(list_slice(list_reverse(
      known || list_filter(named, lambda e, i: NOT list_contains(known, e) AND list_position(named, e) = i)), 1, {cap})), []::VARCHAR[])"""


@query("W06_accumulated_entities", f"""
SELECT session_id, CAST(place AS INT) AS place, known[place] AS entity FROM (
  SELECT session_id, known, unnest(range(1, len(known) + 1)) AS place FROM (
    SELECT session_id, {_fold_sql("list(entities ORDER BY turn_no)", 2)} AS known FROM turns GROUP BY session_id))""", ["turns"])
def w06(t):
    return K.accumulated_entities(t.turns, 2)


@query("X06_coreference_small_cap", rf"""
SELECT session_id, turn_no, CASE WHEN regexp_matches(question, '(?i)\b(he|she|they|it|him|her|them|this|that|those|these|the same|their|his|hers)\b')
    AND coalesce(len(last), 0) > 0 AND len(list_filter(known, lambda e: contains(lower(question), lower(e)))) = 0
  THEN '[Referring to ' || last[1] || '] ' || question ELSE question END AS resolved
FROM (SELECT session_id, turn_no, question, lag(entities) OVER w AS last, {_fold_sql("coalesce(list(entities) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])", 2)} AS known
  FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_no))""", ["turns"])
def x06_small(t):
    """Sessions that remember two names only, so that most of them pass the cap."""
    return K.resolve_coreference(t.turns, cap=2).select("session_id", "turn_no", "resolved")


@query("X06_coreference", r"""
SELECT session_id, turn_no, CASE WHEN regexp_matches(question, '(?i)\b(he|she|they|it|him|her|them|this|that|those|these|the same|their|his|hers)\b')
    AND coalesce(len(last), 0) > 0 AND len(list_filter(list_slice(known, greatest(len(known) - 4, 1), len(known)), lambda e: contains(lower(question), lower(e)))) = 0
  THEN '[Referring to ' || last[1] || '] ' || question ELSE question END AS resolved
FROM (SELECT t.session_id, t.turn_no, t.question, (SELECT entities FROM turns p WHERE p.session_id = t.session_id AND p.turn_no = t.turn_no - 1) AS last,
    coalesce((SELECT list(entity ORDER BY pos) FROM (SELECT entity, min(turn_no * 1000 + i) AS pos FROM (
      SELECT turn_no, unnest(entities) AS entity, generate_subscripts(entities, 1) AS i FROM turns p WHERE p.session_id = t.session_id AND p.turn_no < t.turn_no) GROUP BY entity)), []) AS known
  FROM turns t)""", ["turns"])
def x06(t):
    return K.resolve_coreference(t.turns).select("session_id", "turn_no", "resolved")


@query("A27_session_sizes", """
SELECT session_id, count(*) AS turns, CAST(sum(length(question) + length(answer)) AS BIGINT) AS chars,
  count(*) >= 3 AND sum(length(question) + length(answer)) >= 3000 AS compress FROM turns GROUP BY session_id""", ["turns"])
def a27(t):
    return K.session_sizes(t.turns, 3, 3000)


_INDEX = """
SELECT c.conv_id, CASE WHEN date_diff('day', CAST(started AS DATE), DATE '2024-01-01') = 0 THEN 'Today'
    WHEN date_diff('day', CAST(started AS DATE), DATE '2024-01-01') = 1 THEN 'Yesterday' ELSE strftime(started, '%b %-d') END AS label,
  coalesce(first_question, '(empty conversation)') AS first_question, coalesce(last_type, 'FACTUAL') AS last_query_type
FROM (SELECT conv_id, min(ts) AS started, arg_min(text, turn) FILTER (role = 'user') AS first_question FROM messages GROUP BY conv_id) c
LEFT JOIN (SELECT session_id, arg_max(query_type, turn_no) FILTER (query_type <> '') AS last_type FROM turns GROUP BY session_id) l ON session_id = conv_id"""


def _index(t):
    return K.conversation_index(t.messages, t.turns, F.lit("2024-01-01 20:00:00").cast("timestamp_ntz"))


@query("A29_conversation_index", _INDEX, ["messages", "turns"])
def a29(t):
    return _index(t)


@query("A29_label_counts", f"SELECT label, count(*) AS conversations FROM ({_INDEX}) GROUP BY label", ["messages", "turns"])
def a29_labels(t):
    return K.label_counts(_index(t))


@query("F10_conversation_search", "SELECT conv_id, count(*) AS hits FROM messages WHERE contains(lower(text), 'nation_1') GROUP BY conv_id", ["messages"])
def f10(t):
    return filtering.search_conversations(t.messages, "NATION_1")


@query("F10_answer_search", "SELECT session_id, turn_no FROM turns WHERE contains(lower(question), 'eaux') OR contains(lower(answer), 'eaux')", ["turns"])
def f10_answers(t):
    return filtering.search_answers(t.turns, "Eaux").select("session_id", "turn_no")


@query("P19_citations", r"""
SELECT question_id, config, attempt, CAST(i - 1 AS INT) AS citation_no, trim(sentences[i]) AS sentence, sources[i] AS source FROM (
  SELECT *, unnest(generate_series(1, len(sources))) AS i FROM (
    SELECT question_id, config, attempt, regexp_extract_all(a, '([^.。\n]+?)\s*\[Source:\s*([^\]]+)\]', 1) AS sentences,
      regexp_extract_all(a, '([^.。\n]+?)\s*\[Source:\s*([^\]]+)\]', 2) AS sources
    FROM (SELECT *, regexp_replace(answer, '\[Relation: .*?\]', '', 'g') AS a FROM runs WHERE answer IS NOT NULL)))""", ["runs"])
def p19(t):
    return K.extract_citations(t.wide.runs, key=("question_id", "config", "attempt"))


@query("S15_cache_history", """
SELECT entry_id, question, answer, ts_s, array_to_string(list_transform(sources, lambda s: s.title || '/' || length(left(s.full_text, 500)) || '/' || coalesce(s.regions[1], '-')), '; ') AS sources
FROM cache_entries""", ["cache_entries"])
def s15(t):
    rows = K.cache_history(t.cache_entries)
    text = F.transform("sources", lambda s: F.concat_ws("/", s["title"], F.length(s["text"]).cast("string"), F.coalesce(s["region"], F.lit("-"))))
    return rows.select("entry_id", "question", "answer", "ts_s", F.array_join(text, "; ").alias("sources"))


# ---------------------------------------------------------------- sessions and service calls

_SESSIONS = """
SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no, event_id, ts FROM (
  SELECT *, CASE WHEN coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 3600000000, true) THEN 1 ELSE 0 END AS fresh FROM events)"""


@query("R01_sessions", f"""
SELECT user_id, session_no, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity
FROM ({_SESSIONS}) GROUP BY user_id, session_no""")
def r01(t):
    rows = K.session_summary(t.events)
    return rows.select("user_id", "session_no", "events", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
                       F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


@query("R01_event_sessions", f"SELECT user_id, event_id, session_no FROM ({_SESSIONS})")
def r01_events(t):
    return K.sessionize(t.events).select("user_id", "event_id", "session_no")


@query("R06_failure_streaks", """
SELECT user_id, count(*) AS failures, min(event_id) AS first_call, max(event_id) AS last_call FROM (
  SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS good FROM events)
WHERE event_type = 'error' GROUP BY user_id, good HAVING count(*) >= 3""")
def r06(t):
    return K.failure_streaks(t.events)


@query("R06_availability_states", """
WITH RECURSIVE calls AS MATERIALIZED (SELECT user_id AS service, event_id AS call_id, epoch_us(ts) AS t_us, event_type = 'error' AS failed,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT service, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS call_id, 0 AS failures, CAST(0 AS BIGINT) AS last_failure, false AS is_open, '' AS before, '' AS after, false AS rejected
  FROM (SELECT DISTINCT service FROM calls)
  UNION ALL
  SELECT service, n, call_id, f2, lf2, o2, before, CASE WHEN NOT o2 THEN 'closed' WHEN t_us - lf2 >= 60000000 THEN 'half_open' ELSE 'open' END, before = 'open'
  FROM (SELECT *, CASE WHEN before = 'open' THEN failures WHEN failed THEN failures + 1 ELSE 0 END AS f2,
      CASE WHEN before <> 'open' AND failed THEN t_us ELSE last_failure END AS lf2,
      CASE WHEN before = 'open' THEN true WHEN failed THEN failures + 1 >= 3 ELSE false END AS o2
    FROM (SELECT c.service, c.n, c.call_id, c.t_us, c.failed, w.failures, w.last_failure,
        CASE WHEN NOT w.is_open THEN 'closed' WHEN c.t_us - w.last_failure >= 60000000 THEN 'half_open' ELSE 'open' END AS before
      FROM walk w JOIN calls c ON c.service = w.service AND c.n = w.n + 1)))
SELECT service, call_id, before, after, rejected FROM walk WHERE n > 0""")
def r06_states(t):
    return K.availability(t.events)


# ---------------------------------------------------------------- profiles


def _profile_sql(table: str, order: str, columns: dict[str, str]) -> str:
    def one(name: str, kind: str) -> str:
        text, counted = kind == "string", kind in ("string", "integer", "boolean")
        value = f"nullif({name}, '')" if text else f"CAST({name} AS STRING)"
        size = "length(v)" if text else "CAST(NULL AS INT)"

        def hint(test: str) -> str:
            if not text:
                return "CAST(NULL AS BOOLEAN)"
            return f"(SELECT bool_or({test}) FROM (SELECT v FROM x WHERE v IS NOT NULL ORDER BY pos LIMIT 50))"

        median = "CAST((list_sort(list(length(v)) FILTER (v IS NOT NULL)))[count(v) // 2 + 1] AS INT)" if text else "CAST(NULL AS INT)"
        listed = "CASE WHEN count(DISTINCT v) <= 30 THEN string_agg(DISTINCT v, '|' ORDER BY v) END" if counted else "CAST(NULL AS STRING)"
        return f"""SELECT * FROM (
WITH x AS MATERIALIZED (SELECT {order} AS pos, {name} IS NULL AS raw_null, {value} AS v FROM {table})
SELECT '{name}' AS field_name, CASE WHEN count(v) > 0 THEN '{kind}' ELSE 'null' END AS primary_type, count(*) AS total_count,
  count(v) AS non_null_count, count(*) FILTER (raw_null) AS null_count, round(1 - count(v) / count(*), 4) AS null_rate,
  CAST(min({size}) AS INT) AS min_length, CAST(max({size}) AS INT) AS max_length, round(avg({size}), 1) AS avg_length,
  {median} AS median_length, {"count(DISTINCT v)" if counted else "CAST(NULL AS BIGINT)"} AS unique_count, {listed} AS unique_values,
  (SELECT string_agg(e, '|' ORDER BY p) FROM (SELECT CASE WHEN length(v) > 200 THEN left(v, 200) || '...' ELSE v END AS e, min(pos) AS p
    FROM x WHERE v IS NOT NULL GROUP BY 1 ORDER BY p LIMIT 3)) AS examples,
  {hint("contains(v, '<') AND contains(v, '>')")} AS contains_html,
  {hint("contains(v, '#') OR contains(v, '[[') OR contains(v, '**')")} AS contains_markdown,
  {hint("contains(v, '{{') OR contains(v, '[[')")} AS contains_wikitext
FROM x)"""

    return " UNION ALL ".join(one(name, kind) for name, kind in columns.items())


def _profiled(df, order):
    return profiling.profile(df, order).withColumn("examples", F.array_join("examples", "|"))


_DOCS = {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"}
_CUSTOMERS = {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_mktsegment": "string"}


@query("A14_profile_documents", _profile_sql("documents", "doc_id", _DOCS))
def a14_documents(t):
    return _profiled(spread(t.documents.select(*_DOCS)), "doc_id")


@query("A14_profile_customers", _profile_sql("customer", "c_custkey", _CUSTOMERS))
def a14_customers(t):
    return _profiled(t.customer.select(*_CUSTOMERS), "c_custkey")


_PAGES = {"page_id": "integer", "url": "string", "html": "string"}


@query("A14_profile_pages", _profile_sql("pages", "page_id", _PAGES))
def a14_pages(t):
    return _profiled(t.pages.select(*_PAGES), "page_id")


_WIKI = {"doc_id": "integer", "title": "string", "markdown": "string"}


@query("A14_profile_wiki", _profile_sql("wiki", "doc_id", _WIKI), ["wiki"])
def a14_wiki(t):
    return _profiled(t.wiki.select(*_WIKI), "doc_id")


_SKETCHED = {"documents": ("doc_id", _DOCS), "customer": ("c_custkey", _CUSTOMERS), "pages": ("page_id", _PAGES), "wiki": ("doc_id", _WIKI)}


def _hints_sql(table: str, columns: dict[str, str]) -> str:
    def one(name: str, kind: str) -> str:
        value = f"nullif({name}, '')" if kind == "string" else f"CAST({name} AS STRING)"
        size = "length(v)" if kind == "string" else "CAST(NULL AS INT)"
        hint = lambda test: f"bool_or({test}) FILTER (v IS NOT NULL)" if kind == "string" else "CAST(NULL AS BOOLEAN)"
        return f"""SELECT '{table}' AS table_name, '{name}' AS field_name, CASE WHEN count(v) > 0 THEN '{kind}' ELSE 'null' END AS primary_type, count(*) AS total_count,
  count(v) AS non_null_count, count(*) FILTER (raw_null) AS null_count, round(1 - count(v) / count(*), 4) AS null_rate,
  CAST(min({size}) AS INT) AS min_length, CAST(max({size}) AS INT) AS max_length, round(avg({size}), 1) AS avg_length,
  CASE WHEN count(DISTINCT v) <= 30 THEN string_agg(DISTINCT v, '|' ORDER BY v) END AS unique_values,
  {hint("contains(v, '<') AND contains(v, '>')")} AS contains_html, {hint("contains(v, '#') OR contains(v, '[[') OR contains(v, '**')")} AS contains_markdown,
  {hint("contains(v, '{{') OR contains(v, '[[')")} AS contains_wikitext FROM (SELECT {name} IS NULL AS raw_null, {value} AS v FROM {table})"""

    return " UNION ALL ".join(one(name, kind) for name, kind in columns.items())


@query("A14_profile_sketched", " UNION ALL ".join(_hints_sql(table, columns) for table, (_, columns) in _SKETCHED.items()), ["wiki"])
def a14_sketched(t):
    """Profiles of four tables from sketches: what they give exactly, format hints over all values included."""
    result = None
    for table, (order, columns) in _SKETCHED.items():
        rows = profiling.profile_sketched(getattr(t, table).select(*columns), order).drop("frequent", "examples", "unique_count", "median_length")
        rows = rows.withColumn("table_name", F.lit(table))
        result = rows if result is None else result.unionByName(rows)
    return result


def _roles_sql(table: str, order: str, columns: dict[str, str]) -> str:
    return f"""
WITH p AS ({_profile_sql(table, order, columns)})
SELECT 'id' AS role, field_name FROM p WHERE primary_type IN ('string', 'integer') AND null_rate < 0.05 AND unique_count > total_count * 0.8
UNION ALL SELECT 'name', field_name FROM p WHERE primary_type = 'string' AND regexp_matches(lower(field_name), 'name|title|label')
UNION ALL SELECT 'category', field_name FROM p WHERE primary_type = 'string' AND unique_count BETWEEN 1 AND 30 AND null_rate < 0.3
UNION ALL SELECT 'text', field_name FROM p WHERE primary_type = 'string' AND avg_length > 200
UNION ALL SELECT 'reference', field_name FROM p WHERE primary_type = 'string' AND (contains(examples, 'http') OR contains(examples, '[[') OR contains(lower(examples), 'wiki'))"""


@query("A15_key_roles_of_pages", _roles_sql("pages", "page_id", _PAGES))
def a15(t):
    return profiling.infer_roles(profiling.profile(t.pages.select(*_PAGES), "page_id"))


@query("A15_key_roles_of_documents", _roles_sql("documents", "doc_id", _DOCS))
def a15_documents(t):
    return profiling.infer_roles(profiling.profile(t.documents.select(*_DOCS), "doc_id"))


@query("A16_link_clues", """
WITH head AS (SELECT doc_id, text AS parent_text, '[[' || lang || ']] link' AS link_note, source FROM documents ORDER BY doc_id LIMIT 20)
SELECT 'parent_text' AS field_name, bool_or(contains(parent_text, '[[') AND contains(parent_text, ']]')) AS has_links, true AS relation_name FROM head
UNION ALL SELECT 'link_note', bool_or(contains(link_note, '[[') AND contains(link_note, ']]')), true FROM head
UNION ALL SELECT 'source', bool_or(contains(source, '[[') AND contains(source, ']]')), false FROM head""")
def a16(t):
    rows = t.documents.select("doc_id", F.col("text").alias("parent_text"), F.expr("'[[' || lang || ']] link'").alias("link_note"), "source")
    return profiling.link_clues(rows, "doc_id")
