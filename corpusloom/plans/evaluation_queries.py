"""Queries of the evaluation study: plans, answers, scores, reviews, costs, salvage, model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import text as X
from corpusloom.functions.jsonfix import salvage_json
from corpusloom.operators import evaluation, filtering, models, ranking, reports
from corpusloom.plans.catalog import d_round, d_strip, query
from corpusloom.tables import by_key, dealt_by, spread

CONFIGS = ["S4-LLM", "S4-VEC", "S4-GRF", "S4-HYB", "G4-LLM", "G4-VEC", "G4-GRF", "G4-HYB"]


@query("F11_selected_questions", "SELECT question_id, tier FROM questions WHERE tier IN (3, 4) ORDER BY k LIMIT 50", ["questions"])
def f11(t):
    return filtering.select_questions(t.questions, [3, 4], 50).select("question_id", "tier")


@query("J12_run_plan", "SELECT question_id, config FROM questions, configs", ["questions", "configs"])
def j12(t):
    return evaluation.plan_runs(t.questions, CONFIGS).select("question_id", "config")


_DONE = "answer IS NOT NULL OR error IS NOT NULL"


@query("S12_pending_runs", f"""
SELECT q.question_id, c.config FROM questions q, configs c
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.question_id = q.question_id AND r.config = c.config AND ({_DONE}))""", ["questions", "configs", "runs"])
def s12(t):
    return evaluation.plan_runs(t.questions, CONFIGS, t.runs.filter(_DONE)).select("question_id", "config")


@query("U03_missing_gold", "SELECT question_id FROM questions WHERE question_id NOT IN (SELECT question_id FROM gold WHERE NOT parse_error)", ["questions", "gold"])
def u03(t):
    return reports.pending(t.questions.select("question_id"), t.gold.filter("NOT parse_error"), ["question_id"])


@query("J08_gold_join", """
SELECT r.question_id, r.config, r.attempt, len(g.key_facts) AS facts FROM runs r JOIN gold g ON g.question_id = r.question_id AND NOT parse_error""", ["runs", "gold"])
def j08(t):
    matched, _ = evaluation.with_gold(t.runs.select("question_id", "config", "attempt"), t.gold.filter("NOT parse_error"))
    return matched.select("question_id", "config", "attempt", F.size("key_facts").cast("long").alias("facts"))


@query("J08_missing_gold", "SELECT question_id, config, attempt FROM runs WHERE question_id IN (SELECT question_id FROM gold WHERE parse_error)", ["runs", "gold"])
def j08_missing(t):
    return evaluation.with_gold(t.runs.select("question_id", "config", "attempt"), t.gold.filter("NOT parse_error"))[1]


# ---------------------------------------------------------------- scores

_GIVEN = """SELECT r.*, g.key_facts, g.hallucination_traps, g.min_acceptable_facts, len(key_facts) AS nf, len(hallucination_traps) AS nt,
  (k % 19 <> 0) AS parsed_ok FROM runs r JOIN gold g USING (k, question_id, tier)"""
_SCORED = f"""
SELECT k, question_id, tier, config, model, attempt, nf, nt, min_acceptable_facts, tokens_in, tokens_out, seconds,
  CASE WHEN empty THEN 'empty' WHEN NOT parsed_ok THEN 'unreadable' ELSE 'scored' END AS outcome,
  round(CASE WHEN empty OR NOT parsed_ok THEN 0.0 ELSE hit / greatest(nf, 1) END, 4) AS fact_score,
  CAST(CASE WHEN empty OR NOT parsed_ok THEN 0 ELSE hit END AS INT) AS facts_covered,
  CASE WHEN empty OR NOT parsed_ok THEN false ELSE hit >= min_acceptable_facts END AS min_facts_met,
  round(CASE WHEN empty THEN 1.0 WHEN NOT parsed_ok THEN 0.0 WHEN nt > 0 THEN 1.0 - sprung / nt ELSE 1.0 END, 4) AS trap_score,
  round(CASE WHEN empty OR NOT parsed_ok THEN 0.0 ELSE CAST(0.6 AS DOUBLE) * (hit / greatest(nf, 1)) + CAST(0.4 AS DOUBLE) * (CASE WHEN nt > 0 THEN 1.0 - sprung / nt ELSE 1.0 END) END, 4) AS overall_score,
  CAST(CASE WHEN empty OR NOT parsed_ok THEN 0 ELSE given - hit END AS INT) AS facts_out_of_range
FROM (SELECT *, coalesce(answer = '', true) OR error IS NOT NULL AS empty, len(list_distinct(covered)) AS given,
    len(list_filter(list_distinct(covered), lambda i: i >= 0 AND i < nf)) AS hit,
    len(list_filter(list_distinct(triggered), lambda i: i >= 0 AND i < nt)) AS sprung FROM ({_GIVEN}))"""


def _judged(t):
    gold = t.gold.select("question_id", "key_facts", "hallucination_traps", "min_acceptable_facts")
    asked = t.questions.count()
    runs = dealt_by(t.dealt.runs, asked, "question_id")
    return runs.join(by_key(dealt_by(gold, asked, "question_id")), "question_id").withColumn("parsed_ok", F.col("k") % 19 != 0)


def _scores(t):
    return evaluation.score_answers(_judged(t))


@query("A17_answer_scores", f"""
SELECT question_id, config, attempt, outcome, fact_score, facts_covered, min_facts_met, trap_score, overall_score, facts_out_of_range
FROM ({_SCORED}) WHERE outcome = 'scored'""", ["runs", "gold"])
def a17(t):
    return _scores(t).filter("outcome = 'scored'").select(
        "question_id", "config", "attempt", "outcome", "fact_score", "facts_covered", "min_facts_met", "trap_score", "overall_score", "facts_out_of_range")


@query("A18_failure_scores", f"""
SELECT question_id, config, attempt, outcome, fact_score, min_facts_met, trap_score, overall_score FROM ({_SCORED}) WHERE outcome <> 'scored'""", ["runs", "gold"])
def a18(t):
    return _scores(t).filter("outcome <> 'scored'").select(
        "question_id", "config", "attempt", "outcome", "fact_score", "min_facts_met", "trap_score", "overall_score")


_SUMMARY = f"""
SELECT config, {d_round('avg(CAST(overall_score AS DECIMAL(12, 4)))', 4)} AS overall, {d_round('avg(CAST(fact_score AS DECIMAL(12, 4)))', 4)} AS fact_score, {d_round('avg(CAST(trap_score AS DECIMAL(12, 4)))', 4)} AS trap_score,
  {d_round('avg(CAST(min_facts_met AS INT)) * 100', 1)} AS min_facts_pct,
  {', '.join(f"{d_round(f'coalesce(avg(CAST(overall_score AS DECIMAL(12, 4))) FILTER (tier = {i}), 0.0)', 4)} AS tier{i}" for i in (1, 2, 3, 4))}, count(*) AS n
FROM (SELECT * FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY question_id, config ORDER BY attempt DESC) = 1) GROUP BY config"""


def _summary(t):
    last = ranking.keep_last(_scores(t), ["question_id", "config"], ["attempt"])
    return evaluation.summarize_scores(last)


@query("A19_score_summary", _SUMMARY, ["runs", "gold"])
def a19(t):
    return _summary(t)


@query("A20_lift", f"""
WITH s AS ({_SUMMARY}) SELECT a.config, split_part(a.config, '-', 1) AS family, split_part(a.config, '-', 2) AS strategy,
  {d_round('a.overall - b.overall', 4)} AS lift, {d_round('(a.overall - b.overall) / b.overall * 100', 2)} AS lift_pct
FROM s a JOIN s b ON split_part(b.config, '-', 1) = split_part(a.config, '-', 1) AND split_part(b.config, '-', 2) = 'LLM'""", ["runs", "gold"])
def a20(t):
    return evaluation.lift(_summary(t))


def _price_sql(column: str, side: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{m}' THEN CAST({p[side]} AS DOUBLE)" for m, p in C.TOKEN_PRICES.items()) + " END"


@query("A21_usage_cost", f"""
SELECT config, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cached_in) AS BIGINT) AS cached_in,
  round(sum(((tokens_in - cached_in - written_in) + cached_in * CAST(0.1 AS DOUBLE) + written_in * CAST(1.25 AS DOUBLE)) * {_price_sql('model', 0)} + tokens_out * {_price_sql('model', 1)}) / 1e6, 10) AS cost_usd
FROM runs GROUP BY config""", ["runs"])
def a21(t):
    return evaluation.usage_cost(t.runs, places=10)


_CLASS_SQL = "CASE WHEN use_vector AND use_graph THEN 'HYB' WHEN use_vector THEN 'VEC' WHEN use_graph THEN 'GRF' ELSE 'LLM' END"


def _constant_sql(i: int) -> str:
    return f"CASE {_CLASS_SQL} " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in C.ESTIMATE_BY_CLASS.items()) + " END"


@query("A22_cost_estimate", f"""
SELECT model, config, round(sum(usd * n), 4) AS usd, CAST(round(sum(seconds * n), 1) AS DOUBLE) AS seconds, CAST(sum(n) AS BIGINT) AS calls FROM (
  SELECT model, config, (SELECT count(*) FROM questions) AS n, CAST({_constant_sql(2)} AS DOUBLE) AS seconds,
    ({_constant_sql(0)} * {_price_sql('model', 0)} + {_constant_sql(1)} * {_price_sql('model', 1)}) / 1e6
      + (300 * {_price_sql('classifier', 0)} + 50 * {_price_sql('classifier', 1)}) / 1e6 * CASE WHEN use_expansion THEN 2 ELSE 1 END AS usd FROM configs)
GROUP BY ROLLUP (model, config)""", ["configs", "questions"])
def a22(t):
    return evaluation.estimate_cost(t.configs, t.questions)


@query("A23_config_averages", f"""
SELECT config, round(avg(seconds), 4) AS avg_seconds, round(avg((tokens_in * {_price_sql('model', 0)} + tokens_out * {_price_sql('model', 1)}) / 1e6), 8) AS avg_cost
FROM runs GROUP BY config""", ["runs"])
def a23(t):
    return evaluation.config_averages(t.runs)


# ---------------------------------------------------------------- review

_FLAGGED = r"""
SELECT *, list_filter(list_append(list_transform(key_facts, lambda f, i:
    CASE WHEN NOT f.verified THEN 'key_facts[' || (i - 1) || ']: verified=false — ' || left(f.fact, 60)
         WHEN regexp_matches(f.fact, '\d+\s*年|第[一二三四五六七八九十\d]+|先知|Harbinger|\d+\s*个') THEN 'key_facts[' || (i - 1) || ']: high-risk pattern — ' || left(f.fact, 60) END),
    CASE WHEN lower(coverage_notes) <> 'none' THEN 'coverage_notes: ' || left(coverage_notes, 100) END), lambda x: x IS NOT NULL) AS flags FROM gold"""


@query("A25_review_flags", f"SELECT question_id, array_to_string(flags, '; ') AS flags, len(flags) > 0 AS needs_review FROM ({_FLAGGED})", ["gold"])
def a25(t):
    return evaluation.review_flags(t.gold).select("question_id", F.array_join("review_flags", "; ").alias("flags"), "needs_review")


@query("A26_review_report", f"""
SELECT tier, count(*) AS total, count(*) FILTER (NOT parse_error AND len(flags) > 0) AS flagged, count(*) FILTER (NOT parse_error AND len(flags) = 0) AS clean,
  count(*) FILTER (parse_error) AS broken, CAST(coalesce(sum(len(flags)) FILTER (NOT parse_error), 0) AS BIGINT) AS flags FROM ({_FLAGGED}) GROUP BY ROLLUP (tier)""", ["gold"])
def a26(t):
    return evaluation.review_report(evaluation.review_flags(t.gold))


@query("W03_last_run", """
SELECT question_id, config, attempt, tokens_in FROM (SELECT *, row_number() OVER (PARTITION BY question_id, config ORDER BY attempt DESC) AS r FROM runs) WHERE r = 1""", ["runs"])
def w03(t):
    runs = dealt_by(t.dealt.runs.select("question_id", "config", "attempt", "tokens_in"), t.questions.count(), "question_id")
    return ranking.keep_last(runs, ["question_id", "config"], ["attempt"]).select("question_id", "config", "attempt", "tokens_in")


# ---------------------------------------------------------------- model replies

_REPLY = "facts_covered array<int>, traps_triggered array<int>, reasoning string"
_UNFENCED = rf"""CASE WHEN starts_with({d_strip('raw')}, '```') THEN {d_strip(rf"regexp_replace(regexp_replace({d_strip('raw')}, '^```(?:json)?\s*', ''), '\s*```\s*$', '')")} ELSE {d_strip('raw')} END"""


# DuckDB reads trailing commas, which JSON does not allow, so the statement rules them out.
@query("X11_native_salvage", rf"""
SELECT question_id, config, attempt, status, array_to_string(CAST(json_extract(j, '$.facts_covered') AS INT[]), ',') AS covered,
  array_to_string(CAST(json_extract(j, '$.traps_triggered') AS INT[]), ',') AS triggered, json_extract_string(j, '$.reasoning') AS reasoning
FROM (SELECT *, CASE WHEN (json_valid(body) AND NOT regexp_matches(body, ',\s*[\]}}]')) THEN 'direct' WHEN (json_valid(regexp_extract(body, '(?s)\{{.*\}}')) AND NOT regexp_matches(body, ',\s*[\]}}]')) THEN 'braces' END AS status,
    CASE WHEN (json_valid(body) AND NOT regexp_matches(body, ',\s*[\]}}]')) THEN CAST(body AS JSON) WHEN (json_valid(regexp_extract(body, '(?s)\{{.*\}}')) AND NOT regexp_matches(body, ',\s*[\]}}]')) THEN CAST(regexp_extract(body, '(?s)\{{.*\}}') AS JSON) END AS j
  FROM (SELECT *, {_UNFENCED} AS body FROM runs)) WHERE status IS NOT NULL""", ["runs"])
def x11_native(t):
    rows = salvage_json(t.wide.runs, "raw", _REPLY).filter(F.col("status").isin("direct", "braces"))
    return rows.select("question_id", "config", "attempt", "status", F.array_join(F.col("parsed.facts_covered").cast("array<string>"), ",").alias("covered"),
                       F.array_join(F.col("parsed.traps_triggered").cast("array<string>"), ",").alias("triggered"), F.col("parsed.reasoning").alias("reasoning"))


@query("X11_salvaged_replies")
def x11(t):
    rows = salvage_json(t.wide.runs, "raw", _REPLY)
    return rows.select("question_id", "config", "attempt", "status", F.to_json("parsed").alias("parsed"))


@query("X12_tagged_block", """
SELECT question_id, config, attempt, CASE WHEN k % 3 = 0 THEN raw ELSE trim(raw) END AS summary FROM runs""", ["runs"])
def x12(t):
    raw = F.when(F.col("k") % 3 == 0, F.col("raw")).otherwise(
        F.concat(F.lit("<analysis>draft</analysis>\n<summary>\n "), "raw", F.lit(" \n</summary> end")))
    return t.runs.select("question_id", "config", "attempt", X.tagged_block(raw).alias("summary"))


_EXTRACTED = """chr(123) || '"entities": [' || chr(123) || '"name": "' || c_name || '", "type": "Character"' || chr(125) || ', '
  || chr(123) || '"name": "NATION_' || c_nationkey || '", "description": "a land"' || chr(125) || '], "triples": ['
  || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(123) || '"head": "' || c_name || '", "relation": "LOCATED_IN", "tail": "NATION_' || c_nationkey || '"' || chr(125) END
  || ']' || chr(125)"""


def _extractions(t):
    rows = t.customer.select(F.concat(F.lit("doc_"), F.col("c_custkey").cast("string")).alias("doc_id"), F.col("c_name").alias("title"),
                             F.expr(_EXTRACTED).alias("reply"))
    return rows.withColumn("parsed", F.from_json("reply", models.EXTRACTION_SCHEMA))


@query("D06_entity_rows", """
SELECT c_name AS name, 'Character' AS type, '' AS description, 'doc_' || c_custkey AS source_doc_id, c_name AS source_title FROM customer
UNION ALL SELECT 'NATION_' || c_nationkey, 'Unknown', 'a land', 'doc_' || c_custkey, c_name FROM customer""")
def d06_entities(t):
    return models.split_extractions(_extractions(t))[0]


@query("D06_triple_rows", """
SELECT c_name AS head, 'LOCATED_IN' AS relation, 'NATION_' || c_nationkey AS tail, '' AS evidence, 'doc_' || c_custkey AS source_doc_id, c_name AS source_title
FROM customer WHERE c_custkey % 3 <> 0""")
def d06_triples(t):
    return models.split_extractions(_extractions(t))[1]


def _stub_client():
    """Deterministic stand-in for a model: labels a text by its length and fails on no batch."""

    def label(rows: list[dict]) -> list[dict]:
        return [{"label": "long" if len(r["text"]) > 2000 else "short", "tokens": len(r["text"]) // 4} for r in rows]

    return label


@query("D04_model_calls", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS label, length(text) // 4 AS tokens, CAST(NULL AS STRING) AS error FROM documents""")
def d04(t):
    return models.map_model(spread(t.documents.select("doc_id", "text")), _stub_client, "label string, tokens bigint", "doc_id")


@query("D05_default_embedding")
def d05(t):
    rows = models.embed(t.documents.select("doc_id", "text"), "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return rows.select("doc_id", F.size("embedding").alias("width"), F.round(F.sqrt(total), 4).alias("length"))
