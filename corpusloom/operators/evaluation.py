"""Gold joins, answer scores, summaries, review flags and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C


def plan_runs(questions: DataFrame, configs: Sequence[str], done: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """Every configuration for every question, without what is done. The configurations are a
    short list, so each question row is multiplied where it lies."""
    work = questions.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    if done is None:
        return work
    return work.join(done.select("config", key).distinct(), ["config", key], "left_anti")


def with_gold(runs: DataFrame, gold: DataFrame, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """Answers with their gold record, and the answers that have none."""
    return runs.join(gold, key), runs.join(gold.select(key), key, "left_anti")


def _valid(indices: Column, total: Column) -> Column:
    """Distinct indices that name an existing entry."""
    return F.filter(F.array_distinct(F.coalesce(indices, F.array().cast("array<int>"))), lambda i: (i >= 0) & (i < total))


def score_answers(judged: DataFrame) -> DataFrame:
    """Scores of each judged answer. Needs covered, triggered, key_facts, hallucination_traps,
    min_acceptable_facts, answer, error and parsed_ok.

    An empty or failed answer scores no facts and no traps sprung; an unreadable judgement scores
    nothing. Indices outside the gold lists are left out and counted.
    """
    n_facts, n_traps = F.size("key_facts"), F.size("hallucination_traps")
    covered, triggered = F.size(_valid(F.col("covered"), n_facts)), F.size(_valid(F.col("triggered"), n_traps))
    given = F.size(F.array_distinct(F.coalesce("covered", F.array().cast("array<int>"))))
    fact = covered / F.greatest(F.lit(1), n_facts)
    trap = F.when(n_traps > 0, 1.0 - triggered / n_traps).otherwise(1.0)
    empty = F.coalesce(F.col("answer") == "", F.lit(True)) | F.col("error").isNotNull()
    broken = ~F.coalesce("parsed_ok", F.lit(False))

    def graded(value: Column, when_empty, when_broken) -> Column:
        return F.when(empty, F.lit(when_empty)).when(broken, F.lit(when_broken)).otherwise(value)

    return judged.select(
        "*",
        F.when(empty, "empty").when(broken, "unreadable").otherwise("scored").alias("outcome"),
        F.round(graded(fact, 0.0, 0.0), 4).alias("fact_score"),
        graded(covered, 0, 0).alias("facts_covered"), n_facts.alias("facts_total"),
        graded(covered >= F.col("min_acceptable_facts"), False, False).alias("min_facts_met"),
        F.round(graded(trap, 1.0, 0.0), 4).alias("trap_score"),
        graded(triggered, 0, 0).alias("traps_triggered"), n_traps.alias("traps_total"),
        F.round(graded(C.FACT_WEIGHT * fact + C.TRAP_WEIGHT * trap, 0.0, 0.0), 4).alias("overall_score"),
        graded(given - covered, 0, 0).alias("facts_out_of_range"),
    )


def summarize_scores(scores: DataFrame) -> DataFrame:
    """One row per configuration: means, share that met the minimum, mean per tier, count."""
    def mean(col: Column, places: int = 4) -> Column:
        # Scores have four places, so a decimal mean is exact and does not depend on the order of rows.
        return F.round(F.coalesce(F.avg(col.cast("decimal(12,4)")), F.lit(0)), places).cast("double")

    tiers = [mean(F.when(F.col("tier") == t, F.col("overall_score"))).alias(f"tier{t}") for t in (1, 2, 3, 4)]
    return scores.groupBy("config").agg(
        mean(F.col("overall_score")).alias("overall"), mean(F.col("fact_score")).alias("fact_score"),
        mean(F.col("trap_score")).alias("trap_score"),
        F.round(F.avg(F.col("min_facts_met").cast("int").cast("decimal(12,4)")) * 100, 1).cast("double").alias("min_facts_pct"),
        *tiers, F.count(F.lit(1)).alias("n"))


def lift(summary: DataFrame, baseline: str = "LLM") -> DataFrame:
    """Difference and percent of each configuration against its model's baseline strategy."""
    parts = summary.select("config", "overall", F.split_part("config", F.lit("-"), F.lit(1)).alias("family"),
                           F.split_part("config", F.lit("-"), F.lit(2)).alias("strategy"))
    base = parts.filter(F.col("strategy") == baseline).select("family", F.col("overall").alias("base"))
    return parts.join(base, "family").select(
        "config", "family", "strategy", F.round(F.col("overall") - F.col("base"), 4).alias("lift"),
        F.round(F.when(F.col("base") > 0, (F.col("overall") - F.col("base")) / F.col("base") * 100), 2).alias("lift_pct"))


def _price(model: Column, side: int, prices: dict) -> Column:
    return F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[side]))])[model]


def usage_cost(runs: DataFrame, prices: dict | None = None, places: int = 6) -> DataFrame:
    """Token totals and dollars per configuration; tokens read from a prompt cache or written to
    it cost a share of the input price."""
    prices = prices or C.TOKEN_PRICES
    plain = F.col("tokens_in") - F.col("cached_in") - F.col("written_in")
    weighted = plain + F.col("cached_in") * C.CACHE_READ_SHARE + F.col("written_in") * C.CACHE_WRITE_SHARE
    cost = (weighted * _price(F.col("model"), 0, prices) + F.col("tokens_out") * _price(F.col("model"), 1, prices)) / 1e6
    return runs.withColumn("cost", cost).groupBy("config").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cached_in").alias("cached_in"), F.round(F.sum("cost"), places).alias("cost_usd"))


def config_averages(runs: DataFrame, prices: dict | None = None) -> DataFrame:
    """Mean seconds and mean cost per configuration."""
    prices = prices or C.TOKEN_PRICES
    cost = (F.col("tokens_in") * _price(F.col("model"), 0, prices) + F.col("tokens_out") * _price(F.col("model"), 1, prices)) / 1e6
    return runs.groupBy("config").agg(F.round(F.avg("seconds"), 4).alias("avg_seconds"), F.round(F.avg(cost), 8).alias("avg_cost"))


def retrieval_class() -> Column:
    return (
        F.when(F.col("use_vector") & F.col("use_graph"), "HYB").when(F.col("use_vector"), "VEC")
        .when(F.col("use_graph"), "GRF").otherwise("LLM"))


def estimate_cost(configs: DataFrame, questions: DataFrame, prices: dict | None = None) -> DataFrame:
    """Cost and time before running: per configuration, per model and in total (null keys)."""
    prices = prices or C.TOKEN_PRICES

    def constant(i: int) -> Column:
        return F.create_map(*[F.lit(x) for k, v in C.ESTIMATE_BY_CLASS.items() for x in (k, float(v[i]))])[F.col("class")]

    n = questions.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    rows = configs.withColumn("class", retrieval_class()).withColumn("one", F.lit(1)).join(n, "one")
    answer = (constant(0) * _price(F.col("model"), 0, prices) + constant(1) * _price(F.col("model"), 1, prices)) / 1e6
    tokens_in, tokens_out = C.ESTIMATE_CLASSIFIER
    classify = (tokens_in * _price(F.col("classifier"), 0, prices) + tokens_out * _price(F.col("classifier"), 1, prices)) / 1e6
    per_question = answer + classify * F.when(F.col("use_expansion"), 2).otherwise(1)
    rows = rows.withColumn("usd", per_question * F.col("n")).withColumn("seconds", constant(2) * F.col("n"))
    return rows.rollup("model", "config").agg(
        F.round(F.sum("usd"), 4).alias("usd"), F.round(F.sum("seconds"), 1).alias("seconds"), F.sum("n").alias("calls"))


def review_flags(gold: DataFrame, risk_patterns: Sequence[str] = C.RISK_PATTERNS) -> DataFrame:
    """Review flags of a gold record: unverified facts, risky facts, coverage notes."""
    risk = "|".join(f"(?:{p})" for p in risk_patterns)

    def flag(fact: Column, i: Column) -> Column:
        where = F.concat(F.lit("key_facts["), i.cast("string"), F.lit("]: "))
        return F.when(~F.coalesce(fact["verified"], F.lit(True)), F.concat(where, F.lit("verified=false — "), F.left(fact["fact"], F.lit(60)))).when(
            fact["fact"].rlike(risk), F.concat(where, F.lit("high-risk pattern — "), F.left(fact["fact"], F.lit(60))))

    notes = F.coalesce("coverage_notes", F.lit("none"))
    note_flag = F.when(F.lower(notes) != "none", F.concat(F.lit("coverage_notes: "), F.left(notes, F.lit(100))))
    flags = F.array_compact(F.concat(F.transform("key_facts", flag), F.array(note_flag)))
    return gold.withColumn("review_flags", flags).withColumn("needs_review", F.size("review_flags") > 0)


def review_report(flagged: DataFrame) -> DataFrame:
    """Clean, flagged and broken counts by tier, highest tier first, and over all."""
    broken = F.coalesce("parse_error", F.lit(False))
    return flagged.rollup("tier").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~broken & F.col("needs_review")).alias("flagged"),
        F.count_if(~broken & ~F.col("needs_review")).alias("clean"), F.count_if(broken).alias("broken"),
        F.sum(F.when(~broken, F.size("review_flags")).otherwise(0)).alias("flags"),
    ).orderBy(F.desc_nulls_last("tier"))
