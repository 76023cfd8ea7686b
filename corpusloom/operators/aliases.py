"""Alias extraction, collection and conflict resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import text as X
from corpusloom.operators.ranking import first_per_key


def extract_aliases(df: DataFrame, text_col: str, name_col: str = "name", patterns: Sequence[str] = C.ALIAS_PATTERNS) -> DataFrame:
    """Aliases that follow an alias phrase: distinct (canonical, alias), cleaned, unlike the name."""
    matches = [F.regexp_extract_all(text_col, F.lit(f"(?iu){p}"), F.lit(1)) for p in patterns]
    found = df.select(F.col(name_col).alias("canonical"), F.explode(F.concat(*matches)).alias("raw"))
    cleaned = found.select("canonical", X.valid_alias(F.col("raw")).alias("alias"))
    return cleaned.filter(F.lower("alias") != F.lower("canonical")).distinct()


def listed_aliases(docs: DataFrame) -> DataFrame:
    """Aliases from the documents' own alias lists, cleaned."""
    found = docs.select(F.col("canonical_name").alias("canonical"), F.explode("aliases").alias("raw"))
    cleaned = found.select("canonical", X.valid_alias(F.col("raw")).alias("alias"))
    return cleaned.filter(F.lower("alias") != F.lower("canonical")).distinct()


def doc_alias_table(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Alias rows of the documents as stored: one per alias, the last document wins."""
    rows = docs.filter(F.col("canonical_name") != "").select(
        F.explode("aliases").alias("alias"), "canonical_name", "entity_type", id_col)
    return first_per_key(rows.filter(F.col("alias") != F.col("canonical_name")), ["alias"], [F.desc(id_col)])


def collect_aliases(*sources: DataFrame) -> DataFrame:
    """Distinct (canonical, alias) over several sources."""
    result = sources[0].select("canonical", "alias")
    for source in sources[1:]:
        result = result.unionByName(source.select("canonical", "alias"))
    return result.distinct()


def resolve_alias_conflicts(aliases: DataFrame) -> DataFrame:
    """One canonical name per alias: (alias, canonical_name, alias_count).

    A pair is turned round when its alias is itself canonical and has more aliases. Then each
    alias stays with the canonical name that has most aliases, the smaller name on ties.
    """
    counts = aliases.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    sized = aliases.join(counts, "canonical").join(
        counts.select(F.col("canonical").alias("alias"), F.col("n").alias("alias_n")), "alias", "left")
    turn = F.coalesce(F.col("alias_n") > F.col("n"), F.lit(False))
    final = sized.select(
        F.when(turn, F.col("alias")).otherwise(F.col("canonical")).alias("canonical"),
        F.when(turn, F.col("canonical")).otherwise(F.col("alias")).alias("alias"),
    ).distinct()
    final_counts = final.groupBy("canonical").agg(F.count(F.lit(1)).alias("alias_count"))
    best = first_per_key(final.join(final_counts, "canonical"), ["alias"], [F.desc("alias_count"), F.col("canonical")])
    return best.select("alias", F.col("canonical").alias("canonical_name"), "alias_count")
