"""From raw documents to token ids: five stages, each an operator of ``corpusloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes
each result as Parquet in the shared folder and reads it again, so that a lost executor costs no
earlier stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, pii, quality, simhash
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.shared import numbered, stored, table
from corpusloom.tables import let_workers_import


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier takes for good, with all their columns; all rows where no label can be learnt from.

    A null text is scored as an empty one, equal texts alike; repeated rows stay or go together; an empty table stays empty.
    """
    let_workers_import(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest id.

    Rows are told apart by a number of their own, so a group without ids keeps a row, and of two texts
    under one id each stays that stands for its own group. Null and blank texts are one group. Among equal
    ids of a group any one row stays; an empty table stays empty.
    """
    let_workers_import(spark)
    rows, row, own = numbered(docs)
    found = simhash.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col("doc_id").cast("long").alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", row))
    kept = found.join(ids, row).groupBy("component_id").agg(best.alias("best")).select(F.col("best")[row].alias(row))
    return rows.join(kept, row, "left_semi").select(*own)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with personal data in the text replaced by its kind and ``n_chars`` set anew; a null text stays null, as does its length."""
    let_workers_import(spark)
    return pii.without_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, with all its columns, whatever their names.

    Rows are told apart by a number of their own, so repeated or null ids each have their own copies. Rows
    without words (null, empty or blank texts) fall into the mix by the same draw, but add no words; an empty
    table stays empty.
    """
    rows, row, own = numbered(docs)
    taken = mixing.mix(rows, row=row).filter("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), "copies").alias(f"{row}_copies"))
    return rows.join(taken, row).select(*own, F.explode(f"{row}_copies").alias(f"{row}_copy")).select(*own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of the mix: token ids and decoded text of its whole text, none for a null text."""
    let_workers_import(spark)
    return bpe.encoded(docs, vocabulary(), kept=bpe.KEPT_BESIDE_STAGES)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicates", near_dedup),
    ("personal data", mask_pii),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier's fit and the vocabulary's merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
