"""Retrieval for a whole table of questions under a configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import labels
from corpusloom.operators import context, graph, paths, similarity
from corpusloom.session import written
from corpusloom.tables import beside, in_shares, spread


@dataclass(frozen=True)
class RetrievalConfig:
    use_vectors: bool = True
    use_graph: bool = True
    use_paths: bool = True
    use_full_text: bool = True
    use_graph_ranking: bool = True
    use_multi_path: bool = True
    use_reranking: bool = True
    adaptive_depth: bool = True
    top_k: int = 8
    max_relations: int = 15
    max_hops: int = 3
    max_paths: int = 3
    graph_budget: int = C.GRAPH_BUDGET
    text_budget: int = C.TEXT_BUDGET
    #: What a caller keeps of the contexts, who then has them made in shares of the questions.
    keep: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Stores:
    """What retrieval reads: vectors (item_id, embedding), passages (item_id, doc_id, title,
    section_title, source_url, full_text, optionally preview), graph nodes and edges."""

    vectors: DataFrame
    passages: DataFrame
    nodes: DataFrame
    edges: DataFrame


def enrich_text(matches: DataFrame, chunks: DataFrame, key: str, text: str = "text", preview: str = "preview") -> DataFrame:
    """Full text of a match, or its stored preview where the text is missing or empty."""
    joined = matches.join(chunks.select(key, text), key, "left")
    return joined.withColumn("full_text", F.coalesce(F.nullif(F.col(text), F.lit("")), F.col(preview))).drop(text)


def _passages(questions: DataFrame, stores: Stores, config: RetrievalConfig) -> tuple[DataFrame, DataFrame]:
    """The passages found for each question, with their places, and the texts that they are shown with."""
    top = similarity.vector_topk(questions, stores.vectors, config.top_k, query_id="question_id").withColumnRenamed("query_id", "question_id")
    texts = stores.passages
    if not config.use_full_text and "preview" in texts.columns:
        texts = texts.withColumn("full_text", F.col("preview"))
    placed = context.rerank_passages(top, texts, questions) if config.use_reranking else top.withColumn("place", F.col("rank"))
    return placed, texts


def _relations(questions: DataFrame, stores: Stores, config: RetrievalConfig) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods of the entity lists that are asked, those without relations included, and their ranked relations."""
    lists = graph.entity_lists(questions)
    around = written(graph.neighbors_many(lists, stores.nodes, stores.edges, config.max_relations, key="entities"))
    if config.use_graph_ranking:
        ranked = graph.rank_relations(around, lists, key="entities")
    else:
        place = F.col("rank") + F.when(F.col("direction") == "outgoing", 0).otherwise(config.max_relations)
        ranked = around.filter(F.col("relation").isNotNull()).withColumn("score", F.lit(0.0)).withColumn("place", place)
    return around, ranked


def question_paths(questions: DataFrame, stores: Stores, config: RetrievalConfig) -> DataFrame:
    """Paths between the first two entities. Questions about the same two entities share a search."""
    kinds = ["RELATIONSHIP", "MULTI_HOP"]
    asked = questions.filter(F.col("query_type").isin(kinds) & (F.size("entities") >= 2)).select(
        "question_id", F.get("entities", F.lit(0)).alias("source"), F.get("entities", F.lit(1)).alias("target"),
        labels.search_depth(F.col("question"), F.col("entities"), F.col("query_type")).alias("depth"))
    if config.adaptive_depth:
        asked = asked.withColumn("hops", F.col("depth.hops")).withColumn("keep", F.col("depth.paths"))
        hops, keep = C.DEPTH_RANGE[1], 5
    else:
        hops, keep = config.max_hops, config.max_paths if config.use_multi_path else 1
        asked = asked.withColumn("hops", F.lit(hops)).withColumn("keep", F.lit(keep))
    pair = F.concat_ws("\x1f", "source", "target", F.col("hops").cast("string"))
    asked = asked.withColumn("pair_id", pair)
    found = paths.paths(asked.select("pair_id", "source", "target", "hops").distinct(), stores.nodes, stores.edges, hops, keep)
    return spread(asked.select("question_id", "pair_id", "source", "target", "keep")).join(beside(found), "pair_id").filter(F.col("path_rank") <= F.col("keep"))


def retrieve(questions: DataFrame, stores: Stores, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Context and token figures per question (question_id, question, entities, embedding).

    The configuration decides which branches the plan has. Work is shared across questions:
    neighbourhoods per distinct entity, paths per distinct pair, one vector pass. Contexts are many times the
    texts that they are made of. A caller who keeps only something of them (``config.keep``: rows of contexts to rows) has
    them made in shares of the questions, after the shared work, so that no more than a share's are on disk.
    """
    typed = questions.withColumn("query_type", labels.classify_query(F.col("question")))
    hold = written if config.keep is not None else lambda df: df
    placed = texts = lines = lists = blocks = None
    if config.use_vectors:
        placed, texts = _passages(typed, stores, config)
        placed = hold(placed)
    if config.use_graph:
        if config.use_paths:
            best = question_paths(typed, stores, config).filter(F.col("path_rank") == 1)
            blocks = hold(context.path_block(best.withColumnRenamed("source", "entity1").withColumnRenamed("target", "entity2")))
        around, ranked = _relations(typed, stores, config)
        lines = context.pack_graph_context(ranked, None, config.graph_budget, key="entities", around=around)
        lists = context.line_lists(lines)

    def contexts(cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
        asked = cut(typed)
        packed = asked.select("question_id").limit(0).withColumn("text_context", F.lit(""))
        graphs = asked.select("question_id").limit(0).withColumn("graph_context", F.lit(""))
        if placed is not None:
            packed = context.pack_passages(cut(placed).join(texts, "item_id"), config.text_budget)
        if lists is not None:
            graphs = context.shared_graph_text(lines, asked, cut(blocks) if blocks is not None else None, config.graph_budget, lists=lists)
        return context.assemble_context(asked, packed, graphs)

    if config.keep is None:
        return contexts(lambda df: df)
    typed = written(typed.select("question_id", "query_type", "entities"))
    shares = 1
    if placed is not None:
        graph_chars = typed.count() * config.graph_budget * C.CHARS_PER_TOKEN if lists is not None else 0
        shares = context.text_shares(placed, texts, config.text_budget, more=graph_chars)
    return in_shares(typed.sparkSession, "question_id", shares, lambda cut: config.keep(contexts(cut)))
