"""Knowledge graph as two tables: nodes (name, type, description, ...) and edges
(head, relation, tail, evidence, source_doc_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import scoring, text as X
from corpusloom.operators.ranking import first_per_key, top_per_key
from corpusloom.session import written
from corpusloom.tables import beside, by_key, spread

EDGE_KEY = ["head", "relation", "tail"]


def _size(col: str) -> Column:
    return F.length(F.coalesce(F.col(col), F.lit("")))


def dedup_entities(mentions: DataFrame, order_by: str = "pos") -> DataFrame:
    """One row per name: the longest description, the first on ties."""
    return first_per_key(mentions, ["name"], [_size("description").desc(), F.col(order_by)])


def upsert_nodes(current: DataFrame, new: DataFrame) -> DataFrame:
    """Insert unknown names; on a match only a longer description is taken over."""
    old, fresh = current.alias("o"), dedup_entities(new).alias("n")
    joined = old.join(fresh, F.col("o.name") == F.col("n.name"), "full_outer")
    known = F.col("o.name").isNotNull()

    def keep(col: str) -> Column:
        return F.when(known, F.col(f"o.{col}")).otherwise(F.col(f"n.{col}")).alias(col)

    longer = F.length("n.description") > F.length(F.coalesce(F.col("o.description"), F.lit("")))
    description = F.when(known & ~F.coalesce(longer, F.lit(False)), F.col("o.description")).otherwise(F.col("n.description"))
    return joined.select(keep("name"), keep("type"), description.alias("description"), keep("source_doc_id"), keep("source_title"))


def existing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    names = nodes.select("name")
    return edges.join(names.withColumnRenamed("name", "head"), "head", "left_semi").join(
        names.withColumnRenamed("name", "tail"), "tail", "left_semi"
    )


def complete_triple() -> Column:
    return F.coalesce((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != ""), F.lit(False))


def upsert_edges(current: DataFrame, new: DataFrame, nodes: DataFrame, order_by: str = "pos") -> DataFrame:
    """Edges after the load: the first evidence of a key stays, ends must exist."""
    fields = [*EDGE_KEY, "evidence", "source_doc_id"]
    fresh = first_per_key(existing_edges(new.filter(complete_triple()), nodes), EDGE_KEY, [order_by])
    added = fresh.join(current.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return current.select(*fields).unionByName(added.select(*fields))


def edge_load_report(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many triples were skipped for a blank part and how many had an unknown end."""
    names = nodes.select(F.col("name"), F.lit(True).alias("known"))
    seen = new.join(names.withColumnRenamed("name", "head").withColumnRenamed("known", "h"), "head", "left").join(
        names.withColumnRenamed("name", "tail").withColumnRenamed("known", "t"), "tail", "left")
    whole = complete_triple()
    return seen.agg(
        F.count(F.lit(1)).alias("triples"),
        F.count_if(~whole).alias("skipped"),
        F.count_if(whole & (F.col("h").isNull() | F.col("t").isNull())).alias("dangling"),
    )


def entity_table(entities: DataFrame) -> DataFrame:
    """Rows keyed by type and slug; the last of two names with one slug wins, as in a key-value store."""
    rows = dedup_entities(entities).withColumn("entity_id", X.slug(F.col("name"))).withColumn(
        "entity_type", F.coalesce("type", F.lit("Unknown")))
    rows = first_per_key(rows, ["entity_type", "entity_id"], [F.desc("pos")])
    return rows.select("entity_type", "entity_id", F.col("name").alias("entity_name"),
                       F.coalesce("description", F.lit("")).alias("description"), "source_doc_id", "source_title")


def retype_edges(edges: DataFrame, decisions: DataFrame, order_by: Sequence[Column | str] = ("new_relation",)) -> DataFrame:
    """Replace the relation of generic edges by a decided one, matched null-safe on the evidence.

    Of several decisions for one edge the first in ``order_by`` counts, so edges are never multiplied.
    """
    first = top_per_key(decisions, ["head", "tail", "evidence"], list(order_by), 1)
    e, d = edges.alias("e"), first.alias("d")
    on = (
        (F.col("e.relation") == "RELATED_TO")
        & (F.col("e.head") == F.col("d.head")) & (F.col("e.tail") == F.col("d.tail"))
        & F.col("e.evidence").eqNullSafe(F.col("d.evidence"))
    )
    decided = F.coalesce(F.col("d.new_relation"), F.col("e.relation"))
    return e.join(d, on, "left").select(
        F.col("e.head").alias("head"), decided.alias("relation"), F.col("e.tail").alias("tail"),
        F.col("e.evidence").alias("evidence"), F.col("e.source_doc_id").alias("source_doc_id"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals, counts by node type and counts by relation in one long table."""
    one = F.count(F.lit(1)).alias("n")
    types = nodes.groupBy(F.coalesce("type", F.lit("default")).alias("value")).agg(one)
    relations = edges.groupBy(F.col("relation").alias("value")).agg(one)

    def labelled(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("value"), F.col("n"))

    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("value", F.lit(name))
    return (
        labelled(types, "type").unionByName(labelled(relations, "relation"))
        .unionByName(labelled(total(types, "nodes"), "total"))
        .unionByName(labelled(total(relations, "links"), "total"))
    )


def export_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node list, link list and counts."""
    node_list = nodes.select(F.col("name").alias("id"), "name", F.coalesce("type", F.lit("default")).alias("type"))
    links = edges.select(F.col("head").alias("source"), F.col("tail").alias("target"), "relation")
    return node_list, links, graph_counts(nodes, edges)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree over both ends and the drawn size; a node without an edge has size 1.

    Both ends come out of one scan of the edges, and the count is combined before the shuffle.
    """
    ends = edges.select(F.explode(F.array("head", "tail")).alias("name"))
    counted = ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.select("name").join(counted, "name", "left")
    degree = F.coalesce("degree", F.lit(0))
    return joined.select("name", degree.alias("degree"), F.sqrt(F.greatest(degree, F.lit(1))).alias("size"))


def symmetric_aliases(edges: DataFrame, relation: str = "TRANSFORMED_INTO") -> DataFrame:
    """Both ends of a relation are aliases of each other."""
    pairs = edges.filter((F.col("relation") == relation) & (F.col("head") != F.col("tail")))
    both = F.explode(F.array(
        F.struct(F.col("tail").alias("canonical"), F.col("head").alias("alias")),
        F.struct(F.col("head").alias("canonical"), F.col("tail").alias("alias"))))
    return pairs.select(both.alias("p")).select("p.*").distinct()


def neighbors(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20, salts: int = 16) -> DataFrame:
    """Outgoing and incoming edges of named entities, at most ``limit`` per direction.

    Seeds are reduced to distinct names first, so a name asked for a million times is looked up
    once. The edges of a node are dealt over ``salts`` parts by their other end; each part is cut to its first
    ``limit`` edges and these to the first ``limit`` of the node before anything is joined to them, so a
    hub with most edges is neither matched nor ranked in one task.
    """
    wanted = seeds.select(F.lower("name").alias("__key")).distinct()
    found = written(nodes.join(beside(wanted), F.lower(nodes["name"]) == F.col("__key"), "left_semi").select(
        F.col("name").alias("entity"), F.col("type").alias("entity_type"), "description"))
    ends = F.explode(F.array(
        F.struct(F.col("head").alias("entity"), F.lit("outgoing").alias("direction"), F.col("tail").alias("other")),
        F.struct(F.col("tail").alias("entity"), F.lit("incoming").alias("direction"), F.col("head").alias("other"))))
    touching = edges.select(ends.alias("e"), "relation", "evidence").select("e.*", "relation", "evidence")
    touching = touching.withColumn("__salt", F.pmod(F.xxhash64("other", "relation"), F.lit(salts)).cast("int"))
    asked = found.select("entity", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    parts = top_per_key(touching.join(beside(asked), ["entity", "__salt"], "left_semi"), ["entity", "__salt", "direction"], ["other", "relation"], limit)
    kept = top_per_key(parts.drop("__salt"), ["entity", "direction"], ["other", "relation"], limit, "rank")
    kept = written(kept.join(found, "entity", "right"))
    # Stored edges have existing ends, so only the types of the kept ones are looked up.
    types = nodes.select(F.col("name").alias("other"), F.col("type").alias("other_type"))
    return kept.join(by_key(types.join(beside(kept.select("other").distinct()), "other", "left_semi")), "other", "left")


def neighbors_many(questions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 10,
                   key: str = "question_id") -> DataFrame:
    """Neighbourhoods of all entities of all questions; unknown entities drop out."""
    asked = spread(questions.select(key, "entities")).select(key, F.posexplode("entities").alias("entity_no", "asked")).withColumn("__key", F.lower("asked"))
    around = neighbors(asked.select(F.col("asked").alias("name")), nodes, edges, limit)
    return asked.join(beside(around.withColumn("__key", F.lower("entity"))), "__key").drop("__key", "asked")


def entity_lists(questions: DataFrame) -> DataFrame:
    """Distinct entity lists (entities). What depends on nothing else is worked out with ``key="entities"`` and handed on by ``per_question``."""
    return questions.select("entities").distinct()


def per_question(rows: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows of an entity list (entities) for each question that has this list, by its key."""
    return spread(questions.select(key, "entities")).join(beside(rows), "entities").drop("entities")


def rank_relations(around: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Score every relation for its question and order it within the entity."""
    scored = around.join(by_key(questions.select(F.col(key), F.col("entities").alias("__asked"))), key).withColumn(
        "score", scoring.relation_score(F.col("evidence"), F.col("relation"), F.col("other"), F.col("__asked")))
    direction = F.when(F.col("direction") == "outgoing", 0).otherwise(1)
    order = Window.partitionBy(key, "entity_no").orderBy(F.desc("score"), direction, "rank")
    return scored.filter(F.col("relation").isNotNull()).withColumn("place", F.row_number().over(order)).drop("__asked")


def induced_subgraph(around: DataFrame, key: str = "question_id", first: int = 15) -> DataFrame:
    """Edges among the entities retrieved for a question, without loops and repeats.

    Of each entity's relations the first ``first`` in rank order are looked at.
    """
    members = around.select(key, F.col("entity").alias("member")).distinct()
    out = F.col("direction") == "outgoing"
    rows = around.filter(F.col("relation").isNotNull() & (F.col("place") <= first)).select(
        key,
        F.when(out, F.col("entity")).otherwise(F.col("other")).alias("source"),
        "relation",
        F.when(out, F.col("other")).otherwise(F.col("entity")).alias("target"),
    ).filter(F.col("source") != F.col("target"))
    for end in ("source", "target"):
        rows = rows.join(members.withColumnRenamed("member", end), [key, end], "left_semi")
    return rows.distinct()


def edges_among(questions: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "question_id") -> DataFrame:
    """All edges of the graph with both ends among the entities of a question, without loops and repeats.

    Entities are matched to nodes whatever their case. Edges are first cut to those whose two ends are
    asked for at all, so of a hub only its edges to other asked nodes meet the questions.
    """
    asked = questions.select(key, F.explode("entities").alias("__asked")).select(key, F.lower("__asked").alias("__low")).distinct()
    named = nodes.select(F.col("name").alias("member"), F.lower("name").alias("__low"))
    members = asked.join(named, "__low").select(key, "member").distinct()
    wanted = members.select("member").distinct()
    rows = edges.select(F.col("head").alias("source"), "relation", F.col("tail").alias("target")).filter(F.col("source") != F.col("target")).distinct()
    for end in ("source", "target"):
        rows = rows.join(wanted.withColumnRenamed("member", end), end, "left_semi")
    rows = rows.join(members.withColumnRenamed("member", "source"), "source")
    return rows.join(members.withColumnRenamed("member", "target"), [key, "target"], "left_semi").select(key, "source", "relation", "target")


def entity_text(nodes: DataFrame, limit: int = 200) -> Column:
    text = F.col("description")
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


__all__: Sequence[str] = [
    "dedup_entities", "upsert_nodes", "upsert_edges", "existing_edges", "entity_table", "retype_edges",
    "graph_counts", "export_graph", "degrees", "symmetric_aliases", "neighbors", "neighbors_many",
    "entity_lists", "per_question", "rank_relations", "induced_subgraph", "edges_among", "edge_load_report", "complete_triple", "EDGE_KEY", "C",
]
