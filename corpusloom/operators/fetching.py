"""Documents for questions, in layers: by title, by meaning, by co-mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import scoring, text as X
from corpusloom.operators.mentions import mention_counts
from corpusloom.operators.ranking import first_per_key, top_per_key
from corpusloom.operators.similarity import vector_topk
from corpusloom.session import cut_lineage
from corpusloom.tables import beside, by_key, spread

GRAM = 8


def contained_in(needles: DataFrame, texts: DataFrame, needle: str, text: str, gram: int = GRAM) -> DataFrame:
    """Pairs (needle, text) of distinct strings where the text contains the needle.

    A needle is keyed by its first ``gram`` characters (all of a shorter one); texts give their
    substrings of the key lengths that occur, so the pairs come from an equi-join and only
    candidates that share a key are compared.
    """
    keyed = needles.select(needle).filter(F.length(needle) > 0).distinct().withColumn(
        "__gram", F.left(F.col(needle), F.lit(gram)))
    lengths = sorted(r["n"] for r in keyed.select(F.length("__gram").alias("n")).distinct().collect())
    if not lengths:
        return keyed.select(needle).join(texts.select(text).limit(0), F.lit(True))

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        cut = F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    places = [pieces(n) for n in lengths]
    grams = texts.select(text).distinct().select(text, F.explode(F.array_distinct(F.concat(*places))).alias("__gram"))
    return keyed.join(grams, "__gram").filter(F.contains(F.col(text), F.col(needle))).select(needle, text)


def asked_entities(questions: DataFrame, key: str = "question_id") -> DataFrame:
    return questions.select(key, F.posexplode("entities").alias("entity_no", "entity"))


def title_matches(entities: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Best document per distinct entity: (entity, doc_id, score). Equal names beat containment,
    the smaller id wins ties."""
    names = docs.select(id_col, F.explode(F.concat(F.array("canonical_name"), F.col("aliases"))).alias("name"))
    # Only the first document of a name can win, so each distinct name is compared once.
    first = names.select(id_col, X.strip(F.lower("name")).alias("name")).filter("name <> ''").groupBy("name").agg(
        F.min(id_col).alias(id_col))
    wanted = entities.select(X.strip(F.lower("entity")).alias("low")).filter("low <> ''").distinct()
    pairs = contained_in(wanted, first, "low", "name").unionByName(
        contained_in(first, wanted, "name", "low").select("low", "name")).distinct()
    scored = pairs.join(first, "name").withColumn("score", scoring.title_match(F.col("low"), F.col("name")))
    best = first_per_key(scored, ["low"], [F.desc("score"), F.col(id_col)]).select("low", id_col, "score")
    spelled = entities.select("entity").distinct().withColumn("low", X.strip(F.lower("entity")))
    return spelled.join(best, "low").drop("low")


def layer_title(questions: DataFrame, docs: DataFrame, key: str = "question_id", id_col: str = "doc_id") -> DataFrame:
    """Layer A: one document per entity at most, distinct per question, in entity order."""
    asked = asked_entities(spread(questions.select(key, "entities")), key)
    best = title_matches(asked, docs, id_col)
    found = asked.join(beside(best), "entity").groupBy(key, id_col).agg(F.min("entity_no").alias("place"), F.max("score").alias("score"))
    return found


def layer_semantic(questions: DataFrame, vectors: DataFrame, held: DataFrame, k: int = 20, keep: int = 8,
                   key: str = "question_id", id_col: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """Layer B: of the k nearest vectors the first documents that exist and are not held yet.

    ``questions``: key, embedding. ``vectors``: vec_id, doc_id, embedding.
    """
    near = vector_topk(questions, vectors, k, query_id=key, item_id="vec_id").withColumnRenamed("query_id", key)
    found = near.join(vectors.select(F.col("vec_id").alias("item_id"), id_col), "item_id")
    if docs is not None:
        found = found.join(docs.select(id_col), id_col, "left_semi")
    near_docs = found.groupBy(key, id_col).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    fresh = near_docs.join(by_key(held.select(key, id_col)), [key, id_col], "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    return fresh.withColumn("place", place).filter(F.col("place") <= keep)


def comention_scores(pairs: DataFrame, docs: DataFrame, depth: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Best ``depth`` documents that mention both names of a pair: (a, b, doc_id, score, rank).

    ``pairs`` holds lower-cased names a, b and may hold ``depth``, a number of its own for each pair up to the common one.
    Counting starts from the rarer name of a pair, so a name found in a third of all documents is only met through its
    partner's documents.
    """
    own = pairs.groupBy("a", "b").agg(F.max("depth").alias("depth")) if "depth" in pairs.columns else None
    pairs = pairs.select("a", "b")
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    counts = mention_counts(docs, names, key=id_col)
    spread_of = counts.groupBy("name").agg(F.count(F.lit(1)).alias("docs"))
    weighed = pairs.distinct().join(spread_of.select(F.col("name").alias("a"), F.col("docs").alias("da")), "a").join(
        spread_of.select(F.col("name").alias("b"), F.col("docs").alias("db")), "b")
    swap = F.col("db") < F.col("da")
    driven = weighed.select(
        "a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("rare"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("common"))
    first = counts.select(F.col("name").alias("rare"), id_col, F.col("n").alias("n1"))
    second = counts.select(F.col("name").alias("common"), id_col, F.col("n").alias("n2"))
    both = driven.join(first, "rare").join(second, ["common", id_col])
    boosted = docs.select(id_col, F.when(F.col("entity_type").isin(C.CO_MENTION_BOOST_TYPES), 10).otherwise(0).alias("boost"))
    scored = both.join(boosted, id_col).select("a", "b", id_col, (F.col("n1") + F.col("n2") + F.col("boost")).alias("score"))
    best = top_per_key(scored, ["a", "b"], [F.desc("score"), F.col(id_col)], depth, "rank")
    return best if own is None else best.join(own, ["a", "b"]).filter(F.col("rank") <= F.col("depth")).drop("depth")


def entity_pairs(questions: DataFrame, entities: int = 6, key: str = "question_id") -> DataFrame:
    """Pairs of the first entities of each question in order: (key, pair_no, a, b), lower-cased."""
    names = F.slice("entities", 1, entities)
    indexed = F.transform(names, lambda n, i: F.struct(i.alias("i"), F.lower(n).alias("n")))
    pairs = F.flatten(F.transform(indexed, lambda x: F.transform(
        F.filter(indexed, lambda y: y["i"] > x["i"]), lambda y: F.struct(x["n"].alias("a"), y["n"].alias("b")))))
    return questions.select(key, F.posexplode(pairs).alias("pair_no", "p")).select(key, "pair_no", "p.a", "p.b")


def layer_comention(questions: DataFrame, docs: DataFrame, held: DataFrame, entities: int = 6, keep: int = 6,
                    key: str = "question_id", id_col: str = "doc_id") -> DataFrame:
    """Layer C: for each entity pair in order the best document with both that is not held or
    taken by an earlier pair, until ``keep`` documents are found.

    A pair is offered as many documents as its own questions may have to pass over: those a question holds and one for
    each earlier pair. A question that holds many documents deepens its own pairs only.
    """
    pairs = entity_pairs(questions, entities, key)
    holds = held.groupBy(key).agg(F.count_distinct(id_col).alias("held"))
    needs = pairs.join(by_key(holds), key, "left").withColumn("depth", F.coalesce("held", F.lit(0)) + F.least(F.col("pair_no"), F.lit(keep - 1)) + 1)
    # The greatest need only trims what a task hands on; each pair is then cut to its own.
    most = needs.agg(F.coalesce(F.max("depth"), F.lit(1)).alias("n")).first()["n"]
    best = comention_scores(needs.select("a", "b", "depth"), docs, int(most), id_col)
    ranked = best.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("rank", id_col))).alias("candidates"))
    taken = held.groupBy(key).agg(F.collect_set(id_col).alias("held"))
    offers = pairs.join(beside(ranked), ["a", "b"]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pair_no", "candidates"))).alias("offers"))
    rows = offers.join(by_key(taken), key, "left")
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    barred = F.coalesce("held", none)

    def choose(acc: Column, offer: Column) -> Column:
        free = F.filter(offer["candidates"], lambda c: ~F.array_contains(barred, c[id_col]) & ~F.array_contains(acc, c[id_col]))
        return F.when((F.size(free) > 0) & (F.size(acc) < keep), F.array_append(acc, F.get(free, F.lit(0))[id_col])).otherwise(acc)

    chosen = F.aggregate("offers", none, choose)
    return rows.select(key, F.posexplode(chosen).alias("place", id_col))


def fetch_layers(questions: DataFrame, docs: DataFrame, vectors: DataFrame, cap: int = 20,
                 key: str = "question_id", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All layers a question asks for, each leaving out what earlier layers hold: the documents
    with layer and place, and the counts per question.

    ``questions`` also holds ``layers`` (array) and ``embedding``.
    """
    # Held documents are a few rows per question and read by every later layer.
    a = cut_lineage(layer_title(questions, docs, key, id_col).select(key, id_col, "place").withColumn("layer", F.lit("A")))
    b = cut_lineage(layer_semantic(questions.filter(F.array_contains("layers", "B")), vectors, a, key=key, id_col=id_col, docs=docs).select(
        key, id_col, "place").withColumn("layer", F.lit("B")))
    c = layer_comention(questions.filter(F.array_contains("layers", "C")), docs, a.unionByName(b), key=key, id_col=id_col).select(
        key, id_col, "place").withColumn("layer", F.lit("C"))
    every = a.unionByName(b).unionByName(c)
    kept = top_per_key(every, [key], ["layer", "place", id_col], cap, "doc_no")
    counts = questions.select(key).join(by_key(every.groupBy(key).agg(
        F.count_if(F.col("layer") == "A").alias("layer_a"), F.count_if(F.col("layer") == "B").alias("layer_b"),
        F.count_if(F.col("layer") == "C").alias("layer_c"), F.least(F.count(F.lit(1)), F.lit(cap)).alias("total"))), key, "left").na.fill(0)
    return kept, counts
