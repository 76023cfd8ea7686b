"""Bounded path search between named nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scoring import path_steps
from corpusloom.operators.ranking import top_per_key
from corpusloom.session import written

HUB_LINKS = 256  # a node with more neighbours is a hub: it is met, not walked through from one side


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge walked forwards and, unless it is a loop, backwards."""
    key = F.struct("head", "relation", "tail")
    ends = F.array(
        F.struct(F.col("head").alias("a"), F.col("tail").alias("b"), F.lit(True).alias("forward")),
        F.struct(F.col("tail").alias("a"), F.col("head").alias("b"), F.lit(False).alias("forward")),
    )
    return edges.select(
        F.struct("relation", "evidence", key.alias("key")).alias("edge"),
        F.explode(F.filter(ends, lambda e: e["forward"] | (e["a"] != e["b"]))).alias("e"),
    ).select(
        F.col("e.a").alias("a"), F.col("e.b").alias("b"),
        F.struct(F.col("edge.relation").alias("relation"), F.col("edge.evidence").alias("evidence"),
                 F.col("edge.key").alias("key"), F.col("e.forward").alias("forward")).alias("hop"),
    )


def _without_dead_ends(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges without those to nodes that have no other edge and are no end of a pair: no path, which uses an edge once, gets past them."""
    touched = edges.select(F.explode(F.array_distinct(F.array("head", "tail"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    alive = written(touched.filter(F.col("n") > 1).select("name").unionByName(ends.select("name")).distinct())
    for end in ("head", "tail"):
        edges = edges.join(alive.withColumnRenamed("name", end), end, "left_semi")
    return edges


class _Links:
    """Distinct (a, b) that an edge joins, apart for hubs, and those of hubs that more than one edge joins."""

    def __init__(self, steps: DataFrame, hub_links: int):
        counted = written(steps.groupBy("a", "b").agg(F.count_distinct("hop.key").alias("n")))
        self.every = counted.select("a", "b")
        self.hubs = written(counted.groupBy(F.col("a").alias("hub")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub_links).select("hub"))
        self.light = written(self.every.join(self.hubs, F.col("a") == F.col("hub"), "left_anti"))
        around = written(counted.join(self.hubs, F.col("a") == F.col("hub")).select("hub", F.col("b").alias("node"), "n"))
        self.of_hubs, self.doubled = around.select("hub", "node"), around.filter(F.col("n") > 1).select("hub", "node")


class _Frontiers:
    """Nodes that a walk of exactly 0, 1, 2, ... edges reaches from each start: (start, node), each node once per start.

    ``levels`` hold every node. The last step of the walks that are met in the middle is not taken from hubs: a tip
    holds the nodes one step beyond the light nodes of a level, and the hubs of that level by themselves.
    """

    def __init__(self, starts: DataFrame, links: _Links):
        self.links = links
        self.levels = [starts.select(F.col("name").alias("start"), F.col("name").alias("node")).distinct()]
        self.tips: dict[int, tuple[DataFrame, DataFrame | None]] = {0: (self.levels[0], None)}

    def _step(self, level: DataFrame, starts: DataFrame, links: DataFrame) -> DataFrame:
        last = level.join(starts.select(F.col("name").alias("start")).distinct(), "start", "left_semi")
        return written(last.join(links, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct())

    def tip(self, size: int, starts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(start, node) one step beyond the light nodes of the level before, and (start, hub) of that level."""
        if size not in self.tips:
            while len(self.levels) < size:
                self.levels.append(self._step(self.levels[-1], starts, self.links.every))
            before = self.levels[size - 1]
            hubs = before.join(self.links.hubs, F.col("node") == F.col("hub")).select("start", "hub")
            self.tips[size] = self._step(before, starts, self.links.light), hubs
        return self.tips[size]


def _middles(left: DataFrame, ahead: tuple, behind: tuple, links: _Links) -> DataFrame:
    """(source, target, node) where walks from both ends meet, for the pairs that are left.

    Where a walk comes from a hub, the nodes of the other side are looked up among the hub's neighbours, so a hub costs
    what lies on the other side and not its edges. Between two hubs the common neighbours count; of one and the same hub
    only those that two edges join to it, as no path uses an edge twice.
    """
    pairs = left.select("source", "target")
    (nodes_a, hubs_a), (nodes_b, hubs_b) = ahead, behind
    nodes_a, nodes_b = nodes_a.withColumnRenamed("start", "source"), nodes_b.withColumnRenamed("start", "target")
    fields = ["source", "target", "node"]
    found = pairs.join(nodes_a, "source").join(nodes_b, ["target", "node"]).select(*fields)
    if hubs_a is not None:
        hubs_a = hubs_a.withColumnRenamed("start", "source")
        near = nodes_b.join(links.of_hubs, "node").join(pairs, "target")
        found = found.unionByName(near.join(hubs_a, ["source", "hub"], "left_semi").select(*fields))
    if hubs_b is not None:
        hubs_b = hubs_b.withColumnRenamed("start", "target")
        near = nodes_a.join(links.of_hubs, "node").join(pairs, "source")
        found = found.unionByName(near.join(hubs_b, ["target", "hub"], "left_semi").select(*fields))
    if hubs_a is not None and hubs_b is not None:
        met = pairs.join(hubs_a, "source").join(hubs_b.withColumnRenamed("hub", "other"), "target")
        asked = met.filter(F.col("hub") != F.col("other")).select("hub", "other").distinct()
        others = links.of_hubs.select(F.col("hub").alias("other"), "node")
        shared = links.of_hubs.join(others, "node").join(asked, ["hub", "other"], "left_semi").select("hub", "other", "node")
        shared = shared.unionByName(links.doubled.select("hub", F.col("hub").alias("other"), "node"))
        found = found.unionByName(met.join(shared, ["hub", "other"]).select(*fields))
    return found.distinct()


def _sweep(upper: DataFrame, level: DataFrame, links: _Links, end: str) -> DataFrame:
    """(source, target, node, before): each node of ``upper`` with its neighbours in the level of its ``end``.

    Light nodes look at their neighbours; for a hub those of the level are looked at instead.
    """
    reached = level.select(F.col("start").alias(end), F.col("node").alias("before"))
    near = upper.join(links.light, F.col("node") == F.col("a")).select("source", "target", "node", F.col("b").alias("before"))
    near = near.join(reached, [end, "before"], "left_semi")
    at_hubs = reached.join(links.of_hubs.withColumnRenamed("node", "before"), "before").withColumnRenamed("hub", "node")
    return near.select("source", "target", "node", "before").unionByName(
        upper.join(at_hubs, [end, "node"]).select("source", "target", "node", "before"))


def _layers(mids: DataFrame, ahead: _Frontiers, behind: _Frontiers, links: _Links, length: int) -> list[DataFrame]:
    """For each step of a walk of this length the edges (source, target, v, w) that lead from source to target in it.

    ``mids`` are the nodes where walks of half the length from both ends meet. From there the layers
    are swept back to the source and on to the target, so each edge left is part of a whole walk.
    """
    half, out = (length + 1) // 2, [None] * length
    upper = mids
    for i in range(half - 1, -1, -1):
        found = _sweep(upper, ahead.levels[i], links, "source").select("source", "target", F.col("before").alias("v"), F.col("node").alias("w"))
        out[i] = written(found) if i else found
        upper = out[i].select("source", "target", F.col("v").alias("node")).distinct()
    lower = mids
    for j in range(length - half - 1, -1, -1):
        found = _sweep(lower, behind.levels[j], links, "target").select("source", "target", F.col("node").alias("v"), F.col("before").alias("w"))
        out[length - 1 - j] = written(found) if j else found
        lower = out[length - 1 - j].select("source", "target", F.col("w").alias("node")).distinct()
    return out


_ORDER = ["nodes", "relations", "forward"]


def _grow(ends: DataFrame, layers: list[DataFrame], steps: DataFrame, keep: int | None) -> DataFrame:
    """Walks along the layers for each (source, target), no edge twice; of those at one node only the first ``keep`` go on."""
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema["hop"].dataType.fields}
    none = {name: F.array().cast(f"array<{kind}>") for name, kind in kinds.items()}
    level = ends.select("source", "target", F.col("source").alias("v"), F.array("source").alias("nodes"), none["relation"].alias("relations"),
                        none["forward"].alias("forward"), none["evidence"].alias("evidences"), none["key"].alias("used"))
    hops = steps.select(F.col("a").alias("v"), F.col("b").alias("w"), "hop")
    for layer in layers:
        taken = level.join(layer, ["source", "target", "v"]).join(hops, ["v", "w"]).filter(~F.array_contains("used", F.col("hop.key")))
        level = taken.select(
            "source", "target", F.col("w").alias("v"), F.array_append("nodes", F.col("w")).alias("nodes"),
            F.array_append("relations", F.col("hop.relation")).alias("relations"), F.array_append("forward", F.col("hop.forward")).alias("forward"),
            F.array_append("evidences", F.nullif(F.col("hop.evidence"), F.lit(""))).alias("evidences"), F.array_append("used", F.col("hop.key")).alias("used"))
        if keep is not None:
            level = top_per_key(level, ["source", "target", "v"], _ORDER, keep)
    return level.select("source", "target", F.size("relations").alias("path_length"), "nodes", "relations", F.array_compact("evidences").alias("evidences"), "forward")


def paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 3, max_paths: int = 3, key: str = "pair_id",
          hub_links: int = HUB_LINKS) -> DataFrame:
    """The ``max_paths`` shortest undirected paths per pair, edges used once.

    ``pairs`` holds (key, source, target) and may hold ``hops``, a bound of its own. Pairs with the
    same two ends share a search. Lengths are taken in turn, and ends that have enough paths leave, which is exact as
    shorter paths rank first.

    For each length the nodes in the middle come from frontiers of both ends, and only edges that lead
    over one of them to the other end are walked at all. A walk at most one edge longer than the
    shortest cannot use an edge twice (without the part in between it would be shorter by two), so there only
    the first ``max_paths`` walks to a node need to go on: for the same rest of the way the order of walks
    is the order of their beginnings. Longer walks (asked for
    only where the two shortest lengths do not give enough paths) are followed in full.

    Up to four edges a node with more than ``hub_links`` neighbours is never opened for each end that reaches it: the
    other side's nodes are looked up among its neighbours. From five edges on the levels before the last open hubs.
    """
    names = nodes.select("name", F.lower("name").alias("__low"))
    todo = pairs
    for col in ("source", "target"):
        other = names.withColumnRenamed("name", f"__{col}")
        todo = todo.join(other, F.lower(F.col(col)) == F.col("__low")).drop("__low")
    bound = F.least(F.col("hops"), F.lit(max_hops)) if "hops" in pairs.columns else F.lit(max_hops)
    todo = written(todo.select(key, F.col("__source").alias("source"), F.col("__target").alias("target"), bound.alias("bound")))
    # near: the length of the shortest walk, once it is known
    near = F.when(F.col("source") == F.col("target"), 0)
    left = todo.groupBy("source", "target").agg(F.max("bound").alias("bound")).withColumn("near", near)
    ends = left.select(F.explode(F.array("source", "target")).alias("name"))
    steps = written(_both_ways(_without_dead_ends(edges, ends)))
    links = _Links(steps, hub_links)
    ahead = _Frontiers(left.select(F.col("source").alias("name")), links)
    behind = _Frontiers(left.select(F.col("target").alias("name")), links)

    result = None
    for length in range(1, max_hops + 1):
        left = left.filter(F.col("bound") >= length)
        half = (length + 1) // 2
        tips = (ahead.tip(half, left.select(F.col("source").alias("name"))),
                behind.tip(length - half, left.select(F.col("target").alias("name"))))
        mids = _middles(left, *tips, links).join(left.select("source", "target", "near"), ["source", "target"])
        mids = written(mids.select("source", "target", "node", F.coalesce("near", F.lit(length)).alias("near")))
        ends = mids.groupBy("source", "target").agg(F.min("near").alias("near"))
        tight, loose = ends.agg(F.count_if(F.col("near") + 1 >= length), F.count_if(F.col("near") + 1 < length)).first()
        if not tight + loose:
            continue
        layers = _layers(mids.select("source", "target", "node"), ahead, behind, links, length)
        grown = []
        if tight:
            grown.append(_grow(ends.filter(F.col("near") + 1 >= length), layers, steps, max_paths))
        if loose:
            grown.append(_grow(ends.filter(F.col("near") + 1 < length), layers, steps, None))
        found = grown[0] if len(grown) == 1 else grown[0].unionByName(grown[1])
        found = written(top_per_key(found, ["source", "target"], _ORDER, max_paths))
        result = found if result is None else result.unionByName(found)
        if length < max_hops:
            served = result.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max_paths)
            known = ends.withColumnRenamed("near", "found")
            left = left.join(known, ["source", "target"], "left").withColumn("near", F.coalesce("near", "found")).drop("found")
            left = written(left.join(served, ["source", "target"], "left_anti"))
    if result is None:
        ends = left.limit(0)
        result = _grow(ends, [], steps, None)
    joined = todo.join(result, ["source", "target"]).filter(F.col("path_length") <= F.col("bound")).select(key, "path_length", "nodes", "relations", "evidences", "forward")
    ranked = top_per_key(joined, [key], ["path_length", *_ORDER], max_paths, "path_rank")
    return ranked.withColumn("path_steps", path_steps(F.col("nodes"), F.col("relations")))
