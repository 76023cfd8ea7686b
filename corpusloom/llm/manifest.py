"""Operator 12: Merkle manifest of a dataset as postorder append logs.

Rows are leaves. The leaves of a group (a language), in order of id, form a tree: while there are
several nodes, every ``WIDTH`` neighbours get one digest above them; the groups' roots form a tree
of the same kind. Aligned builders take ``WIDTH ** LEVELS`` neighbouring nodes each and append nodes to their log as
soon as they are complete: a node follows its last child. So a node's place in the log follows from
the sizes of the subtrees before it and its own, and a proof is read from the log at computed places, without a search. The last
node of each builder's log is a leaf of the next round, until each tree has one builder.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import ordered, stored

#: Children of a node, and levels that one builder adds: it takes at most 8 ** 3 nodes.
WIDTH, LEVELS = 8, 3

SEGMENT = "tree long, block long, n long, nodes array<string>"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
STEPS = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def subtree(leaves: int, level: int) -> int:
    """Nodes of a subtree of this many leaves whose root is on this level (leaves: 0)."""
    return sum(-(-leaves // WIDTH**k) for k in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of the index-th node of a level, in a tree of so many leaves.

    Before it stand all nodes completed by the leaves left of its own, and the rest of its own subtree.
    """
    first = index * WIDTH**level
    before, power = first, WIDTH
    while power <= first:
        before, power = before + first // power, power * WIDTH
    return before + subtree(min(leaves - first, WIDTH**level), level) - 1


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while WIDTH**levels < leaves:
        levels += 1
    return levels


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes in order of completion, up to this level."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(node: str, level: int) -> None:
        log.append(node)
        waiting[level].append(node)
        if level < levels and len(waiting[level]) == WIDTH:
            close(level)

    def close(level: int) -> None:
        children, waiting[level] = waiting[level], []
        add(digest("".join(children)), level + 1)

    for leaf in leaves:
        add(leaf, 0)
    for level in range(levels):
        if waiting[level]:
            close(level)
    return log


def path(log: list[str], place: int, leaves: int, levels: int) -> list[tuple[str, str]]:
    """For each level the siblings left and right of the path from a leaf, read at their computed places."""
    out = []
    for level in range(levels):
        run = place // WIDTH * WIDTH
        end = min(run + WIDTH, -(-leaves // WIDTH**level))
        read = lambda a, b, level=level: "".join([log[position(level, j, leaves)] for j in range(a, b)])
        out.append((read(run, place), read(place + 1, end)))
        place //= WIDTH
    return out


def paths(log: list[str], count: int, levels: int) -> list[list[tuple[str, str]]]:
    """The path of each of the ``count`` leaves of a builder; what neighbours share is read once."""
    above: dict[int, list[tuple[str, str]]] = {}
    out = []
    for place in range(count):
        run = place // WIDTH
        if levels and run not in above:
            above[run] = path(log, place, count, levels)[1:]
        out.append(path(log, place, count, min(levels, 1)) + above.get(run, []))
    return out


def folded(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = digest(left + leaf + right)
    return leaf


def framed(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


@dataclass
class Manifest:
    """Rows with their tree and place, trees, and the builders' logs: a list of rounds for the groups' trees and one for the top."""

    placed: DataFrame
    trees: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    levels: int

    @property
    def block(self) -> int:
        return WIDTH**self.levels


def build(nodes: DataFrame, levels: int) -> DataFrame:
    """The builders' logs over (tree, place, n, h): one row (tree, block, n, nodes) per builder.

    A builder adds ``levels`` levels, or all there are where it has the whole tree.
    """
    most = WIDTH**levels

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n = group.column("n")[0].as_py()
        log = append_log(group.column("h").to_pylist(), height(n) if n <= most else levels)
        one = [group.column(c).slice(0, 1) for c in ("tree", "block", "n")]
        return pa.Table.from_arrays([*one, pa.array([log], pa.list_(pa.string()))], names=["tree", "block", "n", "nodes"])

    blocks = nodes.withColumn("block", F.floor(F.col("place") / most))
    return stored(blocks.groupBy("tree", "block").applyInArrow(run, SEGMENT))


def last(nodes: str = "nodes") -> Column:
    return F.element_at(nodes, -1)


def all_rounds(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """Rounds of builders until each tree has one."""
    rounds, most = [build(nodes, levels)], WIDTH**levels
    while largest > most:
        largest = -(-largest // most)
        more = rounds[-1].filter(F.col("n") > most)
        rounds.append(build(more.select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / most).alias("n"), last().alias("h")), levels))
    return rounds


def manifest(leaves: DataFrame, id_col: str = "doc_id", group: str = "lang", leaf: str = "leaf", levels: int = LEVELS) -> Manifest:
    """The manifest of a table of leaves with an id and a group; other columns are kept along with the rows.

    Groups stand by their text in UTF-8 bytes, null first; leaves of a group by id, rows without id last,
    rows with equal ids by leaf. Places come from a range partitioning over all groups at once, so a group with most rows
    is spread over tasks like the rest, and no builder gets more than ``WIDTH ** levels`` nodes.
    """
    rows = ordered(leaves, [F.col(group).isNotNull(), F.col(group), F.col(id_col), F.col(leaf)])
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    trees = ordered(sizes, [F.col("first")])
    trees = stored(trees.select(F.col(group).alias("__group"), "n", "first", F.col("idx").alias("tree")))
    placed = rows.join(trees, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    placed = stored(placed.withColumn("place", F.col("idx") - F.col("first")).drop("idx", "first"))
    largest, count = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    rounds = all_rounds(placed.select("tree", "place", "n", F.col(leaf).alias("h")), largest, levels)
    roots = None
    for segments in rounds:
        ready = segments.filter(F.col("n") <= WIDTH**levels).select(F.col("tree").alias("place"), last().alias("h"))
        roots = ready if roots is None else roots.unionByName(ready)
    top = all_rounds(roots.select(F.lit(-1).cast("long").alias("tree"), "place", F.lit(count).cast("long").alias("n"), "h"), count, levels)
    return Manifest(placed, trees, rounds, top, levels)


def descend(segments: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Paths of the leaves of each builder, from the path of its last node: (tree, place, steps, subroot, root)."""
    most = WIDTH**levels

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                log, n, block = r["nodes"], r["n"], r["block"]
                count = min(most, n - block * most)
                rest = [(s["left"], s["right"]) for s in r["steps"]]
                steps = [[{"left": a, "right": b} for a, b in own + rest] for own in paths(log, count, height(n) if n <= most else levels)]
                same = [pa.array([r[c]] * count, t) for c, t in (("tree", pa.int64()), ("subroot", pa.string()), ("root", pa.string()))]
                places = pa.array(range(block * most, block * most + count), pa.int64())
                yield pa.RecordBatch.from_arrays([same[0], places, pa.array(steps, pa.list_(STEP)), *same[1:]], names=["tree", "place", "steps", "subroot", "root"])

    joined = segments.join(above, ["tree", "block"]).select("tree", "block", "n", "nodes", "steps", "subroot", "root")
    return joined.mapInArrow(run, f"tree long, place long, steps {STEPS}, subroot string, root string")


def paths_above(made: Manifest) -> DataFrame:
    """For each builder of the first round what stands above it: (tree, block, steps, subroot, root)."""
    none = F.array().cast(STEPS).alias("steps")
    above = made.top[-1].select("tree", "block", none, F.lit(None).cast("string").alias("subroot"), last().alias("root"))
    for segments in reversed(made.top):
        found = stored(descend(segments, above, made.levels))
        above = found.select("tree", F.col("place").alias("block"), "steps", "subroot", "root")
    heads = found.select(F.col("place").alias("tree"), "steps", "root")
    above = None
    for k in range(len(made.rounds) - 1, -1, -1):
        ready = made.rounds[k].filter(F.col("n") <= made.block).select("tree", "block", last().alias("subroot")).join(heads, "tree")
        ready = ready.select("tree", "block", "steps", "subroot", "root")
        above = ready if above is None else ready.unionByName(above)
        if k:
            above = stored(descend(made.rounds[k], above, made.levels)).select("tree", F.col("place").alias("block"), "steps", "subroot", "root")
    return above


def proofs(made: Manifest, id_col: str = "doc_id", leaf: str = "leaf", shown: str | None = None, steps: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, and its siblings on every level with ``steps``.

    ``shown`` names a column with the leaf that is checked against the manifest (null: the row's own).
    Each builder's log meets its own rows and the one path above it, so no group exceeds ``made.block`` rows.
    """
    most, levels = made.block, made.levels
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["steps"] if steps else [])]

    def run(rows: pa.Table, segment: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        one = segment.to_pylist()[0]
        rest = [(s["left"], s["right"]) for s in one["steps"]]
        tail = "".join([a + b for a, b in rest])
        leaves, offered = rows.column("leaf").to_pylist(), rows.column("shown").to_pylist()
        proof, fold, shown_steps = [], [], []
        for own, given, other in zip(paths(one["nodes"], len(leaves), height(one["n"]) if one["n"] <= most else levels), leaves, offered):
            proof.append(digest("".join([a + b for a, b in own]) + tail))
            fold.append(folded(other or given, own + rest))
            shown_steps.append([{"left": a, "right": b} for a, b in own + rest] if steps else None)
        columns = [rows.column("doc_id"), rows.column("leaf"), *(pa.array([one[c]] * len(leaves), pa.string()) for c in ("subroot", "root"))]
        columns += [pa.array(proof, pa.string()), pa.array(fold, pa.string()), pa.array([f == one["root"] for f in fold], pa.bool_())]
        return pa.Table.from_arrays([*columns, *([pa.array(shown_steps, pa.list_(STEP))] if steps else [])], names=names)

    offered = F.col(shown) if shown else F.lit(None).cast("string")
    rows = made.placed.select("tree", F.floor(F.col("place") / most).alias("block"), "place", F.col(id_col).alias("doc_id"), F.col(leaf).alias("leaf"), offered.alias("shown"))
    logs = made.rounds[0].join(paths_above(made), ["tree", "block"])
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", steps {STEPS}" if steps else "")
    return rows.groupBy("tree", "block").cogroup(logs.groupBy("tree", "block")).applyInArrow(run, schema)


def document_leaves(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper: bool = False) -> DataFrame:
    """(doc_id, lang, leaf) of every row: the digest of its framed columns, null as ``-``.

    With ``tamper`` also ``shown``: where 3 divides the checksum of the id, the leaf of the row with A-Z of
    its text in lower case, else null.
    """
    given = [F.col(c) for c in columns]
    rows = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_of(*given).alias("leaf")]
    if tamper:
        changed = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in columns]
        hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
        rows.append(F.when(hit, leaf_of(*changed)).alias("shown"))
    return docs.select(*rows)


def verified_documents(docs: DataFrame, tamper: bool = True, levels: int = LEVELS) -> DataFrame:
    """Proofs of all documents against their manifest, a third of them tampered with.

    Repeated rows are leaves of their own; rows without id or language are leaves too (the null language is the
    first tree, rows without id stand last in theirs); other columns are left out, whatever their names; an empty
    table has no leaves and gives an empty result. Texts are read once and do not go through a shuffle.
    """
    made = manifest(document_leaves(docs, tamper=tamper), levels=levels)
    return proofs(made, shown="shown" if tamper else None)
