"""Operator 4: near-duplicate embeddings by PCA-ordered tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import components, forest, ordered, stored

#: Rows of a tile, leading dimensions that are added at a time, pairs that are verified at a time.
TILE, STEP, AT_ONCE = 1024, 8, 1 << 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def matrix(column, dim: int) -> np.ndarray:
    return column.values.to_numpy().reshape(-1, dim) if len(column) else np.empty((0, dim))


def basis(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the principal axes of the unit vectors, leading axis first.

    Tasks sum up products; only dim * dim sums reach the driver for each dimension.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in set(batch.column(0).to_pylist()):
                some = batch.filter(pa.compute.equal(batch.column(0), dim))
                u = unit(np.array(some.column(1).to_pylist()))
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, s in sums.items():
            columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "at", "s"])

    def add(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        total = sum(c.values.to_numpy().reshape(-1, dim).sum(axis=0) for c in group.column("s").chunks if len(c))
        return pa.Table.from_arrays([*(group.column(n).slice(0, 1) for n in ("dim", "at")), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["dim", "at", "s"])

    parts = vectors.select("dim", "v").mapInArrow(run, "dim int, at int, s array<double>")
    sums = parts.groupBy("dim", "at").applyInArrow(add, "dim int, at int, s array<double>").orderBy("dim", "at").collect()  # one row per dimension
    out: dict[int, list[list[float]]] = {}
    for r in sums:
        out.setdefault(r.dim, []).append(r.s)
    return {d: np.linalg.eigh(np.array(s))[1][:, ::-1] for d, s in out.items()}


def close_pairs(a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, may: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) with may[i, j] and cosine >= least.

    Products of the leading axes are summed first; what the others can still add is at most the
    product of the two suffix norms. Where even that cannot reach ``least`` a pair is out, and the
    tile ends when no pair is left. Pairs left are verified in double precision on the vectors themselves.
    """
    dim, slack = ya.shape[1], 1e-9
    done, alive = np.zeros((len(ya), len(yb))), may
    for at in range(0, dim, STEP):
        done += ya[:, at : at + STEP] @ yb[:, at : at + STEP].T
        rest_a = np.sqrt(np.square(ya[:, at + STEP :]).sum(axis=1))
        rest_b = np.sqrt(np.square(yb[:, at + STEP :]).sum(axis=1))
        alive = alive & (done + np.outer(rest_a, rest_b) >= least - slack)
        left = np.count_nonzero(alive)
        if left == 0 or left * 50 < alive.size:
            break
    i, j = np.nonzero(alive)
    sure = [np.einsum("ij,ij->i", a[i[k : k + AT_ONCE]], b[j[k : k + AT_ONCE]]) >= least for k in range(0, len(i), AT_ONCE)]
    keep = np.concatenate(sure) if sure else np.zeros(0, dtype=bool)
    return i[keep], j[keep]


def tile_links(axes, least: float):
    """Compare two tiles: how many rows each class is linked to, and pairs that span the links."""

    def run(batches):
        known = axes.value
        for batch in batches:
            out = [[], [], []]
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                sides = []
                for side in ("a", "b"):
                    rows = one.column(batch.schema.get_field_index(side))[0].values
                    get = lambda f, rows=rows: rows.field(f).to_numpy(zero_copy_only=False)
                    sides.append((get("id"), get("label"), get("dim"), get("n"), rows.field("v")))
                twin = one.column(batch.schema.get_field_index("i"))[0].as_py() == one.column(batch.schema.get_field_index("j"))[0].as_py()
                for dim in np.intersect1d(sides[0][2], sides[1][2]).tolist():
                    (ia, la, na, va), (ib, lb, nb, vb) = [(x[0][x[2] == dim], x[1][x[2] == dim], x[3][x[2] == dim], unit(np.array(x[4].filter(pa.array(x[2] == dim)).to_pylist()))) for x in sides]
                    may = la[:, None] == lb[None, :]
                    if twin:
                        may &= np.tri(len(ia), k=-1, dtype=bool).T
                    i, j = close_pairs(va, vb, va @ known[dim], vb @ known[dim], may, least)
                    for ids, ends, others in ((ia, i, nb[j]), (ib, j, na[i])):
                        count = np.bincount(ends, weights=others, minlength=len(ids))
                        hit = np.flatnonzero(count)
                        out[0] += ids[hit].tolist()
                        out[1] += [None] * len(hit)
                        out[2] += count[hit].astype(np.int64).tolist()
                    if len(i):
                        near, k = np.zeros((len(ia) + (0 if twin else len(ib)),) * 2, dtype=bool), 0 if twin else len(ia)
                        near[i, j + k] = near[j + k, i] = True
                        ids = ia if twin else np.concatenate([ia, ib])
                        tree = forest(near)
                        out[0] += [int(ids[x]) for x, _ in tree]
                        out[1] += [int(ids[y]) for _, y in tree]
                        out[2] += [0] * len(tree)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "w", "n"])

    return run


def near_embeddings(vectors: DataFrame, least: float = 0.98, tile: int = TILE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors with equal labels link where their cosine, in double precision, is ``least`` or more.
    Equal vectors under one label form a class, compared once. Classes are put in order of label,
    dimension, cell on the leading principal axis and place on the second, and cut into tiles of ``tile`` rows. Linked unit
    vectors are at most sqrt(2 - 2 * least) apart on any axis; cells are that wide, so two tiles are compared only
    if they share a label, have rows in the same or neighbouring cells and their ranges there come that near on the second axis. A tile pair hands on counts and a spanning forest of its links, never the pairs.
    So a crowded label gives more tile pairs, not larger tasks.

    Rows with a null id, label or vector, with null or non-finite components or of length zero link
    with nothing and are their own component. Repeated rows are other vectors to each other, and so are different
    vectors under one id, each with its own links. Vectors of different dimension do not link. Other columns are left out; an empty table gives an empty one.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    key = [F.when(usable, F.xxhash64("label", "v", F.lit(s))).alias(f"k{s}") for s in (1, 2)]
    rows = rows.withColumn("usable", usable)
    member = stored(rows.select("vec_id", *key))
    same = rows.filter("usable").select("vec_id", "label", "v", *key)
    classes = stored(same.groupBy("k1", "k2").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("n")))
    first = classes.select("name", "n", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    held = same.join(first, (F.col("vec_id") == F.col("name")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).dropDuplicates(["k1", "k2"])
    held = held.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "name", "n", F.xxhash64("label").alias("label"), F.size("v").alias("dim"), "v")
    held = stored(held)  # from here on a class goes by its own number, as an id may stand at several vectors
    classes, held = held.select("id", "k1", "k2", "name", "n"), held.select("id", "n", "label", "dim", "v")
    axes = basis(held)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)  # dim * dim numbers

    def place(batches):
        for batch in batches:
            v, dims = batch.column(4), np.array(batch.column(3).to_pylist(), dtype=np.int64)
            y = np.zeros((2, len(dims)))
            for dim in np.unique(dims).tolist():
                axes = shared.value[dim][:, :2]
                y[: axes.shape[1], dims == dim] = (unit(np.array(v.filter(pa.array(dims == dim)).to_pylist())) @ axes).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, y)], names=["id", "n", "label", "dim", "v", "x", "y"])

    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    along = held.mapInArrow(place, "id long, n long, label long, dim int, v array<double>, x double, y double")
    along = along.withColumn("cell", F.floor(F.col("x") / reach))
    along = ordered(along, [F.col("label"), F.col("dim"), F.col("cell"), F.col("y"), F.col("id")])
    along = along.withColumn("tile", F.floor(F.col("idx") / tile))
    tiles = stored(along.groupBy("tile").agg(F.collect_list(F.struct("id", "label", "dim", "n", "v")).alias("rows")))  # at most ``tile`` rows each
    ranges = along.groupBy("label", "dim", "cell", "tile").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    # a cell is as wide as linked vectors can be apart, so they lie in the same or in neighbouring ones
    beside = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
    other = ranges.select("label", "dim", beside, F.col("tile").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = ranges.join(other, ["label", "dim", "cell"]).filter((F.col("tile") <= F.col("j")) & (F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach))
    pairs = pairs.select(F.col("tile").alias("i"), "j").distinct()
    met = pairs.join(tiles.select(F.col("tile").alias("i"), F.col("rows").alias("a")), "i").join(tiles.select(F.col("tile").alias("j"), F.col("rows").alias("b")), "j")
    wide = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    met = met.select("i", "j", "a", "b").repartition(max(wide, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "i", "j")
    found = stored(met.mapInArrow(tile_links(shared, least), "u long, w long, n long"))
    linked = found.filter("w is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("w is not null"), "u", "w")
    facts = classes.join(linked, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    facts = facts.withColumn("root", F.coalesce("root", "id"))
    smallest = facts.groupBy("root").agg(F.min("name").alias("component_id"))
    facts = facts.join(smallest, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = member.join(facts, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
