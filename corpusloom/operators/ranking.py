"""Keep-first, keep-last, top-n per key, running totals and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C

Order = Column | str


def top_per_key(df: DataFrame, keys: Sequence[Order], order_by: Sequence[Order], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    The rank filter sits directly on the window, so Spark cuts each key to ``n`` rows inside
    every input task before the shuffle; a key that holds a third of all rows stays cheap.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[Order], order_by: Sequence[Order]) -> DataFrame:
    return top_per_key(df, keys, order_by, 1)


def keep_last(df: DataFrame, key: Sequence[str], order_by: Sequence[Order]) -> DataFrame:
    """Last record per key in the given ascending order."""
    backwards = [F.desc(o) if isinstance(o, str) else o.desc() for o in order_by]
    return first_per_key(df, key, backwards)


def dedup_exact(df: DataFrame, hash_col: str = "content_hash", order_by: Sequence[Order] = ("doc_id",)) -> DataFrame:
    """First occurrence of each content hash in the given order."""
    return first_per_key(df, [hash_col], order_by)


def cap_newest(df: DataFrame, ts_col: str, n: int = C.CACHE_SIZE, tie: str | None = None) -> DataFrame:
    """The ``n`` newest rows: a distributed take-ordered, no global sort."""
    order = [F.desc(ts_col)] + ([F.desc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)


def select_documents(docs: DataFrame, all_types=None, caps=None, skip_types=None,
                     type_col: str = "entity_type", size: Column | None = None, order_by: str = "doc_id") -> DataFrame:
    """Whole priority types, the longest documents of capped types, no skipped types, all others."""
    all_types = C.EXTRACT_ALL_TYPES if all_types is None else all_types
    caps = C.EXTRACT_TYPE_CAPS if caps is None else caps
    skip_types = C.EXTRACT_SKIPPED_TYPES if skip_types is None else skip_types
    size = F.length("content") if size is None else size
    capped = [t for t in caps if t not in all_types]
    free = docs.filter(
        F.col(type_col).isin(list(all_types)) | ~F.col(type_col).isin([*capped, *skip_types])
    )
    limits = F.create_map(*[F.lit(x) for t in capped for x in (t, caps[t])]) if capped else None
    if limits is None:
        return free
    most = max(caps[t] for t in capped)
    limited = top_per_key(docs.filter(F.col(type_col).isin(capped)), [type_col], [size.desc(), F.col(order_by)], most, "__n")
    limited = limited.filter(F.col("__n") <= limits[F.col(type_col)]).drop("__n")
    return free.unionByName(limited)


def _slot(value: Column, bounds: list[float], low: int = 0) -> Column:
    """Index of the first bound that is >= value, as a balanced decision tree."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value <= bounds[mid], _slot(value, bounds[:mid], low)).otherwise(
        _slot(value, bounds[mid + 1:], low + mid + 1)
    )


def running_total(df: DataFrame, value: str, order_by: str, out: str = "total_before", slots: int | None = None) -> DataFrame:
    """Sum of ``value`` over all earlier rows of a global order, without a single global window.

    Rows are dealt into ranges of the (unique, numeric) order column; each range is summed by
    itself and lifted by the total of the ranges before it. Only one row per range is ever
    brought together.
    """
    slots = slots or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / slots for i in range(1, slots)]
    bounds = sorted(set(df.approxQuantile(order_by, shares, 0.2 / slots))) if shares else []
    placed = df.withColumn("__slot", _slot(F.col(order_by), bounds))
    totals = placed.groupBy("__slot").agg(F.sum(value).alias("__sum"))
    ahead = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__slot", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__slot").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__before", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(offsets, "__slot")
        .withColumn(out, F.col("__before") + F.col("__offset"))
        .drop("__slot", "__before", "__offset")
    )


def within_budget(df: DataFrame, cost_col: str, order_by: str, budget: float, guard: float = C.BUDGET_GUARD) -> DataFrame:
    """Rows that are started while the cost so far is still below the guarded budget."""
    return running_total(df, cost_col, order_by, "spent_before").filter(F.col("spent_before") < budget * guard)
