"""Column profiles, key roles and link clues of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.ranking import top_per_key

EXAMPLE_CHARS = 200
EXAMPLES = 3
HINT_ROWS = 50
LISTED_VALUES = 30


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "string"


def _cells(df: DataFrame, order_by: str) -> DataFrame:
    """One row per cell: column, type, position, text value, size; null, "" and [] give a null value."""
    cells = []
    for field in df.schema.fields:
        kind, col = type_name(field.dataType), F.col(field.name)
        if kind == "array":
            value, size = F.when(F.size(col) > 0, F.to_json(col)), F.size(col)
        elif kind == "object":
            value, size = F.to_json(col), F.lit(None).cast("int")
        else:
            value = F.nullif(col.cast("string"), F.lit("")) if kind == "string" else col.cast("string")
            size = F.length(value) if kind == "string" else F.lit(None).cast("int")
        cells.append(F.struct(F.lit(field.name).alias("col"), F.lit(kind).alias("type"), col.isNull().alias("is_null"),
                              value.alias("value"), F.when(value.isNotNull(), size).alias("size")))
    return df.select(F.col(order_by).alias("pos"), F.explode(F.array(*cells)).alias("c")).select("pos", "c.*")


def profile(df: DataFrame, order_by: str) -> DataFrame:
    """One row per column: counts, null rate, examples, lengths, format hints, distinct values.

    All columns are read in one scan and counted value by value with a map-side combine; long
    texts are represented by a digest, so no text travels through the shuffles. Per column only
    ranked heads and value-level counts are brought together.
    """
    cells = _cells(df, order_by)
    shown = F.when(F.length("value") > EXAMPLE_CHARS, F.concat(F.left("value", F.lit(EXAMPLE_CHARS)), F.lit("..."))).otherwise(F.col("value"))
    ident = F.when(F.length("value") > 64, F.md5(F.col("value").cast("binary"))).otherwise(F.col("value"))
    basic = cells.groupBy("col", "type").agg(
        F.count(F.lit(1)).alias("total_count"), F.count("value").alias("non_null_count"),
        F.count_if("is_null").alias("nulls"), F.min("size").alias("min_length"), F.max("size").alias("max_length"),
        F.round(F.avg("size"), 1).alias("avg_length"))

    filled = cells.filter(F.col("value").isNotNull())
    values = filled.groupBy("col", "type", ident.alias("ident"), shown.alias("shown")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    unique = values.filter(F.col("type").isin("string", "integer", "boolean")).groupBy("col").agg(
        F.count(F.lit(1)).alias("unique_count"))
    few = values.join(unique.filter(F.col("unique_count") <= LISTED_VALUES), "col").filter(F.length("ident") <= 64)
    listed = few.groupBy("col").agg(F.array_join(F.array_sort(F.collect_set("ident")), "|").alias("unique_values"))
    shown_first = values.groupBy("col", "shown").agg(F.min("pos").alias("pos"))
    examples = top_per_key(shown_first, ["col"], ["pos", "shown"], EXAMPLES).groupBy("col").agg(
        F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("e"))
    examples = examples.select("col", F.transform("e", lambda x: x["shown"]).alias("examples"))

    # Upper median from the counts per length.
    lengths = filled.filter(F.col("type") == "string").groupBy("col", "size").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("col").orderBy("size")
    spread = lengths.select("col", "size", F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                            F.sum("n").over(Window.partitionBy("col")).alias("all"))
    median = spread.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("col").agg(F.min("size").alias("median_length"))

    def has(*words: str) -> Column:
        test = None
        for w in words:
            hit = F.contains("value", F.lit(w))
            test = hit if test is None else test | hit
        return test

    heads = top_per_key(filled.filter(F.col("type") == "string"), ["col"], ["pos"], HINT_ROWS)
    hints = heads.groupBy("col").agg(
        F.bool_or(F.contains("value", F.lit("<")) & F.contains("value", F.lit(">"))).alias("contains_html"),
        F.bool_or(has("#", "[[", "**")).alias("contains_markdown"),
        F.bool_or(has("{{", "[[")).alias("contains_wikitext"))

    result = basic
    for part in (unique, listed, examples, median, hints):
        result = result.join(part, "col", "left")
    return result.select(
        F.col("col").alias("field_name"),
        F.when(F.col("non_null_count") > 0, F.col("type")).otherwise("null").alias("primary_type"),
        "total_count", "non_null_count", (F.col("nulls")).alias("null_count"),
        F.round(1 - F.col("non_null_count") / F.col("total_count"), 4).alias("null_rate"),
        "min_length", "max_length", "avg_length", "median_length", "unique_count", "unique_values", "examples",
        "contains_html", "contains_markdown", "contains_wikitext")


def profile_sketched(df: DataFrame, order_by: str) -> DataFrame:
    """One row per column from one scan and one exchange of fixed-size sketches, whatever the number of distinct values.

    Counts, null rates, lengths and format hints are exact and cover every value. ``unique_count`` comes from
    a HyperLogLog sketch (2 ** 14 registers, standard error under 1 %), ``median_length`` from a KLL sketch (rank error under
    2 %), ``frequent`` from a frequent-items sketch; ``unique_values`` is what it holds if there are few. ``examples`` are the first
    values by position of three classes of values, so they differ.
    """
    figures = []
    for field in df.schema.fields:
        kind, col = type_name(field.dataType), F.col("`" + field.name.replace("`", "``") + "`")
        if kind == "array":
            value, size = F.when(F.size(col) > 0, F.to_json(col)), F.size(col)
        elif kind == "object":
            value, size = F.to_json(col), F.lit(None).cast("int")
        else:
            value = F.nullif(col.cast("string"), F.lit("")) if kind == "string" else col.cast("string")
            size = F.length(value) if kind == "string" else F.lit(None).cast("int")
        size = F.when(value.isNotNull(), size)
        ident = F.when(F.length(value) > 64, F.md5(value.cast("binary"))).otherwise(value)
        shown = F.when(F.length(value) > EXAMPLE_CHARS, F.concat(F.left(value, F.lit(EXAMPLE_CHARS)), F.lit("..."))).otherwise(value)
        text, counted = kind == "string", kind in ("string", "integer", "boolean")
        none = F.lit(None)
        some = lambda *words: F.bool_or(_any_of(value, words)) if text else none.cast("boolean")  # noqa: E731, B023
        firsts = [F.min(F.when(value.isNotNull() & (F.pmod(F.xxhash64(ident), F.lit(EXAMPLES)) == i), F.struct(F.col(order_by).alias("pos"), shown.alias("shown")))) for i in range(EXAMPLES)]
        figures.append(F.struct(
            F.lit(field.name).alias("field_name"), F.when(F.count(value) > 0, F.lit(kind)).otherwise("null").alias("primary_type"),
            F.count(F.lit(1)).alias("total_count"), F.count(value).alias("non_null_count"), F.count_if(col.isNull()).alias("null_count"),
            F.round(1 - F.count(value) / F.count(F.lit(1)), 4).alias("null_rate"),
            F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.round(F.avg(size), 1).alias("avg_length"),
            (F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint(size.cast("long")), F.lit(0.5)) if text else none).cast("int").alias("median_length"),
            (F.hll_sketch_estimate(F.hll_sketch_agg(ident, 14)) if counted else none).cast("long").alias("unique_count"),
            (F.transform(_top(ident), lambda x: x["item"]) if counted else none).cast("array<string>").alias("frequent"),
            F.transform(F.array_sort(F.array_compact(F.array(*firsts))), lambda e: e["shown"]).alias("examples"),
            (F.bool_or(F.contains(value, F.lit("<")) & F.contains(value, F.lit(">"))) if text else none.cast("boolean")).alias("contains_html"),
            some("#", "[[", "**").alias("contains_markdown"), some("{{", "[[").alias("contains_wikitext")))
    one = df.agg(F.array(*figures).alias("fields"))
    rows = one.select(F.inline("fields"))
    few = (F.col("unique_count") <= LISTED_VALUES) & (F.size("frequent") <= LISTED_VALUES)
    return rows.withColumn("unique_values", F.when(few, F.array_join(F.array_sort("frequent"), "|")))


def _any_of(value: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(value, F.lit(w))
    return F.when(value.isNotNull(), test)


def _top(value: Column) -> Column:
    """The most frequent values, one more than are listed; null is none of them."""
    return F.filter(F.call_function("approx_top_k", value, F.lit(LISTED_VALUES + 2), F.lit(1024)), lambda x: x["item"].isNotNull())


def infer_roles(profiled: DataFrame) -> DataFrame:
    """Key roles a column could play: (role, field_name)."""
    name = F.lower("field_name")
    kind = F.col("primary_type")
    unique = F.coalesce("unique_count", F.lit(0))

    def named(*words: str) -> Column:
        return name.rlike("|".join(words))

    reference = F.exists("examples", lambda e: F.contains(e, F.lit("http")) | F.contains(e, F.lit("[[")) | F.contains(F.lower(e), F.lit("wiki")))
    tests = {
        "id": kind.isin("string", "integer") & (F.col("null_rate") < 0.05) & (unique > F.col("total_count") * 0.8),
        "name": (kind == "string") & named("name", "title", "label"),
        "category": ((kind == "string") & unique.between(1, LISTED_VALUES) & (F.col("null_rate") < 0.3)) | (kind == "array"),
        "text": (kind == "string") & (F.coalesce("avg_length", F.lit(0.0)) > 200),
        "reference": (kind == "string") & F.coalesce(reference, F.lit(False)),
    }
    roles = F.array_compact(F.array(*[F.when(test, F.lit(role)) for role, test in tests.items()]))
    return profiled.select(F.explode(roles).alias("role"), "field_name")


def link_clues(df: DataFrame, order_by: str, n: int = 20) -> DataFrame:
    """Text fields with ``[[...]]`` links and fields named like a relation, over the first records."""
    head = df.orderBy(order_by).limit(n)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in texts])
    rows = head.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("value").isNotNull())
    return rows.groupBy("field_name").agg(
        F.bool_or(F.contains("value", F.lit("[[")) & F.contains("value", F.lit("]]"))).alias("has_links"),
        F.bool_or(F.lower("field_name").rlike("relation|link|ref|parent|child|connect")).alias("relation_name"))
