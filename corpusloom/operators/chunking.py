"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C


def _units(text: str, limit: int) -> Iterator[tuple[str, str, bool]]:
    """(glue, unit, starts_afresh): paragraphs, or the sentences of a paragraph that is too long."""
    for paragraph in text.split("\n\n"):
        if len(paragraph) <= limit:
            yield "\n\n", paragraph, False
            continue
        for i, sentence in enumerate(paragraph.replace(". ", ".\n").split("\n")):
            yield " ", sentence, i == 0


def pack_text(text: str, limit: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP_CHARS) -> list[str]:
    """Chunks of at most ``limit`` characters (one sentence may be longer), each starting with
    the tail of the one before. Empty chunks are never produced."""
    if len(text) <= limit:
        return [text]
    done: list[str] = []
    held = ""

    def close() -> None:
        if held.strip():
            done.append(held.strip())

    for glue, unit, afresh in _units(text, limit):
        if afresh:
            close()
            held = ""
        if not held:
            held = unit
        elif len(held) + len(glue) + len(unit) <= limit:
            held += glue + unit
        else:
            close()
            held = held[-overlap:].lstrip() + glue + unit if overlap > 0 else unit
    close()
    return done


def split_column(col: Column, max_chars: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP_CHARS) -> Column:
    """Array of chunks of a text. Packing depends on every earlier cut, so it runs over Arrow batches."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pack_text(t, max_chars, overlap))

    return split(col)


def split_text(df: DataFrame, col: str, max_chars: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP_CHARS) -> DataFrame:
    """One row per chunk of a text column."""
    rest = [c for c in df.columns if c != col]
    parts = df.withColumn("__parts", split_column(F.col(col), max_chars, overlap))
    return parts.select(*rest, F.posexplode("__parts").alias("chunk_index", "text"))


def section_groups(sections: Column, max_chars: int = C.CHUNK_CHARS) -> Column:
    """Adjacent small sections joined while they fit; each group keeps its first title."""
    group = "struct<title:string,text:string>"
    start = F.struct(
        F.array().cast(f"array<{group}>").alias("done"), F.lit("").alias("title"), F.lit("").alias("text"))

    def one(title: Column, text: Column) -> Column:
        return F.struct(title.alias("title"), text.alias("text"))

    def step(acc: Column, section: Column) -> Column:
        body = F.coalesce(section["content"], F.lit(""))
        title = F.coalesce(section["title"], F.lit(""))
        full = (acc["text"] != "") & (F.length(acc["text"]) + F.length(body) + 2 > max_chars)
        return F.struct(
            F.when(full, F.array_append(acc["done"], one(acc["title"], acc["text"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["title"] == ""), title).otherwise(acc["title"]).alias("title"),
            F.when(full | (acc["text"] == ""), body).otherwise(F.concat(acc["text"], F.lit("\n\n"), body)).alias("text"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["text"] != "", F.array_append(acc["done"], one(acc["title"], acc["text"]))).otherwise(acc["done"])

    return F.aggregate(sections, start, step, finish)


def chunk_documents(docs: DataFrame, max_chars: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP_CHARS,
                    id_col: str = "page_key", carry=("entity_type", "regions", "categories", "source_url")) -> DataFrame:
    """Chunks of the section groups, or of the whole content where a document has no section."""

    @F.pandas_udf("array<array<string>>")
    def split_all(groups: pd.Series) -> pd.Series:
        return groups.map(lambda texts: [pack_text(t, max_chars, overlap) for t in texts])

    whole = F.array(F.struct(F.lit("").alias("title"), F.col("content").alias("text")))
    groups = F.when(F.size("sections") > 0, section_groups(F.col("sections"), max_chars)).otherwise(whole)
    df = docs.withColumn("__groups", groups)
    df = df.withColumn("__texts", split_all(F.transform("__groups", lambda g: g["text"])))
    pieces = F.flatten(
        F.transform(
            F.arrays_zip("__groups", "__texts"),
            lambda g: F.transform(g["__texts"], lambda t: F.struct(g["__groups"]["title"].alias("title"), t.alias("text"))),
        )
    )
    df = df.select(F.col(id_col).alias("doc_id"), F.col("canonical_name").alias("title"), *carry,
                   F.posexplode(pieces).alias("chunk_index", "piece"))
    text = F.col("piece")["text"]
    return df.select(
        F.format_string("%s_c%03d", "doc_id", "chunk_index").alias("chunk_id"),
        "doc_id", "title", F.col("piece")["title"].alias("section_title"), "chunk_index",
        text.alias("text"), F.length(text).alias("text_length"), *carry,
        F.sha2(text.cast("binary"), 256).alias("content_hash"),
    )


def fixed_windows(df: DataFrame, col: str, size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP_CHARS) -> DataFrame:
    """Windows of fixed size and stride over a text; all native."""
    stride = size - overlap
    rest = [c for c in df.columns if c != col]
    last = F.greatest(F.lit(0), F.ceil((F.length(col) - overlap) / stride) - 1).cast("int")
    starts = df.withColumn("__window", F.sequence(F.lit(0), last))
    parts = starts.select(
        *rest,
        F.posexplode(F.transform("__window", lambda i: F.substring(F.col(col), i * stride + 1, F.lit(size)))).alias("window_index", "text"),
    )
    return parts
