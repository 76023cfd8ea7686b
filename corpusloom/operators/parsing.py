"""Raw pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import text as X


def with_title(df: DataFrame, out: str = "title") -> DataFrame:
    """First section's title without outer blanks and quotes, else the URL slug, else ``Unknown``."""
    first = F.get(F.col("sections"), F.lit(0))["title"]
    from_section = F.when(first != "", X.strip(X.strip(first), '"'))
    from_url = F.replace(X.wiki_slug(F.col("url")), F.lit("_"), F.lit(" "))
    return df.withColumn(out, F.coalesce(from_section, from_url, F.lit("Unknown")))


def with_doc_id(df: DataFrame, url_col: str = "url", out: str = "page_key") -> DataFrame:
    """Readable id from the URL slug, or a short digest of the URL when it has none."""
    url = F.col(url_col)
    readable = F.translate(X.wiki_slug(url), " /", "__")
    digest = F.substring(F.md5(url.cast("binary")), 1, 12)
    return df.withColumn(out, F.concat(F.lit("wiki_"), F.coalesce(readable, digest)))


def entity_type(categories: Column, rules=None, default: str = "Other") -> Column:
    """Type of the first rule whose exact member or substring occurs in the category list."""
    chain = None
    for name, members, parts in rules or C.ENTITY_TYPE_RULES:
        tests = [F.array_contains(categories, m) for m in members]
        if parts:
            tests.append(_has_part(categories, parts))
        test = _any(tests)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(default)


def _has_part(categories: Column, parts: list[str]) -> Column:
    return F.exists(categories, lambda c: _any(F.contains(c, F.lit(p)) for p in parts))


def _any(tests) -> Column:
    result = None
    for test in tests:
        result = test if result is None else result | test
    return result


def with_entity_type(df: DataFrame, rules=None, default: str = "Other") -> DataFrame:
    return df.withColumn("entity_type", entity_type(F.col("category"), rules, default))


def regions(categories: Column, keywords=None) -> Column:
    """Names of the regions whose keyword occurs in the blank-joined categories, in table order."""
    joined = F.lower(F.concat_ws(" ", categories))
    return F.array_compact(
        F.array(*[F.when(F.contains(joined, F.lit(k.lower())), F.lit(n)) for k, n in keywords or C.REGION_KEYWORDS])
    )


def with_regions(df: DataFrame, keywords=None) -> DataFrame:
    return df.withColumn("regions", regions(F.col("category"), keywords))


def with_hash(df: DataFrame, col: str = "content") -> DataFrame:
    return df.withColumn("content_length", F.length(col)).withColumn(
        "content_hash", F.sha2(F.col(col).cast("binary"), 256)
    )


def parse_pages(df: DataFrame) -> DataFrame:
    """Whole parse step: one document per raw page (url, category, markdown, sections)."""
    df = with_regions(with_entity_type(with_doc_id(with_title(df))))
    df = df.withColumn("content", X.clean_markdown(F.col("markdown")))
    df = df.withColumn("sections", X.parse_sections(F.col("sections")))
    df = df.withColumnRenamed("category", "categories").withColumnRenamed("url", "source_url")
    return with_hash(df.drop("markdown"))
