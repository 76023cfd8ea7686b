"""Registry of runnable queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusloom import constants as C
from corpusloom.plans.views import with_views
from corpusloom.tables import Tables


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    views: tuple[str, ...]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))

    def oracle(self) -> str | None:
        return None if self.sql is None else with_views(list(self.views), self.sql)


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register a query builder under a name, with the DuckDB statement that must agree with it."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(build, sql, tuple(views))
        return build

    return register


# DuckDB renderings of the text helpers, used by oracle statements only.
_BLANK_SET = " || ".join(f"chr({ord(c)})" for c in C.BLANKS)


def d_strip(x: str) -> str:
    return f"trim({x}, {_BLANK_SET})"


def d_clean_markdown(x: str) -> str:
    x = rf"regexp_replace({x}, '!\[[^\]]*\]\([^)]+\)', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)^---+\s*$', '', 'g')"
    return d_strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def d_normalize(x: str) -> str:
    x = rf"regexp_replace({x}, '\{{\{{[^}}]*\}}\}}', '', 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?m)[ \t]+$', '', 'g')"
    return d_strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def d_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def d_list(words) -> str:
    return "(" + ", ".join(d_quote(w) for w in words) + ")"


def d_round(x: str, places: int) -> str:
    """Half-up rounding of a double by its decimal digits, as Spark does it."""
    return f"CAST(round(CAST({x} AS DECIMAL(30, 14)), {places}) AS DOUBLE)"
