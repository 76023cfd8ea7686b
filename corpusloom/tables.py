"""Loading of the given tables and the size checks that decide physical strategy."""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import batch_by_bytes, shared_folder, shuffles_dropped, size_by_rows, written

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give CPU-heavy row work at least one task per core.

    A table that arrives as fewer splits than there are cores (one small parquet row group) is
    dealt out round-robin; a table with enough splits is returned as it is, so nothing is
    shuffled at scale. The row count that is observed keeps later filters above the exchange,
    where they run on all cores; select the needed columns beforehand. With ``rows``, for tables of
    which a row makes many, a task has no more than about that number of them however large the table is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        wanted = max(wanted, math.ceil(df.count() / rows))
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted).observe(f"rows_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def fits_in_rows(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


DEALT_ROWS = 32_768   # of a table per task, where a row makes many
SHARED_ROWS = 65_536  # of a table that may be sent whole to the driver and all tasks


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that deals both sides by key, never sent whole.

    Spark estimates a side from the bytes of its files. Rows that take a few bytes there (one per question) would be
    sent through the driver with all that was derived from them.
    """
    return df.hint("merge")


def beside(df: DataFrame, limit: int = SHARED_ROWS) -> DataFrame:
    """``df`` as the smaller side of a join: shared with all tasks if it was counted to be small, dealt by key otherwise.

    A few keys that most rows of the other side have stay where they are, and are not brought together by key.
    """
    small = written(df)
    return F.broadcast(small) if fits_in_rows(small, limit) else by_key(small)


def dealt_by(df: DataFrame, keys: int, *cols: str) -> DataFrame:
    """``df`` dealt by columns over the session's number of tasks, or more, so that none has over ``DEALT_ROWS`` of the ``keys`` different values."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, math.ceil(keys / DEALT_ROWS)), *cols)


def in_shares(spark: SparkSession, key: str, shares: int, make: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """What ``make`` returns for each share of the keys, one after the other, as one written table.

    ``make`` is given the function that cuts a table with the column ``key`` to the share. For results that bring large
    rows to many keys: a share's shuffles go before the next one begins, so the disk holds those of one share.
    """
    path = f"{shared_folder(spark)}/shares-{uuid.uuid4().hex}"
    for share in range(shares):
        part = make(lambda df, share=share: df.filter(F.pmod(F.xxhash64(key), F.lit(shares)) == share))
        with shuffles_dropped(spark):
            part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the Python path of the workers, where it exists there.

    Clusters that install the package or ship it with ``--py-files`` do not need it.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, home]))


class Tables:
    """Attribute access to the parquet tables of one folder and to the views derived from them.

    Each table is opened once; derived views refer to it by a session-local name, so reading a
    view costs no further look at the files.
    """

    def __init__(self, spark: SparkSession, folder: str, spread_out: bool = False, rows: int | None = None):
        self.spark = spark
        self.spread_out = spread_out
        self.rows = rows
        self.folder = folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        size_by_rows(spark)
        batch_by_bytes(spark)
        let_workers_import(spark)

    @property
    def wide(self) -> Tables:
        """The same tables dealt out over all cores, for views whose rows are costly to work on."""
        return Tables(self.spark, self.folder, spread_out=True)

    @property
    def dealt(self) -> Tables:
        """The same tables dealt out in tasks of a fixed number of rows, for views that make many rows of one."""
        return Tables(self.spark, self.folder, spread_out=True, rows=DEALT_ROWS)

    def sql_name(self, table: str) -> str:
        """Name under which SQL text can read a table of this folder."""
        kind = "corpusloom" if not self.spread_out else "wide" if self.rows is None else f"dealt{self.rows}"
        name = f"{kind}_{hashlib.md5(self.folder.encode()).hexdigest()[:8]}_{table}"
        if table not in self._open:
            df = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
            self._open[table] = spread(df, self.rows) if self.spread_out else df
            self._open[table].createOrReplaceTempView(name)
        return name

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            self.sql_name(name)
            return self._open[name]
        from corpusloom.plans import views

        if name in views.VIEWS:
            return views.spark_view(self, name)
        raise AttributeError(name)
