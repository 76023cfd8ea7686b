"""Session creation and the two cluster-facing settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine (tests) may leave it unset and then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


# Rows of short repetitive names take about 30 times the bytes of their Parquet files once a join holds them.
FILE_GROWTH = 30


def size_by_rows(spark: SparkSession) -> None:
    """Have Spark estimate a scanned table by what its rows take in memory, so that no join sends whole what is only small as a file."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) < FILE_GROWTH:
        spark.conf.set(name, str(float(FILE_GROWTH)))


# Bytes of rows that a Python worker is given at a time; it holds several copies of them in other forms.
BATCH_BYTES = 4 << 20


def batch_by_bytes(spark: SparkSession) -> None:
    """Have Spark end a batch for a Python worker by its bytes as well: 10,000 rows are little of numbers and much of whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(name).removesuffix("b"))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have the files of a shuffle go when the query that made them ends, not when the driver happens to collect its garbage.

    For queries that end in a table, whose shuffles nothing reads again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later steps start from its files and know its size."""
    size_by_rows(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
