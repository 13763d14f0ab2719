"""Tables that cut lineage, kept in the folder that every executor shares."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary folder if all runs on this machine (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return base.rstrip("/")


class Scratch:
    """Written tables of one operator run. A lost executor never costs what is written here; all go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, fs = self._at(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and returns the reading of it."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            path, fs = self._at(df._scratch_path)
            fs.delete(path, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files behind when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, given)


def buckets_for(items: int, per_bucket: int) -> int:
    """How many buckets keep each near per_bucket items; grows with the input, 8 at least."""
    return max(8, math.ceil(items / per_bucket))


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 32) -> None:
    """From now on Spark hands at most so many rows and bytes at a time to Python; texts are long, and a batch is held several times over.

    Every operator on texts asks for it, so that none depends on what ran before. Smaller settings of the session stay.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        given = spark.conf.get(name).rstrip("b")
        if not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(name, str(most))


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """The named columns of df, cast; other columns, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])
