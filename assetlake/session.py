"""Session settings and durable scratch tables.

Loops and order-dependent steps cut their lineage by writing a table to a folder every executor can
reach, so a lost executor costs a re-read and never a recomputation of the loop.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on (all of them changeable at run time)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What is run in the block hands rows to Python in Arrow batches of about this size, so texts of any length take
    little memory beside the JVM's heap and in the workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut points: one the application has set itself, the cluster's setting, else a local one
    for local mode only."""
    own = spark.sparkContext.getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None)
    plain = (root or "").rstrip("/").removeprefix("file:").replace("//", "/")
    if own and not (plain and own.removeprefix("file:").replace("//", "/").startswith(plain)):
        return own.rstrip("/")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="assetlake-")
    spark.sparkContext.setCheckpointDir(root)
    return scratch_root(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and continue from the stored table.

    Unlike an in-memory cut this keeps columnar pruning and gives the optimizer true sizes, so the
    next join broadcasts the step's result only when it really is small.
    """
    return materialize_counted(df, label)[0]


def materialize_counted(df: DataFrame, label: str = "step", where: Column | None = None) -> tuple[DataFrame, int]:
    """Like :func:`materialize`, with the number of rows (that satisfy ``where``), counted while written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1) if where is None else F.when(where, 1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


class Grown:
    """A stored table that grows round by round, with rows of the same ``keys`` in the same one of its buckets.

    Joins and groupings by the keys (or more columns) read it as it lies, so a loop moves only its new rows. While it
    grows it is an external table of the session's catalog; :meth:`end` takes it off again and leaves the files.
    """

    def __init__(self, spark: SparkSession, label: str, keys: list[str]):
        self.spark, self.keys, self.path = spark, keys, scratch_path(spark, label)
        self.name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, rows: DataFrame, round_: int = 0) -> int:
        """Stores the rows of a round and gives their number."""
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("_round", F.lit(round_)).write
        writer = writer.mode("append").format("parquet").option("path", self.path).partitionBy("_round")
        writer.bucketBy(self.buckets, *self.keys).saveAsTable(self.name)
        return seen.get["rows"]

    def rows(self, round_: int | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        return (rows if round_ is None else rows.where(F.col("_round") == round_)).drop("_round")

    def end(self) -> DataFrame:
        """All rows, from the files."""
        schema = self.rows().schema
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)


def of_known_size(df: DataFrame, label: str = "facts") -> DataFrame:
    """Store a table that has a row per run or so before it meets a large one.

    The optimizer then knows its true size and sends it to the large table's tasks while it is small, instead of
    dealing out the large table by run, where one run can hold most rows.
    """
    return materialize(df, label)
