"""Bound inputs for the registered queries, and the registry itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.plans.bindings import BINDINGS
from assetlake.plans.dialects import DuckText, SparkText
from assetlake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_DUCK = DuckText()


class Bound:
    """Tables derived from one data folder, by binding name: ``bound.receipts`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir
        self._text = SparkText(sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BINDINGS:
            raise AttributeError(name)
        return self.spark.sql(BINDINGS[name](self._text))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def journal(self) -> DataFrame:
        """Journal rows with their (eight) outputs nested."""
        objects = F.when(
            F.col("class_id").isNotNull(), F.struct("source_file", "path_id", "class_id", "name", "container")
        ).alias("object")
        rows = self.flat.groupBy("run", "resource_index", "output_directory", "source", "source_sha256", "failed").agg(
            F.sort_array(F.collect_list(F.struct("position", "path", "kind", "bytes", "sha256", objects))).alias("o")
        )
        return rows.select(
            "run",
            (~F.col("failed") & (F.col("resource_index") % 3 == 0)).alias("cache_hit"),
            "source",
            "output_directory",
            "source_sha256",
            F.size("o").cast("long").alias("objects"),
            (F.size("o") - 1).cast("long").alias("selected_objects"),
            F.lit(1).cast("long").alias("skipped_objects"),
            F.transform("o", lambda x: F.struct(x["path"], x["kind"], x["bytes"], x["sha256"], x["object"])).alias("outputs"),
            F.when(F.col("failed"), F.array(F.when(F.col("resource_index") % 2 == 0, "Read timed out").otherwise("bad header")))
            .otherwise(F.array().cast("array<string>"))
            .alias("errors"),
        )


def oracle(sql: str, *bindings: str) -> str:
    """Put the named bindings in front of a check."""
    ctes = [f"{b} AS ({BINDINGS[b](_DUCK)})" for b in bindings]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + body


def query(name: str, sql: str | None = None, *bindings: str):
    """Register a query under ``name`` with its check over the named bindings."""

    def register(f: Callable[[Bound], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *bindings)
        return f

    return register
