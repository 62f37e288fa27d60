"""Sinks. Readers trust only what a record written last points to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_publication(df: DataFrame, prefix: str, region: str, publication_id: str) -> str:
    """Immutable tree of one publication; its completion marker is written last.

    Publishing an id twice is refused by the write itself.
    """
    root = f"{prefix}/{region}/publications/{publication_id}"
    df.write.mode("errorifexists").parquet(f"{root}/files")
    marker = df.sparkSession.range(1).select(
        F.lit(region).alias("region"), F.lit(publication_id).alias("publication_id"), F.current_timestamp().alias("completed_at")
    )
    marker.coalesce(1).write.mode("errorifexists").json(f"{root}/complete")
    return root


def read_publications(spark: SparkSession, prefix: str) -> DataFrame:
    """Files of complete publications only: those whose marker exists."""
    files = spark.read.parquet(f"{prefix}/*/publications/*/files").select(
        F.regexp_extract("_metadata.file_path", r"/([^/]+)/publications/", 1).alias("region"),
        F.regexp_extract("_metadata.file_path", r"/publications/([^/]+)/", 1).alias("publication_id"),
        "*",
    )
    markers = spark.read.schema("region STRING, publication_id STRING").json(f"{prefix}/*/publications/*/complete")
    return files.join(markers, ["region", "publication_id"], "left_semi")


def write_stable(manifest: DataFrame, summary: DataFrame, version: DataFrame, prefix: str, publication_id: str) -> None:
    """Manifest, then summary, then the version record, each under the publication's own id.

    The record names the id, so a reader never sees a manifest whose publication did not finish.
    """
    root = f"{prefix}/_state"
    manifest.write.mode("errorifexists").partitionBy("run").json(f"{root}/manifests/{publication_id}")
    summary.write.mode("errorifexists").json(f"{root}/summaries/{publication_id}")
    version.withColumn("publication_id", F.lit(publication_id)).coalesce(1).write.mode("append").json(f"{root}/versions")


def read_stable(spark: SparkSession, prefix: str, schema: str) -> DataFrame:
    """The manifest rows of every finished publication, by ``publication_id``."""
    root = f"{prefix}/_state"
    rows = (
        spark.read.schema(schema)
        .json(f"{root}/manifests/*/*")
        .select(
            F.regexp_extract("_metadata.file_path", r"/manifests/([^/]+)/", 1).alias("publication_id"),
            F.url_decode(F.regexp_extract("_metadata.file_path", r"/run=([^/]+)/", 1)).alias("run"),
            "*",
        )
    )
    done = spark.read.schema("publication_id STRING").json(f"{root}/versions").distinct()
    return rows.join(done, "publication_id", "left_semi")
