"""Token ids in Parquet files that can be read selectively.

Format: one row per document in ascending ``doc_id`` order across the files and within each: ``doc_id``,
``shard``, ``shard_start`` (ids before it in its shard), ``n_tokens`` and ``ids`` (list of ints). Ids are
dictionary-encoded, the other columns delta-encoded (version 2 pages); row groups and pages are small, and the
writer adds column and offset indexes, so a filter on ``doc_id`` reads a few pages and a projection without
``ids`` reads none of them. Row groups hold whole documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlake.llm.vocabulary import encoder, text_batches

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def encode(vocabulary: str, end_id: int):
    """For ``mapInArrow`` over (doc_id, text): adds ids, their number and the running start in the partition."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, start, end = encoder(vocabulary).encoded, 0, np.array([end_id], "<u4").tobytes()
        for part in parts:
            for lo, hi, texts in text_batches(part.column(1)):
                ids, bounds = encoded(texts, end)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                columns = [part.column(0).slice(lo, hi - lo), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard_start", "n_tokens", "ids"])
                start += int(bounds[-1])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode every whole text and write the files to ``path`` (a folder all executors can reach).

    Null text: empty, so only the end id. Null ``doc_id``: first. Repeated ``doc_id``: each row is kept, in
    text order. An empty table writes files without rows. Other columns are ignored.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    rows = ordered.mapInArrow(
        encode(vocabulary, end_id), "doc_id long, shard_start long, n_tokens long, ids array<int>"
    ).withColumn("shard", F.spark_partition_id())
    rows.select("doc_id", "shard", "shard_start", "n_tokens", "ids").write.options(**WRITER).parquet(path)


SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``.

    Shards before a row's own are summed from the metadata columns alone: one row per written file.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_offset"))
    )
    # One row per file, and a file holds whole row groups: bounded by the number of write tasks.
    joined = rows.join(F.broadcast(shards), "shard")
    return joined.select("doc_id", (F.col("shard_start") + F.col("shard_offset")).alias("start"), "n_tokens", "ids")


def crc_of_ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (doc_id, start, n_tokens, ids): the last column becomes the ids' crc32."""
    for part in parts:
        lists = part.column(3)
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        raw = memoryview(values.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(crc_of_ids, "doc_id long, start long, n_tokens long, ids_crc32 long")
