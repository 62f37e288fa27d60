"""Packing of token sequences by best fit over the histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. Only the number of pieces of each length goes to the
driver (at most ``capacity`` rows). Best fit decreasing runs over these numbers: ranges of sequences with the same
room left take ranges of pieces with the same length. Its result, a few thousand slot ranges, is joined with the
pieces on their length and their rank within it; ranks come from salted counts, so no task sees a whole length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.vocabulary import encoder, text_batches
from assetlake.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(vocabulary: str, end_id: int, capacity: int, with_ids: bool):
    """For ``mapInArrow`` over (doc_id, text): pieces of the encoded text and its end id."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end = encoder(vocabulary).encoded, np.array([end_id], "<u4").tobytes()
        for part in parts:
            for lo, hi, texts in text_batches(part.column(1)):
                ids, bounds = encoded(texts, end)
                # Every text has an id at least, so a piece.
                counts = -(-np.diff(bounds) // capacity)
                of = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = bounds[of] + capacity * piece
                last = np.minimum(first + capacity, bounds[of + 1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                columns = [
                    part.column(0).slice(lo, hi - lo).take(pa.array(of)), pa.array(piece, pa.int32()),
                    pa.array(capacity * piece), pa.array(last - first), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    starts = np.append(first, bounds[-1]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2_048, with_ids: bool = False):
    """Pieces of every whole text (null: empty) with its end id; ``with_ids`` adds the ids themselves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_cut(vocabulary, end_id, capacity, with_ids), schema)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts: (length, first rank, end rank, first sequence, offset) ranges.

    Ranks first..end-1 of a length go to the sequences first sequence.. one each, at the offset. Every step uses
    up a length or a range of sequences, so the number of ranges does not depend on the counts.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # distinct amounts of room left, ascending
    open_: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def put(room: int, first: int, end: int) -> None:
        if room and end > first:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, end))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, end = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
                n = min(left, end - first)
                slots.append((length, rank, rank + n, first, capacity - room))
                put(room, first + n, end)
                put(room - length, first, first + n)
                rank, left = rank + n, left - n
                continue
            per = capacity // length
            bins, rest = divmod(left, per)
            for n, items in ((bins, per), (1 if rest else 0, rest)):
                if n:
                    for k in range(items):
                        slots.append((length, rank, rank + n, sequences, k * length))
                        rank += n
                    put(capacity - items * length, sequences, sequences + n)
                    sequences += n
            left = 0
    return slots


def pack(pieces: DataFrame, capacity: int = 2_048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id``, ``piece``, ``length``, anything else).

    ``pieces`` is read several times: pass a stored table. Pieces that agree in everything get one slot each.
    Null ``doc_id`` is a value like any other. Empty table: no rows. Lengths outside 1..capacity are an error.
    """
    spark = pieces.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    parts = materialize(salted.groupBy("length", "_salt").count(), "lengths")
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("count")).collect()}  # <= capacity rows
    slots = spark.createDataFrame(
        plan_slots(counts, capacity), "length long, _from long, _to long, _sequence long, offset long"
    )
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_local", F.row_number().over(local) - 1).join(offsets, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_local") + F.col("_before"))
    # Slot ranges: their number depends on the capacity alone.
    fits = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    packed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & fits)
    return packed.select(
        *[ranked[c] for c in pieces.columns],
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset",
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ids in order (at most the capacity); ``packed`` must hold ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
