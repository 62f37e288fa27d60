"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. These helpers range-partition the rows by (group, order), store
them once with the number of their range, and compute per chunk with per-chunk totals carried over, so no task ever
holds more than one chunk of a group. There is one path for all sizes. Where only the newest rows of a group are
wanted, :func:`newest` leaves out beforehand, and without a shuffle, what cannot be among them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.session import materialize, of_known_size

CHUNK = "_chunk"
#: Slots of time in the summary by which :func:`newest` finds where a group's head ends.
SLOTS = 1024


def chunked(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``_chunk``: ascending along ``order`` within each group. The result is stored, so chunk numbers stay."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
    return materialize(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _same(group: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[g].eqNullSafe(right[g]) for g in group])


def newest(
    df: DataFrame, group: Sequence[str], at: str, rows: int | None = None, sums: dict[str, int] | None = None
) -> DataFrame:
    """The rows of ``df`` but those that certainly lie behind the first ``rows`` of their group, or behind the ones
    whose summed column stays within its limit (``{column: limit}``, no negative values), counted from the newest.

    Each group's time is cut into equal slots, whose counts and sums combine before the shuffle; rows in slots behind
    the one in which a limit is passed go where they are read. Some rows beyond the limits stay: the rest of that
    slot. ``at`` is a number or a timestamp; null is the oldest.
    """
    sums = sums or {}
    time = F.col(at).cast("double")
    ends = of_known_size(df.groupBy(*group).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")), "ends")
    part = (time - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    slot = F.when(time.isNull(), -1).otherwise(F.floor(SLOTS * F.coalesce(part, F.lit(0.0))).cast("int"))
    slotted = df.join(ends, _same(group, df, ends)).select(*[df[c] for c in df.columns], slot.alias("_slot"))
    totals = {"_rows": F.count(F.lit(1)), **{f"_sum_{c}": F.sum(c) for c in sums}}
    summary = slotted.groupBy(*group, "_slot").agg(*[agg.alias(name) for name, agg in totals.items()])
    newer = Window.partitionBy(*group).orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(*group, "_slot", *[F.coalesce(F.sum(n).over(newer), F.lit(0)).alias(n) for n in totals])
    wanted = F.lit(True) if rows is None else F.col("_rows") < rows
    for c, limit in sums.items():
        wanted = wanted & (F.col(f"_sum_{c}") <= limit)
    cuts = of_known_size(before.where(wanted).groupBy(*group).agg(F.min("_slot").alias("_cut")), "cuts")
    head = slotted.join(cuts, _same(group, slotted, cuts)).where(F.col("_slot") >= F.col("_cut"))
    return head.select(*[slotted[c] for c in df.columns])


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    row_number: str | None = None,
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Row number and/or inclusive running sums (``{new column: summed column}``) within each group.

    ``order`` must be unique within a group.
    """
    sums = sums or {}
    df = chunked(df, group, order)
    w = Window.partitionBy(*group, CHUNK).orderBy(*order)
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {name: F.sum(col).over(rows) for name, col in sums.items()}
    if row_number:
        new[row_number] = F.row_number().over(w).cast("long")
    out = df.withColumns(new)
    before = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = {name: F.sum(col) for name, col in sums.items()}
    if row_number:
        totals[row_number] = F.count(F.lit(1))
    per_chunk = df.groupBy(*group, CHUNK).agg(*[agg.alias(f"_t_{n}") for n, agg in totals.items()])
    offsets = per_chunk.select(
        *group, CHUNK, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    joined = out.join(offsets, _same([*group, CHUNK], out, offsets), "inner")
    keep = [out[c] for c in out.columns if c not in totals and c != CHUNK]
    return joined.select(*keep, *[(out[n] + offsets[f"_o_{n}"]).alias(n) for n in totals])


def previous(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    columns: dict[str, str],
) -> DataFrame:
    """Values of the preceding row of the group (``{new column: column}``); null on the first row.

    A boolean ``_first`` column tells the first row from a null value.
    """
    df = chunked(df, group, order)
    w = Window.partitionBy(*group, CHUNK).orderBy(*order)
    out = df.withColumns(
        {**{n: F.lag(c).over(w) for n, c in columns.items()}, "_first": F.row_number().over(w) == 1}
    )
    last_row = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group, CHUNK).orderBy(*order)))
    ends = last_row.groupBy(*group, CHUNK).agg(
        *[F.max_by(c, "_n").alias(f"_e_{n}") for n, c in columns.items()]
    )
    chunk_order = Window.partitionBy(*group).orderBy(CHUNK)
    carried = ends.select(
        *group, CHUNK,
        *[F.lag(f"_e_{n}").over(chunk_order).alias(f"_c_{n}") for n in columns],
        (F.row_number().over(chunk_order) == 1).alias("_head"),
    )
    joined = out.join(carried, _same([*group, CHUNK], out, carried), "inner")
    keep = [out[c] for c in out.columns if c not in columns and c not in (CHUNK, "_first")]
    return joined.select(
        *keep,
        *[F.when(out["_first"], carried[f"_c_{n}"]).otherwise(out[n]).alias(n) for n in columns],
        (out["_first"] & carried["_head"]).alias("_first"),
    )
