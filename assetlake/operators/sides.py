"""Comparing two tables by key without a full outer join.

Both sides are tagged, stacked and aggregated by key. The partial aggregation runs before the shuffle,
so a key repeated in a third of all rows is reduced to one row per task first, and one shuffle replaces
the two of a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str] = (), extra: Mapping[str, str] | None = None
) -> DataFrame:
    """Per key: ``n_left``, ``n_right`` and ``l_<v>``, ``r_<v>`` for each value.

    Where a key occurs more than once on a side, the smallest value is shown and the count says so.
    ``extra`` names left-only columns to carry (``{new: column}``).
    """
    extra = dict(extra or {})

    def tag(df: DataFrame, is_left: bool) -> DataFrame:
        mine, other = ("l", "r") if is_left else ("r", "l")
        types = dict((f.name, f.dataType) for f in left.schema)
        return df.select(
            *keys,
            F.lit(int(is_left)).alias("n_left"),
            F.lit(int(not is_left)).alias("n_right"),
            *[F.col(v).cast(types[v]).alias(f"{mine}_{v}") for v in values],
            *[F.lit(None).cast(types[v]).alias(f"{other}_{v}") for v in values],
            *[(F.col(c) if is_left else F.lit(None).cast(types[c])).alias(n) for n, c in extra.items()],
        )

    both = tag(left, True).unionByName(tag(right, False))
    return both.groupBy(*keys).agg(
        F.sum("n_left").alias("n_left"),
        F.sum("n_right").alias("n_right"),
        *[F.min(f"{s}_{v}").alias(f"{s}_{v}") for v in values for s in ("l", "r")],
        *[F.min(n).alias(n) for n in extra],
    )
