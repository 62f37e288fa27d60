"""Checks return rows ``(run, code, key, detail)``; nothing is dropped silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["run", "code", "key", "detail"]


class ViolationError(ValueError):
    """Raised by :func:`require_none`; carries a few of the offending rows."""


def violation(df: DataFrame, code: str | Column, key: Column, detail: Column | None = None) -> DataFrame:
    """Shape already-filtered offending rows."""
    code = F.lit(code) if isinstance(code, str) else code
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select("run", code.alias("code"), key.cast("string").alias("key"), detail.alias("detail"))


def rule_violations(df: DataFrame, key: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """One row per failed rule. ``rules`` maps a code to the condition that must hold; unknown fails.

    All rules are evaluated in one pass over ``df``.
    """
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]),
        lambda c: c.isNotNull(),
    )
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(
        "run", F.explode(failed).alias("code"), key.cast("string").alias("key"), detail.alias("detail")
    )


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def require_none(violations: DataFrame) -> None:
    """Raise if any violation exists; reads at most a handful of rows."""
    rows = violations.limit(5).collect()
    if rows:
        raise ViolationError("; ".join(f"{r.run}:{r.code}:{r.key}" for r in rows))
