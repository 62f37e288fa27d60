"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions.binding import let

__all__ = ["WORD_BREAKS", "fresh", "let", "same", "words"]

#: The white space that separates words here: tab to carriage return, and the space itself.
WORD_BREAKS = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of anything but the six separators, in order. Null: no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_BREAKS, " " * len(WORD_BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column in ``taken`` is called so."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def same(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Null-safe equality of all pairs."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out
