"""File-name rules used by the readable layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions.binding import let
from assetlake.functions.paths import ascii_lower

MAX_STEM = 220
CUT_MARK = "__truncated"
# Characters a published name may not contain.
UNSAFE = '<>:"/\\|?*#%'
_TRIM = r"(?U)\A\s+|\s+\z"


def compress_clones(c: Column) -> Column:
    """Two or more trailing ``(Clone)`` marks become ``__cloneN``."""
    tail = F.length(F.regexp_extract(c, r"((?:\(Clone\))*)\z", 1))
    head = F.substring(c, F.lit(1), F.length(c) - tail)
    return F.when(
        c.endswith("(Clone)(Clone)"),
        F.concat(F.regexp_replace(head, r"(?U)\s+\z", ""), F.lit("__clone"), (tail / 7).cast("int").cast("string")),
    ).otherwise(c)


def fix_file_name(c: Column) -> Column:
    safe = F.regexp_replace(F.translate(c, UNSAFE, "_" * len(UNSAFE)), r"\p{Cc}", "_")
    return let(
        let(F.regexp_replace(safe, _TRIM, ""), compress_clones),
        lambda s: F.when(F.length(s) <= MAX_STEM, s).otherwise(
            F.concat(F.substring(s, 1, MAX_STEM - len(CUT_MARK)), F.lit(CUT_MARK))
        ),
    )


def loose(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[_\-\s]", ""))


def snake_case(c: Column) -> Column:
    return ascii_lower(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


_LAST_DOT = r"(?s)\A(.+)\.([^.]*)\z"


def split_ext(c: Column) -> tuple[Column, Column]:
    """Stem and extension at the last dot; a leading dot is not an extension."""
    has = c.rlike(_LAST_DOT)
    return (
        F.when(has, F.regexp_extract(c, _LAST_DOT, 1)).otherwise(c),
        F.when(has, F.regexp_extract(c, _LAST_DOT, 2)).otherwise(F.lit("")),
    )


def join_ext(stem: Column, ext: Column) -> Column:
    return F.when(ext == "", stem).otherwise(F.concat(stem, F.lit("."), ext))


def with_extension(file: Column, ext: Column) -> Column:
    return join_ext(split_ext(file)[0], ext)


def container_key(parts: Column, file: Column) -> Column:
    return F.lower(F.array_join(F.concat(parts, F.array(file)), "/"))
