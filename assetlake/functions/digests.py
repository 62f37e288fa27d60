"""Digests and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_digest(c: Column) -> Column:
    return c.rlike(r"\A[0-9a-f]{64}\z")


def hex32(c: Column) -> Column:
    return c.rlike(r"\A[0-9a-f]{32}\z")


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical_json(c: Column) -> Column:
    """Keys sorted at every level, arrays in order. For equality, not for bytes: numbers are rewritten."""
    return F.to_json(F.parse_json(c))


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the JSON form of the given columns (name them with ``alias``)."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def multiset_digest(row_digest: Column) -> Column:
    """Aggregate: one digest for a whole set of row digests, in any order.

    The eight 32-bit words of each row's SHA-256 are summed separately and the sums hashed again with
    the row count. It is a plain sum, so it is combined map-side and a group that holds a third of all
    rows costs no more than any other; an ordered concatenation would need the group in one task.
    Sums are decimals, exact for any number of rows that a table can hold. It finds differences that happen; it is
    no protection against somebody who makes rows for a given sum.
    """
    words = [
        F.sum(F.conv(F.substring(row_digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(8)
    ]
    return F.sha2(F.concat_ws(",", F.count(row_digest).cast("string"), *words), 256)
