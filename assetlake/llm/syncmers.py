"""Document fingerprints from closed syncmers.

A text's k-mers are those of its UTF-8 bytes. A k-mer is a closed syncmer if the smallest of its s-mers (by hash)
stands at its first or last place, so whether it is chosen depends on its own bytes only: equal passages have equal
anchors wherever they stand. A fingerprint holds the text's length and the ``size`` distinct anchors with the smallest
hashes, each with the byte at which it first occurs. Likeness is the estimated share of common anchors (the smallest
hashes of both together), counted only for anchors whose places fit the same shift of position, in bytes: lengths may
differ as they like.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, S, SIZE = 16, 8, 64
#: Hexadecimal digits of a length or place in bytes; a text is one value, so below 2 GiB.
PLACE = 8
#: Per anchor: 12 hexadecimal digits of hash, then its place.
PART = 12 + PLACE
#: Anchors count together if their shifts of place differ by at most this share of the longer text.
DRIFT = 0.08

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return (x ^ (x >> np.uint64(29))) * _MIX


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    """One hash per start, of the ``width`` bytes from there; width a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < width:
        h = _mixed(h[:-step] * _MIX + h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def _whole(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return np.array([whole], np.uint64), np.zeros(1, np.int64)


def anchors(raw: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the closed syncmers; of a text without any (all are shorter than 2 * ``k`` - ``s`` - 1
    bytes), the whole text at 0."""
    if len(raw) < k:
        return _whole(raw)
    data = np.frombuffer(raw, np.uint8)
    inner = _grams(data, s)
    n, w = len(raw) - k + 1, k - s + 1
    least, reach = inner, 1
    while reach * 2 <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < w:
        least = np.minimum(least[:n], least[w - reach : w - reach + n])
    starts = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : w - 1 + n] == least))
    if not len(starts):
        return _whole(raw)
    # A k-mer's hash from those of its two halves.
    return _mixed(inner[starts] * _MIX + inner[starts + k - s]), starts


def fingerprint(text: str, size: int = SIZE) -> str:
    """Hexadecimal; empty for an empty text. Equal texts have equal fingerprints."""
    raw = text.encode()
    if not raw:
        return ""
    hashes, starts = anchors(raw)
    values = hashes >> np.uint64(16)
    if len(values) > 4 * size:
        # Enough of the smallest that every distinct one among the first ``size`` is in: checked below.
        for some in (4 * size, len(values)):
            part = np.partition(values, some - 1)[:some] if some < len(values) else values
            if len(np.unique(part)) >= size or some == len(values):
                break
        bound = np.unique(part)[:size][-1]
        near = values <= bound
        values, starts = values[near], starts[near]
    distinct, first = np.unique(values, return_index=True)
    places = starts[first][:size]
    parts = (f"{v:012x}{p:0{PLACE}x}" for v, p in zip(distinct[:size].tolist(), places.tolist(), strict=True))
    return f"{len(raw):0{PLACE}x}" + "".join(parts)


def _read(fp: str) -> tuple[int, dict[int, int]]:
    """Length and anchors."""
    places = {int(fp[i : i + 12], 16): int(fp[i + 12 : i + PART], 16) for i in range(PLACE, len(fp), PART)}
    return int(fp[:PLACE], 16), places


def likeness(a: str, b: str, size: int = SIZE, drift: float = DRIFT) -> float:
    """0 to 1. Two empty fingerprints: 1; one empty: 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (n, x), (m, y) = _read(a), _read(b)
    smallest = sorted(x.keys() | y.keys())[:size]
    shifts = sorted(x[h] - y[h] for h in smallest if h in x and h in y)
    best = lo = 0
    for hi, shift in enumerate(shifts):
        while shift - shifts[lo] > drift * max(n, m):
            lo += 1
        best = max(best, hi - lo + 1)
    return best / len(smallest)


def _bounds(spark: SparkSession, ids: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending ids that cut the table into ranges of about equal size."""
    found = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(found or []))


def with_next(docs: DataFrame) -> DataFrame:
    """``part``, ``doc_id``, ``text``, ``borrowed``: ranges of ids, each with the row that follows its last one.

    The next row of a document is the one with the next smaller id; after the last comes the first. Rows without
    an id come after all others; rows with the same id follow each other in the order of their texts. One shuffle
    moves the texts; the largest id of each range is copied to the range above it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _bounds(spark, rows.select("doc_id"), parts)
    # The number of a row's range, counted from the largest ids; null ids last.
    above = F.lit(len(cuts))
    if cuts:
        above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("doc_id") < c))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above)
    rows = rows.withColumn("part", part.cast("int"))
    # One row per range.
    tops = sorted((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return rows.withColumn("borrowed", F.lit(False))
    # Range i ends with the first row of the range after it; the last range with the first row of all.
    goes_to = {tops[(i + 1) % len(tops)][0]: tops[i][0] for i in range(len(tops))}
    top = F.element_at(F.create_map(*[F.lit(x) for p, t in tops for x in (p, t)]).cast("map<int,bigint>"), F.col("part"))
    target = F.element_at(F.create_map(*[F.lit(x) for p, t in goes_to.items() for x in (p, t)]), F.col("part"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("borrowed"))
    lent = F.struct(target.alias("part"), F.lit(True).alias("borrowed"))
    copies = F.when(F.col("doc_id").eqNullSafe(top), F.array(own, lent)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", F.explode(copies).alias("_c"))
    dealt = dealt.select(F.col("_c.part").alias("part"), F.col("_c.borrowed").alias("borrowed"), "doc_id", "text")
    return dealt.repartition(parts, "part").sortWithinPartitions(
        "part", "borrowed", F.col("doc_id").desc_nulls_last(), "text"
    )


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over sorted ranges. Holds one row back until the next one of its range is known; of the
    borrowed rows only the first is the next row."""
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple[int, int, str, str] | None = None  # part, doc_id, text, fingerprint
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in parts:
        for part, borrowed, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None and borrowed:
                continue
            own = fingerprint(text)
            if held is not None:
                _, before, whole, fp = held
                n = len(whole)
                third = n // 3
                edited = whole[: n - third] + text[:third]
                changed = own if edited == text else fp if edited == whole else fingerprint(edited)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                rows.append((before, n, digest, fp, changed, likeness(fp, changed), likeness(fp, own)))
                if len(rows) >= 1000:
                    yield made()
            held = None if borrowed else (part, doc, text, own)
    if rows:
        yield made()


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and likenesses to it and to the next row.

    Edited: the last third of the characters (rounded down) is replaced by as many of the next row's first ones,
    or all it has. Null or empty text: an empty fingerprint; two of them are alike (1), one and another not (0).
    A single row is its own next row. Empty table: no rows. Other columns are ignored.
    """
    return with_next(docs).select("part", "borrowed", "doc_id", "text").mapInArrow(_compare, OUT)
