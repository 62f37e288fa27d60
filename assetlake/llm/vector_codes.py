"""Vectors as short codes: one codebook per part of a vector, trained and applied in exact integers.

Nearest entries are found by matrix products. A float64 product is exact only while its sums stay below 2**53, so
integers are broken into limbs of a base at which they do: each pair of limbs is one matrix product, and the products
are put together again as 64-bit integers (or, where a vector's numbers are too large for these, as Python's). Nothing
is ever rounded, so results depend neither on the machine nor on how rows are dealt out, and ties go to the lower index.

Training passes keep sums per task, one row per codebook component; only those and the codebooks themselves, whose size
is fixed by the number of parts, entries and dimensions, meet in one place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances to all entries of a codebook are held at once.
BLOCK = 4_096
#: Bits of a limb in sums: as many rows as one table can have stay far below 2**63.
SUM_BITS = 24
MOST = (1 << 63) - 1


def limb_bits(width: int) -> int:
    """Bits of a limb with which a dot product over ``width`` components stays below 2**53."""
    return (53 - max(width, 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Low to high, each in [0, 2**bits) but the signed last one; together x."""
    out = []
    while True:
        if not x.size or (-(1 << bits) < x.min() and x.max() < (1 << bits)):
            return [*out, x]
        out.append(x & ((1 << bits) - 1))
        x = x >> bits


def _integer(x: float) -> int:
    # Beyond 2**53 a double is an integer itself, and its product might be infinite.
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x): int64, or Python integers where these do not suffice."""
    if not values.size or np.abs(values).max() < 2.0**53:
        return np.floor(values * float(SCALE)).astype(np.int64)
    return np.frompyfunc(_integer, 1, 1)(values)


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of the rows of ``x`` with those of ``c``, in the integers' own type."""
    bits = limb_bits(x.shape[1])
    wide = object if object in (x.dtype, c.dtype) else np.int64
    out = np.zeros((len(x), len(c)), wide)
    right = [r.astype(np.float64) for r in limbs(c, bits)]
    for i, a in enumerate(limbs(x, bits)):
        a = a.astype(np.float64)
        for j, b in enumerate(right):
            product = (a @ b.T).astype(np.int64)
            out += product.astype(object) << (bits * (i + j)) if wide is object else product << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the first entry of ``c`` at the least squared distance, and that distance."""
    largest = max([int(abs(v)) for y in (x, c) if y.size for v in (y.min(), y.max())], default=0)
    # A squared distance, and each of its terms, fits into 62 bits below this bound.
    if 4 * x.shape[1] * largest * largest >= 1 << 62:
        x, c = x.astype(object), c.astype(object)
    squares = (c * c).sum(axis=1)
    far = squares[None, :] - 2 * dots(x, c)
    at = np.argmin(far, axis=1) if len(x) else np.zeros(0, np.int64)
    return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)


def kept_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``embedding`` (doubles) and ``label`` of the vectors without null and non-finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").where(x.isNotNull() & finite)
    return rows.withColumn("embedding", x.cast("array<double>"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers; missing ones at the end are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def blocks(column: pa.Array, width: int, parts: int) -> Iterator[list[np.ndarray]]:
    """The parts of up to :data:`BLOCK` vectors at a time, as integers."""
    step = width // parts
    for at in range(0, len(column), BLOCK):
        x = integers(matrix(column.slice(at, BLOCK), width))
        yield [x[:, k * step : (k + 1) * step] for k in range(parts)]


def _train(books: list[np.ndarray], width: int):
    """Over (embedding): per part, entry and position the sums of the limbs of what is nearest, and the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts = np.zeros((len(books), max(len(b) for b in books)), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), width, len(books)):
                for part, (x, book) in enumerate(zip(block, books, strict=True)):
                    at, _ = nearest(x, book)
                    counts[part] += np.bincount(at, minlength=counts.shape[1])
                    chosen = (at[:, None] == np.arange(len(book))).astype(np.float64)
                    for n, limb in enumerate(limbs(x, SUM_BITS)):
                        total = (chosen.T @ limb.astype(np.float64)).astype(np.int64)
                        sums[part, n] = sums.get((part, n), 0) + total
        rows = [
            (part, entry, position, n, int(total[entry, position]))
            for (part, n), total in sums.items()
            for entry, position in zip(*np.nonzero(total), strict=True)
        ]
        rows += [(part, entry, -1, 0, int(counts[part, entry])) for part, entry in zip(*np.nonzero(counts), strict=True)]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "limb", "total"])

    return run


def _apply(books: list[np.ndarray], width: int):
    """Over (embedding, vec_id, label): these rows' codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for block in blocks(batch.column(0), width, len(books)):
                found = [nearest(x, book) for x, book in zip(block, books, strict=True)]
                code = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                codes += [row.tobytes().hex() for row in code]
                wide = any(d.dtype == object or d.max(initial=0) >= MOST // len(books) for _, d in found)
                errors += [min(int(e), MOST) for e in sum(d.astype(object) if wide else d for _, d in found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def next_books(books: list[np.ndarray], totals: list) -> list[np.ndarray]:
    """Entries become the floor of the mean of their parts; those without parts stay."""
    sums: dict[tuple[int, int, int], int] = {}
    for part, entry, position, limb, total in totals:
        sums[part, entry, position] = sums.get((part, entry, position), 0) + (total << (SUM_BITS * limb))
    out = []
    for part, book in enumerate(books):
        new = book.astype(object)
        for entry in range(len(book)):
            if n := sums.get((part, entry, -1), 0):
                new[entry] = [sums.get((part, entry, k), 0) // n for k in range(book.shape[1])]
        small = all(abs(v) < 1 << 62 for v in new.flat)
        out.append(new.astype(np.int64) if small else new)
    return out


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = rows.orderBy(*order).limit(entries).select("embedding").toArrow().column(0).combine_chunks()
    x = integers(matrix(first, width))
    step = width // parts
    return [x[:, k * step : (k + 1) * step] for k in range(parts)]


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.flat).encode()).hexdigest()


def _capped(total: Column) -> Column:
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row of ``vectors`` (``vec_id``, ``embedding``, ``label``): ``vec_id``, ``code``, ``error``,
    ``label_error`` and ``codebooks_sha256``.

    Rows whose vector is null, or has a null or non-finite component, are dropped. A vector shorter than the longest
    (made a multiple of ``parts``) counts as filled up with zeros. The first codebooks are the vectors with the smallest
    ids, of rows with the same id those with the smaller vectors as given, rows without id last; with fewer than ``entries`` rows
    there are fewer entries. Repeated rows count each. Rows without label are one label. An error beyond a long is the
    largest long. Empty table, or none kept: no rows. Other columns are ignored. ``entries`` is at most 256.
    """
    rows = kept_rows(vectors)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = first_books(rows, width, parts, entries)
    if not len(books[0]):
        books = [np.zeros((1, width // parts), np.int64)] * parts
    for _ in range(rounds):
        found = rows.select("embedding").mapInArrow(
            _train(books, width), "part long, entry long, position long, limb long, total long"
        )
        totals = found.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total"))
        books = next_books(books, [tuple(r) for r in totals.collect()])
    label = vectors.schema["label"].dataType.simpleString()
    coded = rows.select("embedding", "vec_id", "label").mapInArrow(
        _apply(books, width), f"vec_id long, label {label}, code string, error long"
    )
    coded = materialize(coded, "codes")
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = by_label.select(F.col("label").alias("of"), _capped(F.col("total")).alias("label_error"))
    out = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
