"""Removal of repeated passages by suffix sorting with distributed prefix doubling.

A passage is a string of ``length`` (50) bytes. Whether two positions start the same one is decided by ranks of
growing prefixes: 16 bytes, then pairs of ranks 16 apart (32 bytes), then pairs of ranks 18 apart (50 bytes). After
each step positions whose rank is unique are dropped. What makes this affordable over all positions:

* Rank of 16: each position is represented by the smallest-ranked 16-byte string within its passage. Equal passages
  have equal representatives at equal distances, and neighbouring positions share theirs (about 18 do). Spark counts
  the representatives over all documents; positions whose representative stands in one document only are unique and
  drop out. That is nearly everything that does not repeat.
* Ranks of 32 and 50: the remaining positions are dealt out by their representative, as one row per run of positions
  that share it, with the bytes of their passages. All equal passages meet, and the ranks at the growing offsets lie
  in the row itself, so sorting pairs and reranking need no further shuffle.
* A representative of very many rows is dealt out salted, with the more salts the more rows it has. What no salt
  decides by itself, its first occurrences, goes on in rounds of Spark's own: as runs of positions that share the
  smallest 32-byte rank in their passages. Equal runs meet by their digests, one of each goes on; of these, runs whose
  32-byte rank no other document has are unique; the rest goes on as 50-byte ranks, whose smallest document is an
  aggregation with partial sums.

Whole texts that repeat are found by their digest first and take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.jaccard_join import filter_of, in_filter
from assetlake.llm.shingles import mixed, text_slices
from assetlake.session import materialize, materialize_counted

PREFIX, DOUBLE = 16, 32
#: Rows of one representative that a task takes, about; more are salted.
SALTED = 4_000
#: Passages looked at together, and rows ranked together.
SEGMENT, CHUNK = 1 << 21, 50_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 24) - 1)


def prefix_ranks(data: np.ndarray) -> np.ndarray:
    """A 64-bit rank for the 16 bytes at every position."""
    n = len(data) - 7
    if n <= 8:
        return np.zeros(0, np.uint64)
    words = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,))
    return mixed(words[:-8] * _A ^ mixed(words[8:] * _B))


def pair_ranks(ranks: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of the pairs (rank here, rank ``offset`` further)."""
    return mixed(ranks[: len(ranks) - offset] * _B + ranks[offset:])


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of passage starts that share a representative: (its rank, text number, first start, number)."""
    starts_of = np.maximum(bounds[1:] - bounds[:-1] - length + 1, 0)
    at = 0
    total = len(data) - length + 1
    while at < total:
        end = min(total, at + SEGMENT)
        part = data[at : end + length - 1]
        ranks = prefix_ranks(part)
        width = length - PREFIX + 1
        # The smallest in a sliding window, the leftmost of equal ones: the place is in the low bits.
        least = (ranks & ~_PLACE) | np.arange(len(ranks), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        least = least[: end - at]
        # Starts whose passage lies within one text.
        position = np.arange(at, end)
        text = np.searchsorted(bounds, position, "right") - 1
        inside = position - bounds[text] < starts_of[text]
        place = (least & _PLACE).astype(np.int64)
        place, text, position = place[inside], text[inside], position[inside]
        if len(place):
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (position[1:] != position[:-1] + 1)])
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(place)]]))
            yield ranks[place[first]].view(np.int64), text[first], position[first], count
        at = end


def _without(part: pa.RecordBatch, skipped) -> pa.RecordBatch:
    """Rows (row, doc, text) whose ``row`` is not in the filter."""
    if skipped is None or not part.num_rows:
        return part
    keep = ~in_filter(skipped.value, part.column(0).to_numpy(zero_copy_only=False))
    return part.filter(pa.array(keep))


def _representatives(length: int, skipped):
    """Over (row, doc, text): (g, doc) of all runs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            part = _without(part, skipped)
            docs = part.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in text_slices(part.column(2)):
                for g, text, _, _ in runs(data, bounds, length):
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(docs[lo:hi][text])], names=["g", "doc"])

    return run


def _passages(length: int, skipped, repeated, salted):
    """Over (row, doc, text): runs whose representative is in the filter, with the bytes of their passages.

    ``salt`` is -1, or by row and place for the representatives that are in filters of ``salted``: a number below two to the
    power of the filters that hold it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, levels = repeated.value, salted.value
        for part in parts:
            part = _without(part, skipped)
            rows = part.column(0).to_numpy(zero_copy_only=False)
            docs = part.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in text_slices(part.column(2)):
                for g, text, first, count in runs(data, bounds, length):
                    keep = in_filter(bits, g)
                    g, text, first, count = g[keep], text[keep], first[keep], count[keep]
                    if not len(g):
                        continue
                    size = count + length - 1
                    ends = np.cumsum(size)
                    at = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
                    row = rows[lo:hi][text]
                    salt = np.full(len(g), -1, np.int64)
                    hot = np.arange(len(g))
                    for level in levels:
                        hot = hot[in_filter(level, g[hot])]
                        salt[hot] = np.where(salt[hot] < 0, 1, 2 * salt[hot] + 1)
                    hot = np.flatnonzero(salt >= 0)
                    own = mixed(row[hot].view(np.uint64) + first[hot].astype(np.uint64) * _A)
                    salt[hot] = (own & salt[hot].view(np.uint64)).astype(np.int64)
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    passages = pa.Array.from_buffers(
                        pa.binary(), len(g), [None, offsets.buffers()[1], pa.py_buffer(data[at].tobytes())]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g), pa.array(salt), pa.array(row), pa.array(docs[lo:hi][text]),
                         pa.array(first - bounds[text]), passages],
                        names=["g", "salt", "row", "doc", "start", "bytes"],
                    )

    return run


def repeats(data, bounds, row_docs, open_rows, length: int):
    """Which passage starts repeat one of a document with a smaller number.

    ``data`` holds the rows' bytes end to end. Returns for all starts: index of the row, start within it, verdict,
    50-byte rank (two numbers), and whether the start must be compared with other tasks' (rows in ``open_rows``), then
    with the place and value of the smallest 32-byte rank in its passage.
    """
    counts = np.diff(bounds) - length + 1
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = bounds[row] + within
    r16 = prefix_ranks(data)
    r32 = pair_ranks(r16, DOUBLE - PREFIX)
    # Rerank pairs 16 apart; unique ones are done, except in rows that other tasks hold parts of.
    _, inverse, number = np.unique(r32[at], return_inverse=True, return_counts=True)
    left = np.flatnonzero((number[inverse] > 1) | open_rows[row])
    # Pairs of ranks up to the passage's length.
    second = length - DOUBLE
    keys = mixed(r32[at[left]] * _B + r32[at[left] + second])
    _, group, number = np.unique(keys, return_inverse=True, return_counts=True)
    docs = row_docs[row[left]]
    order = np.lexsort((docs, group))
    head = np.concatenate([[0], np.cumsum(number)[:-1]]).astype(np.int64)
    first = left[order[head]] if len(left) else left
    first_doc = row_docs[row[first]]
    gone = docs > first_doc[group] if len(left) else np.zeros(0, bool)
    # The bytes have the last word.
    hit = np.flatnonzero(gone)
    for lo in range(0, len(hit), 200_000):
        some = hit[lo : lo + 200_000]
        mine = at[left[some]][:, None] + np.arange(length)
        other = at[first[group[some]]][:, None] + np.arange(length)
        gone[some] = (data[mine] == data[other]).all(axis=1)
    verdict = np.zeros(len(row), bool)
    verdict[left] = gone
    undecided = left[~gone & open_rows[row[left]]]
    other_key = mixed(r32[at[undecided]] ^ (r32[at[undecided] + second] * _A))
    own_key = mixed(r32[at[undecided]] * _B + r32[at[undecided] + second])
    place = at[undecided]
    for lo in range(0, len(place), 200_000):
        some = place[lo : lo + 200_000]
        some += np.argmin(r32[some[:, None] + np.arange(second + 1)], axis=1)
    return row, within, verdict, undecided, place, r32[place].view(np.int64), own_key.view(np.int64), other_key.view(np.int64)


def run_digests(length: np.ndarray, first: np.ndarray, *keys: np.ndarray) -> Iterator[np.ndarray]:
    """One number per run and kind of key, from the run's keys in their order and its length."""
    place = mixed((np.arange(length.sum()) - np.repeat(first, length)).astype(np.uint64) + _A)
    for key in keys:
        total = np.add.reduceat(mixed(key.view(np.uint64) + place), first)
        yield mixed(total ^ length.astype(np.uint64) * _B).view(np.int64)


RANKED = "row long, doc long, lo long, hi long, g long, d1 long, d2 long, k1 array<long>, k2 array<long>"


def _rank(length: int):
    """Over rows sorted by (g, salt): ``row``, ``doc`` and byte range to remove, and runs of undecided starts with
    their smallest 32-byte rank ``g``, digest ``d1``, ``d2`` and the 50-byte ranks ``k1``, ``k2`` of each."""
    names = ["row", "doc", "lo", "hi", "g", "d1", "d2", "k1", "k2"]

    def ranked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        passages = pa.chunked_array(table.column("bytes")).combine_chunks()
        _, offsets, raw = passages.buffers()
        offsets = np.frombuffer(offsets, np.int32)[passages.offset : passages.offset + len(passages) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
        salt, rows, docs, starts = (table.column(c).to_numpy() for c in ("salt", "row", "doc", "start"))
        found = repeats(data, offsets - offsets[0], docs, salt >= 0, length)
        row, within, verdict, undecided, place, g, k1, k2 = found

        def ranges(some, change):
            ends = change | (row[some[1:]] != row[some[:-1]]) | (within[some[1:]] != within[some[:-1]] + 1)
            first = np.flatnonzero(np.concatenate([[True], ends]))
            size = np.diff(np.concatenate([first, [len(some)]]))
            at = row[some[first]]
            lo = starts[at] + within[some[first]]
            return first, size, [pa.array(rows[at]), pa.array(docs[at]), pa.array(lo), pa.array(lo + size - 1 + length)]

        gone = np.flatnonzero(verdict)
        if len(gone):
            first, _, columns = ranges(gone, False)
            blank, blanks = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, blank, blank, blank, blanks, blanks], names=names)
        if len(undecided):
            first, size, columns = ranges(undecided, place[1:] != place[:-1])
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            digests = [pa.array(d) for d in run_digests(size, first, k1, k2)]
            keys = [pa.ListArray.from_arrays(ends, pa.array(k)) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(g[first]), *digests, *keys], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for part in parts:
            # Representatives stay together: cut where the next one begins.
            if count >= CHUNK and part.num_rows:
                g, s = part.column(0).to_numpy(), part.column(1).to_numpy()
                before = held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()
                change = np.flatnonzero(np.concatenate([[(g[0], s[0]) != before], (g[1:] != g[:-1]) | (s[1:] != s[:-1])]))
                if len(change):
                    cut = int(change[0])
                    yield from ranked([*held, part.slice(0, cut)])
                    held, count, part = [], 0, part.slice(cut)
            if part.num_rows:
                held.append(part)
                count += part.num_rows
        if held:
            yield from ranked(held)

    return run


def _cut_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (doc_id, text, spans): the digest of what is left, and the kept text's bytes counted."""
    for part in parts:
        out: list[tuple] = []
        for raw, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
            kept, at, removed, found = [], 0, 0, 0
            for s in sorted(spans or [], key=lambda s: s["lo"]):
                lo, hi = s["lo"], s["hi"]
                if hi <= at:
                    continue
                if found and lo <= at:
                    lo = at
                else:
                    found += 1
                    kept.append(raw[at:lo])
                removed += hi - lo
                at = hi
            digest = hashlib.sha256(b"".join([*kept, raw[at:]])).hexdigest() if found else hashlib.sha256(raw).hexdigest()
            out.append((len(raw), removed, found, digest))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _across_salts(ranked: DataFrame, length: int) -> DataFrame:
    """``row``, ``doc``, ``lo``, ``hi`` of undecided starts that repeat one of another salt's documents."""
    runs_ = ranked.where("d1 IS NOT NULL")
    distinct = materialize(
        runs_.groupBy("d1", "d2").agg(
            F.min("doc").alias("_first"), F.max("doc").alias("_last"), *[F.any_value(c).alias(c) for c in ("g", "k1", "k2")]
        ), "open-runs",
    )
    whole = runs_.join(distinct.where("_first < _last").select("d1", "d2", "_first"), ["d1", "d2"]).where("doc > _first")
    met = distinct.groupBy("g").agg(F.min("_first").alias("_least"), F.max("_first").alias("_most")).where("_least < _most")
    starts = distinct.join(met.select("g"), "g", "left_semi")
    starts = starts.select("d1", "d2", "_first", F.posexplode(F.arrays_zip("k1", "k2")).alias("at", "key"))
    starts = starts.select("d1", "d2", "_first", "at", "key.k1", "key.k2")
    shared = starts.groupBy("k1", "k2").agg(F.min("_first").alias("_least"), F.max("_first").alias("_most"))
    late = starts.join(shared.where("_least < _most").drop("_most"), ["k1", "k2"]).where("_first > _least")
    # A run has as many starts as a passage has 16-byte strings, at most.
    late = late.groupBy("d1", "d2", "_first").agg(F.collect_set("at").alias("ats"))
    parts = runs_.join(late, ["d1", "d2"]).where("doc = _first").select("row", "doc", "lo", F.explode("ats").alias("at"))
    parts = parts.select("row", "doc", (F.col("lo") + F.col("at")).alias("lo"), (F.col("lo") + F.col("at") + length).alias("hi"))
    return whole.select("row", "doc", "lo", "hi").unionByName(parts)


def repeated_spans(rows: DataFrame, length: int = 50) -> DataFrame:
    """``row``, ``doc``, ``spans`` (array of ``lo``, ``hi`` byte ranges, in any order, that may overlap) of the rows
    (``row``, ``doc``, ``text``) with bytes to remove."""
    if length < DOUBLE + 2:
        raise ValueError(f"length must be {DOUBLE + 2} at least")
    spark = rows.sparkSession
    send = spark.sparkContext.broadcast
    digests = materialize(
        rows.select("row", "doc", F.octet_length("text").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("digest"))
        .where(F.col("n") >= length), "digests",
    )
    firsts = digests.groupBy("digest", "n").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last"))
    copies = digests.join(firsts.where("_first < _last"), ["digest", "n"]).where("doc > _first")
    copies, n_copies = materialize_counted(copies.select("row", "doc", "n"), "copies")
    skipped = send(filter_of(copies, "row", n_copies))

    # A filter has false hits: what it holds back without being a copy is put back.
    def held_back(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = in_filter(skipped.value, part.column(0).to_numpy(zero_copy_only=False))
            yield part.filter(pa.array(keep))

    schema = "row long, doc long, text string"
    back = rows.mapInArrow(held_back, schema).join(copies.select("row", "doc"), ["row", "doc"], "left_anti")
    back = materialize(back, "put-back")

    found = rows.mapInArrow(_representatives(length, skipped), "g long, doc long").unionByName(
        back.mapInArrow(_representatives(length, None), "g long, doc long")
    )
    found = found.groupBy("g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    found, n_found = materialize_counted(found.where("lo != hi").select("g", "n"), "repeated")
    repeated = send(filter_of(found, "g", n_found))
    # Those of over 4,000 rows, over 8,000 and so on, each a filter; false hits are salted and lose nothing.
    levels, bound, most = [], SALTED, found.agg(F.max("n")).first()[0] or 0
    while bound < most:
        hot = found.where(F.col("n") > bound)
        levels.append(filter_of(hot, "g", hot.count()))
        bound *= 2
    salted = send(levels)

    columns = "g long, salt long, row long, doc long, start long, bytes binary"
    passages = rows.mapInArrow(_passages(length, skipped, repeated, salted), columns).unionByName(
        back.mapInArrow(_passages(length, None, repeated, salted), columns)
    )
    dealt = passages.repartition("g", "salt").sortWithinPartitions("g", "salt")
    ranked = materialize(dealt.mapInArrow(_rank(length), RANKED), "ranked")
    spans = ranked.where("d1 IS NULL").select("row", "doc", "lo", "hi").unionByName(_across_salts(ranked, length))
    whole = copies.select("row", "doc", F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"))
    return spans.unionByName(whole).groupBy("row", "doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def with_rows(docs: DataFrame) -> DataFrame:
    """``row`` (a hash of id and text), ``doc`` (the id, or the largest number), ``doc_id``, ``text`` (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.xxhash64(doc_id, text).alias("row"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("doc"),
        doc_id.alias("doc_id"), text.alias("text"),
    )


def removal_report(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` after removing every
    byte of a passage that also starts in a document with a smaller id.

    Null and empty texts: nothing to remove. Rows without id come after all others and, like rows with the same id,
    remove nothing from each other. Empty table: no rows. Other columns are ignored.
    """
    rows = with_rows(docs)
    spans = materialize(repeated_spans(rows.select("row", "doc", "text"), length), "spans")
    joined = rows.join(spans.hint("shuffle_hash"), ["row", "doc"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
