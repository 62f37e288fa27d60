"""Exact Jaccard similarity join of word-shingle sets, as a metric-space join.

Jaccard distance is a metric, so with a radius r (0.2 for a similarity of 0.8) the triangle inequality bounds where
a neighbour can lie.

1. Which sets can have a neighbour at all: in a common order of shingles, two sets within r share at least l of
   their first |x| - ceil(0.8 |x|) + l shingles (l grows with the set: 1 + |x| // 40). Sets that share fewer with
   all others are done. The order puts frequent shingles (counted over all documents) last, so that a common passage
   brings nobody together.
2. Pivots: of the sets that share a shingle of their beginnings, the smallest is the pivot; the sets that meet at the
   same pivot are its region. A set leaves regions where it shares few shingles, as far as any two sets within r still
   meet in one.
3. Regions above ``leaf`` shingles are cut further: some members are sub-pivots, every member goes to the Voronoi
   cell of its nearest one, and also to each whose distance is within 2r of that, because only there a neighbour can
   be at home. This repeats; a region that cannot be cut (all within 2r) is dealt out as pairs of blocks.
4. A leaf is joined exactly: one member after another becomes pivot, its distances to the members that the triangle
   inequality leaves are computed, and members linked to the same pivot are not compared with each other. A leaf
   returns a spanning forest of its links, never all pairs.

Equal sets are one point throughout. Links give components, found by joins over the forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlake.llm.columns import fresh
from assetlake.llm.shingles import mixed, sets_of, text_slices
from assetlake.session import materialize, materialize_counted

#: At most this many shingles are told to every task as frequent (8 bytes each); the bound of the counts follows.
FREQUENT = 100_000
#: Bits of a filter that is sent to every task, at most (16 MB). A full filter lets more rows through, never fewer.
FILTER_BITS = 1 << 27
#: Shingles in a leaf, and members.
LEAF, MEMBERS = 2_000_000, 5_000
SUB_PIVOTS = 12


def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def beginning(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + 1 + n // 40)


def least_shared(n: int, percent: int) -> int:
    return 1 + needed(n, percent) // 40


def ordered(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set in the common order: frequent shingles after all others."""
    if not len(frequent) or not len(found):
        return found
    late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
    return np.concatenate([found[~late], found[late]])


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64, copy=False).view(np.uint64)
    size = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(v), bool)
    for at in (v & size, (v >> np.uint64(32)) & size):
        word = bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        out &= (word >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def filter_of(values: DataFrame, column: str, count: int) -> np.ndarray:
    """A Bloom filter with two bits per value; its size is bounded by :data:`FILTER_BITS`."""
    size = min(FILTER_BITS, 1 << max(10, (16 * count - 1).bit_length()))
    v = F.col(column)
    places = F.array(v.bitwiseAND(size - 1), F.shiftrightunsigned(v, 32).bitwiseAND(size - 1))
    at = values.select(F.explode(places).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _beginnings(percent: int, width: int, frequent, wanted=None):
    """Over (doc_id, text). Without ``wanted``: (h, s) of all beginnings, s the set's id. With a filter: only
    shingles in it, and per document a row (doc_id, n, s) without h."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        bits = wanted.value if wanted is not None else None
        for part in parts:
            for lo, hi, data, bounds in text_slices(part.column(1)):
                sets = sets_of(data, bounds, width)
                ids = [set_id(x) if len(x) else None for x in sets]
                heads = [ordered(x, late)[: beginning(len(x), percent)] for x in sets]
                sizes = [len(x) for x in sets]
                own = np.array([i or 0 for i in ids], np.int64)
                if bits is None:
                    h = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                    s = np.repeat(own, [len(x) for x in heads])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s)], names=["h", "s"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                     pa.nulls(hi - lo, pa.int64())], names=["doc_id", "n", "s", "h"],
                )
                h = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                counts = [len(x) for x in heads]
                keep = in_filter(bits, h)
                h, s, n = h[keep], np.repeat(own, counts)[keep], np.repeat(np.array(sizes, np.int64), counts)[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(h), pa.int64()), pa.array(n), pa.array(s), pa.array(h)],
                    names=["doc_id", "n", "s", "h"],
                )

    return run


def _whole_sets(width: int, wanted):
    """Over (doc_id, text): (s, shingles) of the sets whose id is in the filter, once per batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for part in parts:
            for _, _, data, bounds in text_slices(part.column(1)):
                sets = [x for x in sets_of(data, bounds, width) if len(x)]
                by_id = {set_id(x): x for x in sets}
                ids = np.array(list(by_id), np.int64)
                keep = in_filter(bits, ids) if len(ids) else np.zeros(0, bool)
                chosen = [by_id[i].tobytes() for i in ids[keep].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep]), pa.array(chosen, pa.binary())], names=["s", "shingles"]
                )

    return run


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def forest(ids: list[int], sets: list[np.ndarray], percent: int, blocks: np.ndarray | None = None):
    """Spanning forest of the links among the members (between different blocks only, where these are given)."""
    n = len(ids)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edges: list[tuple[int, int]] = []
    reach = 1 - percent / 100 + 1e-9
    bound = None  # distances to the first pivot
    linked = np.zeros(n, bool)
    done = np.zeros(n, bool)
    for p in np.argsort(-sizes, kind="stable").tolist():
        if bound is not None and linked[p] and blocks is None and not np.any(~linked & ~done):
            done[p] = True
            continue
        lo, hi = np.searchsorted(flat, sets[p], "left"), np.searchsorted(flat, sets[p], "right")
        spans = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        shared = np.bincount(owner[at], minlength=n)
        union = sizes + sizes[p] - shared
        near = 100 * shared >= percent * union
        near[p] = False
        if bound is None:
            bound = 1 - shared / union
            linked = near.copy()
            linked[p] = True
        else:
            # Beyond this the triangle inequality rules a link out; and two links of one pivot need no third.
            near &= np.abs(bound - bound[p]) <= reach
            if linked[p] and blocks is None:
                near &= ~linked
        if blocks is not None:
            near &= blocks != blocks[p]
        for q in np.flatnonzero(near & ~done).tolist():
            a, b = find(p), find(q)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((ids[p], ids[q]))
        done[p] = True
    return edges


def _join_leaf(percent: int):
    def run(_, table):
        ids = table.column("s").to_pylist()
        sets = [np.frombuffer(x, np.int64) for x in table.column("shingles").to_pylist()]
        edges = forest(ids, sets, percent)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return run


def _cells(percent: int):
    """Over (region, s, n, shingles, pivots): one row per cell that a member belongs to."""
    reach = 2 * (1 - percent / 100) + 1e-9

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for region, s, n, raw, pivots in zip(*(c.to_pylist() for c in part.columns), strict=True):
                own, d = np.frombuffer(raw, np.int64), []
                for p in pivots:
                    other = np.frombuffer(p["shingles"], np.int64)
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    d.append(1 - shared / (len(own) + len(other) - shared))
                near = min(d)
                for p, x in zip(pivots, d, strict=True):
                    if x <= near + reach:
                        cell = int(mixed(np.array([region ^ p["s"]], np.int64).view(np.uint64)).view(np.int64)[0])
                        out.append((region, cell, s, n, raw))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["parent", "region", "s", "n", "shingles"]
            )

    return run


def _split(rows: DataFrame, leaf: int, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of the regions that fit into a leaf, the others' (with ``_m`` members and ``_n`` shingles), and the number
    of the others. ``rows`` is stored."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("_m"), F.sum("n").alias("_n"))
    large = (F.col("_n") > leaf) | (F.col("_m") > most)
    sizes, left = materialize_counted(sizes.where("_m > 1"), "region-sizes", large)
    small = rows.join(sizes.where(~large).select("region"), "region", "left_semi")
    return small, rows.join(sizes.where(large), "region"), left


def join_regions(regions: DataFrame, sets: DataFrame, percent: int, leaf: int = LEAF, most: int = MEMBERS) -> DataFrame:
    """Links (``a``, ``b``) that span each region's components, from stored (``region``, ``s``, ``n``) and
    (``s``, ``shingles``). Whole sets are attached to the members of a leaf only."""
    columns, link = ["region", "s", "n", "shingles"], "a long, b long"

    def joined(members: DataFrame) -> DataFrame:
        return materialize(members.groupBy("region").applyInArrow(_join_leaf(percent), link), "leaf-links")

    small, large, left = _split(regions, leaf, most)
    found = [joined(small.join(sets, "s").select(*columns))]
    if left:
        rows, rounds = materialize(large.select("region", "s", "n").join(sets, "s").select(*columns), "large-regions"), 0
        while True:
            small, large, left = _split(rows, leaf, most)
            if rounds:
                found.append(joined(small))
            if not left:
                break
            # Sub-pivots: the members with the smallest seeded hashes, a bounded number per region.
            seeded = F.struct(F.xxhash64(F.lit(rounds), "s").alias("at"), "s", "shingles")
            slot = F.pmod(F.xxhash64(F.lit(-1), "s"), F.lit(SUB_PIVOTS)).alias("k")
            pivots = large.groupBy("region", slot).agg(F.min(seeded).alias("p"))
            pivots = pivots.groupBy("region").agg(F.collect_list(F.struct("p.s", "p.shingles")).alias("pivots"))
            cells = large.select(*columns).join(pivots, "region").select(*columns, "pivots")
            cells = materialize(
                cells.mapInArrow(_cells(percent), "parent long, region long, s long, n long, shingles binary"), "cells"
            )
            # A cut that leaves a cell with most of the region does not pay; its members go to block pairs.
            whole = large.groupBy("region").agg(F.first("_m").alias("_m")).withColumnRenamed("region", "parent")
            worst = cells.groupBy("parent", "region").count().groupBy("parent").agg(
                F.max("count").alias("_w"), F.sum("count").alias("_c")
            )
            no_parts = (5 * F.col("_w") > 4 * F.col("_m")) | (F.col("_c") > 3 * F.col("_m"))
            stuck = whole.join(worst, "parent").where(no_parts)
            stuck = materialize(stuck.select(F.col("parent").alias("region")), "stuck-regions")
            found.append(_block_pairs(large.join(stuck, "region", "left_semi"), percent, leaf, most))
            rows = cells.join(stuck.withColumnRenamed("region", "parent"), "parent", "left_anti").select(*columns)
            rows, rounds = materialize(rows, "regions"), rounds + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block_pairs(large: DataFrame, percent: int, leaf: int, most: int) -> DataFrame:
    """Regions that have no parts: members are dealt into blocks of half a leaf, and every two blocks are joined."""
    blocks = F.greatest(
        F.ceil(2 * F.col("_n") / F.lit(leaf)), F.ceil(2 * F.col("_m") / F.lit(most)), F.lit(1)
    ).cast("long")
    dealt = large.withColumn("_k", blocks).withColumn("_b", F.pmod(F.xxhash64("s"), F.col("_k")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_k") - 1),
        lambda o: F.struct(F.least(o, F.col("_b")).alias("i"), F.greatest(o, F.col("_b")).alias("j")),
    )
    rows = dealt.select("region", "s", "shingles", F.explode(pairs).alias("_p"))
    rows = rows.select("region", "_p.i", "_p.j", "s", "shingles")
    links = rows.groupBy("region", "i", "j").applyInArrow(_join_leaf(percent), "a long, b long")
    return materialize(links, "block-links")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of all nodes that have a link, by joins: labels spread to
    neighbours and along labels until none changes."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    both = materialize(both.distinct(), "both-ways")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))
    labels = materialize(labels, "labels")
    while True:
        spread = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("_seen"))
        step = labels.join(spread, "node").select(
            "node", F.least("component", "_seen").alias("component"), F.col("component").alias("_was")
        )
        step = materialize(step, "spread-labels")
        jump = step.select(F.col("node").alias("_at"), F.col("component").alias("_far"))
        new = step.join(jump, step["component"] == jump["_at"], "left").select(
            "node", F.least("component", F.coalesce("_far", "component")).alias("component"), "_was"
        )
        new, changed = materialize_counted(new, "labels", F.col("component") != F.col("_was"))
        labels = new.select("node", "component")
        if not changed:
            return labels


def link_documents(docs: DataFrame, percent: int = 80, width: int = 5, leaf: int = LEAF, most: int = MEMBERS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    reachable by links, its own included).

    Null, empty and wordless texts have an empty set and are linked with nothing. Repeated rows and copies are
    linked by having the same set; rows without id get the smallest id of their component, or null. Empty table: no
    rows. Other columns are ignored. Sets are compared by 64-bit hashes of shingles.
    """
    spark: SparkSession = docs.sparkSession
    send = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Frequent shingles, from the beginnings of all documents in plain order.
    first = rows.mapInArrow(_beginnings(percent, width, send(np.zeros(0, np.int64))), "h long, s long")
    counts, _ = materialize_counted(first.groupBy("h").count().where("count > 100"), "shingle-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.where(F.col("count") > total // FREQUENT).select("h").toArrow().column("h").to_numpy()
    frequent = send(np.sort(often))
    # Shingles of beginnings that two different sets share.
    lists = rows.mapInArrow(_beginnings(percent, width, frequent), "h long, s long")
    lists = lists.groupBy("h").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo != hi").select("h")
    lists, n_lists = materialize_counted(lists, "shared-shingles")
    wanted = send(filter_of(lists, "h", n_lists))
    third = rows.mapInArrow(_beginnings(percent, width, frequent, wanted), "doc_id long, n long, s long, h long")
    third = materialize(third, "beginnings")
    meta = third.where("h IS NULL").select("doc_id", "n", "s")
    shared = third.where("h IS NOT NULL").select("h", "s", "n").distinct().join(lists, "h")
    shared = materialize(shared, "shared")
    hundred, forty = F.lit(100).cast("long"), F.lit(40).cast("long")
    must = 1 + F.call_function("div", F.call_function("div", F.col("n") * percent + 99, hundred), forty)
    alive = shared.groupBy("s", "n").count().where(F.col("count") >= must).select("s")
    alive, n_alive = materialize_counted(alive, "possible-sets")
    met = materialize(shared.join(alive, "s", "left_semi"), "met")
    pivots = met.groupBy("h").agg(F.min("s").alias("region"), F.max("s").alias("_hi")).where("region != _hi")
    regions = met.join(pivots.select("h", "region"), "h").groupBy("region", "s", "n").count()
    # A set leaves the regions it meets by the fewest shingles, less than half of what it must share with a neighbour
    # in all. As a neighbour does the same, at least one of their common shingles keeps them in one region.
    fewest = Window.partitionBy("s").orderBy("count", "region").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spare = F.call_function("div", must - 1, F.lit(2).cast("long"))
    regions = regions.withColumn("_left", F.sum("count").over(fewest)).where(F.col("_left") > spare)
    regions = materialize(regions.select("region", "s", "n"), "regions")
    sets = rows.mapInArrow(_whole_sets(width, send(filter_of(alive, "s", n_alive))), "s long, shingles binary")
    sets = sets.groupBy("s").agg(F.first("shingles").alias("shingles"))
    links = join_regions(regions, sets, percent, leaf, most)
    labels = components(links)
    # The smallest id of each set, then of each component.
    known = meta.where("s IS NOT NULL")
    of_set = known.groupBy("s").agg(F.min("doc_id").alias("doc"))
    of_set = of_set.join(labels, of_set["s"] == labels["node"], "left").select(
        "s", "doc", F.coalesce("component", "s").alias("component")
    )
    of_set = materialize(of_set, "sets")
    smallest = of_set.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_set = of_set.join(smallest, "component").select("s", "component_id")
    linked = known.join(of_set, "s").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = meta.where("s IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the one with the smallest id stays, of several
    rows with that id one. Rows without words are alone; of such rows with the same id and text one stays. All
    columns are kept."""
    row = fresh(docs.columns, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    ids = keyed.select(F.col(row).alias("doc_id"), "text")
    # Every row is known by its hash here, so that rows without an id, or with the same one, are told apart.
    parts = link_documents(ids, percent, width).select("doc_id", "component_id").distinct()
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("doc_id"))
    known = keyed.select(F.col(row).alias("doc_id"), F.col("doc_id").cast("long").alias("_id")).distinct()
    best = parts.join(known, "doc_id").groupBy("component_id").agg(F.min(order).alias("_best"))
    best = materialize(best.select(F.col("_best.doc_id").alias(row)), "kept-rows")
    kept = keyed.join(best.hint("shuffle_hash"), row, "left_semi").dropDuplicates([row])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
