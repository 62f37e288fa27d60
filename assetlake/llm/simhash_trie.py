"""Near copies by 64-bit fingerprints: a binary trie of the fingerprints is joined with itself.

Pairs of trie nodes are walked together from the root. A step down appends one bit to each node; where the bits differ,
the pair has used up one more of the differing bits allowed, and a pair beyond its budget is dropped with all that lies
below it. Two fingerprints that differ in few bits differ in no more than half as many in one of their halves, so the
trie is walked twice, each half leading once, with half the budget (rounded down) until that half is through; pairs
then die early and few nodes meet.

Spark walks the upper levels, a table of node pairs with their sizes per round; pairs that have become small enough are
dealt to tasks, which walk on over sorted arrays. A task returns a spanning forest of its links, and node pairs whose
members it knows to be linked already are left out, so a dense group costs no more rows than it has fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.llm.jaccard_join import components
from assetlake.session import materialize, materialize_counted

SEED, WIDTH, DISTANCE = 42, 3, 3
#: Fingerprints of a node pair that one task takes.
LEAF = 10_000
#: Bits that the walk over tables goes down a round, first and then.
FIRST_STEP, STEP = 8, 4
#: Node pairs, and pairs of fingerprints, that a task holds at once.
CHUNK = 200_000
#: Node pairs with so few pairs of fingerprints are compared outright.
OUTRIGHT = 32
#: Bytes of a text that are cut into words at once, and shingle hashes whose bits are counted at once.
SEGMENT, HASHES = 1 << 20, 1 << 18

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def digests(text: bytes, width: int) -> Iterator[bytes]:
    """The hashes (8 bytes each, high byte first) of all shingles, in pieces. A long text is cut at white space."""
    words: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            found = _BREAK.search(text, end)
            end = found.start() if found else len(text)
        words += text[at:end].translate(_LOWER).split()
        at = end
        if len(words) >= width:
            some = True
            shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            yield b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
            words = words[len(words) - width + 1 :]
    if words and not some:
        yield xxhash.xxh64_digest(b" ".join(words), SEED)


def fingerprints(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A bit is 1 where it is in over half of the hashes. Signed 64-bit; 0 without words."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []

    def count() -> None:
        if held:
            owners = np.array([n for n, _ in held])
            sizes = np.array([len(x) // 8 for _, x in held])
            bits = np.unpackbits(np.frombuffer(b"".join([x for _, x in held]), np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
            np.add.at(ones, owners, sums)
            np.add.at(total, owners, sizes)
            held.clear()

    waiting = 0
    for n, text in enumerate(texts):
        for piece in digests(text, width):
            held.append((n, piece))
            waiting += len(piece) // 8
            if waiting >= HASHES:
                count()
                waiting = 0
    count()
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(-1)


def with_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = fingerprints([x.as_py() or b"" for x in texts], width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def budget(depth: int, distance: int) -> int:
    return distance // 2 if depth <= 32 else distance


def turned(x: np.ndarray) -> np.ndarray:
    """The halves of each 64-bit number swapped."""
    return (x << np.uint64(32)) | (x >> np.uint64(32))


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` names each member's smallest linked one; now also a[i] and b[i] are linked."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, further := root[root]):
            root = further


def _pairs(al, ah, bl, bh) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of ranges [al, ah) x [bl, bh), in chunks."""
    wide = bh - bl
    count = (ah - al) * wide
    upto = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, base + CHUNK, "right")))
        of = np.repeat(np.arange(lo, hi), count[lo:hi])
        at = np.arange(len(of)) - np.repeat(upto[lo:hi] - count[lo:hi] - base, count[lo:hi])
        yield al[of] + at // wide[of], bl[of] + at % wide[of]
        lo = hi


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, distance: int) -> np.ndarray:
    """Joins two nodes of depth ``depth``, given as sorted uint64 arrays of what is below them (one with itself where
    ``b`` is None). Returns for each member of a, then b, the smallest index it is linked with."""
    own = b is None
    both = a if own else np.concatenate([a, b])
    root = np.arange(len(both))
    if not len(a) or not (own or len(b)):
        return root
    shift = 0 if own else len(a)
    used = int(np.bitwise_count((both[0] ^ both[shift]) >> np.uint64(64 - depth))) if depth else 0
    start = [np.array([x]) for x in (0, len(a), shift, len(both), used)]
    stack = [(depth, start)]
    while stack:
        level, (al, ah, bl, bh, e) = stack.pop()
        # Node pairs whose members are known to be linked need no walk.
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        known = (turns[ah - 1] == turns[al]) & (turns[bh - 1] == turns[bl]) & (root[al] == root[bl])
        al, ah, bl, bh, e = (x[~known] for x in (al, ah, bl, bh, e))
        few = ((ah - al) * (bh - bl) <= OUTRIGHT) | (level == 64)
        for i, j in _pairs(al[few], ah[few], bl[few], bh[few]):
            near = np.bitwise_count(both[i] ^ both[j]) <= distance
            root = merged(root, i[near], j[near])
        al, ah, bl, bh, e = (x[~few] for x in (al, ah, bl, bh, e))
        if not len(al):
            continue
        place = np.uint64(63 - level)
        am = np.searchsorted(a, ((both[al] >> place) | np.uint64(1)) << place)
        bm = shift + np.searchsorted(a if own else b, ((both[bl] >> place) | np.uint64(1)) << place)
        once = (al != bl) | (ah != bh)
        below = [
            np.concatenate(x)
            for x in zip(
                (al, am, bm, bh, e + 1),
                tuple(x[once] for x in (am, ah, bl, bm, e + 1)),
                (al, am, bl, bm, e),
                (am, ah, bm, bh, e),
                strict=True,
            )
        ]
        alive = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget(level + 1, distance))
        below = [x[alive] for x in below]
        # The last pushed is walked first: nodes with themselves before nodes with others.
        for lo in range(0, len(below[0]), CHUNK):
            stack.append((level + 1, [x[lo : lo + CHUNK] for x in below]))
    return root


def _join_leaf(distance: int):
    def run(key, table):
        side, depth, u, v = (x.as_py() for x in key)
        keys = table.column("key").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        first = table.column("first").combine_chunks().to_numpy(zero_copy_only=False)
        a, b = np.sort(keys[first]), None if u == v else np.sort(keys[~first])
        root = walk(a, b, depth, distance)
        both = a if b is None else np.concatenate([a, b])
        both = (turned(both) if side else both).view(np.int64)
        more = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(both[more]), "b": pa.array(both[root[more]])})

    return run


def _node(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def _leaf_links(pairs: DataFrame, keys: DataFrame, depth: int, distance: int) -> DataFrame:
    """``a``, ``b`` of the links between the members of each pair of nodes, as forests."""
    roles = F.when(F.col("u") == F.col("v"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    ends = pairs.select("side", "u", "v", F.explode(roles).alias("first"))
    ends = ends.withColumn("node", F.when(F.col("first"), F.col("u")).otherwise(F.col("v")))
    members = keys.withColumn("node", _node(depth)).join(ends, ["side", "node"])
    members = members.select("side", F.lit(depth).alias("depth"), "u", "v", "key", "first")
    return members.groupBy("side", "depth", "u", "v").applyInArrow(_join_leaf(distance), "a long, b long")


def near_links(points: DataFrame, distance: int = DISTANCE, leaf: int = LEAF) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct ``fingerprint`` values within ``distance`` bits of each other,
    directly or over others; no pair is given that is not so connected."""
    low = F.shiftrightunsigned("fingerprint", 32)
    swapped = F.shiftleft("fingerprint", 32).bitwiseOR(low)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("fingerprint").alias("key")), F.struct(F.lit(1).alias("side"), swapped.alias("key"))
    )
    keys = materialize(points.select(F.explode(sides).alias("x")).select("x.side", "x.key"), "keys")
    zero = F.lit(0).cast("long")
    pairs = keys.groupBy("side").agg(F.count("*").alias("n_u"))
    pairs = pairs.select("side", zero.alias("u"), zero.alias("v"), "n_u", F.col("n_u").alias("n_v"))
    small = F.when(F.col("u") == F.col("v"), F.col("n_u")).otherwise(F.col("n_u") + F.col("n_v")) <= leaf
    depth, found = 0, []
    while True:
        pairs, left = materialize_counted(pairs, "node-pairs", ~small)
        found.append(_leaf_links(pairs.where(small), keys, depth, distance))
        if not left:
            break
        deeper = min(64, depth + (STEP if depth else FIRST_STEP))
        nodes = keys.groupBy("side", _node(deeper).alias("node")).agg(F.count("*").alias("n"))
        up = F.shiftrightunsigned("node", deeper - depth) if depth else zero
        nodes = materialize(nodes.withColumn("up", up), "nodes")
        one = nodes.select("side", F.col("up").alias("u"), F.col("node").alias("new_u"), F.col("n").alias("new_n_u"))
        other = nodes.select(
            F.col("side").alias("_side"), F.col("up").alias("_v"), F.col("node").alias("new_v"), F.col("n").alias("new_n_v")
        )
        both = pairs.where(~small).join(one, ["side", "u"])
        both = both.join(
            other,
            (F.col("side") == F.col("_side")) & (F.col("v") == F.col("_v"))
            & (F.bit_count(F.col("new_u").bitwiseXOR(F.col("new_v"))) <= budget(deeper, distance))
            & ((F.col("u") != F.col("v")) | (F.col("new_u") <= F.col("new_v"))),
        )
        pairs = both.select("side", *[F.col(f"new_{c}").alias(c) for c in ("u", "v", "n_u", "n_v")])
        depth = deeper
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out, "trie-links")


def link_by_fingerprint(docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH, leaf: int = LEAF) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id reachable over fingerprints that differ in at most ``distance`` bits.

    Null, empty and wordless texts have fingerprint zero, which is linked like any other. Equal texts and repeated rows
    share a fingerprint and so a component. Rows without id get the smallest id of their component, or null. Empty
    table: no rows. Other columns are ignored.
    """
    rows = materialize(with_fingerprints(docs, width), "fingerprints")
    points = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc")), "points")
    labels = components(near_links(points.select("fingerprint"), distance, leaf))
    linked = points.join(labels, points["fingerprint"] == labels["node"]).select("fingerprint", "doc", "component")
    smallest = linked.groupBy("component").agg(F.min("doc").alias("component_id"))
    linked = materialize(linked.join(smallest, "component").select("fingerprint", "component_id"), "linked")
    alone = points.join(linked, "fingerprint", "left_anti").select("fingerprint", F.col("doc").alias("component_id"))
    out = rows.join(linked.unionByName(alone), "fingerprint")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")
