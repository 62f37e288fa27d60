"""Numbers of tokens of whole texts; huge documents are encoded in overlapping chunks and spliced.

A document of up to ``chunk`` characters is counted where it is read. A longer one is cut into chunks that
overlap by ``overlap`` characters; the chunks are dealt out over all tasks. Each chunk is encoded with offsets
and tells its stable boundaries inside both overlaps: places with one white-space character between two visible
ones that no token spans (words are cut there whatever stands further left or right), with the number of its
tokens before the place and a hash of the ids up to the next such place. Two neighbours are spliced at the
first place that both report with equal ids after it. Where there is none, the overlap is widened to both whole
chunks, and on to the next neighbour as long as that one fails too: such a run is encoded as one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.vocabulary import batches, encoder, load
from assetlake.session import materialize

CUTS = "array<struct<at: long, before: long, after: long>>"
_LIBRARY: dict[str, object] = {}


def _library(path: str):
    if path not in _LIBRARY:
        _LIBRARY[path] = load(path)
    return _LIBRARY[path]


def _first_pass(vocabulary: str, chunk: int, overlap: int):
    """(row, doc_id, n_bytes, text) to finished rows (``n_tokens`` set) or chunks (``piece``, ``at``, ``text``)."""
    step = chunk - overlap

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(vocabulary).encoded
        names = ["row", "doc_id", "n_bytes", "n_tokens", "piece", "pieces", "at", "text"]
        kinds = [pa.int64()] * 7 + [pa.string()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for part in parts:
            row, doc, size, texts = (c.to_pylist() for c in part.columns)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            chosen = [texts[i] for i in short]
            for lo, hi in batches(chosen):
                counts = np.diff(encoded(chosen[lo:hi])[1]).tolist()
                yield made(
                    [(row[i], doc[i], size[i], n, None, None, None, None) for i, n in zip(short[lo:hi], counts)]
                )
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    starts = range(0, len(t) - overlap, step)
                    for k, at in enumerate(starts):
                        yield made([(row[i], doc[i], size[i], None, k, len(starts), at, t[at : at + chunk])])

    return run


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, lo: int, hi: int) -> list[dict]:
    """Stable places of ``text`` in [lo, hi): position, tokens before it, hash of the ids up to the next one."""
    places = [
        i
        for i in range(max(lo, 1), min(hi, len(text) - 1))
        if text[i] in " \n" and not text[i - 1].isspace() and not text[i + 1].isspace()
    ]
    if not places:
        return []
    at = np.array(places)
    before = np.searchsorted(starts, at, "left")
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    clear = [b == 0 or reach[b - 1] <= i for b, i in zip(before, at)]
    at, before = at[clear], before[clear]
    out = []
    for j in range(len(at) - 1):
        inside = ids[before[j] : before[j + 1]]
        after = xxhash.xxh64_intdigest(inside.astype("<u4").tobytes()) >> 1
        out.append({"at": int(at[j]), "before": int(before[j]), "after": after})
    return out


def _encode_chunks(vocabulary: str, overlap: int):
    """(row, doc_id, n_bytes, piece, pieces, at, text) to the chunk's number of tokens and boundaries."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _library(vocabulary)
        for part in parts:
            rows = part.to_pylist()
            heads, tails, totals = [], [], []
            for r in rows:
                text, at = r["text"], r["at"]
                e = tok.encode(text, add_special_tokens=False)
                spans = np.array(e.offsets, np.int64).reshape(-1, 2)
                ids = np.array(e.ids, np.int64)
                n = len(text)
                found = {
                    "head": boundaries(text, spans[:, 0], spans[:, 1], ids, 0, overlap) if r["piece"] else [],
                    "tail": boundaries(text, spans[:, 0], spans[:, 1], ids, n - overlap, n)
                    if r["piece"] < r["pieces"] - 1
                    else [],
                }
                for x in found.values():
                    for y in x:
                        y["at"] += at
                heads.append(found["head"])
                tails.append(found["tail"])
                totals.append(len(ids))
            cuts = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64()), ("after", pa.int64())]))
            keep = ["row", "piece"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(part.schema.get_field_index(k)) for k in keep],
                 pa.array(totals, pa.int64()), pa.array(heads, cuts), pa.array(tails, cuts)],
                names=[*keep, "total", "head", "tail"],
            )

    return run


def _encode_runs(vocabulary: str, overlap: int):
    """(row, run, left_at, right_at, texts): tokens between both places of a run of chunks encoded as one text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _library(vocabulary)
        for part in parts:
            counts = []
            for r in part.to_pylist():
                pieces = sorted(r["texts"], key=lambda x: x["piece"])
                text = pieces[0]["text"] + "".join(x["text"][overlap:] for x in pieces[1:])
                starts = np.array([a for a, _ in tok.encode(text, add_special_tokens=False).offsets], np.int64)
                base = pieces[0]["at"]
                right = len(starts) if r["right_at"] is None else np.searchsorted(starts, r["right_at"] - base)
                left = 0 if r["left_at"] is None else np.searchsorted(starts, r["left_at"] - base)
                counts.append(int(right - left))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["row", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row's whole text, as the library gives them.

    Null or empty text: 0 bytes, 0 tokens. Null and repeated ``doc_id``: each row is counted on its own. Empty
    table: no rows. Other columns are ignored. Texts without any stable boundary are encoded whole, in one task,
    as the library itself would do.
    """
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and smaller than chunk")
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    first = base.mapInArrow(
        _first_pass(vocabulary, chunk, overlap),
        "row long, doc_id long, n_bytes long, n_tokens long, piece long, pieces long, at long, text string",
    )
    first = materialize(first, "token-counts")
    done = first.where("piece IS NULL").select("doc_id", "n_bytes", "n_tokens")
    chunks = first.where("piece IS NOT NULL").drop("n_tokens").repartition("row", "piece")
    coded = chunks.select("row", "piece", "pieces", "at", "text").mapInArrow(
        _encode_chunks(vocabulary, overlap), f"row long, piece long, total long, head {CUTS}, tail {CUTS}"
    )
    coded = materialize(coded, "token-chunks")
    order = Window.partitionBy("row").orderBy("piece")
    # A document has as many chunks here as it has multiples of the chunk size, each with a short list.
    pairs = coded.withColumn("_next", F.lead("head").over(order))
    common = F.filter(
        "tail", lambda x: F.exists("_next", lambda y: (x["at"] == y["at"]) & (x["after"] == y["after"]))
    )
    pairs = pairs.withColumn("_cut", F.get(common, F.lit(0)))
    pairs = pairs.withColumn(
        "_cut_next", F.get(F.filter("_next", lambda y: y["at"] == F.col("_cut.at")), F.lit(0))["before"]
    )
    linked = pairs.select(
        "row", "piece", "total",
        F.col("_cut.at").alias("right_at"), F.col("_cut.before").alias("right_before"),
        F.lag("_cut.at").over(order).alias("left_at"), F.lag("_cut_next").over(order).alias("left_before"),
        F.lead("piece").over(order).isNull().alias("last"),
    )
    # A run starts at the first chunk and after every splice.
    linked = linked.withColumn(
        "run", F.sum(F.when((F.col("piece") == 0) | F.col("left_at").isNotNull(), 1).otherwise(0)).over(order)
    )
    spans = linked.withColumn("members", F.count("*").over(Window.partitionBy("row", "run")))
    alone = spans.where("members = 1").select(
        "row", (F.coalesce("right_before", "total") - F.coalesce("left_before", F.lit(0))).alias("n_tokens")
    )
    runs = (
        spans.where("members > 1").join(chunks.select("row", "piece", "at", "text"), ["row", "piece"])
        .groupBy("row", "run")
        .agg(
            F.max("left_at").alias("left_at"), F.max("right_at").alias("right_at"),
            F.collect_list(F.struct("piece", "at", "text")).alias("texts"),
        )
        .select("row", "left_at", "right_at", "texts")
        .mapInArrow(_encode_runs(vocabulary, overlap), "row long, n_tokens long")
    )
    long_docs = chunks.where("piece = 0").select("row", "doc_id", "n_bytes")
    sums = alone.unionByName(runs).groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"))
    return done.unionByName(long_docs.join(sums, "row").select("doc_id", "n_bytes", "n_tokens"))
