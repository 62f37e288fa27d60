"""How far the sources of a language differ in their words, with exact counts over all documents.

Words are heavy and counts are light, so texts of words come last. What is counted and shuffled are 64-bit digests of
terms. Only for the terms that stay (those in enough documents) are the words themselves fetched: the smallest and the
largest word of each digest. Where they differ, several words share the digest, and its words are counted anew, each by
itself. After the ranking, words are joined to the rows that are returned.

A source's probability of a term that it lacks is the same for all such terms, so sums over all terms need only the
terms that occur: per pair of sources a sum over the terms both have, and per source its counts' histogram.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.jaccard_join import filter_of, in_filter
from assetlake.session import materialize, materialize_counted

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Counted terms that a task holds at once, and bytes of a text that are cut into terms at once.
HELD, SEGMENT = 500_000, 1 << 20

#: Only letters A to Z are lower-cased; all that is no letter and not above 0x7F parts terms.
_TERMS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def segments(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end where no term does."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            found = _BREAK.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].translate(_TERMS).split()
        at = end


def digests(terms: list[bytes], bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join([xxhash.xxh3_64_digest(t) for t in terms]), ">u8").astype(np.uint64)
    return (raw >> np.uint64(64 - bits)).view(np.int64)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    return (x.as_py() for x in batch.column(at).cast(pa.large_binary()))


def _count_terms(bits: int):
    """Over (lang, source, text): counts and numbers of documents by digest, in parts that add up. A document may be
    counted twice for a digest that two of its words share; such words are counted anew."""
    names = ["lang", "source", "digest", "count", "docs"]

    def rows(found: list[tuple[tuple[str, str], np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(len(found)), [len(x[1]) for x in found]), pa.int64())
        labels = [pa.array([x[0][k] for x in found], pa.string()).take(of) for k in (0, 1)]
        numbers = [pa.array(np.concatenate([x[k] for x in found])) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([*labels, *numbers], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            found = [
                (key, digests(list(counts), bits), np.fromiter(counts.values(), np.int64, len(counts)),
                 np.fromiter((docs[t] for t in counts), np.int64, len(counts)))
                for key, (counts, docs) in held.items()
            ]
            held.clear()
            if found:
                yield rows(found)

        size = 0
        for batch in batches:
            labels = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, text in zip(labels, _texts(batch, 2), strict=True):
                if len(text) > SEGMENT:
                    # The terms of a long text are not held together: its documents are counted from digests at its end.
                    seen = [np.zeros(0, np.int64)]
                    for words in segments(text):
                        counts = Counter(words)
                        seen.append(digests(list(counts), bits))
                        yield rows([(key, seen[-1], np.fromiter(counts.values(), np.int64, len(counts)), 0 * seen[-1])])
                    once = np.unique(np.concatenate(seen))
                    yield rows([(key, once, 0 * once, 0 * once + 1)])
                    continue
                counts, docs = held.setdefault(key, (Counter(), Counter()))
                before = len(counts)
                for words in segments(text):
                    counts.update(words)
                    docs.update(set(words))
                size += len(counts) - before
                if size > HELD:
                    yield from emptied()
                    size = 0
        yield from emptied()

    return run


def _name_terms(bits: int, wanted):
    """Over (lang, text): the words whose digest is in the filter, once per language in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set[bytes]] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                terms = list(found)
                own = digests(terms, bits)
                keep = np.flatnonzero(in_filter(wanted.value, own))
                words = pa.array([terms[k] for k in keep.tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(keep)), pa.array(own[keep]), words], names=["lang", "digest", "term"]
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                for words in segments(text):
                    held.setdefault(lang, set()).update(words)
                    if sum(map(len, held.values())) > HELD:
                        yield from emptied()
        yield from emptied()

    return run


def _count_words(bits: int, wanted):
    """Over (lang, source, text): a document's counts of the words whose digest is in the filter."""
    names = ["lang", "source", "digest", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), _texts(batch, 2), strict=True):
                counts: Counter = Counter()
                for words in segments(text):
                    new = Counter(words)
                    terms = list(new)
                    keep = in_filter(wanted.value, digests(terms, bits)) if terms else []
                    for term, good in zip(terms, keep, strict=True):
                        if good:
                            counts[term] += new[term]
                terms = list(counts)
                n = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(digests(terms, bits)),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()),
                     pa.repeat(pa.scalar(1, pa.int64()), n)], names=names,
                )

    return run


def _in_enough(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The counts of terms that stay, with the language's ``total``; ``lead`` marks one row per term."""
    term = Window.partitionBy(*keys)
    counted = counts.groupBy(*dict.fromkeys(["lang", "source", *keys])).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    known = counted.select(
        "*", F.sum("count").over(term).alias("total"), F.sum("docs").over(term).alias("in_docs"),
        (F.col("source") == F.min("source").over(term)).alias("lead"),
    )
    return known.where(F.col("in_docs") >= least).drop("docs", "in_docs")


def kept_terms(rows: DataFrame, least: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """From (``lang``, ``source``, ``text``): the counts of the terms that stay, by ``lang``, ``source``, ``digest`` and
    ``term`` (empty but where words share a digest), and the words of the digests."""
    send = rows.sparkSession.sparkContext.broadcast
    counts = rows.mapInArrow(_count_terms(bits), "lang string, source string, digest long, count long, docs long")
    kept, n = materialize_counted(_in_enough(counts, ["lang", "digest"], least), "kept-digests", F.col("lead"))
    leads = kept.where("lead").select("lang", "digest")
    named = rows.select("lang", "text").mapInArrow(
        _name_terms(bits, send(filter_of(leads, "digest", n))), "lang string, digest long, term string"
    )
    names = named.join(leads, ["lang", "digest"], "left_semi").groupBy("lang", "digest")
    names, shared = materialize_counted(
        names.agg(F.min("term").alias("word"), F.max("term").alias("last")), "names", F.col("word") != F.col("last")
    )
    kept = kept.withColumn("term", F.lit(""))
    if shared:
        several = names.where("word != last").select("lang", "digest")
        words = rows.mapInArrow(
            _count_words(bits, send(filter_of(several, "digest", shared))),
            "lang string, source string, digest long, term string, count long, docs long",
        )
        words = words.join(several, ["lang", "digest"], "left_semi")
        split = _in_enough(words, ["lang", "digest", "term"], least)
        kept = kept.join(several, ["lang", "digest"], "left_anti").unionByName(split)
        kept = materialize(kept, "kept-terms")
    return kept, names.select("lang", "digest", "word")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)), exact for any counts."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` from ``docs`` (``text``, ``lang``, ``source``).

    Part ``pair``: each other source of the language by its distance from this one, all of them; 0 where the language
    keeps no term. Part ``term``: the ``top`` terms that the source uses more than its language. Ties go by the item's
    bytes. Nulls in a column count as empty: a null text has no terms, and null and empty names are one. Every row is a
    document, repeated ones too; ``doc_id`` and other columns are not read. Empty table: no rows. ``bits`` is the length
    of digests; with any length the results are the same.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept, names = kept_terms(rows, least, bits)
    of_lang = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count(F.when(F.col("lead"), 1)).alias("terms"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("own"))
    groups = rows.select("lang", "source").distinct().join(of_lang, "lang", "left")
    groups = groups.join(of_source, ["lang", "source"], "left").fillna(0, ["lang_n", "terms", "n", "own"])
    none = F.when(F.col("terms") > 0, share(F.lit(0), F.col("n"), F.col("terms")))
    groups = materialize(groups.withColumn("p0", none), "groups")
    p = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "digest", "term", "p0", share(F.col("count"), F.col("n"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"),
    )
    p = materialize(p, "shares")
    return _pairs(p, groups).unionByName(_terms(p, names, top))


def _pairs(p: DataFrame, groups: DataFrame) -> DataFrame:
    def end(table: DataFrame, name: str, *more: str) -> DataFrame:
        return table.select("lang", F.col("source").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in more])

    a, b = end(groups, "x", "p0", "terms", "own"), end(groups, "y", "p0", "own")
    both = a.repartition("lang", "x").join(b, "lang").where("x < y")
    # All terms as if neither source had them; then what the terms of one add, and the terms of both.
    absent = (F.col("x_terms") - F.col("x_own") - F.col("y_own")) * distance(F.col("x_p0"), F.col("y_p0"))
    absent = both.select("lang", "x", "y", F.coalesce(absent, F.lit(0)).alias("value"))
    alike = p.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    one = end(alike, "x", "p", "n").join(end(groups, "y", "p0"), "lang").where("x != y")
    one = one.groupBy("lang", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(
        F.sum(F.col("x_n") * distance(F.col("x_p"), F.col("y_p0"))).alias("value")
    )
    keys = ["lang", "digest", "term"]
    left = p.select(*keys, F.col("source").alias("x"), F.col("p").alias("x_p"), F.col("p0").alias("x_p0"))
    right = p.select(*keys, F.col("source").alias("y"), F.col("p").alias("y_p"), F.col("p0").alias("y_p0"))
    x, y, x0, y0 = (F.col(c) for c in ("x_p", "y_p", "x_p0", "y_p0"))
    more = distance(x, y) - distance(x, y0) - distance(x0, y) + distance(x0, y0)
    common = left.join(right, keys).where("x < y").groupBy("lang", "x", "y").agg(F.sum(more).alias("value"))
    sums = absent.unionByName(one).unionByName(common).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ways = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("x", "y"), ("y", "x"))])
    out = sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")
    return _ranked(out.withColumn("part", F.lit("pair")))


def _terms(p: DataFrame, names: DataFrame, top: int) -> DataFrame:
    more = p.where("p > q").select("lang", "source", "digest", "term", distance(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Ties at the last place stay until their words are known.
    first = more.withColumn("place", F.rank().over(place)).where(F.col("place") <= top)
    first = first.join(names, ["lang", "digest"])
    item = F.when(F.col("term") != "", F.col("term")).otherwise(F.col("word"))
    out = _ranked(first.select("lang", "source", item.alias("item"), "value", F.lit("term").alias("part")))
    return out.where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
