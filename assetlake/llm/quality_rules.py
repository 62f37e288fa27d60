"""Quality rules whose thresholds follow each language and source.

Every document is measured by column expressions. The measures of documents that pass the base rule are counted
per language and source in log-linear histograms: integers share a bucket if they agree in their seven leading
bits, so a quantile is off by less than one part in 64. Such counts add up in any order (partial aggregation, then
merging), do not depend on chance or partitioning, and have a few hundred rows per group at most. Quartiles read
from them give fences, and a join with the fences judges the documents.

Repetition is rare: where most documents have none, quartiles over all of them are zero and tell nothing of those that
have some. The quartiles of such measures are therefore taken over the documents that show any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.columns import fresh, let, same, words
from assetlake.session import materialize

SYMBOLS = "#*$%&|<>"

#: Measure: (numerator, denominator, scale, both sides, only positive values). The fence is the quartile plus (or
#: minus) ``REACH`` times the distance between the quartiles, both read from the group's own sketch. ``LEAST`` keeps
#: a group of equal values from rejecting all that differs by rounding.
RULES: dict[str, tuple[str, str, int, bool, bool]] = {
    "symbols": ("n_symbols", "word_chars", 1000, False, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False, True),
    "repeats": ("n_repeat_words", "n_words", 1000, False, True),
    "word_length": ("word_chars", "n_words", 1000, True, False),
}
REACH = 3
LEAST = 5


def _repeats(w: Column) -> Column:
    """Words in three-word windows that occur at least twice, by hashes of the windows."""
    count = F.greatest(F.size(w) - 2, F.lit(0))
    windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), count)

    def covered(t: Column) -> Column:
        marked = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            marked,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        steps = let(again, lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def found(t: Column) -> Column:
        twice = let(F.array_sort(t), lambda s: F.exists(F.transform(s, lambda x, i: x == F.get(s, i + 1)), lambda x: x))
        return F.when(twice, covered(t)).otherwise(0)

    return let(windows, found)


def measures(text: Column) -> Column:
    """A struct of the counts; null text: all zero."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    counted = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("r")))
    listed = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(
        F.struct(counted.alias("w"), listed.alias("l"), F.length(bare).alias("c")),
        lambda m: F.struct(
            m["w"]["n"].cast("long").alias("n_words"),
            m["c"].cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            m["l"]["n"].cast("long").alias("n_lines"),
            (m["l"]["n"] - m["l"]["d"]).cast("long").alias("n_dup_lines"),
            m["w"]["r"].cast("long").alias("n_repeat_words"),
        ),
    )


def _shift(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - 7, F.lit(0))


def bucket(value: Column) -> Column:
    """The lower end of a non-negative integer's bucket."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, _shift(value)), _shift(value))


def bucket_end(value: Column) -> Column:
    """The largest integer of a non-negative integer's bucket."""
    return bucket(value) + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(value)) - 1


def _value(m: Column, rule: str) -> Column:
    top, below, scale, *_ = RULES[rule]
    return F.call_function("div", m[top] * scale, F.greatest(m[below], F.lit(1)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def histogram(measured: DataFrame, column: str) -> DataFrame:
    """The mergeable sketch: ``lang``, ``source``, ``rule``, ``bucket``, ``n``."""
    m = F.col(column)
    values = F.array(*[F.struct(F.lit(r).alias("rule"), bucket(_value(m, r)).alias("bucket")) for r in RULES])
    rows = measured.where(~base_failed(m)).select("lang", "source", F.explode(values).alias("_v"))
    return rows.groupBy("lang", "source", "_v.rule", "_v.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Per language and source ``<rule>_low`` and ``<rule>_high``, from the outer ends of the quartiles' buckets."""
    group = Window.partitionBy("lang", "source", "rule")
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positive = [rule for rule, (*_, only) in RULES.items() if only]
    cumulated = sketch.where((F.col("bucket") > 0) | ~F.col("rule").isin(positive)).withColumns(
        {"_upto": F.sum("n").over(running), "_all": F.sum("n").over(group)}
    )
    quartiles = cumulated.groupBy("lang", "source", "rule").agg(
        F.min(F.when(4 * F.col("_upto") >= F.col("_all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("_upto") >= 3 * F.col("_all"), F.col("bucket"))).alias("q3"),
    )
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST))
    ends = []
    for rule, (_, _, _, both, _) in RULES.items():
        here = F.col("rule") == rule
        # No quartiles: all values of the group are zero.
        ends.append(F.coalesce(F.max(F.when(here, bucket_end(F.col("q3")) + reach)), F.lit(REACH * LEAST)).alias(f"{rule}_high"))
        low = F.max(F.when(here, F.col("q1") - reach)) if both else F.lit(-1)
        ends.append(low.alias(f"{rule}_low"))
    return quartiles.groupBy("lang", "source").agg(*ends)


def measure(docs: DataFrame, column: str) -> DataFrame:
    return docs.withColumn(column, measures(F.col("text")))


def judge(measured: DataFrame, column: str, verdict: str) -> DataFrame:
    """Add ``verdict``: false for documents that fail the base rule or lie beyond a fence of their language and
    source, true for all others.

    ``measured`` holds ``lang``, ``source`` and the struct ``column``, and is read twice: pass a stored table.
    Null languages and sources are groups of their own. Null or empty texts fail the base rule. Repeated rows are
    counted and judged each. Empty table: no rows. All other columns are kept.
    """
    # Stored, so that the optimizer knows its size: a row per language and source.
    limits = materialize(fences(histogram(measured, column)), "fences")
    m = measured[column]
    inside = F.lit(True)
    for rule in RULES:
        value = _value(m, rule)
        inside = inside & (value <= limits[f"{rule}_high"]) & (value >= limits[f"{rule}_low"])
    group = same([(measured["lang"], limits["lang"]), (measured["source"], limits["source"])])
    judged = measured.join(limits, group, "left")
    return judged.select(
        *[measured[c] for c in measured.columns], (~base_failed(m) & F.coalesce(inside, F.lit(False))).alias(verdict)
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document its counts, ``base_failed`` and ``kept``."""
    measured = materialize(measure(docs.select("doc_id", "text", "lang", "source"), "_m").drop("text"), "measures")
    judged = judge(measured, "_m", "kept")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col("_m")[n].alias(n) for n in names],
        base_failed(F.col("_m")).alias("base_failed"), "kept",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all its columns.

    Only measures are stored, not texts; rows meet their verdict by two hashes of id, text, language and source.
    """
    keys = [fresh(docs.columns, "_row"), fresh(docs.columns, "_check")]
    hashes = [F.xxhash64(F.lit(i), "doc_id", "text", "lang", "source").alias(k) for i, k in enumerate(keys)]
    measured = docs.select(*hashes, "lang", "source", measures(F.col("text")).alias("_m"))
    good = judge(materialize(measured, "measures"), "_m", "_kept").where("_kept").select(*keys).distinct()
    kept = docs.select("*", *hashes).join(good.hint("shuffle_hash"), keys, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
