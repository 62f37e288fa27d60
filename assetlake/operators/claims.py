"""Claiming keys: equal content is published once, different content under one key gets ``__dupN``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import join_ext, split_ext
from assetlake.operators.layout import content_type
from assetlake.operators.windows import running
from assetlake.session import materialize, materialize_counted

_ORDER = ["resource_index", "position", "alias"]
_MARK = "__dup"


def _split_key(key: Column) -> tuple[Column, Column, Column]:
    folder = F.regexp_extract(key, r"(?s)\A(.*/)[^/]*\z", 1)
    stem, ext = split_ext(F.regexp_extract(key, r"(?s)([^/]*)\z", 1))
    return folder, stem, ext


def numbered_key(key: Column, n: Column) -> Column:
    """The key itself for 1, else its ``__dupN`` form."""
    folder, stem, ext = _split_key(key)
    return F.when(n <= 1, key).otherwise(
        F.concat(folder, join_ext(F.concat(stem, F.lit(_MARK), n.cast("string")), ext))
    )


def component_of(folded: Column) -> Column:
    """Keys can only ever collide within one component: the folded key without its ``__dupN`` marks."""
    folder, stem, ext = _split_key(folded)
    return F.concat(folder, F.regexp_replace(stem, r"(?:__dup[0-9]+)+\z", ""), F.lit("\x00"), ext)


_KEY = ["run", "component", "folded"]
_DUP = r"(?s)\A(.+)__dup([2-9]|[1-9][0-9]{1,8})\z"


def _contested(rows: DataFrame) -> DataFrame:
    """Names two keys can want: a key ``child`` that is also the ``n``-th name of its parent key ``folded``.

    ``t`` and ``content`` are those of the child's first output, the only one that wants the bare name.
    """
    keys = rows.groupBy(*_KEY).agg(F.min("t").alias("t"), F.min_by("content", "t").alias("content"))
    folder, stem, ext = _split_key(F.col("folded"))
    parent = F.concat(folder, join_ext(F.regexp_extract(stem, _DUP, 1), ext))
    children = keys.where(stem.rlike(_DUP)).select(
        "run", "component", parent.alias("folded"), F.regexp_extract(stem, _DUP, 2).cast("long").alias("n"),
        F.col("folded").alias("child"), "t", "content",
    )
    return children.join(keys.select(*_KEY), _KEY, "left_semi")


def settle(rows: DataFrame) -> DataFrame:
    """The sequential rule for components of any size, as a fixpoint of joins and running counts.

    Within one key, outputs take its names in order, skipping names that another key's output holds. So
    an output's place follows from a running count, once it is known (a) which contested names the
    child's first output got before the parent reached them and (b) which outputs met their own content
    on the way. Starting from a guess, both are recomputed from the places they lead to until nothing
    changes. Every round fixes at least the earliest wrong output, so this ends, and a state that
    reproduces itself is the sequential outcome: each output has the first name that no earlier output
    holds with other content.
    """
    rows = rows.withColumn("t", F.struct(*_ORDER)).withColumn("content", F.struct("bytes", "sha256"))
    base = materialize(rows, "mixed-claims")
    lean = base.select(*_KEY, "t", "content", *_ORDER)
    edges = materialize(
        _contested(lean).withColumns(
            {"theirs": F.lit(True), "taken": F.lit(None).cast("struct<bytes: bigint, sha256: string>")}
        ),
        "contested",
    )
    met = materialize(lean.select(*_KEY, "content", F.lit(False).alias("same")), "met")
    order = [F.col(c) for c in _ORDER]
    while True:
        # Place of every output under the current state.
        taken = edges.where("NOT theirs").select(
            "run", "component", F.col("child").alias("folded"), F.col("taken").alias("own"), F.lit(1).alias("shift")
        )
        state = lean.join(met, [*_KEY, "content"]).withColumn("_new", (~F.col("same")).cast("long"))
        state = materialize(state.join(taken, _KEY, "left"), "state")
        state = running(state, _KEY, order, sums={"_count": "_new"})
        slot = F.col("_count") + F.col("same").cast("long") + F.coalesce("shift", F.lit(0))
        state = materialize(state.withColumn("slot", slot), "slots")
        held = edges.withColumn("_b", F.col("theirs").cast("long"))
        held = running(held, _KEY, [F.col("n")], sums={"_upto": "_b"})
        held = held.withColumn("slot", F.col("n") - F.col("_upto") + F.col("_b"))
        held = materialize(held, "held")
        blank = [c for c in state.columns if c not in (*_KEY, "slot")]
        marks = held.where("theirs").select(
            *_KEY, "slot", F.lit(1).cast("long").alias("_mark"), F.col("n").alias("_tie"),
            *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in blank],
        )
        points = state.select(
            *_KEY, "slot", F.lit(0).cast("long").alias("_mark"), F.lit(2**62).cast("long").alias("_tie"), *blank
        )
        both = running(
            materialize(points.unionByName(marks), "points"), _KEY,
            [F.col("slot"), F.col("_tie"), *order], sums={"_skipped": "_mark"},
        )
        placed = materialize(
            both.where("_mark = 0").withColumn("place", F.col("slot") + F.col("_skipped")).drop("_mark", "_tie"), "placed"
        )
        # Who reaches each contested name first, and with what.
        reach = placed.where("NOT same").select(
            *_KEY, "slot", F.col("t").alias("_t"), F.col("content").alias("_content")
        )
        renewed = held.join(reach, [*_KEY, "slot"], "left")
        theirs = F.col("_t").isNull() | (F.col("t") < F.col("_t"))
        renewed = renewed.select(
            *_KEY, "n", "child", "t", "content", theirs.alias("theirs"), F.when(~theirs, F.col("_content")).alias("taken"),
            (~theirs.eqNullSafe(F.col("theirs")) | ~F.when(~theirs, F.col("_content")).eqNullSafe(F.col("taken"))).alias("_changed"),
        )
        edges, moved = materialize_counted(renewed, "contested", F.col("_changed"))
        edges = edges.drop("_changed")
        # Outputs that meet their own content: under the parent's name, or at a name another key holds.
        others = edges.where("theirs").select(*_KEY, "content", F.col("n").alias("_n"), F.col("t").alias("_te"))
        meets = (
            placed.join(others, [*_KEY, "content"])
            .where((F.col("_te") < F.col("t")) & (F.col("_n") < F.col("place")))
            .select(*_KEY, "content").distinct().withColumn("_meets", F.lit(True))
        )
        mine = edges.where("NOT theirs").select(
            "run", "component", F.col("child").alias("folded"), F.col("taken").alias("_own")
        )
        again = (
            placed.select(*_KEY, "content", F.col("same").alias("_was"))
            .join(meets, [*_KEY, "content"], "left")
            .join(mine, _KEY, "left")
            .withColumn("same", F.coalesce("_meets", F.lit(False)) | F.coalesce(F.col("_own") == F.col("content"), F.lit(False)))
        )
        again = again.select(*_KEY, "content", "same", (F.col("same") != F.col("_was")).alias("_changed"))
        met, changed = materialize_counted(again, "met", F.col("_changed"))
        met = met.drop("_changed")
        if not moved and not changed:
            break
    final = placed.select(*_KEY, "content", F.col("place").alias("_place"), (~F.col("same")).alias("_kept"))
    return base.join(final, [*_KEY, "content"]).drop("t", "content")


def claim_keys(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their final ``path``, and ``(run, deduplicated, renamed)`` counts.

    Only the first output of each (folded key, content) can matter, so that pair is aggregated first.
    A component with one folded key is a plain numbering by first appearance, done with windows however
    large it is. Components mixing several keys (``a`` next to a real ``a__dup2``) go to :func:`settle`.
    """
    df = wanted.withColumn("folded", F.lower("key")).withColumn("component", component_of(F.col("folded")))
    rest = [c for c in wanted.columns if c not in ("run", "bytes", "sha256")]
    firsts = (
        df.groupBy("run", "component", "folded", "bytes", "sha256")
        .agg(F.min_by(F.struct(*rest), F.struct(*_ORDER)).alias("first"), F.count(F.lit(1)).alias("_copies"))
        .select("run", "component", "folded", "bytes", "sha256", "first.*", "_copies")
    )
    firsts = materialize(firsts, "claims")
    shape = firsts.groupBy("run", "component").agg((F.min("folded") != F.max("folded")).alias("_mixed"))
    mixed, any_mixed = materialize_counted(shape.where("_mixed"), "mixed-components")
    simple = firsts.join(mixed, ["run", "component"], "left_anti")
    numbered = running(simple, ["run", "component"], [F.col(c) for c in _ORDER], row_number="_place")
    settled = numbered.withColumn("_kept", F.lit(True))
    if any_mixed:
        rows = firsts.join(mixed.select("run", "component"), ["run", "component"], "left_semi")
        settled = settled.unionByName(settle(rows).select(*settled.columns))
    settled = materialize(settled, "settled")
    entries = (
        settled.where("_kept")
        .withColumn("path", numbered_key(F.col("key"), F.col("_place")))
        .withColumn("content_type", content_type(F.col("path")))
        .drop("component", "folded", "_copies", "_place", "_kept", "key")
    )
    counts = settled.groupBy("run").agg(
        F.sum(F.col("_copies") - F.col("_kept").cast("long")).alias("deduplicated"),
        F.count_if(F.col("_kept") & (F.col("_place") > 1)).alias("renamed"),
    )
    return entries, counts
