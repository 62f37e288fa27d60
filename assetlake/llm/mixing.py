"""Mixing sources to target weights by budgets handed down a tree.

The tree's levels are columns (say domain, language, source). Each leaf can give its tokens ``epochs`` times. From
the root down, a node's budget is shared by weight among its children; a child that cannot use its share is filled
and what it lacks goes to its siblings, so a shortage leaves a subtree only when all of it is used up. Budgets are
whole tokens. Each leaf gives whole epochs and then a prefix of one more in a seeded order; the prefix ends at a
position found from token sums of 4,096 order ranges per leaf, and only the range that holds it is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.columns import fresh, same
from assetlake.session import materialize

WHOLE = "decimal(38,0)"


def _parent(levels: Sequence[str], n: int) -> list[Column]:
    return [F.col(c) for c in levels[:n]] or [F.lit(0)]


def share(nodes: DataFrame, parent: list[Column], name: str) -> DataFrame:
    """Add ``budget`` to children (``capacity``, ``weight``) of a node with ``_budget``.

    In ascending order of capacity by weight a child is filled if its capacity is within its share of what is left;
    no child after the first that is not filled can be. The rest is shared by weight, by differences of rounded
    running shares, so that it adds up and nobody gets more than the capacity.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(name).asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast(WHOLE)
    rest = F.col("_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    out = nodes.withColumn(
        "_full", (F.col("capacity") * F.sum("weight").over(after)).cast(WHOLE) <= (F.col("weight") * rest).cast(WHOLE)
    )
    everyone = Window.partitionBy(*parent)
    open_weight = F.when(F.col("_full"), 0).otherwise(F.col("weight"))
    out = out.withColumns(
        {
            "_left": F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(everyone),
            "_weights": F.sum(open_weight).over(everyone),
            "_upto": F.sum(open_weight).over(upto),
        }
    )

    def part(weight: Column) -> Column:
        return F.call_function("div", (F.col("_left") * weight).cast(WHOLE), F.col("_weights").cast(WHOLE))

    shared = part(F.col("_upto")) - part(F.col("_upto") - F.col("weight"))
    budget = F.when(F.col("_full"), F.col("capacity")).otherwise(F.coalesce(shared, zero)).cast("long")
    return out.withColumn("budget", budget).drop("_full", "_left", "_weights", "_upto")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: DataFrame, total: Column, epochs: int) -> DataFrame:
    """Per leaf (``levels``, ``tokens``) its ``budget``. ``weights``: ``level``, ``name``, ``weight`` (positive
    whole numbers); a node that is not listed weighs 1. ``total`` is an aggregate over the leaves."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    root = leaves.agg(F.sum("capacity").alias("_capacity"), total.cast("long").alias("_total"))
    root = root.select(F.coalesce(F.least("_capacity", "_total"), F.lit(0)).cast("long").alias("_budget"))
    above = None
    for n, level in enumerate(levels):
        keys = list(levels[: n + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        named = weights.where(F.col("level") == level).select(F.col("name").alias("_name"), "weight")
        nodes = nodes.join(named, nodes[level].eqNullSafe(named["_name"]), "left").drop("_name")
        nodes = nodes.withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
        if above is None:
            nodes = nodes.join(root)  # one row
        else:
            up = above.select(*[F.col(c).alias(f"_p_{c}") for c in levels[:n]], F.col("budget").alias("_budget"))
            match = same([(nodes[c], up[f"_p_{c}"]) for c in levels[:n]])
            nodes = nodes.join(up, match).drop(*[f"_p_{c}" for c in levels[:n]])
        above = share(nodes, _parent(levels, n), level).drop("_budget")
    return above.select(*levels, "capacity", "budget")


def position(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The seeded place of a document in an epoch: 32 hexadecimal digits, the same on every engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def ends(sizes: DataFrame, levels: Sequence[str], weights: DataFrame, total: Column, epochs: int, seed: int):
    """Per leaf ``budget``, ``full`` (whole epochs) and where the last epoch's prefix ends: ``end_at``, ``end_id``,
    ``end_tokens`` of its last document, ``end_whole``, how many rows with this place and size are taken whole, and
    ``end_taken``, the tokens taken of one more (nulls: no such prefix).

    ``sizes``: ``doc_id``, ``levels``, ``n_tokens``, a stored table.
    """
    leaves = materialize(
        sizes.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "leaf-tokens"
    )
    plan = budgets(leaves, levels, weights, total, epochs)
    plan = plan.select(*[F.col(c).alias(f"_l_{c}") for c in levels], "capacity", "budget")
    plan = plan.withColumn("_tokens", F.call_function("div", F.col("capacity"), F.lit(epochs).cast("long")))
    plan = plan.select(
        *[f"_l_{c}" for c in levels], "budget",
        F.call_function("div", F.col("budget"), F.col("_tokens")).alias("full"),
        (F.col("budget") % F.col("_tokens")).alias("rest"),
    )
    plan = materialize(plan, "leaf-budgets")  # one row per leaf
    leaf = same([(sizes[c], plan[f"_l_{c}"]) for c in levels])
    keys = [f"_l_{c}" for c in levels]
    placed = sizes.join(plan.where("rest > 0"), leaf).where("n_tokens > 0").select(
        *keys, "doc_id", "n_tokens", "rest", position(seed, F.col("full"), F.col("doc_id")).alias("at")
    )
    placed = placed.withColumn("range", F.substring("at", 1, 3))
    ranges = placed.groupBy(*keys, "rest", "range").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("_upto", F.sum("n").over(along))
    last = ranges.where((F.col("_upto") >= F.col("rest")) & (F.col("_upto") - F.col("n") < F.col("rest")))
    last = materialize(
        last.select(*[F.col(k).alias(f"r{k}") for k in keys], F.col("range").alias("_range"),
                    (F.col("_upto") - F.col("n")).alias("_before")), "last-ranges",
    )
    inside = placed.join(
        last, same([(placed[k], last[f"r{k}"]) for k in keys]) & (placed["range"] == last["_range"])
    )
    # Rows of one place and size are one row with their number; a prefix may end among them.
    tied = inside.groupBy(*keys, "rest", "_before", "at", "doc_id", "n_tokens").agg(F.count("*").alias("_m"))
    rows = Window.partitionBy(*keys).orderBy("at", "doc_id", "n_tokens")
    rows = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("n_tokens") * F.col("_m")
    tied = tied.withColumn("_upto", F.col("_before") + F.sum(size).over(rows))
    over = F.col("rest") - F.col("_upto") + size
    final = tied.where((F.col("_upto") >= F.col("rest")) & (over > 0))
    ended = final.select(
        *[F.col(k).alias(f"e{k}") for k in keys], F.col("at").alias("end_at"), F.col("doc_id").alias("end_id"),
        F.col("n_tokens").alias("end_tokens"), F.call_function("div", over, F.col("n_tokens")).alias("end_whole"),
        (over % F.col("n_tokens")).alias("end_taken"),
    )
    out = plan.join(ended, same([(plan[k], ended[f"e{k}"]) for k in keys]), "left")
    out = out.select(*keys, "budget", "full", "end_at", "end_id", "end_tokens", "end_whole", "end_taken")
    return materialize(out, "leaf-ends")


def take(
    rows: DataFrame, levels: Sequence[str], ended: DataFrame, seed: int, n_tokens: str = "n_tokens",
    epoch: str = "epoch", taken: str = "taken",
) -> DataFrame:
    """Rows as often as they are taken, with ``epoch`` and ``taken`` (tokens); only the last document of a leaf's
    prefix may be taken in part. Joins with one row per leaf and moves nothing else but rows that share the last
    document's id and size: these are stored and numbered, task by task, and as many as fit are taken."""
    used = [*rows.columns, epoch, taken]
    names = {c: fresh(used, f"_end_{c}") for c in ended.columns}
    ended = ended.select(*[F.col(c).alias(names[c]) for c in ended.columns])

    def own(c: str) -> Column:
        return F.col(f"`{c}`")

    def of(c: str) -> Column:
        return F.col(names[c])

    size, full = own(n_tokens), of("full")
    at = position(seed, full, own("doc_id"))
    mine = F.struct(at.alias("at"), own("doc_id").alias("doc_id"), size.alias("n_tokens"))
    end = F.struct(of("end_at").alias("at"), of("end_id").alias("doc_id"), of("end_tokens").alias("n_tokens"))
    last = F.coalesce(of("end_at").isNotNull() & (mine == end), F.lit(False))
    before = F.coalesce(of("end_at").isNotNull() & (mine < end), F.lit(False))
    placed = rows.join(ended, same([(own(c), of(f"_l_{c}")) for c in levels])).where(size > 0)
    times = full + F.when(before, 1).otherwise(0)
    each = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))
    out = placed.select(*[own(c) for c in rows.columns], F.explode(each).alias(epoch), size.cast("long").alias(taken))
    # Of the rows that share the last place, the first ones by their hash within tasks that follow each other.
    task, place = fresh(used, "_task"), fresh(used, "_place")
    leaf = [names[f"_l_{c}"] for c in levels]
    tied = placed.where(last).select(
        *[own(c) for c in rows.columns], *[of(c) for c in ("full", "end_whole", "end_taken")], *leaf,
        F.spark_partition_id().alias(task), F.xxhash64(*[own(c) for c in rows.columns]).alias(place),
    )
    tied = materialize(tied, "tied-rows")
    counts = tied.groupBy(*leaf, task).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*leaf).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(c).alias(f"_c{c}") for c in [*leaf, task]], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_c_before")
    )
    number = F.row_number().over(Window.partitionBy(*leaf, task).orderBy(place))
    tied = tied.withColumn(place, number).join(counts, same([(F.col(c), F.col(f"_c{c}")) for c in [*leaf, task]]))
    rank = F.col(place) + F.col("_c_before")
    part = F.when(rank <= of("end_whole"), size).when(rank == of("end_whole") + 1, of("end_taken")).cast("long")
    tied = tied.select(*[own(c) for c in rows.columns], full.alias(epoch), part.alias(taken))
    return out.unionByName(tied.where(F.col(f"`{taken}`") > 0))
