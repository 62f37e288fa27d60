"""Choosing locations: by key, by pattern, and everything they depend on."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.operators.windows import running
from assetlake.session import Grown, materialize
from assetlake.violations import all_of, violation

MAX_KEYS = 256
MAX_PATTERNS = 128
MAX_PATTERN_BYTES = 2048


#: Classes by name inside brackets, and what Java calls them. Fixed values.
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit",
    "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper",
    "xdigit": "XDigit",
}
_REPEAT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
_GROUP = re.compile(r"\(\?P?<([A-Za-z_][\w.\[\]]*)>")
_FLAGS = re.compile(r"\(\?([imsxu]*)(?:-([imsx]+))?([:)])")


def _bracket(pattern: str, i: int) -> tuple[str, int]:
    """The bracket class at ``i`` in Java's form, and where it ends."""
    out, i = "[", i + 1
    if pattern[i : i + 1] == "^":
        out, i = out + "^", i + 1
    if pattern[i : i + 1] == "]":  # a leading bracket stands for itself
        out, i = out + r"\]", i + 1
    while i < len(pattern):
        ch = pattern[i]
        named = re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:])
        if ch == "]":
            return out + "]", i + 1
        if named and named[2] in _POSIX:
            out, i = out + rf"\{'P' if named[1] else 'p'}{{{_POSIX[named[2]]}}}", i + named.end()
        elif ch == "[":
            inner, i = _bracket(pattern, i)
            out += inner
        elif pattern.startswith(("--", "~~"), i):
            raise ValueError(f"unsupported class operation in pattern {pattern!r}")
        elif ch == "\\":
            out, i = out + pattern[i : i + 2], i + 2
        else:
            out, i = out + ch, i + 1
    raise ValueError(f"unclosed class in pattern {pattern!r}")


def java_pattern(pattern: str) -> str:
    """Check one configured pattern and write it so that Java gives it the expected meaning.

    Without multi-line mode ``$`` is the very end; a dot and line anchors know the line feed only; a repetition may
    be repeated; names of groups do not matter. Look-around, back-references, atomic and possessive groups are
    refused: the patterns must be matchable in linear time.
    """
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError("pattern too long")
    out: list[str] = []
    groups: list[tuple[int, bool]] = []  # where each open group starts, and the mode outside it
    atom: int | None = None  # where the last repeatable item starts
    repeated = lines = False
    i = 0
    while i < len(pattern):
        ch, start, was = pattern[i], len(out), repeated
        repeated = False
        if ch == "\\":
            if re.match(r"\\(?:[1-9]|k[<{']|G|Z|Q|R|X|N|h|H|K)|\\\Z", pattern[i:]):
                raise ValueError(f"unsupported escape in pattern {pattern!r}")
            wide = re.match(r"\\(?:[pP]\{[^}]*\}|x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4})", pattern[i:])
            token = wide[0] if wide else pattern[i : i + 2]
            out.append(token)
            atom, i = start, i + len(token)
        elif ch == "[":
            token, i = _bracket(pattern, i)
            out.append(token)
            atom = start
        elif ch == "(":
            flags = _FLAGS.match(pattern, i)
            name = _GROUP.match(pattern, i)
            inside = lines
            if flags and (flags[1] or flags[2] or flags[3] == ":"):
                on, off = flags[1].replace("u", ""), flags[2] or ""
                inside = (lines or "m" in on) and "m" not in off
                out.append(f"(?{on}{'-' + off if off else ''}{flags[3]}")
                i = flags.end()
                if flags[3] == ")":  # for the rest of the enclosing group
                    lines, atom = inside, None
                    continue
            elif name:
                out.append("(")
                i = name.end()
            elif pattern.startswith("(?", i):
                raise ValueError(f"unsupported construct in pattern {pattern!r}")
            else:
                out.append("(")
                i += 1
            groups.append((start, lines))
            lines, atom = inside, None
        elif ch == ")":
            if not groups:
                raise ValueError(f"unopened group in pattern {pattern!r}")
            atom, lines = groups.pop()
            out.append(")")
            i += 1
        elif m := _REPEAT.match(pattern, i):
            if atom is None:
                raise ValueError(f"nothing to repeat in pattern {pattern!r}")
            if was:
                out[atom:] = ["(?:", *out[atom:], ")"]
            i = m.end()
            lazy = pattern[i : i + 1] == "?"
            out.append(m[0] + "?" * lazy)
            i, repeated = i + lazy, True
        elif ch == "{":
            raise ValueError(f"bad repetition in pattern {pattern!r}")
        else:
            out.append(r"\z" if ch == "$" and not lines else ch)
            atom, i = (None if ch == "|" else start), i + 1
    if groups:
        raise ValueError(f"unclosed group in pattern {pattern!r}")
    return "(?Ud)" + "".join(out)


def java_patterns(patterns: Sequence[str]) -> list[str]:
    if len(patterns) > MAX_PATTERNS:
        raise ValueError("too many patterns")
    return [_compiled(java_pattern(p)) for p in patterns]


def _compiled(pattern: str) -> str:
    """Compile once on the driver, so that a bad pattern is an error here and not in a task."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise ValueError(f"bad pattern {pattern!r}") from e
    return pattern


def matches_any(patterns: Sequence[str], *columns: Column) -> Column:
    """Unanchored match of any pattern on any column; false for no pattern."""
    out = F.lit(False)
    for pattern in java_patterns(patterns):
        for c in columns:
            out = out | c.rlike(pattern)
    return out


def matches_policy(include: Sequence[str], exclude: Sequence[str], *columns: Column) -> Column:
    """Exclude wins; an empty include list means everything."""
    wanted = matches_any(include, *columns) if include else F.lit(True)
    return wanted & ~matches_any(exclude, *columns)


def resolve_keys(keys: DataFrame, locations: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Root ids ``(run, id)`` of the named keys (all locations for no name), and violations.

    ``keys`` has one row per (run, key, id); a key without any location has one row with a null id.
    """
    if len(names) > MAX_KEYS:
        raise ValueError("too many keys")
    if not names:
        roots = locations.select("run", "id")
        return roots, violation(roots.limit(0), "unknown_key", F.col("id"))
    wanted = sorted(set(names))
    named = keys.where(F.col("key").isin(wanted))
    filled = named.where("id IS NOT NULL").select("run", "key").distinct()
    runs = locations.select("run").distinct()
    asked = runs.select("run", F.explode(F.array(*[F.lit(n) for n in wanted])).alias("key"))
    unknown = violation(asked.join(filled, ["run", "key"], "left_anti"), "unknown_key", F.col("key"))
    ids = named.where("id IS NOT NULL").select("run", "id").distinct()
    dangling = violation(
        ids.join(locations.select("run", "id"), ["run", "id"], "left_anti"), "dangling_key", F.col("id")
    )
    return ids, all_of(unknown, dangling)


def filter_roots(
    roots: DataFrame, locations: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Keep roots whose primary key or internal id passes the patterns."""
    ok = matches_policy(include, exclude, F.col("primary_key"), F.col("internal_id"))
    kept = locations.where(ok).select("run", "id")
    return roots.join(kept, ["run", "id"], "left_semi")


def require_roots(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """Runs left without any root."""
    empty = runs.select("run").distinct().join(roots.select("run").distinct(), "run", "left_anti")
    return violation(empty, "empty_selection", F.col("run"))


def _spread(start: DataFrame, locations: DataFrame, scope: list[str], bits: bool = False) -> DataFrame:
    """Rows reachable from ``start`` (``*scope``, ``id`` and, if asked, ``bits``, which run along the edges).

    Edges are stored in buckets by their start, and what was found by its keys: neither is shuffled again, only the rows
    found last (unless ``run`` is the only scope) and what they lead to are. Each round is stored, so a lost executor
    never replays earlier ones. The number of rounds is the greatest distance from a start.
    """
    spark, keys = start.sparkSession, [*scope, "id"]
    edges = Grown(spark, "edges", ["run", "id"])
    edges.add(locations.select("run", "id", F.explode("dependencies").alias("_to")).repartition(edges.buckets, "run", "id"))
    found = Grown(spark, "found", keys)
    rows, rounds = start.repartition(found.buckets, *keys), 0
    while found.add(rows, rounds):
        step = found.rows(rounds).join(edges.rows(), ["run", "id"]).withColumn("id", F.col("_to")).drop("_to")
        if bits:
            step = step.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
            seen = found.rows().groupBy(*keys).agg(F.bit_or("bits").alias("_seen"))
            fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
            rows = step.join(seen, keys, "left").select(*keys, fresh.alias("bits")).where("bits != 0")
        else:
            rows = step.select(*keys).distinct().join(found.rows(), keys, "left_anti")
        rounds += 1
    edges.end()
    return found.end()


def closure(roots: DataFrame, locations: DataFrame) -> DataFrame:
    """Everything reachable from the roots, cycles included once.

    ``roots`` has ``run``, ``id`` and any further scope columns, each scope being closed on its own.
    """
    scope = [c for c in roots.columns if c != "id"]
    return _spread(roots.select(*scope, "id").distinct(), locations, scope).select(*scope, "id")


#: Labels in one block: the bits of a long.
BLOCK = 64


def label_closure(keys: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each label (``run``, ``key``, ``id``) reaches: (``run``, ``key``, ``block``, ``bit``) numbers the labels, and
    (``run``, ``block``, ``id``, ``bits``) tells for each node which labels of a block reach it.

    A node has a row per block of labels that reach it, not one per label, and rows travel the edges once for all labels
    of a block that come in the same round.
    """
    roots = keys.where("id IS NOT NULL").select("run", "key", "id")
    numbered = running(roots.select("run", "key").distinct(), ["run"], [F.col("key")], row_number="_n")
    place = F.col("_n") - 1
    labels = materialize(
        numbered.select("run", "key", F.expr(f"(_n - 1) div {BLOCK}").alias("block"), (place % BLOCK).cast("int").alias("bit")), "labels"
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    start = roots.join(labels, ["run", "key"]).groupBy("run", "block", "id").agg(F.bit_or(bit).alias("bits"))
    reached = _spread(start, locations, ["run", "block"], bits=True)
    return labels, reached


def dangling_dependencies(selected: DataFrame, locations: DataFrame) -> DataFrame:
    """Selected ids that no location row describes."""
    missing = selected.select("run", "id").distinct().join(locations.select("run", "id"), ["run", "id"], "left_anti")
    return violation(missing, "dangling_dependency", F.col("id"))


def select_locations(selected: DataFrame, locations: DataFrame) -> DataFrame:
    return locations.join(selected.select("run", "id").distinct(), ["run", "id"], "left_semi")


def priority_rank(path: Column, patterns: Sequence[str]) -> Column:
    """Index of the first matching pattern, else the number of patterns."""
    java = java_patterns(patterns)
    rank = F.lit(len(java))
    for i in reversed(range(len(java))):
        rank = F.when(path.rlike(java[i]), F.lit(i)).otherwise(rank)
    return rank.cast("long")


def prioritize(assets: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Add ``rank``; download order is ``(rank, relative_path)`` within a run."""
    return assets.withColumn("rank", priority_rank(F.col("relative_path"), patterns))


def scope_flags(selected: DataFrame, locations: DataFrame) -> DataFrame:
    """Per run: selected and all locations, and whether the selection is the whole catalog."""
    both = locations.select("run", F.lit(0).alias("s"), F.lit(1).alias("a")).unionByName(
        selected.select("run", F.lit(1).alias("s"), F.lit(0).alias("a"))
    )
    return (
        both.groupBy("run")
        .agg(F.sum("s").alias("selected_locations"), F.sum("a").alias("all_locations"))
        .withColumn("full_catalog", F.col("selected_locations") == F.col("all_locations"))
    )


def key_overlap(keys: DataFrame, locations: DataFrame, paths: DataFrame, base: str) -> DataFrame:
    """Per label: files after closure, how many the base label also has, and how many only it has.

    ``paths`` maps ``(run, id)`` to ``relative_path``. Labels are compared with the base label and with "any other
    label" through per-file bits, never pair by pair, and files never become a row per label.
    """
    labels, reached = label_closure(keys, locations)
    files = reached.join(paths.select("run", "id", "relative_path"), ["run", "id"])
    files = materialize(files.groupBy("run", "block", "relative_path").agg(F.bit_or("bits").alias("bits")), "label-files")
    based = labels.where(F.col("key") == base).select("run", F.col("block").alias("_block"), F.col("bit").alias("_bit"))
    own = F.call_function("shiftrightunsigned", F.col("bits"), F.col("_bit")).bitwiseAND(F.lit(1).cast("long"))
    of_base = (F.col("block") == F.col("_block")) & (own == 1)
    # Runs without the base label keep their files.
    per_file = files.join(based, "run", "left").groupBy("run", "relative_path").agg(
        F.sum(F.bit_count("bits")).alias("labels"), F.max(F.coalesce(of_base, F.lit(False))).alias("in_base")
    )
    marked = files.join(per_file, ["run", "relative_path"]).groupBy("run", "block", "in_base", (F.col("labels") == 1).alias("_alone"))
    sums = marked.agg(*[F.sum(F.shiftrightunsigned("bits", n).bitwiseAND(F.lit(1).cast("long"))).alias(f"_{n}") for n in range(BLOCK)])
    each = F.array(*[F.struct(F.lit(n).alias("bit"), F.col(f"_{n}").alias("n")) for n in range(BLOCK)])
    per_bit = sums.select("run", "block", "in_base", "_alone", F.inline(each)).where("n > 0").join(labels, ["run", "block", "bit"])
    counts = per_bit.groupBy("run", "key").agg(
        F.sum("n").alias("files"),
        F.sum(F.when(F.col("in_base"), F.col("n")).otherwise(0)).alias("in_base"),
        F.sum(F.when(F.col("_alone"), F.col("n")).otherwise(0)).alias("exclusive"),
    )
    return counts.withColumn("outside_base", F.col("files") - F.col("in_base")).withColumn(
        "relation",
        F.when(F.col("in_base") == 0, "disjoint").when(F.col("in_base") == F.col("files"), "subset").otherwise("overlap"),
    )
