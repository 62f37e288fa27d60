"""Choosing what an export covers, and summing up its journal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import safe_path
from assetlake.operators.selection import matches_policy
from assetlake.operators.windows import running
from assetlake.violations import all_of, violation


def explode_outputs(journal: DataFrame) -> DataFrame:
    """One row per output, in journal order; ``failed`` tells outputs of failed resources apart."""
    rows = journal.select(
        "run",
        "source",
        "output_directory",
        F.col("output_directory").cast("long").alias("resource_index"),
        "source_sha256",
        (F.size("errors") > 0).alias("failed"),
        F.posexplode("outputs").alias("position", "o"),
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("o", "position")],
        F.col("position").cast("long").alias("position"),
        "o.path", "o.kind", "o.bytes", "o.sha256", "o.object.*",
    )


def filter_resources(
    receipts: DataFrame,
    providers: Sequence[str] = (),
    paths: DataFrame | None = None,
    raw_only: bool = False,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Receipts taking part: by provider family, explicit paths ``(run, relative_path)`` and raw patterns."""
    family = F.when(F.col("provider") == "cri", "cri").otherwise("unity")
    out = receipts.where(family.isin(list(providers))) if providers else receipts
    if paths is not None:
        out = out.join(paths.select("run", "relative_path").distinct(), ["run", "relative_path"], "left_semi")
    if raw_only:
        path = F.col("relative_path")
        out = out.where(
            (F.col("provider") != "cri") & safe_path(path, 2048) & matches_policy(include, exclude, path)
        )
    return out


def unknown_paths(filtered: DataFrame, paths: DataFrame) -> DataFrame:
    missing = paths.select("run", "relative_path").distinct().join(
        filtered.select("run", "relative_path"), ["run", "relative_path"], "left_anti"
    )
    return violation(missing, "unknown_path", F.col("relative_path"))


def filter_objects(objects: DataFrame, class_ids: Sequence[int] = ()) -> DataFrame:
    """Per resource: objects, selected and skipped (every class is selected for an empty list)."""
    selected = F.col("class_id").isin(list(class_ids)) if class_ids else F.lit(True)
    return objects.groupBy("run", "resource").agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(selected).alias("selected_objects"),
        F.count_if(~selected).alias("skipped_objects"),
    )


# Which representation fits which class; the first three fit any positive class.
ANY_CLASS = ["auto", "object_raw", "typetree_json"]
CLASS_SUPPORT = {
    "image": [28, 213, 187],
    "image_archive": [187],
    "audio": [83],
    "video": [329, 152],
    "text_bytes": [49],
    "font": [128],
    "shader": [48],
    "obj": [43],
}


def supports(kind: Column, class_id: Column) -> Column:
    ok = kind.isin(ANY_CLASS) & (class_id > 0)
    for name, ids in CLASS_SUPPORT.items():
        ok = ok | ((kind == name) & class_id.isin(ids))
    return ok


def apply_policy(objects: DataFrame, classes: Mapping[int, str], default: str = "auto") -> DataFrame:
    """Add the representation ``kind`` and whether the class supports it."""
    if len(classes) > 256:
        raise ValueError("too many class rules")
    kind = F.lit(default)
    for class_id, name in sorted(classes.items()):
        kind = F.when(F.col("class_id") == class_id, F.lit(name)).otherwise(kind)
    return objects.withColumn("kind", kind).withColumn("supported", supports(F.col("kind"), F.col("class_id")))


def policy_violations(applied: DataFrame) -> DataFrame:
    pairs = applied.where(~F.col("supported")).groupBy("run", "class_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return violation(pairs, "unsupported_kind", F.col("class_id"), F.col("kind"))


def policy_is_native(classes: Mapping[int, str], default: str = "auto") -> bool:
    return default == "auto" and all(kind == "auto" for kind in classes.values())


def export_totals(journal: DataFrame) -> DataFrame:
    """Counters per run, folded per journal row first: nothing is exploded."""
    ok = F.size("errors") == 0
    return journal.groupBy("run").agg(
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.col("cache_hit")).alias("cache_hits"),
        F.sum(F.size("outputs").cast("long")).alias("output_files"),
        F.sum(F.aggregate("outputs", F.lit(0).cast("long"), lambda a, o: a + o["bytes"])).alias("output_bytes"),
        F.sum("objects").alias("unity_objects"),
        F.sum("selected_objects").alias("selected_unity_objects"),
        F.sum("skipped_objects").alias("skipped_unity_objects"),
    )


def payload_counts(journal: DataFrame) -> DataFrame:
    """Outputs per kind."""
    return (
        journal.select("run", F.explode("outputs.kind").alias("kind"))
        .groupBy("run", "kind")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def summarize(journal: DataFrame) -> DataFrame:
    """The export summary of each run, with its kind histogram as a map (kinds are few by design)."""
    kinds = payload_counts(journal).groupBy("run").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "files")))).alias("payloads")
    )
    return export_totals(journal).join(kinds, "run", "left").withColumn(
        "payloads", F.coalesce("payloads", F.create_map().cast("map<string,bigint>"))
    )


def completeness(totals: DataFrame, scope: DataFrame, native: bool = True, all_providers: bool = True, raw_only: bool = False) -> DataFrame:
    """``full_catalog``, ``full_export`` and ``complete`` per run.

    ``scope`` has ``input_files``, ``catalog_files`` and ``complete_selection``.
    """
    df = scope.join(totals, "run", "left")
    full = F.col("complete_selection") & (F.col("input_files") == F.col("catalog_files"))
    return df.select(
        "run",
        full.alias("full_catalog"),
        (full & F.lit(native and all_providers and not raw_only)).alias("full_export"),
        (
            (F.coalesce("failed", F.lit(0)) == 0)
            & (F.coalesce("succeeded", F.lit(0)) == F.col("input_files"))
            & (F.coalesce("output_files", F.lit(0)) > 0)
        ).alias("complete"),
    )


def partial_decision(summaries: DataFrame, allowances: Sequence[int]) -> DataFrame:
    """Whether a run may be published: complete, or partial within the smallest allowance of all targets."""
    allowed = min(allowances, default=0)
    c = F.col
    partial = (
        (c("failed") > 0)
        & (c("failed") <= allowed)
        & (c("succeeded") > 0)
        & (c("succeeded") + c("failed") == c("input_files"))
        & (c("output_files") > 0)
    )
    decision = F.when(partial, "partial").when(c("complete") & (c("failed") == 0), "complete").otherwise("rejected")
    return summaries.select("run", "failed", decision.alias("decision"))


def resource_budget(outputs: DataFrame, limit: int) -> DataFrame:
    """First output of each resource whose running size exceeds the limit."""
    totals = running(
        outputs, ["run", "output_directory"], [F.col("position")], sums={"running_bytes": "bytes"}
    )
    over = totals.where(F.col("running_bytes") > limit)
    first = over.groupBy("run", "output_directory").agg(
        F.min("position").alias("position"), F.min_by("running_bytes", "position").alias("running_bytes")
    )
    return violation(
        first, "resource_too_large", F.concat_ws(":", "output_directory", F.col("position").cast("string")),
        F.col("running_bytes"),
    )


# Words that mark a failure worth retrying.
TRANSIENT_MARKERS = [
    "timed out", "timeout", "connection reset", "connection refused", "connection aborted",
    "temporarily unavailable", "broken pipe", "i/o error", "input/output error", "signal", "killed",
]


def failure_class(text: Column) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for marker in TRANSIENT_MARKERS:
        hit = hit | low.contains(marker)
    return F.when(hit, "transient").otherwise("final")


def classify_failures(journal: DataFrame) -> DataFrame:
    """Errors per run and class."""
    errors = journal.select("run", F.explode("errors").alias("error"))
    return errors.groupBy("run", failure_class(F.col("error")).alias("failure_class")).agg(
        F.count(F.lit(1)).alias("errors")
    )


def expected_kinds(images: Sequence[str], audio: Sequence[str], video: str, codecs: Sequence[str] = ("hca", "adx")) -> dict[str, list[str]]:
    """Configured formats turned into the output kinds each media family must produce."""
    sound = [f for f in audio if f in ("mp3", "flac")]
    if "wav" in audio or "flac" not in audio:
        sound.append("wav")  # one lossless form always remains
    kinds = {"image": [f"image_{f}" for f in images]}
    for codec in codecs:
        kinds[codec] = [f"{codec}_{f}" for f in sound]
    kinds["video"] = {"mkv": ["usm_mkv"], "mp4": ["usm_mp4"], "mkv_and_mp4": ["usm_mp4", "usm_mkv"]}[video]
    return kinds


def expected_renditions(objects: DataFrame, actual: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Renditions that should exist but do not.

    ``objects`` has ``(run, object_id, media)``, ``actual`` ``(run, object_id, kind)``. The format list is
    a literal array per row, so no join is needed to expand it.
    """
    formats = F.lit(None).cast("array<string>")
    for media, names in kinds.items():
        formats = F.when(F.col("media") == media, F.array(*[F.lit(n) for n in names])).otherwise(formats)
    wanted = objects.select("run", "object_id", F.explode(formats).alias("kind"))
    missing = wanted.join(actual.select("run", "object_id", "kind"), ["run", "object_id", "kind"], "left_anti")
    return violation(missing, "rendition_missing", F.col("object_id"), F.col("kind"))
