"""What a publication uploads, keeps, carries forward and removes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import encode_segments, public_base_ok, safe_path
from assetlake.operators.selection import matches_any
from assetlake.operators.windows import previous as previous_values
from assetlake.session import of_known_size
from assetlake.violations import rule_violations

_CONTENT = ["bytes", "sha256", "content_type"]
MANIFEST = ["run", "path", "bytes", "sha256", "content_type", "source", "kind", "class_id", "container", "name"]


def compare_manifest(entries: DataFrame, previous: DataFrame) -> DataFrame:
    """Add ``pending``: true when the entry is new or its content or type changed."""
    old = previous.select("run", "path", *[F.col(c).alias(f"_p_{c}") for c in _CONTENT], F.lit(True).alias("_known"))
    same = F.coalesce("_known", F.lit(False))
    for c in _CONTENT:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return entries.join(old, ["run", "path"], "left").select(*entries.columns, (~same).alias("pending"))


def pending(entries: DataFrame, previous: DataFrame) -> DataFrame:
    return compare_manifest(entries, previous).where("pending").drop("pending")


def unchanged(entries: DataFrame, previous: DataFrame) -> DataFrame:
    return compare_manifest(entries, previous).where("NOT pending").drop("pending")


def carried(previous: DataFrame, failed: DataFrame, entries: DataFrame) -> DataFrame:
    """Previous files of failed sources that no new entry claims (ignoring case)."""
    claimed = entries.select("run", F.lower("path").alias("_folded")).distinct()
    return (
        previous.join(failed.select("run", "source").distinct(), ["run", "source"], "left_semi")
        .withColumn("_folded", F.lower("path"))
        .join(claimed, ["run", "_folded"], "left_anti")
        .select(*previous.columns)
    )


def prunable(previous: DataFrame, entries: DataFrame, carried_entries: DataFrame) -> DataFrame:
    """Previous paths that neither a new nor a carried entry keeps."""
    kept = entries.select("run", "path").unionByName(carried_entries.select("run", "path"))
    return previous.join(kept, ["run", "path"], "left_anti")


def next_manifest(entries: DataFrame, carried_entries: DataFrame) -> DataFrame:
    return entries.select(*MANIFEST).unionByName(carried_entries.select(*MANIFEST))


def stable_counts(
    entries: DataFrame, previous: DataFrame, failed: DataFrame, claims: DataFrame | None = None, prune: bool = True
) -> DataFrame:
    """All counters of a publication, per run, in one final aggregation."""
    kept = carried(previous, failed, entries)
    names = ["files", "uploaded", "unchanged", "pruned", "deduplicated", "renamed", "failed_resources", "carried_forward", "bytes"]

    def part(df: DataFrame, **values: Column) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select("run", *[values.get(n, zero).cast("long").alias(n) for n in names])

    one = F.lit(1)
    parts = [
        part(
            compare_manifest(entries, previous),
            files=one, uploaded=F.col("pending").cast("long"), unchanged=(~F.col("pending")).cast("long"),
            bytes=F.col("bytes"),
        ),
        part(failed.select("run", "source").distinct(), failed_resources=one),
        part(kept, carried_forward=one, bytes=F.col("bytes")),
    ]
    if prune:
        parts.append(part(prunable(previous, entries, kept), pruned=one))
    if claims is not None:
        parts.append(part(claims, deduplicated=F.col("deduplicated"), renamed=F.col("renamed")))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("run").agg(*[F.sum(n).alias(n) for n in names])


def version_record(counts: DataFrame, publications: DataFrame) -> DataFrame:
    """The record written last. ``publications``: ``(run, region, publication_id, release, completed_at)``."""
    fields = [
        F.lit(1).alias("schema_version"),
        F.lit("stable").alias("layout"),
        F.col("region"),
        F.col("publication_id"),
        F.col("release"),
        (F.col("files") + F.col("carried_forward")).alias("files"),
        *[F.col(n) for n in ("bytes", "uploaded", "unchanged", "pruned", "deduplicated", "renamed")],
        *[F.when(F.col(n) > 0, F.col(n)).alias(n) for n in ("failed_resources", "carried_forward")],
        F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("completed_at"),
    ]
    return counts.join(publications, "run").select("run", F.to_json(F.struct(*fields)).alias("record"))


def _template(text: Column, region: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{region}"), region), F.lit("{server}"), region)


def locations_of(entries: DataFrame, runs: DataFrame, providers: Sequence[Mapping[str, object]]) -> DataFrame:
    """Storage key and public address of every entry at every provider.

    ``runs`` has ``(run, region, publication_id)``. The few configured providers are literals, expanded
    per row, so the table of entries is neither joined with them nor shuffled.
    """
    if not 1 <= len(providers) <= 16:
        raise ValueError("1 to 16 providers")
    items = F.array(
        *[
            F.struct(
                F.lit(p["name"]).alias("name"),
                F.lit(p["prefix"]).alias("prefix"),
                F.lit(p.get("public_base_url")).cast("string").alias("base"),
                F.lit(bool(p.get("stable"))).alias("stable"),
            )
            for p in providers
        ]
    )
    df = entries.join(of_known_size(runs.select("run", "region", "publication_id"), "runs"), "run").withColumn("p", F.explode(items))
    region = F.col("region")
    prefix = _template(F.col("p.prefix"), region)
    prefix = F.when(F.col("p.stable"), prefix).otherwise(
        F.concat(prefix, F.lit("/"), region, F.lit("/publications/"), F.col("publication_id"))
    )
    base = F.regexp_replace(_template(F.col("p.base"), region), "/+\\z", "")
    df = df.withColumn("storage_key", F.concat(prefix, F.lit("/"), F.col("path")))
    return df.select(
        "run", "path", F.col("p.name").alias("provider"), "storage_key",
        F.concat(base, F.lit("/"), encode_segments(F.col("storage_key"))).alias("public_url"),
        _template(F.col("p.base"), region).alias("public_base"),
    )


def location_violations(located: DataFrame) -> DataFrame:
    """Unresolved braces and unusable public bases; reported per run and provider."""
    per_provider = located.groupBy("run", "provider").agg(
        F.max(F.col("storage_key").rlike(r"[{}]").cast("int")).alias("_open"), F.min("public_base").alias("_base")
    )
    return rule_violations(
        per_provider,
        F.col("provider"),
        {
            "unresolved_template": (F.col("_open") == 0) & ~F.coalesce(F.col("_base").rlike(r"[{}]"), F.lit(False)),
            "public_base": F.col("_base").isNull() | public_base_ok(F.col("_base")),
        },
    )


def public_read(entries: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), everything: bool = False) -> DataFrame:
    """Add ``public``: everything or any include matches, and no exclude does."""
    path = F.col("path")
    wanted = F.lit(True) if everything else matches_any(include, path)
    return entries.withColumn("public", wanted & ~matches_any(exclude, path))


def raw_paths(df: DataFrame, prefix: str = "raw") -> DataFrame:
    """Add ``raw_path``; null where source or result is unsafe or too long."""
    source = F.col("source")
    ok = safe_path(source, 2048) & (F.octet_length(source) + len(prefix.encode()) + 1 <= 4096)
    return df.withColumn("raw_path", F.when(ok, F.concat(F.lit(prefix + "/"), source)))


def manifest_history(manifests: DataFrame) -> DataFrame:
    """Life of every key over the ordered versions of its target.

    ``uploads`` counts first appearance, content changes and returns after a gap; ``pruned_in`` is the
    first version without the key after its last appearance, if any.
    """
    versions = manifests.select("target", "version").distinct()
    order = previous_values(versions, ["target"], [F.col("version")], {"_before": "version"})
    after = previous_values(versions, ["target"], [F.col("version").desc()], {"_after": "version"})
    known = order.select("target", "version", "_before").join(
        after.select("target", "version", "_after"), ["target", "version"]
    )
    rows = manifests.select("target", "version", "path", *_CONTENT).join(known, ["target", "version"])
    lagged = previous_values(
        rows, ["target", "path"], [F.col("version")],
        {"_v": "version", **{f"_l_{c}": c for c in _CONTENT}},
    )
    upload = F.col("_first") | ~F.col("_v").eqNullSafe(F.col("_before"))
    for c in _CONTENT:
        upload = upload | ~F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    return lagged.groupBy("target", "path").agg(
        F.min("version").alias("first_version"),
        F.max("version").alias("last_version"),
        F.count_if(upload).alias("uploads"),
        F.max_by("_after", "version").alias("pruned_in"),
    )
