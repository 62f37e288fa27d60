"""From locations to a download plan: one asset per path, with every conflict reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import ancestors, ascii_lower, safe_relative
from assetlake.session import of_known_size
from assetlake.violations import all_of, violation

# Provider ids as stored in catalogs, and the two path prefixes they use.
PROVIDERS = {
    "Fwk.Crypt.AssetBundleCryptProvider": "encrypted_bundle",
    "UnityEngine.ResourceManagement.ResourceProviders.AssetBundleProvider": "unity_bundle",
    "CriWare.Assets.CriResourceProvider": "cri",
    "UnityEngine.ResourceManagement.ResourceProviders.BundledAssetProvider": "logical",
}
REMOTE_PREFIX = "{Fwk.Resource.RemoteAssetDir}/"
RUNTIME_PREFIX = "{UnityEngine.AddressableAssets.Addressables.RuntimePath}/"

MAX_FILE_BYTES = 512 * 1024**2
MAX_TOTAL_BYTES = 16 * 1024**3


def provider_of(provider_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, provider in PROVIDERS.items():
        out = F.when(provider_id == name, F.lit(provider)).otherwise(out)
    return out


def classify_provider(locations: DataFrame) -> DataFrame:
    """Add ``provider``; null for an unknown id."""
    return locations.withColumn("provider", provider_of(F.col("provider_id")))


def provider_violations(classified: DataFrame) -> DataFrame:
    return violation(
        classified.where(F.col("provider").isNull()), "unknown_provider", F.col("id"), F.col("provider_id")
    )


def resolve_paths(classified: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``relative_path`` (null if unresolvable or unsafe) and ``embedded`` to non-logical locations.

    ``targets`` has one row per run: ``base`` directory and nullable ``placeholder``.
    """
    df = classified.where(F.col("provider") != "logical").join(
        of_known_size(targets.select("run", "base", "placeholder"), "targets"), "run", "left"
    )
    internal = F.col("internal_id")

    def under(prefix: Column) -> tuple[Column, Column]:
        return F.startswith(internal, prefix), F.substring(internal, F.length(prefix) + 1, F.length(internal))

    rules = [
        under(F.lit(REMOTE_PREFIX)),
        under(F.concat("base", F.lit("/"))),
        under(F.concat("placeholder", F.lit("/"))),
        under(F.lit(RUNTIME_PREFIX)),
    ]
    path = F.lit(None).cast("string")
    for test, rest in reversed(rules):
        path = F.when(test, rest).otherwise(path)
    remote = rules[0][0] | F.coalesce(rules[1][0], F.lit(False)) | F.coalesce(rules[2][0], F.lit(False))
    return (
        df.withColumn("relative_path", path)
        .withColumn("relative_path", F.when(safe_relative(F.col("relative_path")), F.col("relative_path")))
        .withColumn("embedded", ~remote & rules[3][0])
        .drop("base", "placeholder")
    )


def path_violations(resolved: DataFrame) -> DataFrame:
    return violation(
        resolved.where(F.col("relative_path").isNull()), "asset_path", F.col("id"), F.col("internal_id")
    )


def remote_locations(resolved: DataFrame) -> DataFrame:
    return resolved.where(~F.col("embedded") & F.col("relative_path").isNotNull())


def plan_assets(resolved: DataFrame) -> DataFrame:
    """One row per ``(run, relative_path)``: the provider of its first location and how many there are.

    The ids themselves stay one per row (:func:`asset_locations`): a path named by a third of all
    locations must not become one array in one task.
    """
    return (
        remote_locations(resolved)
        .groupBy("run", "relative_path")
        .agg(
            F.min_by("provider", "id").alias("provider"),
            F.min("id").alias("first_location"),
            F.count(F.lit(1)).alias("locations"),
        )
    )


def asset_locations(resolved: DataFrame) -> DataFrame:
    return remote_locations(resolved).select("run", "relative_path", "id", "provider")


def provider_conflicts(resolved: DataFrame) -> DataFrame:
    clash = (
        remote_locations(resolved)
        .groupBy("run", "relative_path")
        .agg(F.min("provider").alias("a"), F.max("provider").alias("b"))
        .where("a <> b")
    )
    return violation(clash, "provider_conflict", F.col("relative_path"), F.concat_ws(",", "a", "b"))


def casefold_conflicts(assets: DataFrame) -> DataFrame:
    clash = (
        assets.groupBy("run", ascii_lower(F.col("relative_path")).alias("folded"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return violation(clash, "casefold_conflict", F.col("folded"), F.col("n"))


def ancestor_conflicts(assets: DataFrame) -> DataFrame:
    """Paths that are also a directory of another path, ignoring ASCII case.

    Ancestors are made distinct before the join, so a directory above a third of all files is one row.
    """
    folded = assets.select("run", ascii_lower(F.col("relative_path")).alias("path")).distinct()
    above = folded.select("run", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return violation(folded.join(above, ["run", "path"], "left_semi"), "ancestor_conflict", F.col("path"))


def plan_counts(classified: DataFrame, resolved: DataFrame) -> DataFrame:
    """Remote assets, embedded and logical locations per run, in one aggregation."""
    logical = classified.where(F.col("provider") == "logical").select(
        "run", F.lit(None).cast("string").alias("path"), F.lit(0).alias("e"), F.lit(1).alias("l")
    )
    physical = resolved.where(F.col("relative_path").isNotNull()).select(
        "run",
        F.when(~F.col("embedded"), F.col("relative_path")).alias("path"),
        F.col("embedded").cast("int").alias("e"),
        F.lit(0).alias("l"),
    )
    per_path = logical.unionByName(physical).groupBy("run", "path").agg(F.sum("e").alias("e"), F.sum("l").alias("l"))
    return per_path.groupBy("run").agg(
        F.count("path").alias("remote_files"),
        F.sum("e").alias("embedded_locations"),
        F.sum("l").alias("logical_locations"),
    )


def size_violations(
    receipts: DataFrame, max_file_bytes: int = MAX_FILE_BYTES, max_total_bytes: int = MAX_TOTAL_BYTES
) -> DataFrame:
    bytes_ = F.col("bytes")
    files = receipts.where((bytes_ <= 0) | (bytes_ > max_file_bytes))
    totals = receipts.groupBy("run").agg(F.sum("bytes").alias("total")).where(F.col("total") > max_total_bytes)
    return all_of(
        violation(
            files,
            F.when(bytes_ <= 0, F.lit("empty_file")).otherwise(F.lit("file_too_large")),
            F.col("relative_path"),
            bytes_,
        ),
        violation(totals, "total_too_large", F.col("run"), F.col("total")),
    )
