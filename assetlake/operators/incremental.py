"""What earlier work can be reused, and what a bounded cache would keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import fingerprint, multiset_digest
from assetlake.operators.sides import side_by_side
from assetlake.operators.windows import newest, running
from assetlake.violations import violation

# Provider tags in download identities.
PROVIDER_TAGS = {"encrypted_bundle": "encrypted", "unity_bundle": "unity", "cri": "cri"}
CACHE_SCHEMA = 1


def _terminated(*parts: Column) -> Column:
    return F.concat(*[F.concat(p, F.lit("\x00")) for p in parts])


def download_identity(df: DataFrame) -> DataFrame:
    """Add ``identity``: the SHA-256 that names a downloaded file across runs."""
    scope = F.concat_ws(":", "region", "environment", "platform", "catalog_url")
    tag = F.lit(None).cast("string")
    for provider, name in PROVIDER_TAGS.items():
        tag = F.when(F.col("provider") == provider, F.lit(name)).otherwise(tag)
    return df.withColumn(
        "identity", F.sha2(_terminated(scope, F.col("catalog_sha256"), F.col("relative_path"), tag), 256)
    )


def dependency_digests(receipts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Per owner: one digest over its dependencies' paths and stored digests, order-free and combinable."""
    stored = receipts.select("run", F.col("relative_path").alias("dependency"), F.col("stored_sha256").alias("sha"))
    row = fingerprint(F.col("dependency"), F.col("sha"))
    return (
        dependencies.join(stored, ["run", "dependency"])
        .select("run", F.col("owner").alias("relative_path"), row.alias("_row"))
        .groupBy("run", "relative_path")
        .agg(multiset_digest(F.col("_row")).alias("dependency_sha256"))
    )


def dependency_violations(receipts: DataFrame, dependencies: DataFrame) -> DataFrame:
    stored = receipts.select("run", F.col("relative_path").alias("dependency"))
    return violation(
        dependencies.join(stored, ["run", "dependency"], "left_anti"),
        "dependency_not_received", F.col("dependency"), F.col("owner"),
    )


def content_identity(receipts: DataFrame, dependencies: DataFrame, scope: Column | str = "") -> DataFrame:
    """Add ``own_sha256``, ``dependency_sha256`` and ``identity`` of the decoded output of each file.

    Two files get the same identity exactly when scope, path, provider, stored digest, decryption flag
    and the set of (dependency path, digest) agree.
    """
    scope = F.lit(scope) if isinstance(scope, str) else scope
    df = receipts.join(dependency_digests(receipts, dependencies), ["run", "relative_path"], "left")
    own = fingerprint(
        scope.alias("scope"), F.col("relative_path"), F.col("provider"), F.col("stored_sha256"), F.col("decrypted")
    )
    return (
        df.withColumn("dependency_sha256", F.coalesce("dependency_sha256", F.lit("")))
        .withColumn("own_sha256", own)
        .withColumn("identity", F.sha2(F.concat("own_sha256", "dependency_sha256"), 256))
    )


def cache_plan(wanted: DataFrame, index: DataFrame, max_bytes: int) -> DataFrame:
    """``hit``, ``invalid`` (stored but unusable, so redone) or ``miss`` for every wanted identity."""
    stored = index.select(
        "identity", "schema", "entry_identity", "errors", "report_sha256", "actual_sha256", F.col("bytes").alias("_bytes")
    )
    usable = (
        (F.col("schema") == CACHE_SCHEMA)
        & (F.col("entry_identity") == F.col("identity"))
        & (F.col("errors") == 0)
        & (F.col("report_sha256") == F.col("actual_sha256"))
        & F.col("_bytes").between(1, max_bytes)
    )
    status = (
        F.when(F.col("schema").isNull(), "miss")
        .when(F.coalesce(usable, F.lit(False)), "hit")
        .otherwise("invalid")
    )
    return wanted.join(stored, "identity", "left").select(
        *wanted.columns, status.alias("status"), F.when(status == "hit", F.col("_bytes")).alias("cached_bytes")
    )


def lru_survivors(
    index: DataFrame, max_bytes: int | None = None, max_entries: int | None = None
) -> DataFrame:
    """Entries left after evicting the oldest (by access time, then identity) until both limits hold.

    Counted from the newest entry, sizes only grow, so the kept entries are those within both limits. Only what can
    be within them is put in order.
    """
    head = newest(index, ["cache_id"], "accessed_at", max_entries, {} if max_bytes is None else {"bytes": max_bytes})
    ranked = running(
        head,
        ["cache_id"],
        [F.col("accessed_at").desc(), F.col("identity").desc()],
        row_number="_n",
        sums={"_bytes": "bytes"},
    )
    keep = F.lit(True)
    if max_bytes is not None:
        keep = keep & (F.col("_bytes") <= max_bytes)
    if max_entries is not None:
        keep = keep & (F.col("_n") <= max_entries)
    return ranked.where(keep).drop("_n", "_bytes")


def admit(index: DataFrame, max_bytes: int) -> DataFrame:
    """Entries small enough to be cached at all; the others stay outputs only."""
    return index.where(F.col("bytes") <= max_bytes)


def reuse_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """How the files of two versions relate, with the number and size of those to redo.

    Both sides come from :func:`content_identity` with ``bytes``; ``run`` names the pair of versions.
    """
    both = side_by_side(before, after, ["run", "relative_path"], ["identity", "own_sha256", "bytes"])
    reason = (
        F.when(F.col("n_left") == 0, "added")
        .when(F.col("n_right") == 0, "removed")
        .when(F.col("l_identity") == F.col("r_identity"), "reused")
        .when(F.col("l_own_sha256") == F.col("r_own_sha256"), "dependency_only")
        .otherwise("changed")
    )
    return (
        both.withColumn("reason", reason)
        .groupBy("run", "reason")
        .agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("r_bytes", "l_bytes")).alias("bytes"))
    )
