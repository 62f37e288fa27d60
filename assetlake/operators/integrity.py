"""Reconciling what was promised (plans, receipts, summaries) with what exists (journals, file trees)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import fingerprint, safe_path, valid_digest
from assetlake.operators.exports import export_totals, payload_counts
from assetlake.operators.selection import matches_policy
from assetlake.operators.sides import side_by_side
from assetlake.session import of_known_size
from assetlake.violations import all_of, rule_violations, violation

# Fixed values.
MAX_RECEIPT_BYTES = 2 * 1024**3
MAX_VERIFIED_BYTES = 128 * 1024**3
MAX_RESOURCES = 100_000
SUMMARY_SCHEMA = 4
BUNDLE_SIGNATURE = "556E697479465300"
LOSSY_FRAMES = 1152
#: Leading digits shared by what a node of a hash tree gathers, from its leaves to its root.
TREE_WIDTHS = (6, 3, 0)


def receipt_vs_plan(receipts: DataFrame, assets: DataFrame) -> DataFrame:
    """Every planned path exactly once in the receipts, with the planned provider."""
    both = side_by_side(assets, receipts, ["run", "relative_path"], ["provider"])
    return rule_violations(
        both,
        F.col("relative_path"),
        {
            "receipt_missing": F.col("n_right") > 0,
            "receipt_unplanned": F.col("n_left") > 0,
            "receipt_repeated": F.col("n_right") <= 1,
            "receipt_provider": (F.col("n_left") == 0)
            | (F.col("n_right") == 0)
            | (F.col("l_provider") == F.col("r_provider")),
        },
    )


def receipt_rules(receipts: DataFrame) -> DataFrame:
    return rule_violations(
        receipts,
        F.col("relative_path"),
        {
            "receipt_bytes": F.col("bytes").between(1, MAX_RECEIPT_BYTES),
            "receipt_decrypted": ~F.col("decrypted") | (F.col("provider") == "encrypted_bundle"),
            "receipt_digest": F.col("decrypted") | (F.col("stored_sha256") == F.col("downloaded_sha256")),
        },
    )


def content_check(receipts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Size, digest and leading bytes of the stored file agree with its receipt."""
    files = inventory.select(
        "run",
        F.col("path").alias("relative_path"),
        F.col("length").alias("_length"),
        F.col("sha256").alias("_sha"),
        F.col("prefix8").alias("_prefix"),
    )
    joined = receipts.join(files, ["run", "relative_path"], "left")
    absent = F.col("_length").isNull()
    bundle = F.col("decrypted") | (F.col("provider") == "unity_bundle")
    return rule_violations(
        joined,
        F.col("relative_path"),
        {
            "file_missing": ~absent,
            "file_size": absent | (F.col("_length") == F.col("bytes")),
            "file_digest": absent | (F.col("_sha") == F.col("stored_sha256")),
            "file_signature": absent | ~bundle | (F.hex("_prefix") == BUNDLE_SIGNATURE),
        },
    )


def receipt_totals(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("run").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("bytes").cast("decimal(38,0)")).cast("long").alias("bytes"),
        F.count_if("decrypted").alias("decrypted"),
    )


def total_violations(receipts: DataFrame, heads: DataFrame) -> DataFrame:
    """Summed bytes equal the stated total and stay within the overall limit."""
    joined = heads.select("run", "total_bytes").join(receipt_totals(receipts), "run", "left")
    bytes_ = F.coalesce("bytes", F.lit(0))
    return rule_violations(
        joined,
        F.col("run"),
        {"total_bytes": bytes_ == F.col("total_bytes"), "total_limit": bytes_ <= MAX_VERIFIED_BYTES},
        detail=bytes_,
    )


def tree_digest(rows: DataFrame, group: str, digest: str) -> DataFrame:
    """Per group the number of rows (``rows``) and the root of a hash tree over their SHA-256 (``root``).

    A leaf holds the rows whose digests share six hexadecimal digits, a branch the leaves that share three, so the
    tree depends on the rows alone and no task gathers more than a leaf or 4,096 children. Repeated rows are counted
    first. Other rows cannot be made to give the same root, as they could with a sum of digests.
    """
    counted = rows.groupBy(group, digest).agg(F.count(F.lit(1)).alias("rows"))
    node = counted.select(group, "rows", F.concat_ws(":", digest, "rows").alias("_part"))
    for width in TREE_WIDTHS:
        near = F.substring("_part", 1, width).alias("_near")
        gathered = node.groupBy(group, near).agg(
            F.sum("rows").alias("rows"), F.array_join(F.sort_array(F.collect_list("_part")), ",").alias("_parts")
        )
        node = gathered.select(group, "rows", F.concat_ws(":", "_near", F.sha2("_parts", 256)).alias("_part"))
    return node.select(group, "rows", F.substring("_part", -64, 64).alias("root"))


def graph_digest(locations: DataFrame) -> DataFrame:
    """One digest per run of the whole location graph; equal digests mean equal graphs."""
    row = fingerprint(
        *[F.col(c) for c in ("id", "primary_key", "internal_id", "provider_id", "dependencies")]
    )
    tree = tree_digest(locations.select("run", row.alias("_row")), "run", "_row")
    return tree.select("run", F.col("rows").alias("locations"), F.col("root").alias("graph_sha256"))


def summary_rules(summaries: DataFrame, max_failed: int = 0) -> DataFrame:
    """The invariants a summary must satisfy on its own.

    Besides the summary's fields: ``want_region`` (that of the receipt), ``kinds_valid``, ``native_kinds``,
    ``media_full``, ``raw_mode`` and ``raw_valid`` describe its stated options.
    """
    c = F.col
    raw_only = F.coalesce(c("raw_mode") == "only", F.lit(False))
    return rule_violations(
        summaries,
        c("run"),
        {
            "schema_version": c("schema_version") == SUMMARY_SCHEMA,
            "region": c("region") == c("want_region"),
            "read_kinds": c("kinds_valid"),
            "raw_config": c("raw_mode").isNull() | c("raw_valid"),
            "retained": c("retained"),
            "all_finished": c("succeeded") + c("failed") == c("input_files"),
            "failed_allowed": c("failed") <= max_failed,
            "complete_flag": c("complete") == (c("failed") == 0),
            "some_succeeded": c("succeeded") > 0,
            "some_input": c("input_files") > 0,
            "input_limit": c("input_files") <= MAX_RESOURCES,
            "input_in_catalog": c("input_files") <= c("catalog_files"),
            "some_output": c("output_files") > 0,
            "media_full": ~c("full_export") | c("media_full"),
            "raw_not_full": ~(c("full_export") & raw_only),
            "catalog_digest": valid_digest(c("catalog_sha256")),
            "full_needs_catalog": ~c("full_export") | c("full_catalog"),
            "full_needs_native": ~c("full_export") | c("native_kinds"),
            "full_catalog_size": ~c("full_catalog") | (c("input_files") == c("catalog_files")),
        },
    )


def journal_rules(journal: DataFrame, summaries: DataFrame) -> DataFrame:
    """Directory names are the zero-padded index below the count; names and sources are unique."""
    j = journal.join(of_known_size(summaries.select("run", "input_files"), "counts"), "run", "left")
    name = F.col("output_directory")
    index = F.when(name.rlike(r"\A[0-9]{1,18}\z"), name).cast("long")
    text = index.cast("string")
    padded = F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, "0"))
    rows = rule_violations(
        j,
        name,
        {
            "directory_name": name == padded,
            "directory_index": index < F.col("input_files"),
            "source_path": safe_path(F.col("source")),
            "source_digest": valid_digest(F.col("source_sha256")),
        },
        detail=F.col("source"),
    )

    def repeated(column: str, code: str) -> DataFrame:
        groups = journal.groupBy("run", column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return violation(groups, code, F.col(column), F.col("n"))

    return all_of(rows, repeated("output_directory", "directory_repeated"), repeated("source", "source_repeated"))


def failure_rules(journal: DataFrame, max_failed: int) -> DataFrame:
    """Failed rows within the accepted number; a failed row never counts as a cache hit."""
    failed = journal.where(F.size("errors") > 0)
    over = failed.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_failed)
    return all_of(
        violation(over, "too_many_failed", F.col("run"), F.col("n")),
        violation(failed.where("cache_hit"), "cached_failure", F.col("source")),
    )


def raw_only_rules(journal: DataFrame, summaries: DataFrame) -> DataFrame:
    """In raw-only mode a succeeded resource has exactly one output and no objects."""
    rows = journal.where(F.size("errors") == 0).join(
        of_known_size(summaries.select("run", "raw_mode"), "modes"), "run"
    )
    return rule_violations(
        rows.where(F.col("raw_mode") == "only"),
        F.col("source"),
        {
            "raw_only_outputs": F.size("outputs") == 1,
            "raw_only_objects": (F.col("objects") == 0) & (F.col("selected_objects") == 0) & (F.col("skipped_objects") == 0),
        },
    )


def output_rules(
    outputs: DataFrame,
    summaries: DataFrame,
    raw_prefix: str = "raw",
    raw_include: Sequence[str] = (),
    raw_exclude: Sequence[str] = (),
) -> DataFrame:
    """Per-output rules of succeeded resources."""
    ok = outputs.where(~F.col("failed")).join(
        of_known_size(summaries.select("run", "acb_preserve", "usm_preserve", "raw_mode"), "modes"), "run", "left"
    )
    kind = F.col("kind")
    raw = kind == "raw_bundle"
    raw_only = F.coalesce(F.col("raw_mode") == "only", F.lit(False))
    rows = rule_violations(
        ok,
        F.concat_ws("/", "output_directory", "path"),
        {
            "output_path": safe_path(F.col("path")),
            "output_digest": valid_digest(F.col("sha256")),
            "container_kind": ~(
                ((kind == "cri_acb_container") & ~F.col("acb_preserve"))
                | ((kind == "cri_usm_container") & ~F.col("usm_preserve"))
            ),
            "raw_allowed": ~raw | F.col("raw_mode").isNotNull(),
            "raw_content": ~raw
            | (
                (F.col("path") == F.concat(F.lit(raw_prefix + "/"), F.col("source")))
                & (F.col("sha256") == F.col("source_sha256"))
                & F.col("class_id").isNull()
                & safe_path(F.col("source"), 2048)
                & matches_policy(raw_include, raw_exclude, F.col("source"))
            ),
            "raw_only": ~raw_only | raw,
        },
    )
    repeated = (
        ok.groupBy("run", "output_directory", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return all_of(
        rows, violation(repeated, "output_repeated", F.concat_ws("/", "output_directory", "path"), F.col("n"))
    )


def exact_tree(outputs: DataFrame, inventory: DataFrame, journal: DataFrame, directories: DataFrame) -> DataFrame:
    """No declared file missing, no file unlisted, no resource directory missing or unknown.

    ``inventory`` has ``(run, output_directory, path)``; ``directories`` lists the directories that
    exist, so that a resource without outputs can be checked as well.
    """
    files = side_by_side(
        outputs.where(~F.col("failed")), inventory, ["run", "output_directory", "path"]
    )
    key = F.concat_ws("/", "output_directory", "path")
    tree = rule_violations(
        files, key, {"tree_missing": F.col("n_right") > 0, "tree_unlisted": F.col("n_left") > 0}
    )
    dirs = side_by_side(
        journal.where(F.size("errors") == 0), directories, ["run", "output_directory"]
    )
    return all_of(
        tree,
        rule_violations(
            dirs,
            F.col("output_directory"),
            {"directory_missing": F.col("n_right") > 0, "directory_unlisted": F.col("n_left") > 0},
        ),
    )


TOTALS = [
    "succeeded", "failed", "cache_hits", "output_files", "output_bytes",
    "unity_objects", "selected_unity_objects", "skipped_unity_objects",
]


def reconcile(journal: DataFrame, summaries: DataFrame) -> DataFrame:
    """Totals and the kind histogram recomputed from the journal equal the summary's."""
    mine = export_totals(journal)
    joined = side_by_side(summaries, mine, ["run"], TOTALS)
    totals = rule_violations(
        joined, F.col("run"), {f"total_{t}": F.col(f"l_{t}").eqNullSafe(F.col(f"r_{t}")) for t in TOTALS}
    )
    stated = summaries.select("run", F.explode("payloads").alias("kind", "files"))
    kinds = side_by_side(stated, payload_counts(journal), ["run", "kind"], ["files"])
    return all_of(
        totals,
        rule_violations(kinds, F.col("kind"), {"payload_count": F.col("l_files").eqNullSafe(F.col("r_files"))}),
    )


def verified_inventory(outputs: DataFrame, receipt_files: DataFrame) -> DataFrame:
    """What may be published: every output of a succeeded resource and the receipt files themselves."""
    listed = outputs.where(~F.col("failed")).select(
        "run", F.concat_ws("/", "output_directory", "path").alias("path"), "bytes", "sha256"
    )
    return listed.unionByName(receipt_files.select("run", "path", "bytes", "sha256"))


def changed_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest differs between two inventories, or that exist in one only."""
    both = side_by_side(before, after, ["run", "path"], ["sha256"])
    differs = both.where(~F.col("l_sha256").eqNullSafe(F.col("r_sha256")))
    return violation(
        differs,
        F.when(F.col("n_right") == 0, F.lit("file_removed"))
        .when(F.col("n_left") == 0, F.lit("file_added"))
        .otherwise(F.lit("file_changed")),
        F.col("path"),
    )


def plan_in_inventory(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    allowed = inventory.select("run", F.col("path").alias("local"), "bytes", "sha256")
    stray = entries.join(allowed, ["run", "local", "bytes", "sha256"], "left_anti")
    return violation(stray, "unverified_entry", F.col("local"), F.col("path"))


def outcome_consistency(exports: DataFrame, verifications: DataFrame) -> DataFrame:
    """An export describes the very catalog its job verified."""
    fields = ["catalog_sha256", "region", "platform", "full_catalog"]
    both = side_by_side(exports, verifications, ["run", "job_id"], fields)
    return rule_violations(
        both.where((F.col("n_left") > 0) & (F.col("n_right") > 0)),
        F.col("job_id"),
        {f"outcome_{f}": F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")) for f in fields},
    )


def signature_family(prefix: Column) -> Column:
    """File family from the leading bytes; an encrypted HCA has the high bit set on each letter."""
    h = F.hex(prefix)

    def masked(i: int) -> Column:
        return F.lpad(F.hex(F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int").bitwiseAND(127)), 2, "0")

    return (
        F.when(h.startswith(BUNDLE_SIGNATURE), "bundle")
        .when(h.startswith("40555446"), "utf_table")
        .when(h.startswith("43524944"), "movie")
        .when((F.length(h) >= 8) & (F.concat(*[masked(i) for i in range(4)]) == "48434100"), "hca")
        .when(h.startswith("8000"), "adx")
        .otherwise("other")
    )


def classify_signature(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("family", signature_family(F.col("prefix8")))


def media_conformance(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """Decoded media agree with what their container declared.

    ``probes`` carries one row per produced file with the decoded values and, for encodings of a
    waveform, the original's: ``original_frames``, ``original_channels``, ``original_rate``, ``original_pcm_sha256``.
    """
    c = F.col
    joined = probes.join(facts.select("run", "resource", "declared_frames"), ["run", "resource"], "left")
    video, pcm = c("kind") == "video", c("kind") == "pcm"
    lossy, lossless = c("kind") == "lossy", c("kind") == "lossless"
    same_form = (c("channels") == c("original_channels")) & (c("rate") == c("original_rate"))
    return rule_violations(
        joined,
        c("path"),
        {
            "video_frames": ~video | (c("declared_frames") == c("decoded_frames")),
            "pcm_form": ~pcm
            | (same_form & (c("pcm_bytes") == c("original_frames") * c("channels") * 2)),
            "lossy_form": ~lossy
            | (
                same_form
                & (c("decoded_frames") > 0)
                & (F.abs(c("original_frames") - c("decoded_frames")) <= LOSSY_FRAMES)
            ),
            "lossless_roundtrip": ~lossless | (c("pcm_sha256") == c("original_pcm_sha256")),
        },
    )
