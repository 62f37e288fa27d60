"""From an export journal to what a publication has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from assetlake.operators import claims, exports, layout, publication
from assetlake.operators.integrity import plan_in_inventory
from assetlake.violations import all_of


def publish_plan(
    journal: DataFrame,
    cues: DataFrame,
    previous: DataFrame,
    inventory: DataFrame,
    max_failed: int = 0,
    lowercase: bool = True,
    prune: bool = True,
) -> dict[str, DataFrame]:
    """Entries, uploads, carried and prunable files, the next manifest, counters and violations."""
    outputs = exports.explode_outputs(journal)
    failed, too_many = layout.split_failed(journal, max_failed)
    wanted = layout.readable_keys(outputs, cues, lowercase=lowercase)
    entries, counts = claims.claim_keys(wanted)
    kept = publication.carried(previous, failed, entries)
    return {
        "entries": entries,
        "uploads": publication.pending(entries, previous),
        "carried": kept,
        "prunable": publication.prunable(previous, entries, kept),
        "manifest": publication.next_manifest(entries, kept),
        "counts": publication.stable_counts(entries, previous, failed, counts, prune),
        "violations": all_of(too_many, layout.key_violations(wanted), plan_in_inventory(entries, inventory)),
    }
