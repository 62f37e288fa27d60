"""From a catalog to an ordered download plan, as one lazy plan around the closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from assetlake.operators import planning, selection
from assetlake.violations import all_of


def catalog_plan(
    locations: DataFrame,
    keys: DataFrame,
    targets: DataFrame,
    names: Sequence[str] = (),
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    priority: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Planned assets with their priority rank, and every violation found on the way."""
    roots, unknown = selection.resolve_keys(keys, locations, names)
    kept = selection.filter_roots(roots, locations, include, exclude)
    selected = selection.closure(kept, locations)
    chosen = selection.select_locations(selected, locations)
    classified = planning.classify_provider(chosen)
    resolved = planning.resolve_paths(classified, targets)
    assets = planning.plan_assets(resolved)
    violations = all_of(
        unknown,
        selection.require_roots(locations, kept),
        selection.dangling_dependencies(selected, locations),
        planning.provider_violations(classified),
        planning.path_violations(resolved),
        planning.provider_conflicts(resolved),
        planning.casefold_conflicts(assets),
        planning.ancestor_conflicts(assets),
    )
    return selection.prioritize(assets, priority), violations
