"""Registered queries: selection and plan building."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators import planning, selection
from assetlake.plans.bound import query
from assetlake.plans.catalog_plan import catalog_plan as build_plan

NAMES = ["Brand#3", "PROMO", "Absent", "Nothing"]
INCLUDE = [r"widget$", r"promo/.*ring", r"^Brand#1[0-5]/"]
EXCLUDE = [r"old|hot_ring", r"_4[0-9]\.bundle$"]
PRIORITY = [r"^promo/", r"_1[0-9]\.bundle$", r"small"]

# The same choices for the checks; RE2 reads these patterns the same way.
_ROOTS = """roots AS (SELECT DISTINCT k.run, k.id FROM catalog_keys k JOIN locations l ON l.run = k.run AND l.id = k.id
  WHERE k.key IN ('Brand#3', 'PROMO')
    AND (regexp_matches(l.primary_key, 'widget$|promo/.*ring|^Brand#1[0-5]/') OR regexp_matches(l.internal_id, 'widget$|promo/.*ring|^Brand#1[0-5]/'))
    AND NOT (regexp_matches(l.primary_key, 'old|hot_ring|_4[0-9]\\.bundle$') OR regexp_matches(l.internal_id, 'old|hot_ring|_4[0-9]\\.bundle$')))"""
_SELECTED = _ROOTS + """,
selected AS (SELECT run, id FROM roots UNION
  SELECT l.run, unnest(l.dependencies) AS id FROM selected s JOIN locations l ON l.run = s.run AND l.id = s.id)"""
_PROVIDER = """CASE provider_id WHEN 'Fwk.Crypt.AssetBundleCryptProvider' THEN 'encrypted_bundle'
  WHEN 'UnityEngine.ResourceManagement.ResourceProviders.AssetBundleProvider' THEN 'unity_bundle'
  WHEN 'CriWare.Assets.CriResourceProvider' THEN 'cri'
  WHEN 'UnityEngine.ResourceManagement.ResourceProviders.BundledAssetProvider' THEN 'logical' END"""
_RESOLVED = f"""classified AS (SELECT *, {_PROVIDER} AS provider FROM locations),
raw AS (SELECT c.*, CASE
    WHEN starts_with(internal_id, '{planning.REMOTE_PREFIX}') THEN substr(internal_id, {len(planning.REMOTE_PREFIX) + 1})
    WHEN starts_with(internal_id, t.base || '/') THEN substr(internal_id, length(t.base) + 2)
    WHEN starts_with(internal_id, t.placeholder || '/') THEN substr(internal_id, length(t.placeholder) + 2)
    WHEN starts_with(internal_id, '{planning.RUNTIME_PREFIX}') THEN substr(internal_id, {len(planning.RUNTIME_PREFIX) + 1}) END AS p,
    starts_with(internal_id, '{planning.RUNTIME_PREFIX}') AS embedded
  FROM classified c LEFT JOIN targets t ON t.run = c.run WHERE provider IS DISTINCT FROM 'logical' AND provider IS NOT NULL),
resolved AS (SELECT *, CASE WHEN regexp_full_match(p, '[A-Za-z0-9._()-]{{1,255}}(/[A-Za-z0-9._()-]{{1,255}})*') AND NOT regexp_matches(p, '(^|/)\\.\\.?(/|$)')
    AND length(p) <= 2048 THEN p END AS relative_path FROM raw),
remote AS (SELECT * FROM resolved WHERE NOT embedded AND relative_path IS NOT NULL),
assets AS (SELECT run, relative_path, arg_min(provider, id) AS provider, min(id) AS first_location, count(*) AS locations FROM remote GROUP BY 1, 2)"""
_V = "SELECT run, code, key, detail FROM"


def _resolved(b):
    return planning.resolve_paths(planning.classify_provider(b.locations), b.targets)


@query("resolve_keys", "SELECT DISTINCT run, id FROM catalog_keys WHERE key IN ('Brand#3', 'PROMO') AND id IS NOT NULL", "catalog_keys")
def _(b):
    return selection.resolve_keys(b.catalog_keys, b.locations, NAMES)[0]


@query(
    "resolve_keys_violations",
    "SELECT DISTINCT run, 'unknown_key' AS code, k AS key, cast(NULL AS VARCHAR) AS detail FROM locations, (VALUES ('Absent'), ('Nothing')) v(k)",
    "locations",
)
def _(b):
    return selection.resolve_keys(b.catalog_keys, b.locations, NAMES)[1]


@query("filter_roots", f"WITH {_ROOTS} SELECT run, id FROM roots", "locations", "catalog_keys")
def _(b):
    roots, _ = selection.resolve_keys(b.catalog_keys, b.locations, NAMES)
    return selection.filter_roots(roots, b.locations, INCLUDE, EXCLUDE)


@query(
    "require_roots",
    """SELECT run, 'empty_selection' AS code, run AS key, cast(NULL AS VARCHAR) AS detail FROM (SELECT DISTINCT run FROM locations)
    WHERE run NOT IN (SELECT run FROM locations WHERE primary_key = 'Brand#7/small ring')""",
    "locations",
)
def _(b):
    everything, _ = selection.resolve_keys(b.catalog_keys, b.locations, [])
    return selection.require_roots(b.locations, selection.filter_roots(everything, b.locations, [r"^Brand#7/small ring$"]))


@query("closure", f"WITH RECURSIVE {_SELECTED} SELECT run, id FROM selected", "locations", "catalog_keys")
def _(b):
    roots, _ = selection.resolve_keys(b.catalog_keys, b.locations, NAMES)
    return selection.closure(selection.filter_roots(roots, b.locations, INCLUDE, EXCLUDE), b.locations)


@query(
    "dangling_dependencies",
    f"""WITH RECURSIVE {_SELECTED} SELECT run, 'dangling_dependency' AS code, cast(id AS VARCHAR) AS key, cast(NULL AS VARCHAR) AS detail
    FROM selected s WHERE NOT EXISTS (SELECT 1 FROM locations l WHERE l.run = s.run AND l.id = s.id)""",
    "locations", "catalog_keys",
)
def _(b):
    roots, _ = selection.resolve_keys(b.catalog_keys, b.locations, NAMES)
    selected = selection.closure(selection.filter_roots(roots, b.locations, INCLUDE, EXCLUDE), b.locations)
    return selection.dangling_dependencies(selected, b.locations)


@query(
    "prioritize",
    f"""WITH {_RESOLVED} SELECT run, relative_path, provider, first_location, locations,
    cast(CASE WHEN regexp_matches(relative_path, '^promo/') THEN 0 WHEN regexp_matches(relative_path, '_1[0-9]\\.bundle$') THEN 1
      WHEN regexp_matches(relative_path, 'small') THEN 2 ELSE 3 END AS BIGINT) AS rank FROM assets""",
    "locations", "targets",
)
def _(b):
    return selection.prioritize(planning.plan_assets(_resolved(b)), PRIORITY).orderBy("run", "rank", "relative_path")


@query(
    "scope_flags",
    f"""WITH RECURSIVE {_SELECTED}, known AS (SELECT s.run, count(*) AS n FROM selected s JOIN locations l ON l.run = s.run AND l.id = s.id GROUP BY 1)
    SELECT l.run, coalesce(any_value(k.n), 0) AS selected_locations, count(*) AS all_locations, coalesce(any_value(k.n), 0) = count(*) AS full_catalog
    FROM locations l LEFT JOIN known k ON k.run = l.run GROUP BY 1""",
    "locations", "catalog_keys",
)
def _(b):
    roots, _ = selection.resolve_keys(b.catalog_keys, b.locations, NAMES)
    selected = selection.closure(selection.filter_roots(roots, b.locations, INCLUDE, EXCLUDE), b.locations)
    return selection.scope_flags(selection.select_locations(selected, b.locations), b.locations)


@query(
    "key_overlap",
    f"""WITH RECURSIVE walk AS (SELECT run, key, id FROM catalog_keys WHERE id IS NOT NULL UNION
      SELECT w.run, w.key, unnest(l.dependencies) FROM walk w JOIN locations l ON l.run = w.run AND l.id = w.id),
    {_RESOLVED},
    files AS (SELECT DISTINCT w.run, w.key, r.relative_path FROM walk w JOIN remote r ON r.run = w.run AND r.id = w.id),
    per AS (SELECT run, relative_path, count(*) AS labels, max(CASE WHEN key = 'PROMO' THEN 1 ELSE 0 END) AS base FROM files GROUP BY 1, 2),
    c AS (SELECT f.run, f.key, count(*) AS files, cast(sum(base) AS BIGINT) AS in_base, count(*) FILTER (labels = 1) AS exclusive
      FROM files f JOIN per p ON p.run = f.run AND p.relative_path = f.relative_path GROUP BY 1, 2)
    SELECT *, files - in_base AS outside_base, CASE WHEN in_base = 0 THEN 'disjoint' WHEN in_base = files THEN 'subset' ELSE 'overlap' END AS relation FROM c""",
    "locations", "catalog_keys", "targets",
)
def _(b):
    paths = planning.remote_locations(_resolved(b))
    return selection.key_overlap(b.catalog_keys, b.locations, paths, "PROMO")


@query("classify_provider", f"SELECT run, {_PROVIDER} AS provider, count(*) AS locations FROM locations GROUP BY ALL", "locations")
def _(b):
    return planning.classify_provider(b.locations).groupBy("run", "provider").agg(F.count(F.lit(1)).alias("locations"))


@query(
    "provider_violations",
    f"SELECT run, 'unknown_provider' AS code, cast(id AS VARCHAR) AS key, provider_id AS detail FROM locations WHERE {_PROVIDER} IS NULL",
    "locations",
)
def _(b):
    return planning.provider_violations(planning.classify_provider(b.locations))


@query("resolve_paths", f"WITH {_RESOLVED} SELECT run, id, provider, relative_path, embedded FROM resolved", "locations", "targets")
def _(b):
    return _resolved(b).select("run", "id", "provider", "relative_path", "embedded")


@query(
    "path_violations",
    f"WITH {_RESOLVED} SELECT run, 'asset_path' AS code, cast(id AS VARCHAR) AS key, internal_id AS detail FROM resolved WHERE relative_path IS NULL",
    "locations", "targets",
)
def _(b):
    return planning.path_violations(_resolved(b))


@query("plan_assets", f"WITH {_RESOLVED} SELECT * FROM assets", "locations", "targets")
def _(b):
    return planning.plan_assets(_resolved(b))


@query("asset_locations", f"WITH {_RESOLVED} SELECT run, relative_path, id, provider FROM remote", "locations", "targets")
def _(b):
    return planning.asset_locations(_resolved(b))


@query(
    "provider_conflicts",
    f"""WITH {_RESOLVED} SELECT run, 'provider_conflict' AS code, relative_path AS key, min(provider) || ',' || max(provider) AS detail
    FROM remote GROUP BY run, relative_path HAVING count(DISTINCT provider) > 1""",
    "locations", "targets",
)
def _(b):
    return planning.provider_conflicts(_resolved(b))


@query(
    "casefold_conflicts",
    f"""WITH {_RESOLVED} SELECT run, 'casefold_conflict' AS code, lower(relative_path) AS key, cast(count(*) AS VARCHAR) AS detail
    FROM assets GROUP BY run, lower(relative_path) HAVING count(*) > 1""",
    "locations", "targets",
)
def _(b):
    return planning.casefold_conflicts(planning.plan_assets(_resolved(b)))


@query(
    "ancestor_conflicts",
    f"""WITH {_RESOLVED}, folded AS (SELECT DISTINCT run, lower(relative_path) AS path FROM assets)
    SELECT DISTINCT a.run, 'ancestor_conflict' AS code, a.path AS key, cast(NULL AS VARCHAR) AS detail
    FROM folded a JOIN folded c ON c.run = a.run AND starts_with(c.path, a.path || '/')""",
    "locations", "targets",
)
def _(b):
    return planning.ancestor_conflicts(planning.plan_assets(_resolved(b)))


@query(
    "plan_counts",
    f"""WITH {_RESOLVED} SELECT r.run, (SELECT count(*) FROM assets a WHERE a.run = r.run) AS remote_files,
    (SELECT count(*) FROM resolved e WHERE e.run = r.run AND e.embedded AND e.relative_path IS NOT NULL) AS embedded_locations,
    (SELECT count(*) FROM classified c WHERE c.run = r.run AND c.provider = 'logical') AS logical_locations
    FROM (SELECT DISTINCT run FROM locations) r""",
    "locations", "targets",
)
def _(b):
    classified = planning.classify_provider(b.locations)
    return planning.plan_counts(classified, planning.resolve_paths(classified, b.targets))


@query(
    "size_violations",
    """SELECT run, CASE WHEN bytes <= 0 THEN 'empty_file' ELSE 'file_too_large' END AS code, relative_path AS key, cast(bytes AS VARCHAR) AS detail
    FROM receipts WHERE bytes <= 0 OR bytes > 9000
    UNION ALL SELECT run, 'total_too_large', run, cast(sum(bytes) AS VARCHAR) FROM receipts GROUP BY run HAVING sum(bytes) > 500000""",
    "receipts",
)
def _(b):
    return planning.size_violations(b.receipts, 9000, 500_000)


@query(
    "catalog_plan",
    f"""WITH RECURSIVE {_SELECTED}, {_RESOLVED},
    mine AS (SELECT r.* FROM remote r JOIN selected s ON s.run = r.run AND s.id = r.id)
    SELECT run, relative_path, arg_min(provider, id) AS provider, min(id) AS first_location, count(*) AS locations,
    cast(CASE WHEN regexp_matches(relative_path, '^promo/') THEN 0 WHEN regexp_matches(relative_path, '_1[0-9]\\.bundle$') THEN 1
      WHEN regexp_matches(relative_path, 'small') THEN 2 ELSE 3 END AS BIGINT) AS rank FROM mine GROUP BY run, relative_path""",
    "locations", "catalog_keys", "targets",
)
def catalog_plan(b):
    plan, _ = build_plan(b.locations, b.catalog_keys, b.targets, NAMES, INCLUDE, EXCLUDE, PRIORITY)
    return plan.orderBy("run", "rank", "relative_path")
