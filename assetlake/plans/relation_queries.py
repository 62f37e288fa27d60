"""Registered queries: object relations and snapshot validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators import planning, relations, snapshots
from assetlake.plans.bound import Bound, query
from assetlake.plans.catalog_queries import _RESOLVED
from assetlake.plans.integrity_queries import NONE, _DEPS, dependencies, rules


@query(
    "bundle_dependencies",
    f"""WITH {_RESOLVED}, ids AS (SELECT run, id, relative_path FROM remote WHERE provider <> 'cri')
    SELECT DISTINCT l.run, o.relative_path AS owner, d.relative_path AS dependency
    FROM (SELECT run, dependencies[1] AS f, unnest(dependencies) AS x FROM locations) l
    JOIN ids o ON o.run = l.run AND o.id = l.f JOIN ids d ON d.run = l.run AND d.id = l.x WHERE o.relative_path <> d.relative_path""",
    "locations", "targets",
)
def _(b):
    resolved = planning.resolve_paths(planning.classify_provider(b.locations), b.targets)
    return relations.bundle_dependencies(b.locations, planning.asset_locations(resolved))


@query(
    "resource_weight",
    f"""WITH {_DEPS} SELECT r.run, r.relative_path, cast(any_value(r.bytes) + coalesce(sum(x.bytes), 0) AS BIGINT) AS weight, count(x.bytes) AS dependencies
    FROM receipts r LEFT JOIN deps d ON d.run = r.run AND d.owner = r.relative_path LEFT JOIN receipts x ON x.run = d.run AND x.relative_path = d.dependency GROUP BY 1, 2""",
    "receipts",
)
def _(b):
    return relations.resource_weight(b.receipts, dependencies(b))


def chunked_objects(b: Bound):
    """Conversations as objects whose turns, last first, are their chunks; some chunks are lost."""
    c = b.table("conversations").withColumn("run", F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")))
    refs = F.sort_array(F.collect_list(F.struct(F.col("conv_id").alias("file_id"), F.when(F.expr("(conv_id * 7 + turn) % 97 <> 5"), F.col("turn")).alias("path_id"))), False)
    objects = c.groupBy("run", F.col("conv_id").alias("object_id")).agg(refs.alias("chunks"))
    objects = objects.withColumn("chunks", F.when(F.col("object_id") % 37 == 3, F.slice("chunks", 1, 0)).otherwise(F.col("chunks")))
    chunks = c.where("(conv_id * 7 + turn) % 41 <> 0").select("run", F.col("conv_id").alias("file_id"), F.col("turn").alias("path_id"), "text")
    return objects, chunks


_CONV = "c AS (SELECT 'c' || cast(conv_id % 3 AS VARCHAR) AS run, * FROM conversations)"


@query(
    "reassemble_chunks",
    f"""WITH {_CONV}, good AS (SELECT *, (conv_id * 7 + turn) % 97 = 5 AS nulled FROM c WHERE conv_id % 37 <> 3),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN nulled THEN 1 ELSE 0 END, turn DESC) - 1 AS position FROM good)
    SELECT run, conv_id AS object_id, count(*) AS chunks, string_agg(text, '' ORDER BY position) AS text
    FROM p GROUP BY 1, 2 HAVING bool_and(NOT nulled AND (conv_id * 7 + turn) % 41 <> 0)""",
)
def _(b):
    objects, chunks = chunked_objects(b)
    return relations.reassemble_chunks(objects, chunks)


@query(
    "chunk_violations",
    f"""WITH {_CONV}, g AS (SELECT *, (conv_id * 7 + turn) % 97 = 5 AS nulled FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN nulled THEN 1 ELSE 0 END, turn DESC) - 1 AS position FROM g)
    SELECT DISTINCT run, 'no_chunks' AS code, cast(conv_id AS VARCHAR) AS key, {NONE} AS detail FROM p WHERE conv_id % 37 = 3
    UNION ALL SELECT run, 'null_chunk', cast(conv_id AS VARCHAR), cast(position AS VARCHAR) FROM p WHERE conv_id % 37 <> 3 AND nulled
    UNION ALL SELECT run, 'missing_chunk', cast(conv_id AS VARCHAR), cast(position AS VARCHAR) FROM p WHERE conv_id % 37 <> 3 AND NOT nulled AND (conv_id * 7 + turn) % 41 = 0""",
)
def _(b):
    return relations.chunk_violations(*chunked_objects(b))


_TRACKS = "SELECT 'm' || cast(l_orderkey % 3 AS {s}) AS run, l_orderkey AS resource, cast(l_linenumber AS BIGINT) AS position, 'cue_' || cast(l_partkey AS {s}) AS name, l_partkey AS cue_id, l_partkey % 4 AS wave_id FROM {t}"
_WAVES = "SELECT 'm' || cast(o_orderkey % 3 AS {s}) AS run, o_orderkey AS resource, cast(o_custkey % 3 AS BIGINT) AS position, o_custkey % 3 AS wave_id FROM {t} UNION ALL SELECT 'm' || cast(o_orderkey % 3 AS {s}), o_orderkey, cast(9 AS BIGINT), cast(3 AS BIGINT) FROM {t}"


def _cues(b: Bound):
    t = b.spark.sql(_TRACKS.format(s="string", t=f"parquet.`{b.sf_dir}/lineitem.parquet`"))
    return t, b.spark.sql(_WAVES.format(s="string", t=f"parquet.`{b.sf_dir}/orders.parquet`"))


_CUES = f"t AS ({_TRACKS.format(s='VARCHAR', t='lineitem')}), w AS ({_WAVES.format(s='VARCHAR', t='orders')})"


@query(
    "cue_tracks",
    f"""WITH {_CUES} SELECT w.run, w.resource, w.position AS track, t.position AS cue_position, t.name, t.cue_id, w.wave_id
    FROM w LEFT JOIN t ON t.run = w.run AND t.resource = w.resource AND t.wave_id = w.wave_id""",
)
def _(b):
    return relations.cue_tracks(*_cues(b))


@query(
    "cue_violations",
    f"""WITH {_CUES} SELECT run, 'absent_waveform' AS code, cast(resource AS VARCHAR) || ':' || cast(cue_id AS VARCHAR) AS key, cast(wave_id AS VARCHAR) AS detail FROM t
    WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.run = t.run AND w.resource = t.resource AND w.wave_id = t.wave_id)""",
)
def _(b):
    return relations.cue_violations(*_cues(b))


@query(
    "merge_containers",
    """WITH o AS (SELECT 'c' || cast(conv_id % 3 AS VARCHAR) AS run, conv_id // 6 AS resource, 'Timeline/c' || cast(conv_id // 3 % 5 AS VARCHAR) || '.Playable' AS container,
      CASE WHEN turn % 3 = 2 THEN 'MonoBehaviour_#' || cast(conv_id * 100 + turn AS VARCHAR) ELSE role END AS name, conv_id * 100 + turn AS index, conv_id AS path_id, turn FROM conversations WHERE conv_id % 5 <> 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY run, resource, container ORDER BY name, index) - 1 AS p, count(*) OVER (PARTITION BY run, resource, container) AS object_count,
      first_value(path_id) OVER (PARTITION BY run, resource, container ORDER BY name, index) AS first_id FROM o)
    SELECT run, resource, container, object_count, any_value(first_id) AS first_id,
      '{"container":"' || container || '","object_count":' || object_count || ',"objects":[' || string_agg('{"name":"' || name || '","asset_type":"MonoBehaviour","data":{"a":[1,2],"t":' || cast(turn AS VARCHAR) || '}}', ',' ORDER BY p) || ']}' AS document
    FROM n GROUP BY 1, 2, 3, 4""",
)
def _(b):
    objects = b.table("conversations").selectExpr(
        "'c' || cast(conv_id % 3 as string) AS run", "conv_id div 6 AS resource",
        "'Timeline\\\\c' || cast(conv_id div 3 % 5 as string) || CASE WHEN conv_id % 5 = 1 THEN '.prefab' ELSE '.Playable' END AS container",
        "114 AS class_id", "CASE WHEN turn % 3 = 2 THEN CASE WHEN turn = 2 THEN '' END ELSE role END AS name", "conv_id * 100 + turn AS index",
        "'f' AS source_file", "conv_id AS path_id", "'{\"t\": ' || cast(turn as string) || ', \"a\": [1, 2]}' AS data",
    )
    return relations.merge_containers(objects).withColumn("first_id", F.col("identity.path_id")).drop("identity")


@query(
    "inline_payloads",
    """WITH o AS (SELECT 'm' || cast(o_orderkey % 3 AS VARCHAR) AS run, o_custkey AS resource, o_orderkey AS path_id FROM orders),
    a AS (SELECT *, cast(0 AS BIGINT) AS ordinal, CASE WHEN path_id % 300 > 255 THEN 'byte_range' END AS problem, CASE WHEN path_id % 300 <= 255 THEN '40555446' || upper(printf('%02x', path_id % 300)) END AS payload FROM o
      UNION ALL SELECT *, 1, CASE WHEN path_id % 4 = 0 THEN 'array_missing' WHEN path_id % 7 = 0 THEN 'signature' END,
        CASE WHEN path_id % 4 <> 0 AND path_id % 7 <> 0 THEN '40555446' END FROM o WHERE path_id % 2 = 0)
    SELECT * FROM a""",
)
def _(b):
    rows = b.table("orders").selectExpr(
        "'m' || cast(o_orderkey % 3 as string) AS run", "o_custkey AS resource", "o_orderkey AS path_id",
        """'{"references":{"RefIds":[{"type":{"class":"Other"},"data":{"x":1}},{"type":{"class":"CriSerializedBytesAssetImpl"},"data":{"data":[64,85,84,70,' || cast(o_orderkey % 300 as string) || ']}}'
        || CASE WHEN o_orderkey % 2 = 1 THEN '' WHEN o_orderkey % 4 = 0 THEN ',{"type":{"class":"CriSerializedBytesAssetImpl"},"data":{}}'
           WHEN o_orderkey % 7 = 0 THEN ',{"type":{"class":"CriSerializedBytesAssetImpl"},"data":{"data":[1,2,3,4]}}' ELSE ',{"type":{"class":"CriSerializedBytesAssetImpl"},"data":{"data":[64,85,84,70]}}' END || ']}}' AS json""",
    )
    return relations.inline_payloads(rows).withColumn("payload", F.hex("payload"))


# --- snapshots -------------------------------------------------------------------------------------

_NOW = "timestamp '1999-01-01 00:05:10'"
_JOINED = """j AS (SELECT s.*, p.region AS w_region, p.environment AS w_environment, p.platform AS w_platform, p.client_version AS w_client, p.protocol_version AS w_protocol,
  p.catalog_locale AS w_locale, r.authorization AS r_auth, r.credential_ref AS r_cred, (epoch_us(timestamp '1999-01-01 00:05:10') - epoch_us(observed_at)) // 1000 AS age
  FROM snapshots s JOIN profiles p ON p.run = s.run LEFT JOIN roots r ON r.run = s.run AND r.root = s.effective_cdn_root)"""
_COMPONENT = "regexp_full_match({0}, '[A-Za-z0-9._-]{{1,256}}') AND {0} NOT IN ('.', '..')"


@query(
    "validate_snapshots",
    f"WITH {_JOINED} "
    + rules("run", {
        "stale": "NOT stale", "age": "age BETWEEN 0 AND 300000",
        "schema": "CASE schema_version WHEN 1 THEN region IS NULL AND w_region = 'jp' AND w_platform = 'iOS' AND protocol_version = '1.0.3' ELSE region = w_region END",
        "explicit_layout": "(catalog_layout IS NOT NULL) = (schema_version = 3) AND (catalog_url IS NOT NULL) = (schema_version = 3)",
        "environment": "environment = w_environment", "platform": "platform = w_platform", "client_version": "client_version = w_client",
        "protocol_version": "protocol_version = w_protocol", "source": "source = 'remote'",
        "resource_version": _COMPONENT.format("resource_version"), "platform_hash": _COMPONENT.format("platform_hash"),
    }, "j"),
    "snapshots", "profiles", "roots",
)
def _(b):
    return snapshots.validate_snapshots(b.snapshots, b.profiles, F.expr(_NOW))


@query(
    "validate_layout",
    f"WITH {_JOINED}, k AS (SELECT *, coalesce(catalog_layout, 'jp') AS layout FROM j) "
    + rules("run", {
        "layout_region": "layout = CASE WHEN w_region IN ('hk', 'en', 'kr') THEN 'global' ELSE 'jp' END",
        "layout_hash": "layout <> 'global' OR regexp_full_match(platform_hash, '[0-9a-f]{32}')",
        "layout_locale": "layout <> 'jp' OR w_locale IS NULL", "cdn_root": "r_auth IS NOT NULL",
        "authorization": "r_auth IS NULL OR coalesce(cdn_authorization, 'basic') = r_auth",
        "credential": "r_auth IS NULL OR credential_ref = CASE WHEN r_auth = 'basic' THEN r_cred ELSE '' END",
    }, "k"),
    "snapshots", "profiles", "roots",
)
def _(b):
    return snapshots.validate_layout(b.snapshots, b.profiles, b.roots)


_DERIVED = f"""{_JOINED}, d AS (SELECT *, coalesce(catalog_layout, 'jp') AS layout,
  CASE WHEN catalog_layout = 'global' THEN effective_cdn_root || '/asset/' || w_platform ELSE effective_cdn_root || '/asset/' || resource_version || '/' || w_platform || '/' || platform_hash END AS base FROM j),
e AS (SELECT *, CASE WHEN layout = 'global' THEN base || '/catalog_' || resource_version || coalesce('_' || w_locale, '') || '.bin' ELSE base || '/catalog_main.bin' END AS url,
  CASE WHEN layout = 'global' THEN base || '/catalog_' || resource_version || '.bin' ELSE base || '/catalog_main.bin' END AS plain FROM d)"""


@query(
    "derive_targets",
    f"""WITH {_DERIVED} SELECT run, layout, url AS catalog_url, CASE WHEN layout = 'global' THEN regexp_replace(url, '\\.bin$', '.hash') END AS hash_url, base AS bundle_base_url,
    CASE WHEN layout = 'global' THEN 'https://dummy.net/asset/' || w_platform END AS placeholder,
    coalesce(catalog_url = plain, true) AND coalesce(bundle_base_url = base, true) AS consistent FROM e""",
    "snapshots", "profiles", "roots",
)
def _(b):
    return snapshots.derive_targets(b.snapshots, b.profiles)


@query(
    "region_identity",
    """SELECT run, CASE WHEN schema_version = 1 AND region IS NULL AND platform = 'iOS' AND protocol_version = '1.0.3' THEN 'jp'
    WHEN schema_version = 2 AND catalog_layout IS NULL THEN region
    WHEN schema_version = 3 AND catalog_layout = CASE WHEN region = 'jp' THEN 'jp' ELSE 'global' END THEN region END AS identity_region FROM snapshots""",
    "snapshots",
)
def _(b):
    return snapshots.region_identity(b.snapshots).select("run", "identity_region")


@query(
    "snapshot_drift",
    """SELECT run, 'resource_version' AS field, resource_version AS pinned, 'v0' AS current FROM snapshots WHERE n % 4 = 1 AND resource_version <> 'v0'
    UNION ALL SELECT run, 'catalog_url', catalog_url, NULL FROM snapshots WHERE n % 10 = 2 AND catalog_url IS NOT NULL
    UNION ALL SELECT run, 'schema_version', cast(schema_version AS VARCHAR), '3' FROM snapshots WHERE n % 6 = 3 AND schema_version <> 3""",
    "snapshots",
)
def _(b):
    s = b.snapshots
    current = s.withColumns(
        {
            "resource_version": F.expr("CASE WHEN n % 4 = 1 THEN 'v0' ELSE resource_version END"),
            "catalog_url": F.expr("CASE WHEN n % 10 <> 2 THEN catalog_url END"),
            "schema_version": F.expr("CASE WHEN n % 6 = 3 THEN 3 ELSE schema_version END"),
            "source": F.lit("ignored"),
        }
    )
    return snapshots.snapshot_drift(s, current)


@query(
    "receipt_base",
    f"""WITH {_DERIVED}, r AS (SELECT *, CASE WHEN n % 23 = 5 THEN url || '?x' ELSE url END AS u, CASE WHEN n % 31 = 6 THEN base || '/z' WHEN catalog_layout IS NULL AND n % 2 = 0 THEN NULL ELSE base END AS bb FROM e)
    SELECT run, CASE WHEN layout = 'global' THEN CASE WHEN n % 23 <> 5 AND n % 31 <> 6 THEN base END
      ELSE CASE WHEN n % 23 <> 5 AND n % 31 <> 6 AND w_locale IS NULL THEN base END END AS base,
    CASE WHEN layout = 'global' AND n % 23 <> 5 AND n % 31 <> 6 THEN 'https://dummy.net/asset/' || platform END AS placeholder FROM r""",
    "snapshots", "profiles", "roots",
)
def _(b):
    derived = snapshots.derive_targets(b.snapshots, b.profiles)
    d = derived.select("run", F.col("catalog_url").alias("_url"), F.col("bundle_base_url").alias("_base"))
    s = b.snapshots.join(b.profiles.select("run", "catalog_locale"), "run").join(d, "run")
    receipts = s.withColumns(
        {
            "catalog_url": F.expr("CASE WHEN n % 23 = 5 THEN _url || '?x' ELSE _url END"),
            "bundle_base_url": F.expr("CASE WHEN n % 31 = 6 THEN _base || '/z' WHEN catalog_layout IS NULL AND n % 2 = 0 THEN NULL ELSE _base END"),
        }
    )
    return snapshots.receipt_base(receipts)


_HOSTS = ["cdn.bang-dream-on.jp", "a-prod-hk-1.gamerfusiontech.com", "x-prod-va-1.bilibiligame.net", "x-prod-kr-1.bilibiligame.net", "x-prod-sg-patch-1.bilibiligame.net", "static.example"]


@query(
    "attribute_region",
    """WITH u AS (SELECT page_id, page_id % 6 AS h, CASE page_id % 7 WHEN 0 THEN '/prod/en_1' WHEN 1 THEN '/prod/kr_2' ELSE '/prod/xx' END AS p, CASE page_id % 4 WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' WHEN 2 THEN 'en' ELSE 'kr' END AS region FROM pages),
    o AS (SELECT *, CASE h WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' WHEN 2 THEN 'en' WHEN 3 THEN 'kr' WHEN 4 THEN CASE p WHEN '/prod/en_1' THEN 'en' WHEN '/prod/kr_2' THEN 'kr' ELSE 'none' END END AS owner FROM u)
    SELECT page_id, region, owner, owner IS NOT NULL AND owner <> region AS mismatch FROM o""",
)
def _(b):
    hosts = F.array(*[F.lit(h) for h in _HOSTS])
    urls = b.table("pages").select(
        "page_id", F.expr("CASE page_id % 4 WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' WHEN 2 THEN 'en' ELSE 'kr' END").alias("region"),
        F.concat(F.lit("https://"), F.get(hosts, (F.col("page_id") % 6).cast("int")),
                 F.expr("CASE page_id % 7 WHEN 0 THEN '/prod/en_1' WHEN 1 THEN '/prod/kr_2' ELSE '/prod/xx' END")).alias("url"),
    )
    return snapshots.attribute_region(urls).select("page_id", "region", "owner", "mismatch")


_NAMES = "CASE c_custkey % 7 WHEN 0 THEN 'tw' WHEN 1 THEN 'jp' WHEN 2 THEN 'hk' WHEN 3 THEN 'cn' WHEN 4 THEN 'us' ELSE 'kr' END"


@query("canonical_region", f"SELECT c_custkey, {_NAMES} AS region, CASE {_NAMES} WHEN 'tw' THEN 'hk' WHEN 'us' THEN NULL ELSE {_NAMES} END AS canonical FROM customer")
def _(b):
    return snapshots.canonical_region(b.table("customer").select("c_custkey", F.expr(_NAMES).alias("region")))


@query("region_violations", "SELECT 'c' || cast(c_custkey AS VARCHAR) AS run, 'unknown_region' AS code, 'us' AS key, cast(NULL AS VARCHAR) AS detail FROM customer WHERE c_custkey % 7 = 4")
def _(b):
    return snapshots.region_violations(
        b.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("run"), F.expr(_NAMES).alias("region"))
    )
