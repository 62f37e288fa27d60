"""Registered queries: readable layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators import claims, layout
from assetlake.operators.exports import explode_outputs
from assetlake.plans.bound import Bound, query
from assetlake.plans.publish_plan import publish_plan


def _fix(x: str) -> str:
    t = f"trim(translate({x}, '<>:\"/\\|?*#%', '___________'))"
    tail = f"regexp_extract({t}, '((?:\\(Clone\\))*)$', 1)"
    return (
        f"CASE WHEN length({tail}) >= 14 THEN rtrim(left({t}, length({t}) - length({tail}))) || '__clone' || cast(length({tail}) // 7 AS VARCHAR) ELSE {t} END"
    )


def _loose(x: str) -> str:
    return f"lower(regexp_replace({x}, '[\\s_-]', '', 'g'))"


def _stem(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^.+\\.[^.]*$') THEN regexp_extract({x}, '^(.+)\\.([^.]*)$', 1) ELSE {x} END"


def _ext(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^.+\\.[^.]*$') THEN regexp_extract({x}, '^(.+)\\.([^.]*)$', 2) ELSE '' END"


def _join(stem: str, ext: str) -> str:
    return f"CASE WHEN {ext} = '' THEN {stem} ELSE {stem} || '.' || {ext} END"


_CLASS = "CASE class_id WHEN 28 THEN 'Texture2D' WHEN 213 THEN 'Sprite' WHEN 1 THEN 'GameObject' WHEN 114 THEN 'MonoBehaviour' WHEN 49 THEN 'TextAsset' WHEN 187 THEN 'Texture2DArray' WHEN 128 THEN 'Font' WHEN 83 THEN 'AudioClip' WHEN 142 THEN 'AssetBundle' ELSE 'ClassID' || cast(class_id AS VARCHAR) END"
_DIR = "CASE class_id WHEN 28 THEN 'texture2d' WHEN 213 THEN 'sprite' WHEN 1 THEN 'gameobject' WHEN 114 THEN 'monobehaviour' WHEN 49 THEN 'text_asset' WHEN 187 THEN 'texture2d_array' WHEN 128 THEN 'font' WHEN 83 THEN 'audio_clip' WHEN 142 THEN 'asset_bundle' ELSE 'class_id' || cast(class_id AS VARCHAR) END"

_LOCATED = f"""l0 AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS file,
  list_filter(string_split(regexp_replace(container, '^Assets/AddressableResources/+', ''), '/'), lambda p: p NOT IN ('', '.', '..')) AS parts,
  'bundle_' || cast(resource_index AS VARCHAR) AS bundle FROM flat WHERE NOT failed),
l1 AS (SELECT *, {_stem('file')} AS file_stem, {_ext('file')} AS ext, parts[-1] AS leaf, CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '/') || '/' ELSE '' END AS dirs FROM l0),
located AS (SELECT *, {_stem('leaf')} AS leaf_stem, {_ext('leaf')} AS leaf_ext, CASE WHEN container IS NULL THEN '_bundles/' || bundle ELSE lower(dirs || leaf) END AS scope FROM l1)"""

_TEXTURES = f"""tx AS (SELECT run, output_directory, source_file, path_id, arg_min(scope, position) AS scope, arg_min(container IS NOT NULL, position) AS boxed,
  arg_min(coalesce({_fix('name')} = {_fix('leaf_stem')}, false), position) AS named FROM located WHERE class_id = 28 GROUP BY 1, 2, 3, 4),
textures AS (SELECT run, scope, count(*) AS textures, count(*) = 1 AND bool_and(named) AS flat FROM tx WHERE boxed GROUP BY 1, 2)"""

_BRANCH = f"""branched AS (SELECT l.*, CASE WHEN class_id IS NULL THEN 'media' WHEN container IS NULL THEN 'bundle' WHEN kind = 'playable_json' THEN 'flat'
  WHEN class_id = 49 AND name IS NOT NULL AND {_loose(_fix('name'))} <> {_loose('leaf_stem')} AND leaf_ext <> 'bytes' THEN 'nested'
  WHEN class_id = 49 AND leaf_ext = 'bytes' THEN 'text_stem' WHEN class_id = 49 THEN 'text_file'
  WHEN class_id = 114 AND coalesce({_loose(_fix('name'))} = {_loose('leaf_stem')}, false) THEN 'flat' WHEN class_id = 28 AND coalesce(t.flat, false) THEN 'flat'
  WHEN class_id = 128 THEN 'font' WHEN class_id IN (83, 9999) THEN 'flat' ELSE 'nested' END AS branch
  FROM located l LEFT JOIN textures t ON t.run = l.run AND t.scope = l.scope)"""

_NUMBERS = f"""firsts AS (SELECT run, source_file, path_id, min({{'i': resource_index, 'p': position, 's': scope, 'c': class_id}}) AS f FROM branched
  WHERE branch IN ('bundle', 'font', 'nested') AND name IS NULL GROUP BY 1, 2, 3),
numbers AS (SELECT run, source_file, path_id, {_CLASS.replace('class_id', 'f.c')} || '_' || cast(row_number() OVER (PARTITION BY run, f.s, f.c ORDER BY f.i, f.p) - 1 AS VARCHAR) AS number_stem FROM firsts)"""

_OBJECTS = f"""o1 AS (SELECT b.*, coalesce({_fix('name')}, number_stem) AS stem FROM branched b LEFT JOIN numbers n ON n.run = b.run AND n.source_file = b.source_file AND n.path_id = b.path_id),
o2 AS (SELECT *, {_join('stem', 'ext')} AS named FROM o1),
o3 AS (SELECT *, CASE branch WHEN 'bundle' THEN '_bundles/' || bundle || '/' || {_DIR} || '/' || named WHEN 'flat' THEN dirs || {_join('leaf_stem', 'ext')}
  WHEN 'text_stem' THEN dirs || leaf_stem WHEN 'text_file' THEN dirs || leaf WHEN 'font' THEN dirs || named WHEN 'nested' THEN dirs || leaf_stem || '.assets/' || {_DIR} || '/' || named END AS whole,
  CASE WHEN class_id = 187 THEN regexp_extract(file_stem, '_layer_([0-9]{{4}})$', 1) ELSE '' END AS layer FROM o2),
o4 AS (SELECT *, regexp_extract(whole, '^((?:.*/)?)[^/]*$', 1) AS w_dir, regexp_extract(whole, '([^/]*)$', 1) AS w_file FROM o3),
keyed AS (SELECT *, CASE WHEN layer <> '' THEN w_dir || {_stem('w_file')} || '/' || {_join("('layer_' || layer)", 'ext')} ELSE whole END AS object_key FROM o4)"""

_CHAIN = f"{_LOCATED}, {_TEXTURES}, {_BRANCH}, {_NUMBERS}, {_OBJECTS}"

_ALIASES = f"""names AS (SELECT c.run, c.output_directory, c.path AS cue_path, list(c.name ORDER BY c.n) AS names FROM
    (SELECT run, output_directory, path, {_fix('name')} AS name, min(n) AS n FROM (SELECT run, output_directory, path, arg_min(name, n) AS name, min(n) AS n FROM cue_rows GROUP BY run, output_directory, path, lower(name)) GROUP BY ALL) c GROUP BY 1, 2, 3),
cue_files AS (SELECT run, output_directory, path AS cue_path FROM flat WHERE NOT failed AND kind = 'cue_metadata'),
k1 AS (SELECT *, string_split(file, '.')[1] AS idx, regexp_extract(path, '^((?:.*/)?)[^/]*$', 1) || string_split(file, '.')[1] || '.cues.json' AS cue_path,
  CASE WHEN contains(file, '.') THEN substr(file, instr(file, '.') + 1) ELSE '' END AS rest, class_id IS NOT NULL AND contains(path, '/') AS deep FROM keyed),
k2 AS (SELECT k.*, CASE WHEN NOT regexp_full_match(k.idx, '[0-9]{{5}}') OR f.run IS NULL THEN NULL WHEN len(coalesce(n.names, [])) = 0 THEN [k.idx] WHEN k.kind = 'cue_metadata' THEN n.names[1:1] ELSE n.names END AS tracks
  FROM k1 k LEFT JOIN cue_files f ON f.run = k.run AND f.output_directory = k.output_directory AND f.cue_path = k.cue_path
  LEFT JOIN names n ON n.run = f.run AND n.output_directory = f.output_directory AND n.cue_path = f.cue_path),
k3 AS (SELECT *, CASE WHEN class_id IS NOT NULL AND NOT deep THEN [NULL] WHEN tracks IS NOT NULL THEN tracks WHEN deep THEN [idx] ELSE [NULL] END AS use FROM k2),
k4 AS (SELECT *, unnest(use) AS track, unnest(range(len(use))) AS alias FROM k3),
k5 AS (SELECT *, 'voice_' || cast(resource_index AS VARCHAR) AS m_stem, CASE WHEN starts_with(path, 'alpha/') THEN '.alpha' ELSE '' END AS m_alpha,
  regexp_extract(object_key, '^((?:.*/)?)[^/]*$', 1) AS k_dir, regexp_extract(object_key, '([^/]*)$', 1) AS k_file FROM k4),
wanted AS (SELECT *, lower(CASE WHEN class_id IS NULL THEN 'cri/sound/' || m_stem || '/' || CASE WHEN track IS NOT NULL THEN {_join('track', 'rest')}
    WHEN regexp_full_match(idx, '[0-9]{{5}}') THEN {_join('(m_stem || m_alpha)', 'rest')} WHEN file_stem = 'movie' THEN {_join('(m_stem || m_alpha)', 'ext')} ELSE m_stem || m_alpha || '.' || file END
  WHEN deep THEN k_dir || {_stem('k_file')} || '/' || {_join('track', 'rest')} ELSE object_key END) AS key, output_directory || '/' || path AS local FROM k5)"""

_CLAIMS = f"""c1 AS (SELECT run, lower(key) AS folded, bytes, sha256, min({{'i': resource_index, 'p': position, 'a': alias, 'key': key, 'local': local, 'source': source, 'kind': kind}}) AS f, count(*) AS copies FROM wanted GROUP BY 1, 2, 3, 4),
c2 AS (SELECT *, row_number() OVER (PARTITION BY run, folded ORDER BY f.i, f.p, f.a) AS n, regexp_extract(f.key, '^((?:.*/)?)[^/]*$', 1) AS d, regexp_extract(f.key, '([^/]*)$', 1) AS b FROM c1),
claimed AS (SELECT *, CASE WHEN n = 1 THEN f.key ELSE d || {_join("(" + _stem('b') + " || '__dup' || cast(n AS VARCHAR))", '(' + _ext('b') + ')')} END AS path FROM c2)"""

_CT = "CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'png' THEN 'image/png' WHEN 'json' THEN 'application/json' WHEN 'txt' THEN 'text/plain; charset=utf-8' WHEN 'wav' THEN 'audio/wav' WHEN 'mkv' THEN 'video/x-matroska' WHEN 'ttf' THEN 'font/ttf' ELSE 'application/octet-stream' END"


def _cues(b: Bound):
    rows = F.sort_array(F.collect_list(F.struct("n", "name")))
    return b.cue_rows.groupBy("run", "output_directory", "path").agg(rows.alias("r")).select(
        "run", "output_directory", "path",
        F.transform("r", lambda x: F.struct(x["name"].alias("name"), F.lit(0).cast("long").alias("cue_id"), F.lit(0).cast("long").alias("wave_id"))).alias("cues"),
    )


@query("explode_outputs", "SELECT run, output_directory, position, path, kind, bytes, sha256, class_id, failed FROM flat", "flat")
def _(b):
    return explode_outputs(b.journal).select("run", "output_directory", "position", "path", "kind", "bytes", "sha256", "class_id", "failed")


@query(
    "strip_container",
    f"WITH {_LOCATED} SELECT container, any_value(array_to_string(parts, '|')) AS parts, count(*) AS outputs FROM located WHERE container IS NOT NULL GROUP BY 1",
    "flat",
)
def _(b):
    rows = b.flat.where("NOT failed AND container IS NOT NULL")
    parts = F.array_join(layout.strip_container(F.col("container")), "|")
    return rows.groupBy("container", parts.alias("parts")).agg(F.count(F.lit(1)).alias("outputs"))


@query("class_dirs", f"SELECT DISTINCT class_id, {_CLASS} AS class_name, {_DIR} AS directory FROM flat WHERE class_id IS NOT NULL", "flat")
def _(b):
    return layout.class_dirs(b.flat.where("class_id IS NOT NULL"))


@query(
    "source_location",
    """SELECT DISTINCT source, CASE WHEN starts_with(source, 'cri') THEN 'cri/sound' ELSE 'pack_assets_unity' END AS folder,
    CASE WHEN starts_with(source, 'cri') THEN 'voice_' || cast(resource_index AS VARCHAR) ELSE 'bundle_' || cast(resource_index AS VARCHAR) || '_' || regexp_extract(source, '_([0-9a-f]{32}\\.bundle)$', 1) END AS stem FROM flat""",
    "flat",
)
def _(b):
    rows = b.flat.select("source", layout.source_location(F.col("source")).alias("l"))
    return rows.select("source", F.array_join("l.dirs", "/").alias("folder"), F.col("l.stem").alias("stem")).distinct()


@query("texture_rule", f"WITH {_LOCATED}, {_TEXTURES} SELECT run, scope, textures, flat FROM textures", "flat")
def _(b):
    return layout.texture_rule(layout.located(b.flat)).withColumnRenamed("_scope", "scope")


@query("number_unnamed", f"WITH {_LOCATED}, {_TEXTURES}, {_BRANCH}, {_NUMBERS} SELECT * FROM numbers", "flat")
def _(b):
    rows = layout.located(b.flat)
    return layout.number_unnamed(layout.branches(rows, layout.texture_rule(rows))).withColumnRenamed("_number_stem", "number_stem")


@query("object_keys", f"WITH {_CHAIN} SELECT run, output_directory, path, branch, object_key FROM keyed WHERE class_id IS NOT NULL", "flat")
def _(b):
    keyed = layout.object_keys(b.flat).where("class_id IS NOT NULL")
    branch = F.when(F.col("_branch") == "text_nested", "nested").otherwise(F.col("_branch"))
    return keyed.select("run", "output_directory", "path", branch.alias("branch"), F.array_join("_key_parts", "/").alias("object_key"))


@query("layer_keys", f"WITH {_CHAIN} SELECT run, path, object_key FROM keyed WHERE class_id = 187 AND layer <> ''", "flat")
def _(b):
    keyed = layout.object_keys(b.flat).where(F.expr("class_id = 187") & F.col("_file_stem").rlike("_layer_[0-9]{4}\\z"))
    return keyed.select("run", "path", F.array_join("_key_parts", "/").alias("object_key"))


@query(
    "media_keys",
    f"""WITH {_CHAIN}, x AS (SELECT *, 'voice_' || cast(resource_index AS VARCHAR) || CASE WHEN starts_with(path, 'alpha/') THEN '.alpha' ELSE '' END AS s FROM keyed WHERE class_id IS NULL)
    SELECT run, output_directory, path, 'cri/sound/voice_' || cast(resource_index AS VARCHAR) || '/' || CASE WHEN regexp_matches(file, '^[0-9]{{5}}\\.') THEN s || substr(file, 6)
      WHEN file_stem = 'movie' THEN s || '.' || ext ELSE s || '.' || file END AS media_key FROM x""",
    "flat",
)
def _(b):
    return layout.media_keys(b.flat).select("run", "output_directory", "path", F.array_join("_key_parts", "/").alias("media_key"))


def _aliased(b: Bound):
    return layout.cue_aliases(layout.object_keys(b.flat), layout.cue_names(b.flat, _cues(b)))


@query("cue_aliases", f"WITH {_CHAIN}, {_ALIASES} SELECT run, local, alias, track FROM wanted WHERE track IS NOT NULL", "flat", "cue_rows")
def _(b):
    return _aliased(b).where("_track IS NOT NULL").select(
        "run", F.concat_ws("/", "output_directory", "path").alias("local"), "alias", F.col("_track").alias("track")
    )


@query("readable_keys", f"WITH {_CHAIN}, {_ALIASES} SELECT run, local, alias, key FROM wanted", "flat", "cue_rows")
def _(b):
    return layout.readable_keys(b.flat, _cues(b)).select("run", "local", "alias", "key")


@query(
    "fold_keys",
    f"WITH {_CHAIN}, {_ALIASES} SELECT run, count(DISTINCT key) AS folded_keys, count(*) AS outputs FROM wanted GROUP BY run",
    "flat", "cue_rows",
)
def _(b):
    return layout.fold_keys(_aliased(b), True).groupBy("run").agg(F.countDistinct("key").alias("folded_keys"), F.count(F.lit(1)).alias("outputs"))


@query(
    "key_violations",
    """SELECT run, 'invalid_key' AS code, output_directory || '/' || path AS key, CASE doc_id % 5 WHEN 0 THEN path || '/' WHEN 1 THEN repeat('k', 1100) WHEN 2 THEN path || chr(10) WHEN 3 THEN 'a/../' || path END AS detail
    FROM flat WHERE doc_id % 5 < 4""",
    "flat",
)
def _(b):
    key = F.expr("CASE doc_id % 5 WHEN 0 THEN path || '/' WHEN 1 THEN repeat('k', 1100) WHEN 2 THEN path || chr(10) WHEN 3 THEN 'a/../' || path ELSE path END")
    return layout.key_violations(b.flat.withColumn("key", key))


_FULL = ("flat", "cue_rows")


@query(
    "claim_keys",
    f"WITH {_CHAIN}, {_ALIASES}, {_CLAIMS} SELECT run, path, f.local AS local, bytes, sha256, {_CT} AS content_type FROM claimed",
    *_FULL,
)
def _(b):
    entries, _ = claims.claim_keys(layout.readable_keys(b.flat, _cues(b)))
    return entries.select("run", "path", "local", "bytes", "sha256", "content_type")


@query(
    "claim_counts",
    f"WITH {_CHAIN}, {_ALIASES}, {_CLAIMS} SELECT run, cast(sum(copies) - count(*) AS BIGINT) AS deduplicated, count(*) FILTER (n > 1) AS renamed FROM claimed GROUP BY run",
    *_FULL,
)
def _(b):
    return claims.claim_keys(layout.readable_keys(b.flat, _cues(b)))[1]


@query("split_failed", "SELECT DISTINCT run, source FROM flat WHERE failed", "flat")
def _(b):
    return layout.split_failed(b.journal, 5)[0]


@query(
    "split_failed_violations",
    "SELECT run, 'too_many_failed' AS code, run AS key, cast(count(DISTINCT resource_index) AS VARCHAR) AS detail FROM flat WHERE failed GROUP BY run HAVING count(DISTINCT resource_index) > 1",
    "flat",
)
def _(b):
    return layout.split_failed(b.journal, 1)[1]


@query("content_type", f"SELECT run, {_CT} AS content_type, count(*) AS outputs FROM flat GROUP BY 1, 2", "flat")
def _(b):
    return b.flat.groupBy("run", layout.content_type(F.col("path")).alias("content_type")).agg(F.count(F.lit(1)).alias("outputs"))


@query(
    "publish_plan",
    f"""WITH {_CHAIN}, {_ALIASES}, {_CLAIMS}, prev AS (SELECT run, path, bytes, sha256, {_CT} AS content_type, f.source AS source FROM claimed WHERE f.i % 4 <> 1),
    lost AS (SELECT DISTINCT run, source FROM flat WHERE failed)
    SELECT c.run, count(*) AS files, count(*) FILTER (p.path IS NULL) AS uploaded, count(*) FILTER (p.path IS NOT NULL) AS unchanged, cast(0 AS BIGINT) AS pruned,
      cast(sum(copies) - count(*) AS BIGINT) AS deduplicated, count(*) FILTER (n > 1) AS renamed,
      (SELECT count(*) FROM lost l WHERE l.run = c.run) AS failed_resources, cast(0 AS BIGINT) AS carried_forward, cast(sum(c.bytes) AS BIGINT) AS bytes
    FROM claimed c LEFT JOIN prev p ON p.run = c.run AND p.path = c.path GROUP BY c.run""",
    *_FULL,
)
def _(b):
    cues = _cues(b)
    entries, _ = claims.claim_keys(layout.readable_keys(b.flat, cues))
    previous = entries.where("resource_index % 4 <> 1")
    inventory = b.flat.select("run", F.concat_ws("/", "output_directory", "path").alias("path"), "bytes", "sha256")
    return publish_plan(b.journal, cues, previous, inventory, max_failed=9)["counts"]
