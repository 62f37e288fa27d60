"""Catalogs, receipts, journals, manifests, ledgers and logs derived from the given tables.

Every binding is one SELECT over whole tables, written once for both dialects, so that a query and its
check start from the same rows. Sizes grow with the tables; anomalies are sprinkled in by rule.
"""

from __future__ import annotations

from assetlake.operators.planning import PROVIDERS, REMOTE_PREFIX, RUNTIME_PREFIX

_CRYPT, _PLAIN, _CRI, _LOGICAL = PROVIDERS


def locations(d) -> str:
    run, key = "p_partkey % 3", d.div("p_partkey", 3)
    slot = f"{key} % 61"
    return f"""
SELECT 'r' || cast({run} as string) AS run, {key} AS id, p_brand || '/' || p_name AS primary_key,
  CASE WHEN {key} % 400 = 13 THEN 'http://other.example/'
       WHEN {slot} < 6 THEN 'https://cdn.example/asset/v' || cast({run} as string) || '/'
       WHEN {slot} < 12 THEN 'https://dummy.net/asset/Android/'
       WHEN {slot} < 16 THEN '{RUNTIME_PREFIX}'
       ELSE '{REMOTE_PREFIX}' END
    || CASE WHEN {key} % 50 = 1 THEN 'shared/' || cast({key} % 3 as string) || '.bundle'
            WHEN {key} % 50 = 2 THEN 'shared/' || cast({key} % 3 as string) || '.bundle/part.bin' ELSE
       CASE WHEN {key} % 211 = 4 THEN 'Promo' ELSE lower(p_type) END || '/'
    || CASE WHEN {key} % 307 = 9 THEN '../x' ELSE replace(p_name, ' ', '_') END || '_' || cast({slot} as string)
    || '.bundle' END AS internal_id,
  CASE WHEN {key} % 499 = 7 THEN 'Unknown.Provider'
       WHEN {key} % 97 = 20 THEN '{_CRI}'
       WHEN {slot} % 7 = 1 THEN '{_LOGICAL}'
       WHEN {slot} % 4 = 0 THEN '{_CRYPT}'
       WHEN {slot} % 4 = 3 THEN '{_CRI}'
       ELSE '{_PLAIN}' END AS provider_id,
  CASE WHEN {key} = 0 THEN {d.array('cast(5 as bigint)')}
       WHEN {key} % 331 = 12 THEN {d.array(d.div(key, 3), 'cast(-1 as bigint)')}
       ELSE {d.array(d.div(key, 3), d.div(key, 7))} END AS dependencies
FROM {d.t('part')}"""


def targets(d) -> str:
    return f"""
SELECT DISTINCT 'r' || cast(p_partkey % 3 as string) AS run, 'https://cdn.example/asset/v' || cast(p_partkey % 3 as string) AS base,
  CASE WHEN p_partkey % 3 < 2 THEN 'https://dummy.net/asset/Android' END AS placeholder
FROM {d.t('part')}"""


def catalog_keys(d) -> str:
    """Brands and types as labels; one label that no location carries."""
    run, key = "'r' || cast(p_partkey % 3 as string)", d.div("p_partkey", 3)
    return f"""
SELECT {run} AS run, p_brand AS key, {key} AS id FROM {d.t('part')}
UNION ALL SELECT {run}, p_type, {key} FROM {d.t('part')}
UNION ALL SELECT DISTINCT {run}, 'Nothing', cast(NULL as bigint) FROM {d.t('part')}"""


def receipts(d) -> str:
    """One received file per document."""
    changed = "doc_id % 37 = 5"
    return f"""
SELECT 'x' || cast(doc_id % 3 as string) AS run,
  lang || '/' || source || '/' || cast(doc_id as string) || '.bundle' AS relative_path,
  CASE doc_id % 4 WHEN 0 THEN 'encrypted_bundle' WHEN 1 THEN 'cri' ELSE 'unity_bundle' END AS provider,
  CASE WHEN doc_id % 101 = 17 THEN cast(0 as bigint) ELSE {d.nbytes('text')} END AS bytes,
  CASE WHEN {changed} THEN {d.sha("'c' || text")} ELSE {d.sha('text')} END AS downloaded_sha256,
  {d.sha('text')} AS stored_sha256, (doc_id % 4 = 0 OR doc_id % 53 = 1) AND doc_id % 8 <> 4 AS decrypted, doc_id AS id
FROM {d.t('documents')}"""


def inventory(d) -> str:
    """The stored files: some missing, some altered, some nobody asked for."""
    path = "lang || '/' || source || '/' || cast(doc_id as string)"
    return f"""
SELECT 'x' || cast(doc_id % 3 as string) AS run, {path} || '.bundle' AS path,
  {d.nbytes('text')} + CASE WHEN doc_id % 67 = 3 THEN 1 ELSE 0 END AS length,
  CASE WHEN doc_id % 71 = 8 THEN {d.sha("'t' || text")} ELSE {d.sha('text')} END AS sha256,
  CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 8) ELSE 'UnityFS' || chr(0) END AS prefix
FROM {d.t('documents')} WHERE doc_id % 59 <> 2
UNION ALL
SELECT 'x' || cast(doc_id % 3 as string), {path} || '.extra', {d.nbytes('lang')}, {d.sha('lang')}, 'other'
FROM {d.t('documents')} WHERE doc_id % 83 = 1"""


def outputs(d) -> str:
    """Eight outputs per resource, three runs; every fifth resource is media without objects."""
    res = d.div("doc_id", 24)
    pos = d.div("doc_id", 3) + " % 8"
    res_text = f"cast({res} as string)"
    media = f"{res} % 5 = 0"
    ext = "CASE doc_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'json' WHEN 2 THEN 'bytes' WHEN 3 THEN 'ttf' WHEN 4 THEN 'dat' WHEN 5 THEN 'tar.gz' ELSE 'json' END"
    item = "cast(doc_id % 23 as string)"
    return f"""
SELECT run, CASE WHEN resource_index < 100000 THEN lpad(cast(resource_index as string), 5, '0') ELSE cast(resource_index as string) END AS output_directory,
  resource_index, source, {d.sha("source || 'z'")} AS source_sha256, position, path, kind, bytes, sha256,
  source_file, path_id, class_id, name, container, doc_id
FROM (
SELECT 'x' || cast(doc_id % 3 as string) AS run, {res} AS resource_index, {pos} AS position, doc_id,
  CASE WHEN {media} THEN 'cri_assets_cri/sound/voice_' || {res_text} || '_' || substr({d.sha(res_text)}, 1, 32)
       ELSE 'pack_assets_unity/bundle_' || {res_text} || '_' || substr({d.sha(res_text)}, 1, 32) || '.bundle' END AS source,
  CASE WHEN {media} THEN CASE {pos} WHEN 0 THEN '00000.wav' WHEN 1 THEN '00000.cues.json' WHEN 2 THEN 'alpha/movie.mkv' WHEN 3 THEN 'movie.mkv'
         WHEN 4 THEN '00001.wav' WHEN 5 THEN '00001.cues.json' WHEN 6 THEN '00002.bin' ELSE 'info.json' END
       WHEN doc_id % 29 = 3 THEN '0_' || cast(doc_id as string) || '.acb/00000.wav'
       WHEN doc_id % 10 = 5 THEN '0_' || cast(doc_id as string) || '_layer_000' || cast(doc_id % 7 as string) || '.png'
       ELSE '0_' || cast(doc_id as string) || '.' || {ext} END AS path,
  CASE WHEN {media} THEN CASE {pos} WHEN 1 THEN 'cue_metadata' WHEN 5 THEN 'cue_metadata' WHEN 2 THEN 'usm_mkv' WHEN 3 THEN 'usm_mkv' WHEN 6 THEN 'acb_raw_waveform' WHEN 7 THEN 'binary' ELSE 'hca_wav' END
       WHEN doc_id % 43 = 11 THEN 'playable_json'
       ELSE CASE lang WHEN 'en' THEN 'typetree_json' WHEN 'fr' THEN 'image_png' WHEN 'de' THEN 'text_bytes' ELSE 'object_raw' END END AS kind,
  {d.nbytes('text')} AS bytes, {d.sha('text')} AS sha256,
  CASE WHEN NOT {media} THEN 'cab-' || {res_text} END AS source_file,
  CASE WHEN NOT {media} THEN doc_id - doc_id % 2 * 3 END AS path_id,
  CASE WHEN NOT {media} THEN CASE doc_id % 10 WHEN 0 THEN 28 WHEN 1 THEN 213 WHEN 2 THEN 1 WHEN 3 THEN 114 WHEN 4 THEN 49 WHEN 5 THEN 187
       WHEN 6 THEN 128 WHEN 7 THEN 83 WHEN 8 THEN 142 ELSE 9999 END END AS class_id,
  CASE WHEN NOT {media} THEN CASE {d.div('doc_id', 5)} % 4 WHEN 1 THEN 'Name ' || cast(doc_id % 17 as string) WHEN 2 THEN 'Item' || {item} WHEN 3 THEN 'a/b:c(Clone)(Clone)' END END AS name,
  CASE WHEN NOT {media} THEN CASE {d.div('doc_id', 7)} % 6 WHEN 1 THEN 'Assets/AddressableResources/UI/Item' || {item} || '.prefab'
       WHEN 2 THEN 'Assets/AddressableResources/Story/Item' || {item} || '.txt' WHEN 3 THEN 'Packages/com.x/../Item' || {item} || '.asset'
       WHEN 4 THEN 'Assets/AddressableResources/Sound/item' || {item} || '.acb.bytes' WHEN 5 THEN 'Timeline/Item.playable' END END AS container
FROM {d.t('documents')})"""


def failed_resources(d) -> str:
    """Resources holding a document labelled both poor and toxic."""
    return f"""
SELECT DISTINCT 'x' || cast(doc_id % 3 as string) AS run, {d.div('doc_id', 24)} AS resource_index
FROM {d.t('labels')} WHERE quality = 0 AND toxic = 1"""


def flat(d) -> str:
    """Outputs with the failure flag of their resource."""
    return f"""
SELECT o.*, f.run IS NOT NULL AS failed
FROM ({outputs(d)}) o LEFT JOIN ({failed_resources(d)}) f ON o.run = f.run AND o.resource_index = f.resource_index"""


def cue_rows(d) -> str:
    """Cues per track, with two names that differ only in case; one row per cue."""
    return f"""
SELECT run, output_directory, path, 0 AS n, 'voice_' || cast(resource_index as string) AS name FROM ({outputs(d)}) WHERE kind = 'cue_metadata' AND (position = 1 OR resource_index % 2 = 0)
UNION ALL SELECT run, output_directory, path, 1, 'VOICE_' || cast(resource_index as string) FROM ({outputs(d)}) WHERE kind = 'cue_metadata' AND position = 1
UNION ALL SELECT run, output_directory, path, 2, 'spot?' || cast(resource_index % 7 as string) FROM ({outputs(d)}) WHERE kind = 'cue_metadata' AND position = 1"""


def manifest(d, version: str, changed: str, removed: str) -> str:
    return f"""
SELECT 'x' || cast(doc_id % 3 as string) AS run, {version} AS version,
  lang || '/' || source || '/' || CASE WHEN doc_id % 31 = 4 AND {version} = 2 THEN 'F' ELSE 'f' END || cast(doc_id as string) || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.json' ELSE '.dat' END AS path,
  {d.nbytes('text')} + CASE WHEN {changed} THEN 1 ELSE 0 END AS bytes,
  CASE WHEN {changed} THEN {d.sha("'n' || text")} ELSE {d.sha('text')} END AS sha256,
  CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/json' ELSE 'application/octet-stream' END AS content_type,
  'bundle_' || cast({d.div('doc_id', 20)} as string) AS source, 'binary' AS kind, cast(NULL as int) AS class_id,
  cast(NULL as string) AS container, cast(NULL as string) AS name,
  lpad(cast(doc_id % 1000 as string), 5, '0') || '/' || cast(doc_id as string) AS local
FROM {d.t('documents')} WHERE NOT ({removed})"""


def previous(d) -> str:
    return manifest(d, "1", "doc_id % 11 = 3", "doc_id % 17 = 5")


def failed_sources(d) -> str:
    return f"""
SELECT DISTINCT 'x' || cast(doc_id % 3 as string) AS run, 'bundle_' || cast({d.div('doc_id', 20)} as string) AS source
FROM {d.t('documents')} WHERE {d.div('doc_id', 20)} % 9 = 4"""


def entries(d) -> str:
    """The new plan: failed sources contribute nothing, apart from one key taken over by another source."""
    return manifest(d, "2", "doc_id % 13 = 3", f"doc_id % 19 = 6 OR ({d.div('doc_id', 20)} % 9 = 4 AND doc_id % 20 <> 7)").replace(
        f"'bundle_' || cast({d.div('doc_id', 20)} as string) AS source",
        f"'bundle_' || cast({d.div('doc_id', 20)} + CASE WHEN {d.div('doc_id', 20)} % 9 = 4 THEN 1 ELSE 0 END as string) AS source",
    )


def versions(d) -> str:
    """Five published versions per target, in which keys change, leave and return."""
    one = [
        f"SELECT run AS target, version, path, bytes, sha256, content_type FROM ({manifest(d, str(v), f'doc_id % {7 + v} = 1', f'doc_id % 6 = {v} OR (doc_id % 10 = 3 AND {v} > 3)')})"
        for v in (1, 3, 4, 6, 9)
    ]
    return " UNION ALL ".join(one)


def jobs(d) -> str:
    """Events as jobs of several ledgers."""
    uid = d.sha("cast(event_id as string)")
    run = d.div("user_id", 40)
    dup = "CASE WHEN event_id % 501 = 77 THEN event_id - 1 ELSE event_id END"
    return f"""
SELECT 'l' || cast({run} as string) AS run, event_id AS position,
  CASE WHEN event_id % 997 = 3 THEN 'bad id' ELSE substr({uid},1,8) || '-' || substr({uid},9,4) || '-' || substr({uid},13,4) || '-' || substr({uid},17,4) || '-' || substr({uid},21,12) END AS id,
  CASE WHEN event_id % 883 = 5 THEN 'cn' ELSE CASE user_id % 4 WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' WHEN 2 THEN 'en' ELSE 'kr' END END AS region,
  CASE WHEN event_id % 769 = 8 THEN 'no good' ELSE 'profile_' || cast(user_id % 5 as string) END AS profile,
  CASE event_id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'export' ELSE 'verify' END AS operation,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled'
    ELSE CASE WHEN event_id % 400 = 11 THEN 'running' WHEN event_id % 400 = 12 THEN 'cancelling' ELSE 'completed' END END AS status,
  {d.instant('ts')} AS created_at, {d.plus_seconds(d.instant('ts'), 'cast(event_id % 7200 as int)')} AS updated_at,
  CASE WHEN event_id % 613 = 2 THEN 'a b' ELSE 'export' END AS phase, event_id % 50 AS completed, event_id % 7 AS failed,
  CASE WHEN event_id % 2 = 0 THEN event_id % 50 + event_id % 6 END AS total,
  CASE WHEN event_type = 'error' THEN 'io_error' END AS failure,
  CASE WHEN event_id % 5 = 4 AND event_id % 25 <> 24 THEN event_id - 1 WHEN event_id % 5 IN (1, 2, 3) THEN event_id - 1 END AS retry_position,
  CASE WHEN event_id % 4 = 0 THEN {d.sha(f"'k' || cast({dup} as string)")} WHEN event_id % 501 = 77 THEN {d.sha(f"'k' || cast({dup} as string)")} END AS idempotency_sha256,
  CASE WHEN event_type IN ('click', 'purchase') AND event_id % 6 <> 1 THEN 'done' END AS outcome
FROM {d.t('events')}"""


def job_targets(d) -> str:
    return f"""
SELECT DISTINCT 'l' || cast({d.div('user_id', 40)} as string) AS run, CASE user_id % 4 WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' ELSE 'en' END AS region,
  CASE WHEN user_id % 8 < 4 THEN 'bot' ELSE 'site' END AS name, 'https://hook.example/' || cast(user_id % 4 as string) AS url,
  {d.sha("cast(user_id % 8 as string)")} AS identity
FROM {d.t('events')} WHERE user_id % 4 < 3"""


def acks(d) -> str:
    """Every third notice of a completed job is acknowledged."""
    return f"""
SELECT j.run, j.id AS job_id, t.identity FROM ({jobs(d)}) j JOIN ({job_targets(d)}) t ON j.run = t.run AND j.region = t.region
WHERE j.status = 'completed' AND j.outcome IS NOT NULL AND j.position % 3 = 0"""


def requests(d) -> str:
    """Submissions: some repeat a key of the ledger, some repeat each other, some change the request."""
    key = d.div("event_id", 3)
    return f"""
SELECT 'l' || cast({d.div('user_id', 40)} as string) AS run, event_id AS position,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 211 = 7 THEN 'bad key' ELSE 'k' || cast({key} * 4 as string) END AS key,
  CASE user_id % 4 WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' WHEN 2 THEN 'en' ELSE 'kr' END AS region, 'profile_' || cast(user_id % 5 as string) AS profile,
  CASE {key} % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'export' ELSE 'verify' END AS operation, {d.instant('ts')} AS submitted_at
FROM {d.t('events')}"""


def history(d) -> str:
    """Status steps per user and day, legal and not."""
    return f"""
SELECT 'h' || cast(user_id % 3 as string) AS run, 'job' || cast(user_id as string) AS job_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelling' ELSE 'completed' END AS status,
  event_id % 3 AS failed, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'service_interrupted' ELSE 'Bad Code' END END AS failure
FROM {d.t('events')}"""


def access(d) -> str:
    """Access records with peers and forwarded lists of every shape."""
    u = "user_id"
    return f"""
SELECT 'w' || cast({u} % 3 as string) AS run, {d.instant('ts')} AS timestamp, 'req-' || cast(event_id as string) AS request_id,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'BREW' ELSE 'DELETE' END AS method,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE '/v1/' || event_type || '/{{id}}' END AS route,
  CASE {u} % 6 WHEN 0 THEN '8.20.30.40' WHEN 1 THEN '172.16.5.5' WHEN 2 THEN '192.168.2.3' WHEN 3 THEN '::ffff:172.16.5.5' WHEN 4 THEN 'fe80::5' ELSE 'fe80::7' END AS peer_ip,
  CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '9.1.1.' || cast({u} as string) || ', 192.168.7.7' WHEN 2 THEN '9.9.9.9, 8.8.1.' || cast({u} as string) || ', 192.168.7.7'
    WHEN 3 THEN 'nobody, 192.168.7.7' WHEN 4 THEN '2400:cb00::77, fe80::6' WHEN 5 THEN '192.168.1.' || cast({u} as string) || ',192.168.7.7' WHEN 6 THEN '' ELSE '9.1.1.300' END AS forwarded,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 13 = 0 THEN NULL ELSE 200 END AS status,
  CASE WHEN event_id % 13 = 0 AND event_type <> 'error' THEN 'cancelled' ELSE 'response' END AS outcome,
  event_id % 3000 AS duration_ms, event_id % 500 AS queue_dropped_records, value
FROM {d.t('events')}"""


def app_log(d) -> str:
    return f"""
SELECT 'w' || cast(user_id % 3 as string) AS run, {d.instant('ts')} AS timestamp, event_id,
  CASE event_type WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'TRACE' END AS level,
  CASE user_id % 5 WHEN 0 THEN 'app' WHEN 1 THEN 'app::jobs' WHEN 2 THEN 'app::jobs::queue' WHEN 3 THEN 'app::jobsite' ELSE 'other' END AS target,
  props AS message, event_type AS stage
FROM {d.t('events')}"""


def snapshots(d) -> str:
    """Orders as observed snapshots."""
    k = "o_orderkey"
    hash32 = f"substr({d.sha(f'cast({k} as string)')}, 1, 32)"
    glob = f"{k} % 4 > 0"
    region = f"CASE {k} % 4 WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' WHEN 2 THEN 'en' ELSE 'kr' END"
    platform = f"CASE WHEN {glob} THEN 'Android' ELSE 'iOS' END"
    version = f"CASE WHEN {k} % 89 = 5 THEN '../other' ELSE 'v' || cast({k} % 100 as string) END"
    root = f"CASE WHEN {k} % 53 = 9 THEN 'https://elsewhere.example/../x' ELSE 'https://static' || cast({k} % 5 as string) || '.example' END"
    base = f"{root} || '/asset/' || {platform}"
    three = f"{k} % 3 > 0 AND {k} % 47 <> 6"
    return f"""
SELECT 's' || cast({k} as string) AS run, {k} % 41 = 3 AS stale, CASE WHEN {k} % 67 = 1 THEN NULL ELSE {region} END AS region,
  CASE WHEN {k} % 67 = 1 THEN 1 WHEN {k} % 3 > 0 THEN 3 ELSE 2 END AS schema_version,
  CASE WHEN {k} % 43 = 2 THEN 'cbt' ELSE 'release' END AS environment, {platform} AS platform, '1.0.4' AS client_version,
  CASE WHEN {k} % 67 = 1 THEN '1.0.3' WHEN {glob} THEN '1.0.1' ELSE '1.0.4' END AS protocol_version, {version} AS resource_version,
  CASE WHEN {k} % 37 = 4 THEN 'HASH' ELSE {hash32} END AS platform_hash, {root} AS effective_cdn_root,
  CASE WHEN {k} % 29 = 8 THEN 'OTHER' WHEN {glob} THEN '' ELSE 'PASSWORD' END AS credential_ref,
  {d.plus_seconds(d.instant("'1999-01-01 00:00:00'"), f'cast({k} % 330 as int)')} AS observed_at,
  CASE WHEN {k} % 59 = 7 THEN 'offline' ELSE 'remote' END AS source,
  CASE WHEN {three} THEN CASE WHEN {glob} THEN 'global' ELSE 'jp' END END AS catalog_layout,
  CASE WHEN {three} THEN CASE WHEN {k} % 61 = 3 THEN 'https://static.example/wrong.bin' WHEN {glob} THEN {base} || '/catalog_' || {version} || '.bin'
    ELSE {root} || '/asset/' || {version} || '/iOS/' || {hash32} || '/catalog_main.bin' END END AS catalog_url,
  CASE WHEN {three} THEN CASE WHEN {glob} THEN {base} ELSE {root} || '/asset/' || {version} || '/iOS/' || {hash32} END END AS bundle_base_url,
  CASE WHEN {three} THEN CASE WHEN {glob} THEN 'none' ELSE 'basic' END END AS cdn_authorization, {k} AS n
FROM {d.t('orders')}"""


def profiles(d) -> str:
    k = "o_orderkey"
    return f"""
SELECT 's' || cast({k} as string) AS run, CASE {k} % 4 WHEN 0 THEN 'jp' WHEN 1 THEN 'hk' WHEN 2 THEN 'en' ELSE 'kr' END AS region, 'release' AS environment,
  CASE WHEN {k} % 4 > 0 THEN 'Android' ELSE 'iOS' END AS platform, '1.0.4' AS client_version,
  CASE WHEN {k} % 67 = 1 AND {k} % 4 = 0 THEN '1.0.3' WHEN {k} % 4 > 0 THEN '1.0.1' ELSE '1.0.4' END AS protocol_version,
  CASE WHEN {k} % 7 = 2 THEN 'ko' END AS catalog_locale
FROM {d.t('orders')}"""


def roots(d) -> str:
    k = "o_orderkey"
    return f"""
SELECT 's' || cast({k} as string) AS run, 'https://static' || cast({k} % 5 as string) || '.example' AS root,
  CASE WHEN {k} % 4 > 0 THEN 'none' ELSE 'basic' END AS authorization, 'PASSWORD' AS credential_ref
FROM {d.t('orders')}"""


def totals(d) -> str:
    """Stated totals per run; two runs state something wrong."""
    return f"""
SELECT run, 4 AS schema_version, count(DISTINCT resource_index) FILTER (WHERE NOT failed) AS succeeded, count(DISTINCT resource_index) FILTER (WHERE failed) AS failed,
  count(DISTINCT resource_index) FILTER (WHERE NOT failed AND resource_index % 3 = 0) AS cache_hits,
  count(*) + CASE WHEN run = 'x1' THEN 1 ELSE 0 END AS output_files, cast(sum(bytes) as bigint) + CASE WHEN run = 'x2' THEN 1 ELSE 0 END AS output_bytes,
  count(*) AS unity_objects, count(*) - count(DISTINCT resource_index) AS selected_unity_objects, count(DISTINCT resource_index) AS skipped_unity_objects,
  count(DISTINCT resource_index) AS input_files, run = 'x0' AS acb_preserve, run <> 'x0' AS usm_preserve,
  CASE WHEN run = 'x2' THEN 'alongside' END AS raw_mode
FROM ({flat(d)}) GROUP BY run"""


def stated_kinds(d) -> str:
    return f"""
SELECT run, kind, count(*) + CASE WHEN run = 'x1' AND kind = 'usm_mkv' THEN 2 ELSE 0 END AS files FROM ({flat(d)}) WHERE NOT (run = 'x2' AND kind = 'binary') GROUP BY run, kind"""


def summaries(d) -> str:
    """Orders as summaries, each rule broken now and then."""
    k = "o_orderkey"
    return f"""
SELECT 's' || cast({k} as string) AS run, CASE WHEN {k} % 101 = 1 THEN 3 ELSE 4 END AS schema_version, {k} % 103 <> 2 AS retained,
  CASE WHEN {k} % 107 = 3 THEN 'kr' ELSE 'jp' END AS region, 'jp' AS want_region, {k} % 109 <> 4 AS kinds_valid, {k} % 7 <> 5 AS raw_valid,
  {k} % 100 AS input_files, {k} % 100 + CASE WHEN {k} % 17 = 3 THEN -1 WHEN {k} % 5 = 2 THEN 1 ELSE 0 END AS catalog_files,
  {k} % 100 - {k} % 4 AS succeeded, {k} % 4 + CASE WHEN {k} % 61 = 4 THEN 1 ELSE 0 END AS failed,
  CASE WHEN {k} % 47 = 5 THEN {k} % 4 > 0 ELSE {k} % 4 = 0 END AS complete, {k} % 79 AS output_files, {k} % 3 = 0 AS full_export,
  {k} % 2 = 0 AS full_catalog, {k} % 23 <> 6 AS media_full, {k} % 19 <> 7 AS native_kinds,
  CASE {k} % 13 WHEN 8 THEN 'only' WHEN 9 THEN 'alongside' END AS raw_mode,
  CASE WHEN {k} % 29 = 9 THEN 'ABC' ELSE {d.sha(f'cast({k} as string)')} END AS catalog_sha256
FROM {d.t('orders')}"""


def bad_journal(d) -> str:
    """Orders as journal rows whose names and sources are not always right."""
    k, i = "o_orderkey", d.div("o_orderkey", 3)
    return f"""
SELECT 'j' || cast({k} % 3 as string) AS run,
  CASE WHEN {i} % 50 = 3 THEN cast({i} as string) WHEN {i} % 50 = 4 THEN 'x' || cast({i} as string) WHEN {i} % 50 = 5 THEN lpad(cast({i} - 1 as string), 5, '0')
    ELSE lpad(cast({i} as string), 5, '0') END AS output_directory,
  CASE WHEN {i} % 70 = 6 THEN 'dup/source' WHEN {i} % 71 = 7 THEN '../' || cast({i} as string) ELSE 'src/' || cast({i} as string) END AS source,
  CASE WHEN {i} % 73 = 8 THEN 'no' ELSE {d.sha(f'cast({k} as string)')} END AS source_sha256,
  o_orderstatus = 'P' AND {k} % 9 = 1 AS failed, {k} % 4 = 0 AS cache_hit
FROM {d.t('orders')}"""


def journal_sizes(d) -> str:
    return f"""
SELECT 'j' || cast(o_orderkey % 3 as string) AS run, count(*) - 10 AS input_files FROM {d.t('orders')} GROUP BY 1"""


BINDINGS = {
    f.__name__: f
    for f in (
        locations, targets, catalog_keys, receipts, inventory, outputs, failed_resources, flat, cue_rows, previous,
        failed_sources, entries, versions, jobs, job_targets, acks, requests, history, access, app_log, snapshots,
        profiles, roots, totals, stated_kinds, summaries, bad_journal, journal_sizes,
    )
}
