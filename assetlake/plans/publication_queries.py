"""Registered queries: publication, ledger and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators import ledger, logs, publication
from assetlake.plans.bound import Bound, query
from assetlake.plans.integrity_queries import rules
from assetlake.session import materialize

_DIFF = """diff AS (SELECT e.*, p.path IS NULL OR p.bytes <> e.bytes OR p.sha256 <> e.sha256 OR p.content_type <> e.content_type AS pending
  FROM entries e LEFT JOIN previous p ON p.run = e.run AND p.path = e.path),
carried AS (SELECT p.* FROM previous p WHERE EXISTS (SELECT 1 FROM failed_sources f WHERE f.run = p.run AND f.source = p.source)
  AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.run = p.run AND lower(e.path) = lower(p.path))),
pruned AS (SELECT p.* FROM previous p WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.run = p.run AND e.path = p.path)
  AND NOT EXISTS (SELECT 1 FROM carried c WHERE c.run = p.run AND c.path = p.path))"""
_ALL = ("entries", "previous", "failed_sources")


@query("pending", f"WITH {_DIFF} SELECT run, path, bytes, sha256 FROM diff WHERE pending", *_ALL)
def _(b):
    return publication.pending(b.entries, b.previous).select("run", "path", "bytes", "sha256")


@query("unchanged", f"WITH {_DIFF} SELECT run, path, bytes, sha256 FROM diff WHERE NOT pending", *_ALL)
def _(b):
    return publication.unchanged(b.entries, b.previous).select("run", "path", "bytes", "sha256")


@query("carried", f"WITH {_DIFF} SELECT run, path, source, bytes FROM carried", *_ALL)
def _(b):
    return publication.carried(b.previous, b.failed_sources, b.entries).select("run", "path", "source", "bytes")


@query("prunable", f"WITH {_DIFF} SELECT run, path FROM pruned", *_ALL)
def _(b):
    kept = publication.carried(b.previous, b.failed_sources, b.entries)
    return publication.prunable(b.previous, b.entries, kept).select("run", "path")


_COLS = "run, path, bytes, sha256, content_type, source, kind, class_id, container, name"


@query("next_manifest", f"WITH {_DIFF} SELECT {_COLS} FROM entries UNION ALL SELECT {_COLS} FROM carried", *_ALL)
def _(b):
    return publication.next_manifest(b.entries, publication.carried(b.previous, b.failed_sources, b.entries))


_COUNTS = f"""{_DIFF}, counts AS (SELECT r.run, (SELECT count(*) FROM entries x WHERE x.run = r.run) AS files, (SELECT count(*) FROM diff x WHERE x.run = r.run AND pending) AS uploaded,
  (SELECT count(*) FROM diff x WHERE x.run = r.run AND NOT pending) AS unchanged, (SELECT count(*) FROM pruned x WHERE x.run = r.run) AS pruned,
  cast(0 AS BIGINT) AS deduplicated, cast(0 AS BIGINT) AS renamed, (SELECT count(*) FROM failed_sources x WHERE x.run = r.run) AS failed_resources,
  (SELECT count(*) FROM carried x WHERE x.run = r.run) AS carried_forward,
  cast((SELECT coalesce(sum(bytes), 0) FROM entries x WHERE x.run = r.run) + (SELECT coalesce(sum(bytes), 0) FROM carried x WHERE x.run = r.run) AS BIGINT) AS bytes
  FROM (SELECT DISTINCT run FROM entries) r)"""


@query("stable_counts", f"WITH {_COUNTS} SELECT * FROM counts", *_ALL)
def _(b):
    return publication.stable_counts(b.entries, b.previous, b.failed_sources)


@query(
    "version_record",
    f"""WITH {_COUNTS} SELECT run, '{{"schema_version":1,"layout":"stable","region":"jp","publication_id":"' || 'pub-' || run || '","release":"r1","files":' || (files + carried_forward)
    || ',"bytes":' || bytes || ',"uploaded":' || uploaded || ',"unchanged":' || unchanged || ',"pruned":' || pruned || ',"deduplicated":0,"renamed":0'
    || CASE WHEN failed_resources > 0 THEN ',"failed_resources":' || failed_resources ELSE '' END || CASE WHEN carried_forward > 0 THEN ',"carried_forward":' || carried_forward ELSE '' END
    || ',"completed_at":"2024-02-01T00:00:00+00:00"}}' AS record FROM counts""",
    *_ALL,
)
def _(b):
    runs = b.entries.select("run").distinct().select(
        "run", F.lit("jp").alias("region"), F.concat(F.lit("pub-"), "run").alias("publication_id"), F.lit("r1").alias("release"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("completed_at"),
    )
    return publication.version_record(publication.stable_counts(b.entries, b.previous, b.failed_sources), runs)


PROVIDERS = [
    {"name": "main", "prefix": "assets/{region}", "public_base_url": "https://cdn.example/{server}/", "stable": True},
    {"name": "archive", "prefix": "old", "public_base_url": None},
    {"name": "broken", "prefix": "x/{channel}", "public_base_url": "http://plain.example"},
]


def _runs(b: Bound):
    return b.entries.select("run").distinct().select("run", F.lit("kr").alias("region"), F.concat(F.lit("p-"), "run").alias("publication_id"))


_LOCATED = """SELECT run, path, 'main' AS provider, 'assets/kr/' || path AS storage_key, 'https://cdn.example/kr/assets/kr/' || path AS public_url, 'https://cdn.example/kr/' AS public_base FROM entries
UNION ALL SELECT run, path, 'archive', 'old/kr/publications/p-' || run || '/' || path, NULL, NULL FROM entries
UNION ALL SELECT run, path, 'broken', 'x/{channel}/kr/publications/p-' || run || '/' || path, 'http://plain.example/x/%7Bchannel%7D/kr/publications/p-' || run || '/' || path, 'http://plain.example' FROM entries"""


@query("locations_of", _LOCATED, "entries")
def _(b):
    return publication.locations_of(b.entries, _runs(b), PROVIDERS)


@query(
    "location_violations",
    """SELECT DISTINCT run, c AS code, 'broken' AS key, cast(NULL AS VARCHAR) AS detail FROM entries, (VALUES ('unresolved_template'), ('public_base')) v(c)""",
    "entries",
)
def _(b):
    return publication.location_violations(publication.locations_of(b.entries, _runs(b), PROVIDERS))


@query("public_read", "SELECT run, path, regexp_matches(path, '^en/|\\.png$') AND NOT regexp_matches(path, '/src1') AS public FROM entries", "entries")
def _(b):
    return publication.public_read(b.entries, [r"^en/", r"\.png$"], ["/src1"]).select("run", "path", "public")


@query(
    "raw_paths",
    "SELECT run, output_directory, path, CASE WHEN doc_id % 15 <> 1 THEN 'raw/' || source END AS raw_path FROM flat",
    "flat",
)
def _(b):
    rows = b.flat.withColumn("source", F.expr("CASE doc_id % 15 WHEN 1 THEN '../' || source ELSE source END"))
    return publication.raw_paths(rows).select("run", "output_directory", "path", "raw_path")


@query(
    "manifest_history",
    """WITH v AS (SELECT target, version, lag(version) OVER w AS before, lead(version) OVER w AS after FROM (SELECT DISTINCT target, version FROM versions) WINDOW w AS (PARTITION BY target ORDER BY version)),
    m AS (SELECT x.*, v.before, v.after, lag(x.version) OVER w AS pv, lag(bytes) OVER w AS pb, lag(sha256) OVER w AS ps, lag(content_type) OVER w AS pc
      FROM versions x JOIN v ON v.target = x.target AND v.version = x.version WINDOW w AS (PARTITION BY x.target, x.path ORDER BY x.version))
    SELECT target, path, min(version) AS first_version, max(version) AS last_version,
      count(*) FILTER (pv IS NULL OR pv IS DISTINCT FROM before OR pb <> bytes OR ps <> sha256 OR pc <> content_type) AS uploads, arg_max(coalesce(after, -1), version) AS pruned_in
    FROM m GROUP BY 1, 2""",
    "versions",
)
def _(b):
    return publication.manifest_history(b.versions).withColumn("pruned_in", F.coalesce("pruned_in", F.lit(-1)))


# --- ledger ----------------------------------------------------------------------------------------


@query(
    "ledger_rules",
    rules("id", {"job_id": "id <> 'bad id'", "job_request": "region <> 'cn' AND profile <> 'no good'"}, "jobs")
    + """ UNION ALL SELECT run, 'job_id_repeated', id, cast(count(*) AS VARCHAR) FROM jobs GROUP BY run, id HAVING count(*) > 1
    UNION ALL SELECT run, 'job_digest_repeated', idempotency_sha256, cast(count(*) AS VARCHAR) FROM jobs WHERE idempotency_sha256 IS NOT NULL GROUP BY run, idempotency_sha256 HAVING count(*) > 1""",
    "jobs",
)
def _(b):
    return ledger.ledger_rules(b.jobs)


@query(
    "event_rules",
    """WITH due AS (SELECT j.run, j.id AS job_id, CASE WHEN j.position % 223 = 4 THEN 'cn' ELSE j.region END AS region, CASE WHEN j.position % 227 = 5 THEN 'short' ELSE t.identity END AS identity
      FROM jobs j JOIN job_targets t ON t.run = j.run AND t.region = j.region WHERE j.status = 'completed'),
    n AS (SELECT run, job_id, identity, count(*) AS n FROM due GROUP BY 1, 2, 3), e AS (SELECT run, count(DISTINCT job_id) AS n FROM due GROUP BY 1)
    """
    + rules("job_id", {"event_job_id": "job_id <> 'bad id'", "event_region": "region <> 'cn'", "event_target": "identity <> 'short'"}, "due", "identity")
    + """ UNION ALL SELECT run, 'event_target_repeated', job_id, cast(n AS VARCHAR) FROM n WHERE n > 1
    UNION ALL SELECT run, 'too_many_events', run, cast(n AS VARCHAR) FROM e WHERE n > 600""",
    "jobs", "job_targets",
)
def _(b):
    done = b.jobs.where("status = 'completed'").join(b.job_targets.select("run", "region", "identity"), ["run", "region"])
    events = done.select(
        "run", F.col("id").alias("job_id"), F.expr("CASE WHEN position % 223 = 4 THEN 'cn' ELSE region END").alias("region"),
        F.expr("CASE WHEN position % 227 = 5 THEN 'short' ELSE identity END").alias("identity"),
    )
    return ledger.event_rules(events, 600)


@query(
    "recover",
    """SELECT run, position, CASE WHEN status IN ('running', 'cancelling') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('running', 'cancelling') THEN 'service_interrupted' ELSE failure END AS failure,
    CASE WHEN status IN ('running', 'cancelling') THEN NULL ELSE outcome END AS outcome, (epoch_us(CASE WHEN status IN ('running', 'cancelling') THEN timestamp '2024-03-01' ELSE updated_at END) // 1000) AS updated_ms FROM jobs""",
    "jobs",
)
def _(b):
    return ledger.recover(b.jobs, F.expr("timestamp '2024-03-01 00:00:00'")).select(
        "run", "position", "status", "failure", "outcome", F.unix_millis("updated_at").alias("updated_ms")
    )


@query(
    "claimable",
    """WITH a AS (SELECT run, region, count(*) FILTER (status IN ('running', 'cancelling')) AS active, min(position) FILTER (status = 'queued') AS p FROM jobs GROUP BY 1, 2),
    f AS (SELECT *, 5 - sum(active) OVER (PARTITION BY run) AS free FROM a), i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p) AS slot FROM f WHERE active = 0 AND p IS NOT NULL)
    SELECT i.run, i.region, j.id, i.p AS position, i.slot FROM i JOIN jobs j ON j.run = i.run AND j.position = i.p WHERE slot <= free""",
    "jobs",
)
def _(b):
    return ledger.claimable(b.jobs, 5)


@query(
    "submissions",
    """WITH r AS (SELECT *, key IS NULL OR key <> 'bad key' AS ok, sha256(key) AS d FROM requests),
    k AS (SELECT run, idempotency_sha256 AS d, arg_min(id, position) AS id, arg_min(region, position) AS region, arg_min(profile, position) AS profile, arg_min(operation, position) AS operation
      FROM jobs WHERE idempotency_sha256 IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT run, d, min(position) AS position, arg_min(region, position) AS region, arg_min(profile, position) AS profile, arg_min(operation, position) AS operation FROM r WHERE ok AND d IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT r.run, r.position, r.ok, r.d, k.id, f.position AS first_position,
      coalesce(k.region, f.region) = r.region AND coalesce(k.profile, f.profile) = r.profile AND coalesce(k.operation, f.operation) = r.operation AS same
      FROM r LEFT JOIN f ON f.run = r.run AND f.d = r.d LEFT JOIN k ON k.run = r.run AND k.d = r.d),
    y AS (SELECT *, CASE WHEN NOT ok THEN 'invalid' WHEN d IS NULL OR (id IS NULL AND first_position = position) THEN 'new' WHEN same THEN 'reuse' ELSE 'conflict' END AS result FROM x)
    SELECT run, position, result, CASE WHEN result IN ('reuse', 'conflict') THEN id END AS job_id, CASE WHEN result IN ('reuse', 'conflict') AND id IS NULL THEN first_position END AS first_position FROM y""",
    "requests", "jobs",
)
def _(b):
    return ledger.submissions(b.requests, b.jobs)


_OUTBOX = """due AS (SELECT j.run, j.id AS job_id, j.region, (epoch_us(j.updated_at) // 1000) AS completed_ms, t.identity FROM jobs j JOIN job_targets t ON t.run = j.run AND t.region = j.region
  WHERE j.status = 'completed' AND j.outcome IS NOT NULL AND NOT EXISTS (SELECT 1 FROM acks a WHERE a.run = j.run AND a.job_id = j.id AND a.identity = t.identity))"""
_LEDGER = ("jobs", "job_targets", "acks")


def _pending(b: Bound):
    return ledger.outbox(b.jobs, b.job_targets, b.acks)


@query(
    "admission",
    f"""WITH {_OUTBOX}, w AS (SELECT DISTINCT run, region FROM job_targets),
    c AS (SELECT j.run, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status IN ('queued', 'running', 'cancelling') AND w.region IS NOT NULL) AS reserved
      FROM jobs j LEFT JOIN w ON w.run = j.run AND w.region = j.region GROUP BY 1),
    e AS (SELECT run, count(DISTINCT job_id) AS events FROM due GROUP BY 1)
    SELECT c.run, queued, reserved, coalesce(events, 0) AS events, queued < 500 AS accepts_plain, queued < 500 AND coalesce(events, 0) + reserved < 900 AS accepts_watched FROM c LEFT JOIN e ON e.run = c.run""",
    *_LEDGER,
)
def _(b):
    return ledger.admission(b.jobs, _pending(b), b.job_targets, 500, 900)


@query(
    "retain",
    """SELECT run, position, status FROM jobs WHERE status NOT IN ('completed', 'failed', 'cancelled')
    UNION ALL SELECT run, position, status FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY updated_at DESC, id DESC) AS n FROM jobs WHERE status IN ('completed', 'failed', 'cancelled')) WHERE n <= 100""",
    "jobs",
)
def _(b):
    return ledger.retain(b.jobs, 100).select("run", "position", "status")


@query(
    "lineage",
    """WITH RECURSIVE base AS (SELECT DISTINCT 'l' AS run, event_id AS id, CASE WHEN event_id % 40 > 0 THEN event_id - 1 END AS up FROM events),
    walk AS (SELECT run, id, id AS root, cast(1 AS BIGINT) AS attempt FROM base WHERE up IS NULL
      UNION ALL SELECT b.run, b.id, w.root, w.attempt + 1 FROM walk w JOIN base b ON b.run = w.run AND b.up = w.id)
    SELECT * FROM walk""",
)
def _(b):
    rows = b.table("events").selectExpr("'l' AS run", "event_id AS id", "CASE WHEN event_id % 40 > 0 THEN event_id - 1 END AS retry_of")
    return ledger.lineage(rows)


@query("outbox", f"WITH {_OUTBOX} SELECT * FROM due", *_LEDGER)
def _(b):
    return _pending(b).select("run", "job_id", "region", F.unix_millis("completed_at").alias("completed_ms"), "identity")


@query(
    "due_deliveries",
    f"""WITH {_OUTBOX}, o AS (SELECT run, identity, min({{'c': completed_ms, 'j': job_id}}) AS o, count(*) AS pending FROM due GROUP BY 1, 2)
    SELECT run, identity, o.j AS job_id, o.c AS completed_ms, pending FROM o WHERE run <> 'l1' OR identity < '8'""",
    *_LEDGER,
)
def _(b):
    states = b.job_targets.select("run", "identity").distinct().withColumn(
        "due", F.when((F.col("run") == "l1") & (F.col("identity") >= "8"), F.lit("2030-01-01").cast("timestamp"))
    )
    due = ledger.due_deliveries(_pending(b), states, F.expr("timestamp '2024-03-01 00:00:00'"))
    return due.withColumn("completed_ms", F.unix_millis("completed_at")).drop("completed_at")


@query(
    "delivery_status",
    f"""WITH {_OUTBOX}, c AS (SELECT run, identity, count(*) AS pending FROM due GROUP BY 1, 2), t AS (SELECT DISTINCT run, identity FROM job_targets WHERE identity >= '4')
    SELECT coalesce(c.run, t.run) AS run, coalesce(c.identity, t.identity) AS identity, coalesce(pending, 0) AS pending, t.run IS NOT NULL AS configured FROM c FULL JOIN t ON t.run = c.run AND t.identity = c.identity""",
    *_LEDGER,
)
def _(b):
    return ledger.delivery_status(_pending(b), b.job_targets.where("identity >= '4'"))


@query(
    "transitions",
    "WITH h AS (SELECT *, lag(status) OVER w AS f, greatest(failed, coalesce(lag(failed) OVER w, 0)) AS bad FROM history WINDOW w AS (PARTITION BY run, job_id ORDER BY seq)) "
    + rules("job_id || ':' || cast(seq AS VARCHAR)", {
        "illegal_transition": """(coalesce(f, '') || '>' || status) IN ('>queued', 'queued>running', 'queued>cancelled', 'running>running', 'running>cancelling', 'running>completed', 'running>failed',
          'cancelling>cancelling', 'cancelling>cancelled') OR (f IN ('running', 'cancelling') AND status = 'failed' AND failure = 'service_interrupted')""",
        "partial_not_failed": "f IS NULL OR NOT (f = 'running' AND status = 'completed' AND bad > 0)",
        "failure_code": "status <> 'failed' OR failure = 'service_interrupted'",
    }, "h", "coalesce(f, '') || '>' || status"),
    "history",
)
def _(b):
    return ledger.transitions(b.history)


@query("progress_rules", rules("id", {"progress_phase": "phase <> 'a b'", "progress_total": "total IS NULL OR completed + failed <= total"}, "jobs"), "jobs")
def _(b):
    return ledger.progress_rules(b.jobs)


@query(
    "target_identity",
    """SELECT DISTINCT run, name, region, url, sha256('["' || name || '","' || CASE region WHEN 'hk' THEN 'tw' ELSE region END || '","' || url || '"]') AS identity FROM job_targets""",
    "job_targets",
)
def _(b):
    return ledger.target_identity(b.job_targets.select("run", "name", "region", "url")).distinct()


# --- logs ------------------------------------------------------------------------------------------

TRUSTED = ["172.16.0.0/12", "192.168.0.0/16", "fe80::/10"]
_PEER = "CASE user_id % 6 WHEN 0 THEN '8.20.30.40' WHEN 1 THEN '172.16.5.5' WHEN 2 THEN '192.168.2.3' WHEN 3 THEN '172.16.5.5' WHEN 4 THEN 'fe80::5' ELSE 'fe80::7' END"
_CLIENT = f"""CASE WHEN user_id % 6 = 0 THEN '8.20.30.40' ELSE CASE event_id % 8 WHEN 1 THEN '9.1.1.' || cast(user_id AS VARCHAR) WHEN 2 THEN '8.8.1.' || cast(user_id AS VARCHAR)
  WHEN 4 THEN '2400:cb00::77' WHEN 5 THEN '192.168.1.' || cast(user_id AS VARCHAR) ELSE {_PEER} END END"""


@query("client_ip", f"SELECT 'req-' || cast(event_id AS VARCHAR) AS request_id, {_CLIENT} AS client_ip FROM events")
def _(b):
    return logs.client_ip(b.access, TRUSTED).select("request_id", "client_ip")


@query(
    "normalize_access",
    f"""SELECT 'req-' || cast(event_id AS VARCHAR) AS request_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'OTHER' ELSE 'DELETE' END AS method,
    CASE WHEN event_id % 9 = 0 THEN '<unmatched>' ELSE '/v1/' || event_type || '/{{id}}' END AS route, {_PEER} AS peer_ip FROM events""",
)
def _(b):
    return logs.normalize_access(b.access).select("request_id", "method", "route", "peer_ip")


def _lines(b: Bound, form: str):
    rows = logs.normalize_access(b.access).withColumn("client_ip", F.when(F.col("status") != 500, F.col("peer_ip")))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if form == "json":
        names = ["request_id", "method", "route", "peer_ip", "client_ip", "status", "outcome", "duration_ms", "queue_dropped_records"]
        line = F.to_json(F.struct(stamp.alias("timestamp"), *names), {"ignoreNullFields": "false"})
    else:
        def dash(c):
            return F.coalesce(F.col(c).cast("string"), F.lit("-"))
        line = F.concat(
            stamp, F.lit(" id="), F.col("request_id"), F.lit(" peer="), dash("peer_ip"), F.lit(" client="), dash("client_ip"), F.lit(" method="), "method",
            F.lit(' route="'), "route", F.lit('" status='), dash("status"), F.lit(" outcome="), "outcome", F.lit(" duration_ms="), F.col("duration_ms").cast("string"),
            F.lit(" queue_dropped_records="), F.col("queue_dropped_records").cast("string"),
        )
    bad = F.when(F.col("duration_ms") % 100 == 7, "{").otherwise("")
    # Stored, as log lines are; the parser then reads text and not the expressions that made it.
    return materialize(rows.select("run", F.concat(bad, line).alias("value")), "lines")


_PARSED = f"""SELECT 'w' || cast(user_id % 3 AS VARCHAR) AS run, (epoch_us(ts) // 1000) AS ms, 'req-' || cast(event_id AS VARCHAR) AS request_id,
  CASE WHEN event_id % 9 = 0 THEN '<unmatched>' ELSE '/v1/' || event_type || '/{{id}}' END AS route, {_PEER} AS peer_ip,
  CASE WHEN event_type = 'error' OR event_id % 13 = 0 THEN NULL ELSE {_PEER} END AS client_ip,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 13 = 0 THEN NULL ELSE 200 END AS status, event_id % 3000 AS duration_ms FROM events WHERE event_id % 3000 % 100 <> 7"""


@query("parse_access", _PARSED)
def _(b):
    good, _ = logs.parse_access(_lines(b, "json"))
    return good.select("run", F.unix_millis("timestamp").alias("ms"), "request_id", "route", "peer_ip", "client_ip", "status", "duration_ms")


@query(
    "parse_access_text",
    _PARSED.replace("event_id % 3000 % 100 <> 7", "event_id % 3000 % 100 <> 7 OR true").replace("SELECT 'w' || cast(user_id % 3 AS VARCHAR) AS run, (epoch_us(ts) // 1000)", "SELECT 'w' || cast(user_id % 3 AS VARCHAR) AS run, CASE WHEN event_id % 3000 % 100 <> 7 THEN (epoch_us(ts) // 1000) END"),
)
def _(b):
    good, _ = logs.parse_access(_lines(b, "text"), "text")
    return good.select("run", F.unix_millis("timestamp").alias("ms"), "request_id", "route", "peer_ip", "client_ip", "status", "duration_ms")


@query("access_violations", "SELECT 'w' || cast(user_id % 3 AS VARCHAR) AS run, count(*) AS bad_lines FROM events WHERE event_id % 3000 % 100 = 7 GROUP BY 1")
def _(b):
    _, bad = logs.parse_access(_lines(b, "json"))
    return bad.groupBy("run").agg(F.count(F.lit(1)).alias("bad_lines"))


TEMPLATE = "[${time}] ${status} ${method} \"${path}\" in ${latency}/${duration_ms} ${client_ip}"


@query(
    "render",
    f"""SELECT 'req-' || cast(event_id AS VARCHAR) AS request_id, '[t' || cast(event_id AS VARCHAR) || '\\n] ' || CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 13 = 0 THEN '-' ELSE '200' END || ' ' ||
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'OTHER' ELSE 'DELETE' END || ' "' ||
    CASE WHEN event_id % 9 = 0 THEN '<unmatched>' ELSE '/v1/' || event_type || '/{{id}}' END || '" in ' || CASE WHEN value * 40 >= 1000 THEN printf('%.2fs', value * 40 / 1000.0) ELSE printf('%.2fms', value * 40) END
    || '/' || cast(event_id % 3000 AS VARCHAR) || ' ' || {_CLIENT} AS line FROM events""",
)
def _(b):
    rows = logs.client_ip(b.access, TRUSTED)
    rows = logs.normalize_access(rows).withColumn("elapsed_ms", F.col("value") * 40)
    rows = rows.withColumn("timestamp", F.concat(F.lit("t"), F.substring("request_id", 5, 20), F.lit("\n")))
    return logs.render(rows, TEMPLATE).select("request_id", "line")


SPEC = "warn,app=info,app::jobs=off,app::jobs::queue=trace"


@query(
    "filter_levels",
    """SELECT event_id, level, target FROM app_log WHERE CASE target WHEN 'app' THEN level IN ('ERROR', 'WARN', 'INFO') WHEN 'app::jobs' THEN false WHEN 'app::jobs::queue' THEN true
    WHEN 'app::jobsite' THEN level IN ('ERROR', 'WARN', 'INFO') ELSE level IN ('ERROR', 'WARN') END""",
    "app_log",
)
def _(b):
    return logs.filter_levels(b.app_log, SPEC).select("event_id", "level", "target")


@query(
    "permit_fields",
    """SELECT doc_id, 'message' AS field, CASE WHEN strlen(text) <= 1024 THEN text ELSE substr(text, 1, list_max(list_filter(range(300, 1025), lambda n: strlen(substr(text, 1, n)) <= 1024))) END AS value FROM documents
    UNION ALL SELECT doc_id, 'stage', lang FROM documents""",
)
def _(b):
    rows = b.table("documents").select("doc_id", F.create_map(F.lit("message"), "text", F.lit("secret"), "source", F.lit("stage"), "lang").alias("fields"))
    return logs.permit_fields(rows).select("doc_id", F.explode("fields").alias("field", "value"))


@query(
    "rotate",
    """WITH a AS (SELECT run, request_id, strftime(timestamp, '%Y-%m-%d') AS period FROM access), r AS (SELECT run, period, row_number() OVER (PARTITION BY run ORDER BY period DESC) AS n FROM (SELECT DISTINCT run, period FROM a))
    SELECT a.* FROM a JOIN r ON r.run = a.run AND r.period = a.period WHERE n <= 7""",
    "access",
)
def _(b):
    return logs.rotate(b.access, "daily", 7).select("run", "request_id", "period")


@query(
    "access_summary",
    """SELECT run, coalesce(route, '<unmatched>') AS route, CASE method WHEN 'BREW' THEN 'OTHER' ELSE method END AS method, outcome, status, count(*) AS requests, cast(sum(duration_ms) AS BIGINT) AS duration_ms, max(duration_ms) AS slowest_ms FROM access GROUP BY ALL""",
    "access",
)
def _(b):
    return logs.access_summary(logs.normalize_access(b.access))


@query(
    "dropped_records",
    """WITH l AS (SELECT run, queue_dropped_records AS q, coalesce(lag(queue_dropped_records) OVER (PARTITION BY run ORDER BY timestamp, request_id), 0) AS p FROM access)
    SELECT run, cast(sum(CASE WHEN q >= p THEN q - p ELSE q END) AS BIGINT) AS dropped, count(*) AS records FROM l GROUP BY 1""",
    "access",
)
def _(b):
    return logs.dropped_records(b.access)
