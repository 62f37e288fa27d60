"""Registered queries: streaming forms, run over the given tables with ``availableNow``."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetlake.plans.bindings import BINDINGS
from assetlake.plans.bound import ORACLES, Bound, query
from assetlake.plans.dialects import SparkText
from assetlake.operators.ledger import LEGAL
from assetlake.plans.publication_queries import TRUSTED, _CLIENT, _OUTBOX, _pending
from assetlake.plans.source_queries import journal_files
from assetlake.session import materialize, scratch_path
from assetlake.streaming import streams


class _Placeholder(SparkText):
    def t(self, name: str) -> str:
        return "{" + name + "}"


def streamed(b: Bound, binding: str, table: str) -> DataFrame:
    """A binding over ``table`` read as a stream of files."""
    schema = b.table(table).schema
    rows = b.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", f"{table}.parquet").parquet(b.sf_dir)
    text = BINDINGS[binding](_Placeholder(b.sf_dir))
    return b.spark.sql(text.replace("{id}", "{{id}}"), **{table: rows})


def with_state_store(b: Bound) -> None:
    for key, value in streams.STATE_STORE.items():
        b.spark.conf.set(key, value)


def landed(b: Bound, df: DataFrame, mode: str = "append", keys: Sequence[str] = ("run",)) -> DataFrame:
    """Run a stream to its end into stored files and read them back."""
    out, state = scratch_path(b.spark, "stream"), scratch_path(b.spark, "stream-state")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        def batch(rows: DataFrame, batch_id: int) -> None:
            rows.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

        q = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = b.spark.read.parquet(out)
    if mode == "append":
        return rows
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "_batch")]), "_batch").alias("r"))
    return newest.select(*keys, "r.*")


@query(
    "stream_summary",
    """WITH res AS (SELECT run, resource_index, any_value(failed) AS failed, count(*) AS n, sum(bytes) AS bytes FROM flat WHERE resource_index % 11 <> 6 GROUP BY 1, 2)
    SELECT run, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed,
      count(*) FILTER (NOT failed AND resource_index % 3 = 0) AS cache_hits, cast(sum(n) AS BIGINT) AS output_files,
      cast(sum(bytes) AS BIGINT) AS output_bytes, cast(sum(n) AS BIGINT) AS unity_objects,
      cast(sum(n - 1) AS BIGINT) AS selected_unity_objects, count(*) AS skipped_unity_objects FROM res GROUP BY 1""",
    "flat",
)
def _(b):
    return landed(b, streams.stream_summary(streams.stream_lines(b.spark, journal_files(b))), "update")


@query(
    "stream_payloads",
    "SELECT run, kind, count(*) AS files FROM flat WHERE resource_index % 11 <> 6 GROUP BY 1, 2",
    "flat",
)
def _(b):
    return landed(b, streams.stream_payloads(streams.stream_lines(b.spark, journal_files(b))), "update", ["run", "kind"])


@query("stream_submissions", ORACLES["submissions"])
def _(b):
    """The rows of the batch form, from requests that come as a stream after the jobs of the ledger."""
    with_state_store(b)
    return landed(b, streams.stream_submissions(streamed(b, "requests", "events"), b.jobs, "60 days"))


_LEGAL = ", ".join(f"('{old or ''}', '{new}')" for old, new in LEGAL)
_FAILS = "s = 'running' AND status = 'completed' AND (failure IS NOT NULL OR greatest(f, failed) > 0)"
_STEP = f"""
  SELECT run, job_id, n, seq, s AS from_status, t AS to_status, why AS failure, ok AS accepted,
    CASE WHEN ok THEN t ELSE s END AS s, CASE WHEN ok THEN greatest(f, failed) ELSE f END AS f
  FROM (
    SELECT *, (s, t) IN ({_LEGAL}) OR (s IN ('running', 'cancelling') AND t = 'failed'
      AND coalesce(why, '') = 'service_interrupted') AS ok
    FROM (
      SELECT *, CASE WHEN {_FAILS} THEN 'failed' ELSE status END AS t,
        CASE WHEN {_FAILS} THEN coalesce(failure, 'partial_failure') ELSE failure END AS why
      FROM ({{}})))"""
_FIRST = "SELECT *, '' AS s, cast(0 AS BIGINT) AS f FROM ordered WHERE n = 1"
_NEXT = """SELECT o.*, p.s, p.f FROM steps p JOIN ordered o ON o.run = p.run AND o.job_id = p.job_id AND o.n = p.n + 1"""


@query(
    "stream_jobs",
    f"""WITH RECURSIVE ordered AS (
      SELECT *, row_number() OVER (PARTITION BY run, job_id ORDER BY seq) AS n FROM history),
    steps AS ({_STEP.format(_FIRST)} UNION ALL {_STEP.format(_NEXT)})
    SELECT run, job_id, seq, from_status, to_status, failure, accepted FROM steps""",
    "history",
)
def _(b):
    with_state_store(b)
    return landed(b, streams.stream_jobs(streamed(b, "history", "events")))


def _refused(notice: dict) -> str | None:
    """Some targets are down."""
    return "unreachable" if notice["identity"] < "4" else None


def idle(q: StreamingQuery, limit: float = 600) -> None:
    """Stops a query with a clock of its own when its source has no more to give."""
    end = time.time() + limit
    while time.time() < end:
        done = q.lastProgress
        if q.exception() is not None or done and done["batchId"] > 0 and done["numInputRows"] == 0:
            break
        time.sleep(0.1)
    q.stop()
    if q.exception() is not None:
        raise q.exception()


@query(
    "stream_outbox",
    f"""WITH {_OUTBOX}, o AS (SELECT *, identity < '4' AS down, row_number() OVER (
        PARTITION BY run, identity ORDER BY completed_ms % 3, completed_ms, job_id) AS turn FROM due)
    SELECT run, identity, job_id, completed_ms, turn, cast(1 AS BIGINT) AS attempt, CASE WHEN down THEN 'unreachable' END AS error
    FROM o WHERE NOT down OR turn = 1""",
    "jobs", "job_targets", "acks",
)
def _(b):
    """Notices come in three parts, then all of them again. Each is delivered once, within a part oldest first; targets
    that are down get their oldest notice and then rest beyond the end of this run."""
    with_state_store(b)
    source, out, state = (scratch_path(b.spark, n) for n in ("notices", "attempts", "outbox-state"))
    notices = materialize(_pending(b), "pending")
    parts = [notices.where(F.unix_millis("completed_at") % 3 == n) for n in range(3)]
    for part in [*parts, notices]:
        part.coalesce(1).write.mode("append").parquet(source)
    rows = b.spark.readStream.schema(notices.schema).option("maxFilesPerTrigger", 1).parquet(source)
    attempts = streams.stream_outbox(rows, _refused, retry_ms=86_400_000)
    idle(attempts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start())
    return b.spark.read.schema(streams.ATTEMPTS).parquet(out).drop("region")


@query(
    "stream_fresh",
    "SELECT run, (epoch_us(observed_at) // 1000) AS observed_ms FROM snapshots WHERE NOT stale AND (epoch_us(timestamp '1999-01-01 00:05:10') - epoch_us(observed_at)) // 1000 BETWEEN 0 AND 300000",
    "snapshots",
)
def _(b):
    rows = streamed(b, "snapshots", "orders")
    now = F.expr("timestamp '1999-01-01 00:05:10'")
    return landed(b, streams.stream_fresh(rows, now).select("run", F.unix_millis("observed_at").alias("observed_ms")))


@query(
    "stream_access",
    f"""SELECT 'w' || cast(user_id % 3 AS VARCHAR) AS run, 'req-' || cast(event_id AS VARCHAR) AS request_id, {_CLIENT} AS client_ip, strftime(ts, '%Y-%m-%d') AS period FROM events""",
)
def _(b):
    path = scratch_path(b.spark, "access")
    streams.stream_access(streamed(b, "access", "events"), path, scratch_path(b.spark, "access-state"), TRUSTED).awaitTermination()
    return b.spark.read.parquet(path).select("run", "request_id", "client_ip", F.date_format("period", "yyyy-MM-dd").alias("period"))
