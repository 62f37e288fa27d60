"""Reports over job ledgers: validity, what could run next, retention, lineage and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions import valid_digest
from assetlake.operators.snapshots import ALIASES, REGIONS, RESERVED_REGION
from assetlake.operators.windows import newest, previous, running
from assetlake.session import materialize_counted
from assetlake.violations import all_of, rule_violations, violation

# Fixed values.
TERMINAL = ["completed", "failed", "cancelled"]
ACTIVE = ["running", "cancelling"]
OPERATIONS = ["update", "export", "verify"]
MAX_EVENTS = 4096
#: Up to here the engine itself limits ranked rows before their shuffle.
FEW = 1000
MAX_TARGETS = 16
LEGAL = [
    (None, "queued"),
    ("queued", "running"),
    ("queued", "cancelled"),
    ("running", "running"),
    ("running", "cancelling"),
    ("running", "completed"),
    ("running", "failed"),
    ("cancelling", "cancelling"),
    ("cancelling", "cancelled"),
]
INTERRUPTED = "service_interrupted"
_UUID = (
    r"\A(?i:urn:uuid:)?(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9A-Fa-f]{32})\z"
    r"|\A\{[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}\z"
)


def valid_request(region: Column, profile: Column) -> Column:
    return region.isin(REGIONS) & (region != RESERVED_REGION) & profile.rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


def request_ok(key: Column, region: Column, profile: Column) -> Column:
    """Whether a submission can be judged: a valid request, with no key or a valid one. Never null."""
    good = valid_request(region, profile) & (key.isNull() | key.rlike(r"\A[A-Za-z0-9._:-]{1,128}\z"))
    return F.coalesce(good, F.lit(False))


def ledger_rules(jobs: DataFrame) -> DataFrame:
    rows = rule_violations(
        jobs,
        F.col("id"),
        {
            "job_id": F.col("id").rlike(_UUID),
            "job_request": valid_request(F.col("region"), F.col("profile")),
            "job_operation": F.col("operation").isin(OPERATIONS),
            "job_status": F.col("status").isin(["queued", *ACTIVE, *TERMINAL]),
            "job_digest": F.col("idempotency_sha256").isNull() | valid_digest(F.col("idempotency_sha256")),
        },
    )

    def repeated(column: str, code: str) -> DataFrame:
        groups = (
            jobs.where(F.col(column).isNotNull()).groupBy("run", column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        )
        return violation(groups, code, F.col(column), F.col("n"))

    return all_of(rows, repeated("id", "job_id_repeated"), repeated("idempotency_sha256", "job_digest_repeated"))


def event_rules(events: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """Rules of undelivered notices, given as one row per (run, job_id, region, identity)."""
    rows = rule_violations(
        events,
        F.col("job_id"),
        {
            "event_job_id": F.col("job_id").rlike(_UUID),
            "event_region": F.col("region").isin(REGIONS) & (F.col("region") != RESERVED_REGION),
            "event_target": valid_digest(F.col("identity")),
        },
        detail=F.col("identity"),
    )
    per_target = events.groupBy("run", "job_id", "identity").agg(F.count(F.lit(1)).alias("n"))
    per_event = per_target.groupBy("run", "job_id").agg(F.count(F.lit(1)).alias("n"))
    per_run = per_event.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return all_of(
        rows,
        violation(per_target.where("n > 1"), "event_target_repeated", F.col("job_id"), F.col("n")),
        violation(per_event.where(F.col("n") > MAX_TARGETS), "event_targets", F.col("job_id"), F.col("n")),
        violation(per_run.where(F.col("n") > max_events), "too_many_events", F.col("run"), F.col("n")),
    )


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs caught running by a restart become failures; everything else is untouched."""
    caught = F.col("status").isin(ACTIVE)
    return jobs.withColumns(
        {
            "failure": F.when(caught, F.lit(INTERRUPTED)).otherwise(F.col("failure")),
            "outcome": F.when(~caught, F.col("outcome")),
            "updated_at": F.when(caught, now).otherwise(F.col("updated_at")),
            "status": F.when(caught, F.lit("failed")).otherwise(F.col("status")),
        }
    )


def claimable(jobs: DataFrame, max_running: int) -> DataFrame:
    """Jobs that would start now: the oldest queued job of each idle region, within the free slots.

    Reduced to one row per (ledger, region) by aggregation; the ranking then sees only regions.
    """
    regions = jobs.groupBy("run", "region").agg(
        F.count_if(F.col("status").isin(ACTIVE)).alias("active"),
        F.min(F.when(F.col("status") == "queued", F.struct("position", "id"))).alias("next"),
    )
    per_run = Window.partitionBy("run")
    ranked = regions.withColumn("free", F.lit(max_running) - F.sum("active").over(per_run))
    idle = ranked.where((F.col("active") == 0) & F.col("next").isNotNull())
    slot = F.row_number().over(per_run.orderBy("next.position"))
    return (
        idle.withColumn("slot", slot.cast("long"))
        .where(F.col("slot") <= F.col("free"))
        .select("run", "region", "next.id", "next.position", "slot")
    )


def submissions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outcome of each request: ``new``, ``reuse``, ``conflict`` or ``invalid``, with the job or request it leads to.

    ``requests``: ``(run, position, key, region, profile, operation)``; a null key is never deduplicated.
    """
    key = F.col("key")
    good = request_ok(key, F.col("region"), F.col("profile"))
    request = F.struct("region", "profile", "operation")
    df = requests.withColumn("_ok", good).withColumn("_digest", F.sha2(key, 256))
    known = jobs.where(F.col("idempotency_sha256").isNotNull()).groupBy(
        "run", F.col("idempotency_sha256").alias("_digest")
    ).agg(F.min_by(F.struct("id", "region", "profile", "operation"), "position").alias("_job"))
    first = df.where(F.col("_ok") & F.col("_digest").isNotNull()).groupBy("run", "_digest").agg(
        F.min(F.struct("position", "region", "profile", "operation")).alias("_first")
    )
    leaders = first.join(known, ["run", "_digest"], "left")
    df = df.join(leaders, ["run", "_digest"], "left")
    job, lead = F.col("_job"), F.col("_first")
    owner = F.when(
        job.isNotNull(), F.struct(job["region"].alias("region"), job["profile"].alias("profile"), job["operation"].alias("operation"))
    ).otherwise(F.struct(lead["region"].alias("region"), lead["profile"].alias("profile"), lead["operation"].alias("operation")))
    result = (
        F.when(~F.col("_ok"), "invalid")
        .when(F.col("_digest").isNull() | (job.isNull() & (lead["position"] == F.col("position"))), "new")
        .when(owner == request, "reuse")
        .otherwise("conflict")
    )
    df = df.withColumn("result", result)
    settled = F.col("result").isin("reuse", "conflict")
    return df.select(
        "run", "position", "result",
        F.when(settled, job["id"]).alias("job_id"),
        F.when(settled & job.isNull(), lead["position"]).alias("first_position"),
    )


def admission(jobs: DataFrame, events: DataFrame, targets: DataFrame, max_queued: int, max_events: int = MAX_EVENTS) -> DataFrame:
    """Per ledger: whether one more job would be accepted, with and without delivery targets.

    ``events`` holds one row per undelivered notice; ``targets`` lists ``(run, region, identity)``.
    """
    watched = targets.select("run", "region", F.lit(True).alias("_watched")).distinct()
    waiting = ~F.col("status").isin(TERMINAL)
    counts = jobs.join(watched, ["run", "region"], "left").groupBy("run").agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(waiting & F.coalesce("_watched", F.lit(False))).alias("reserved"),
    )
    pending = events.groupBy("run").agg(F.countDistinct("job_id").alias("events"))
    df = counts.join(pending, "run", "left").withColumn("events", F.coalesce("events", F.lit(0).cast("long")))
    room = F.col("queued") < max_queued
    return df.withColumn("accepts_plain", room).withColumn(
        "accepts_watched", room & (F.col("events") + F.col("reserved") < max_events)
    )


def retain(jobs: DataFrame, keep: int) -> DataFrame:
    """Active jobs and the ``keep`` most recently updated terminal ones (0 keeps all).

    While ``keep`` is small, each task sends on its own first ``keep`` of a run at most. Beyond that, the newest are
    cut off by a summary of times and put in order by ranges.
    """
    if keep == 0:
        return jobs
    done = F.col("status").isin(TERMINAL)
    order = [F.col("updated_at").desc(), F.col("id").desc()]
    if keep <= FEW:
        ranked = jobs.where(done).withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy(*order)))
    else:
        ranked = running(newest(jobs.where(done), ["run"], "updated_at", keep), ["run"], order, row_number="_n")
    return jobs.where(~done).unionByName(ranked.where(F.col("_n") <= keep).drop("_n"))


def lineage(jobs: DataFrame) -> DataFrame:
    """First job and attempt number of every job along ``retry_of``.

    Pointers are doubled each round, so a chain of length n takes log2(n) rounds. A job still pointing
    somewhere when no chain can be that long is in a cycle and is returned with a null root.
    """
    known = jobs.select("run", F.col("id").alias("retry_of"), F.lit(True).alias("_known"))
    linked = jobs.select("run", "id", "retry_of").join(known, ["run", "retry_of"], "left")
    step = linked.select(
        "run", "id",
        F.when(F.col("_known"), F.col("retry_of")).alias("up"),
        F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("hops"),
    )
    # (id, up, hops): ``up`` is the ancestor ``hops`` steps above; roots point at themselves with 0.
    state, rows = materialize_counted(step.withColumn("up", F.coalesce("up", "id")), "lineage")
    for _ in range(rows.bit_length()):
        above = state.select("run", F.col("id").alias("up"), F.col("up").alias("_up2"), F.col("hops").alias("_h2"))
        # Capped so that a cycle cannot overflow; no real chain is longer than the table.
        further = state.join(above, ["run", "up"]).select(
            "run", "id", F.col("_up2").alias("up"),
            F.least(F.col("hops") + F.col("_h2"), F.lit(2**60)).alias("hops"), (F.col("_h2") > 0).alias("_moved"),
        )
        state, moved = materialize_counted(further, "lineage", F.col("_moved"))
        state = state.drop("_moved")
        if not moved:
            break
    roots = step.where(F.col("hops") == 0).select("run", F.col("id").alias("up"), F.col("id").alias("root"))
    return state.join(roots, ["run", "up"], "left").select(
        "run", "id", "root", F.when(F.col("root").isNotNull(), F.col("hops") + 1).alias("attempt")
    )


def outbox(jobs: DataFrame, targets: DataFrame, acks: DataFrame) -> DataFrame:
    """Undelivered notices, one row per (completed job, target), oldest first by ``completed_at``."""
    done = jobs.where((F.col("status") == "completed") & F.col("outcome").isNotNull())
    due = done.join(targets.select("run", "region", "identity"), ["run", "region"]).select(
        "run", F.col("id").alias("job_id"), "region", F.col("updated_at").alias("completed_at"), "identity"
    )
    return due.join(acks.select("run", "job_id", "identity"), ["run", "job_id", "identity"], "left_anti")


def due_deliveries(pending: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """The oldest pending notice of each target whose retry delay has passed."""
    oldest = pending.groupBy("run", "identity").agg(
        F.min(F.struct("completed_at", "job_id")).alias("o"), F.count(F.lit(1)).alias("pending")
    )
    return (
        oldest.join(states.select("run", "identity", "due"), ["run", "identity"], "left")
        .where(F.col("due").isNull() | (F.col("due") <= now))
        .select("run", "identity", "o.job_id", "o.completed_at", "pending")
    )


def delivery_status(pending: DataFrame, targets: DataFrame) -> DataFrame:
    """Pending notices per target; notices for targets no longer configured are marked."""
    counts = pending.groupBy("run", "identity").agg(F.count(F.lit(1)).alias("pending"))
    configured = targets.select(
        "run", "identity", F.lit(True).alias("configured"), F.lit(0).cast("long").alias("pending")
    ).distinct()
    both = configured.unionByName(counts.select("run", "identity", F.lit(False).alias("configured"), "pending"))
    return both.groupBy("run", "identity").agg(
        F.max("pending").alias("pending"), F.max(F.col("configured").cast("int")).cast("boolean").alias("configured")
    )


def transitions(history: DataFrame) -> DataFrame:
    """Illegal status changes in a per-job history ``(run, job_id, seq, status, failed, failure)``."""
    df = previous(history, ["run", "job_id"], [F.col("seq")], {"_from": "status", "_failed": "failed"})
    to, failure = F.col("status"), F.col("failure")
    legal = F.lit(False)
    for old, new in LEGAL:
        legal = legal | (F.col("_from").eqNullSafe(F.lit(old)) & (to == new))
    restart = F.col("_from").isin(ACTIVE) & (to == "failed") & (failure == INTERRUPTED)
    failed = F.greatest(F.coalesce("_failed", F.lit(0)), F.coalesce("failed", F.lit(0))) > 0
    step = F.concat_ws(">", F.coalesce("_from", F.lit("")), to)
    return rule_violations(
        df,
        F.concat_ws(":", "job_id", F.col("seq").cast("string")),
        {
            "illegal_transition": legal | F.coalesce(restart, F.lit(False)),
            "partial_not_failed": ~((F.col("_from") == "running") & (to == "completed") & failed) | F.col("_from").isNull(),
            "failure_code": (to != "failed") | F.coalesce(failure.rlike(r"\A[a-z_]{1,64}\z"), F.lit(False)),
        },
        detail=step,
    )


def progress_rules(jobs: DataFrame) -> DataFrame:
    done = F.col("completed").cast("decimal(38,0)") + F.col("failed")
    return rule_violations(
        jobs,
        F.col("id"),
        {
            "progress_phase": F.col("phase").rlike(r"\A[A-Za-z0-9_]{0,64}\z"),
            "progress_total": F.col("total").isNull() | (done <= F.col("total")),
        },
    )


def target_identity(targets: DataFrame) -> DataFrame:
    """Add ``identity``: digest of name, frozen region tag and address. Credentials take no part."""
    tag = F.col("region")
    for old, new in ALIASES.items():
        tag = F.when(F.col("region") == new, F.lit(old)).otherwise(tag)
    return targets.withColumn("identity", F.sha2(F.to_json(F.array("name", tag, "url")), 256))
