"""Streaming forms of the journal, ledger, outbox, freshness and log operators."""

from __future__ import annotations

import heapq
import operator
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from assetlake.operators.exports import export_totals, payload_counts
from assetlake.operators.ledger import ACTIVE, INTERRUPTED, LEGAL, request_ok
from assetlake.operators.logs import client_ip, normalize_access, rotation_period
from assetlake.operators.snapshots import MAX_AGE_MS
from assetlake.session import materialize
from assetlake.sources.readers import parse_journal, run_of

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines appended below ``path/<run>/``."""
    return spark.readStream.option("recursiveFileLookup", "true").text(path).select(run_of(), "value")


def stream_summary(journal_lines: DataFrame) -> DataFrame:
    """Running export totals per run; use with update or complete output mode."""
    journal, _ = parse_journal(journal_lines)
    return export_totals(journal)


def stream_payloads(journal_lines: DataFrame) -> DataFrame:
    """Running numbers of outputs per run and kind; use with update or complete output mode."""
    journal, _ = parse_journal(journal_lines)
    return payload_counts(journal)


_JUDGED = "run STRING, position LONG, result STRING, job_id STRING, first_position LONG"
#: Keys are dealt to so many groups. A group is one call in a micro-batch, however many keys it has.
_GROUPS = 1024
#: A group's owners lie in so many packed values: reading or writing one is a call to the state store.
_SLOTS = 32


def _still(packed: tuple, now: int) -> dict[tuple, tuple]:
    """The owners ``(request, position, until)`` of a slot by their keys, without those that the watermark has passed."""
    return {key: owned for key, owned in pickle.loads(packed[0]).items() if owned[2] > now}


class Submissions(StatefulProcessor):
    """Judges the requests of a group of idempotency keys: the first one owns its key, later ones repeat it or conflict
    with it.

    The owner is kept until the watermark has passed its time by ``keep_ms``. A job that was known at the start comes
    with the requests (``known``, ``known_request``, ``known_id``) and owns its key for good. Of the requests that come in
    one micro-batch before there is an owner, the one with the least position becomes it; of these two numbers, a
    position and a time are held (24 bytes each), whatever the key. A micro-batch reads and writes the slots of the keys
    at hand, with all the owners in them.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owners = handle.getMapState("owners", "slot INT", "packed BINARY")
        self.cleaning = handle.getValueState("cleaning", "due LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        keys: dict[tuple, int] = {}
        requests: dict[str, int] = {}
        parts = []
        for part in rows:
            known = part["known"].to_numpy(bool)
            if known.any():
                old = part[known]
                result = np.where(old["request"] == old["known_request"], "reuse", "conflict")
                yield self._rows(old["run"].to_numpy(object), old["position"].to_numpy(np.int64), result, old["known_id"].to_numpy(object))
                part = part[~known]
            if len(part):
                parts.append((
                    np.array([keys.setdefault(x, len(keys)) for x in zip(part["run"], part["digest"], strict=True)], np.int32),
                    np.array([requests.setdefault(x, len(requests)) for x in part["request"]], np.int32),
                    part["position"].to_numpy(np.int64), part["at"].fillna(now).to_numpy(np.int64),
                ))
        if not parts:
            return
        owner, place, opened = self._owners(keys, requests, *(np.concatenate(x) for x in zip(*parts, strict=True)), now)
        runs = np.array([x[0] for x in keys], object)
        for k, r, positions, _ in parts:
            new = opened[k] & (positions == place[k])
            result = np.where(new, "new", np.where(owner[k] == r, "reuse", "conflict"))
            yield self._rows(runs[k], positions, result, None, pd.arrays.IntegerArray(place[k], new))

    def _owners(self, keys, requests, k, r, positions, at, now) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per key the number of its owner's request, the owner's position, and whether it has become it now."""
        order = np.lexsort((positions, k))
        leads = order[np.flatnonzero(np.diff(k[order], prepend=-1))]
        names = list(requests)
        owner, place, opened = r[leads], positions[leads], np.ones(len(leads), bool)
        until = at[leads] + self.keep_ms
        slots: dict[int, list[tuple]] = {}
        for key, n in keys.items():
            slots.setdefault(zlib.crc32(key[1].encode()) % _SLOTS, []).append((key, n))
        fresh = not self.cleaning.exists()  # then there is no owner either
        for slot, members in slots.items():
            packed = None if fresh else self.owners.getValue((slot,))
            kept = {} if packed is None else _still(packed, now)
            before = len(kept)
            for key, n in members:
                if key in kept:
                    owned = kept[key]
                    owner[n], place[n], opened[n] = requests.get(owned[0], -1), owned[1], False
                else:
                    kept[key] = (names[owner[n]], int(place[n]), int(until[n]))
            if len(kept) > before:
                self.owners.updateValue((slot,), (pickle.dumps(kept),))
        if fresh:
            self._clean_at(int(until.max()))
        return owner, place, opened

    @staticmethod
    def _rows(runs, positions, result, job_ids, at_first=None) -> pd.DataFrame:
        at_first = pd.array([None] * len(positions), "Int64") if at_first is None else at_first
        return pd.DataFrame({"run": runs, "position": positions, "result": result, "job_id": job_ids, "first_position": at_first})

    def _clean_at(self, due: int) -> None:
        self.cleaning.update((due,))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forgets the owners that the watermark has passed. The next time is that of the last one left, so a group is
        gone through about once in ``keep_ms``."""
        now, last = timerValues.getCurrentWatermarkInMs(), None
        for slot, packed in list(self.owners.iterator()):
            if kept := _still(packed, now):
                self.owners.updateValue(tuple(slot), (pickle.dumps(kept),))
                last = max(x[2] for x in kept.values()) if last is None else max(last, *(x[2] for x in kept.values()))
            else:
                self.owners.removeKey(tuple(slot))
        if last is None:
            self.cleaning.clear()
        else:
            self._clean_at(last)
        return iter(())

    def close(self) -> None:
        pass


def stream_submissions(requests: DataFrame, jobs: DataFrame | None = None, keep: str = "7 days") -> DataFrame:
    """What each request leads to: ``run``, ``position``, ``result`` (``new``, ``reuse``, ``conflict`` or ``invalid``)
    and the job or the position of the request that owns its key; like ``ledger.submissions``, as requests come in.

    ``jobs``, a table, are those known before: it is read and stored at the start, one row per key, and each micro-batch
    is joined with that; requests without a key are always new. A key is remembered for ``keep``
    after its first request, by the requests' own ``submitted_at``, and requests that come later than ``keep`` after
    the newest are left out by the watermark.
    """
    rows = requests.withWatermark("submitted_at", keep)
    good = request_ok(F.col("key"), F.col("region"), F.col("profile"))
    request = F.to_json(F.array("region", "profile", "operation"))
    keyed = rows.where(good & F.col("key").isNotNull()).select(
        "run", F.sha2("key", 256).alias("digest"), "position", request.alias("request"), "submitted_at",
        F.unix_millis("submitted_at").alias("at"),
    )
    none = {"known": F.lit(False), "known_request": F.lit(None).cast("string"), "known_id": F.lit(None).cast("string")}
    if jobs is None:
        keyed = keyed.withColumns(none)
    else:
        # Without a position a job comes last.
        least = F.min_by(F.struct(request.alias("known_request"), F.col("id").alias("known_id")), F.coalesce("position", F.lit(2**63 - 1)))
        known = jobs.where(F.col("idempotency_sha256").isNotNull()).groupBy(
            F.col("run").alias("known_run"), F.col("idempotency_sha256").alias("known_digest")
        ).agg(least.alias("k")).select("known_run", "known_digest", "k.*", F.lit(True).alias("known"))
        known = materialize(known, "known")
        same = F.col("run").eqNullSafe(F.col("known_run")) & (F.col("digest") == F.col("known_digest"))
        keyed = keyed.join(known, same, "left").drop("known_run", "known_digest").withColumn("known", F.coalesce("known", F.lit(False)))
    span = F.expr(f"cast(interval '{keep}' as interval day to second)")
    keep_ms = requests.sparkSession.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + span))).first()[0]
    grouped = keyed.withColumn("group", F.pmod(F.xxhash64("run", "digest"), F.lit(_GROUPS))).groupBy("group")
    judged = grouped.transformWithStateInPandas(
        Submissions(keep_ms), outputStructType=_JUDGED, outputMode="Append", timeMode="EventTime"
    )
    others = rows.where(~good | F.col("key").isNull()).select(
        "run", F.col("position").cast("long").alias("position"), F.when(good, "new").otherwise("invalid").alias("result"),
        F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("long").alias("first_position"),
    )
    return judged.unionByName(others)


_STATUSES = ("", "queued", "running", "cancelling", "completed", "failed", "cancelled")
_LEGAL = {(old or "", new) for old, new in LEGAL}
#: What a step can be: a status (the last number stands for unknown ones), failed items, a failure code (none, some, the
#: one of an interrupted service), and whether the step before it has the same ``seq``.
_KINDS = [(c, k, p, t) for c in range(len(_STATUSES) + 1) for k in (0, 1) for p in (0, 1, 2) for t in (0, 1)]


def _effect(state: int, kind: tuple[int, int, int, int]) -> tuple[int, str | None, bool]:
    """The state after a step, the status it turns into (none: its own) and whether that is legal. A state is a status,
    whether items have failed, and whether a step of the current ``seq`` has been accepted."""
    status, (failed, taken) = _STATUSES[state // 4], divmod(state % 4, 2)
    code, count, failure, tied = kind
    new = _STATUSES[code] if code < len(_STATUSES) else None
    taken, failed_now = taken if tied else 0, failed | count
    turned = status == "running" and new == "completed" and (failed_now or failure)
    new = "failed" if turned else new
    restart = status in ACTIVE and new == "failed" and failure == 2
    legal = not taken and ((status, new) in _LEGAL or restart)
    after = 4 * _STATUSES.index(new) + 2 * failed_now + 1 if legal else 4 * (state // 4) + 2 * failed + taken
    return after, "failed" if turned else None, legal


_STATES = 4 * len(_STATUSES)
_EFFECTS = [[_effect(state, kind) for state in range(_STATES)] for kind in _KINDS]
#: Per kind of step the state after each state, as a table for ``bytes.translate``: maps compose by translation.
_MAPS = [bytes(x[0] for x in effects).ljust(256, b"\0") for effects in _EFFECTS]
_SAME = bytes(range(_STATES))
_SEGMENT = "run STRING, job_id STRING, first LONG, last LONG, ends BINARY, steps BINARY"
_PLACED = "run STRING, job_id STRING, first LONG, start INT, late LONG, steps BINARY"


def _composed(kinds) -> bytes:
    ends = _SAME
    for kind in kinds:
        ends = ends.translate(_MAPS[kind])
    return ends


_CODES = {x: n for n, x in enumerate(_STATUSES)}
_SEGMENTS = pa.schema([("run", pa.string()), ("job_id", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                       ("ends", pa.binary()), ("steps", pa.binary())])


def _kind(status: str | None, failed: int | None, failure: str | None) -> int:
    """A kind of step, as one that has a ``seq`` of its own."""
    code, count = _CODES.get(status, len(_STATUSES)), int((failed or 0) > 0)
    return ((code * 2 + count) * 3 + (0 if failure is None else 2 if failure == INTERRUPTED else 1)) * 2


def _segment(steps: list[tuple]) -> tuple[int, int, bytes, bytes]:
    """Steps ``(seq, status, failure, kind)`` in the order of ``seq``: the first and last, what they make of each state,
    and themselves, with their ties."""
    seqs, statuses, failures, kinds = zip(*steps, strict=True)
    kinds = bytes([kinds[0] & ~1, *(k & ~1 | (a == b) for a, b, k in zip(seqs, seqs[1:], kinds[1:]))])
    return seqs[0], seqs[-1], _composed(kinds), pickle.dumps((seqs, statuses, failures, kinds))


def _steps(packed: bytes) -> Iterator[tuple]:
    return zip(*pickle.loads(packed), strict=True)


_SEQ = operator.itemgetter(0)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per job and batch: its steps in order, and what they make of each state."""
    for batch in batches:
        jobs: dict[tuple, list[tuple]] = {}
        names: dict[str | None, str | None] = {}  # equal texts as one object are packed once
        for run, job_id, seq, status, failed, failure in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            step = (seq, names.setdefault(status, status), names.setdefault(failure, failure), _kind(status, failed, failure))
            jobs.setdefault((run, job_id), []).append(step)
        out = [(*key, *_segment(sorted(steps, key=_SEQ))) for key, steps in jobs.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _SEGMENTS, strict=True)], schema=_SEGMENTS)


def _joined(parts: list[tuple]) -> tuple:
    """One segment of several that reach into each other."""
    return _segment(sorted((step for part in parts for step in _steps(part[3])), key=_SEQ))


class JobState(StatefulProcessor):
    """Keeps the state of one job and tells each segment of its steps in which state it starts.

    The steps themselves are not looked at: a segment says what it makes of any state. Only segments that reach into
    each other, or behind what earlier micro-batches held, are taken apart.
    """

    def __init__(self, remembered_ms: int | None = None):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "state INT, seq LONG", self.remembered_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last = self.state.get() if self.state.exists() else (0, -1)
        columns = ("first", "last", "ends", "steps")
        parts = sorted((x for part in rows for x in zip(*(part[c] for c in columns), strict=True)), key=lambda x: (x[0], x[1]))
        out, at = [], 0
        while at < len(parts):
            upto, reach = at + 1, parts[at][1]
            while upto < len(parts) and parts[upto][0] <= reach:
                reach, upto = max(reach, parts[upto][1]), upto + 1
            first, end, ends, steps = parts[at] if upto == at + 1 else _joined(parts[at:upto])
            if first <= last:
                ends = _composed(kind for seq, _, _, kind in _steps(steps) if seq > last)
            out.append((*key, int(first), state, last, steps))
            # The next segment begins another seq.
            state, last, at = ends[state] & ~1, max(last, int(end)), upto
        self.state.update((state, last))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _PLACED.split(", ")])

    def close(self) -> None:
        pass


JOB_STEPS = (
    "run STRING, job_id STRING, seq LONG, from_status STRING, to_status STRING, failure STRING, accepted BOOLEAN"
)
_OUTCOMES = pa.schema([(x.split()[0], {"LONG": pa.int64(), "BOOLEAN": pa.bool_()}.get(x.split()[1], pa.string())) for x in JOB_STEPS.split(", ")])


def _outcomes(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """What each step of a segment led to, from the state in which it starts; some ``most`` rows at a time."""

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _OUTCOMES, strict=True)], schema=_OUTCOMES)

    out = []
    for batch in batches:
        for run, job_id, state, late, packed in zip(*(batch.column(c).to_pylist() for c in ("run", "job_id", "start", "late", "steps")), strict=True):
            for seq, status, failure, kind in _steps(packed):
                after, turned, legal = _EFFECTS[kind][state]
                legal = legal and seq > late
                failure = failure or "partial_failure" if turned else failure
                out.append((run, job_id, seq, _STATUSES[state // 4], turned or status, failure, legal))
                state = after if seq > late else state
                if len(out) >= most:
                    yield rows()
                    out = []
    if out:
        yield rows()


def stream_jobs(steps: DataFrame, remembered_ms: int | None = None) -> DataFrame:
    """Status changes ``(run, job_id, seq, status, failed, failure)`` with what each one led to.

    Legal changes of a job are applied in the order of ``seq``; the others are given back as not accepted. Of steps
    with the same ``seq`` the first legal one counts. A step that comes in a later micro-batch than one it does not
    follow is not accepted, nor is one without ``seq`` (-1). A run that ends with a failure code or failed items has failed. Neither the order in files
    nor the size of Arrow batches matters.

    A step is a map over the few states, so whatever steps lie together in a task are composed to one map there. The
    task that keeps a job's state gets a row per such segment, and the steps are judged in other tasks again; a job
    with most of all steps is thus spread. A finished job's state (one short row) is kept, since only it tells that a
    late step is no new job. With ``remembered_ms`` it is forgotten that long after the last step; that needs a
    continuous trigger, as ``availableNow`` never ends with processing time.
    """
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-1).cast("long"))
    fields = steps.select("run", "job_id", seq.alias("seq"), "status", F.col("failed").cast("long").alias("failed"), "failure")
    placed = fields.mapInArrow(_segments, _SEGMENT).groupBy("run", "job_id").transformWithStateInPandas(
        JobState(remembered_ms), outputStructType=_PLACED, outputMode="Append",
        timeMode="None" if remembered_ms is None else "ProcessingTime",
    )
    return placed.repartition("run", "job_id", "first").mapInArrow(_outcomes, JOB_STEPS)


#: Sends one notice (a dict) to its target; gives an error code, or nothing when it was received.
Deliver = Callable[[dict], "str | None"]
ATTEMPTS = "run STRING, identity STRING, turn LONG, job_id STRING, region STRING, completed_ms LONG, attempt LONG, error STRING"


class Outbox(StatefulProcessor):
    """Delivers the notices of one target, oldest first.

    What is not yet received is kept with the target. After a failure the target rests for ``retry_ms``, with all its
    notices, as later ones must not overtake; a timer wakes it. A notice that comes again is not sent again while it is
    remembered (``keep_ms`` after its delivery). Only the ``head`` oldest notices are held in memory at a time.
    """

    def __init__(self, deliver: Deliver, retry_ms: int, keep_ms: int, head: int = 1_000):
        self.deliver, self.retry_ms, self.keep_ms, self.head = deliver, retry_ms, keep_ms, head

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "job_id STRING", "completed_ms LONG, region STRING")
        self.received = handle.getMapState("received", "job_id STRING", "turn LONG", self.keep_ms)
        self.target = handle.getValueState("target", "due LONG, attempts LONG, turns LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for job_id, completed, region in zip(part["job_id"], part["completed_ms"], part["region"], strict=True):
                if not self.received.containsKey((job_id,)):
                    self.pending.updateValue((job_id,), (int(completed), region))
        yield from self._sent(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._sent(key, timerValues.getCurrentProcessingTimeInMs())

    def _oldest(self) -> list[tuple]:
        waiting = ((completed, job_id, region) for (job_id,), (completed, region) in self.pending.iterator())
        return heapq.nsmallest(self.head, waiting, key=lambda x: x[:2])

    def _sent(self, key, now: int) -> Iterator[pd.DataFrame]:
        due, attempts, turns = self.target.get() if self.target.exists() else (0, 0, 0)
        out, error = [], None
        while due <= now and error is None and (oldest := self._oldest()):
            for completed, job_id, region in oldest:
                turns, attempts = turns + 1, attempts + 1
                notice = {"run": key[0], "identity": key[1], "job_id": job_id, "region": region, "completed_ms": completed, "attempt": attempts}
                try:
                    error = self.deliver(notice)
                except Exception as failure:  # whatever a caller's function raises is a failed delivery, and is reported
                    error = type(failure).__name__
                out.append((*key, turns, job_id, region, completed, attempts, error))
                if error is not None:
                    due = now + self.retry_ms
                    self.handle.registerTimer(due)
                    break
                self.pending.removeKey((job_id,))
                self.received.updateValue((job_id,), (turns,))
                attempts = 0
        if out:
            self.target.update((due, attempts, turns))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ATTEMPTS.split(", ")])

    def close(self) -> None:
        pass


def stream_outbox(notices: DataFrame, deliver: Deliver, retry_ms: int = 30_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """Delivers notices (``run``, ``identity``, ``job_id``, ``region``, ``completed_at``) at least once and gives a row
    per attempt: ``turn`` (its place among the target's attempts), ``attempt`` (at this notice) and ``error``.

    Each target is served by itself, oldest notice first, and rests for ``retry_ms`` after a failure. Nothing but the
    target's own state is read in a micro-batch. A batch that is replayed after a failure delivers again, so receivers
    deduplicate by job. Retries go by the clock: use a trigger that goes on, not ``availableNow``.
    """
    rows = notices.select("run", "identity", "job_id", "region", F.unix_millis("completed_at").alias("completed_ms"))
    return rows.groupBy("run", "identity").transformWithStateInPandas(
        Outbox(deliver, retry_ms, keep_ms), outputStructType=ATTEMPTS, outputMode="Append", timeMode="ProcessingTime"
    )


def fresh(now: Column) -> Column:
    age = F.unix_millis(now) - F.unix_millis("observed_at")
    return age.between(0, MAX_AGE_MS)


def stream_fresh(snaps: DataFrame, now: Column | None = None) -> DataFrame:
    """Snapshots that are neither stale nor older than the limit when they pass."""
    return snaps.where(~F.col("stale") & fresh(F.current_timestamp() if now is None else now))


def stream_access(records: DataFrame, path: str, checkpoint: str, trusted: list[str], period: str = "daily") -> StreamingQuery:
    """Normalized access records, appended to run and period partitions."""
    rows = normalize_access(client_ip(records, trusted)).withColumn("period", rotation_period(F.col("timestamp"), period))
    return (
        rows.writeStream.format("parquet")
        .partitionBy("run", "period")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
