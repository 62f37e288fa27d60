"""Streams that remember: submissions by key, and notices that wait for their target."""

import time
from datetime import datetime

from assetlake.session import scratch_path
from assetlake.streaming import streams

REQUESTS = "run string, position long, key string, region string, profile string, operation string, submitted_at timestamp"
JOBS = "run string, id string, position long, region string, profile string, operation string, idempotency_sha256 string"


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def judged(spark, files, jobs=None, keep="2 days"):
    src, out, state = (scratch_path(spark, n) for n in ("requests", "out", "state"))
    for rows in files:
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.stream_submissions(stream, jobs, keep).writeStream.format("parquet").option("path", out)
    q.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return {r.position: (r.result, r.job_id, r.first_position) for r in spark.read.parquet(out).collect()}


def test_submissions_repeat_or_conflict_over_batches(spark):
    import hashlib

    known = hashlib.sha256(b"old").hexdigest()
    jobs = spark.createDataFrame([("r", "j1", 0, "jp", "p", "update", known), ("r", "j0", 5, "kr", "p", "update", known)], JOBS)
    files = [
        [("r", 2, "k", "jp", "p", "update", at(1)), ("r", 1, "k", "jp", "p", "export", at(1)), ("r", 3, None, "jp", "p", "update", at(1)),
         ("r", 4, "bad key", "jp", "p", "update", at(1)), ("r", 5, "n", "nowhere", "p", "update", at(1)), ("s", 6, "k", "jp", "p", "update", at(1))],
        [("r", 11, "k", "jp", "p", "export", at(2)), ("r", 12, "old", "jp", "p", "update", at(2)), ("r", 13, "old", "jp", "q", "update", at(2))],
        # The watermark passes k's time by more than it is remembered; then the key is free again.
        [("r", 21, "late", "jp", "p", "update", at(9))],
        [("r", 31, "k", "kr", "p", "update", at(9, 1)), ("r", 32, None, "jp", "p", "update", at(9, 1))],
    ]
    assert judged(spark, files, jobs) == {
        1: ("new", None, None), 2: ("conflict", None, 1), 3: ("new", None, None), 4: ("invalid", None, None), 5: ("invalid", None, None),
        6: ("new", None, None), 11: ("reuse", None, 1), 12: ("reuse", "j1", None), 13: ("conflict", "j1", None),
        21: ("new", None, None), 31: ("new", None, None), 32: ("new", None, None),
    }


def test_the_first_position_of_a_batch_owns_the_key_in_any_order_and_batch_size(spark):
    rows = [("r", n, "k", "jp", "p", ("update", "export")[n % 2], at(1)) for n in range(50)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {n: ("conflict" if n % 2 else "reuse", None, 0) for n in range(50)} | {0: ("new", None, None)}
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert judged(spark, [rows[::-1]]) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


NOTICES = "run string, identity string, job_id string, region string, completed_at timestamp"


def test_targets_get_their_notices_in_order_and_rest_after_a_failure(spark):
    def deliver(notice):
        if notice["identity"] == "slow" and notice["attempt"] == 1:
            return "busy"
        if notice["identity"] == "broken":
            raise TimeoutError
        return None

    src, out, state = (scratch_path(spark, n) for n in ("notices", "attempts", "state"))
    first = [("r", t, f"j{n}", "jp", at(9 - n)) for n in (3, 1, 2) for t in ("good", "slow", "broken")]
    second = [("r", t, "j9", "jp", at(20)) for t in ("good", "slow", "broken")] + first[:3]
    third = [("r", "good", "j1", "jp", at(8)), ("r", "good", "j0", "jp", at(1))]
    for rows in (first, second, third):
        spark.createDataFrame(rows, NOTICES).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(NOTICES).option("maxFilesPerTrigger", 1).parquet(src)
    attempts = streams.stream_outbox(stream, deliver, retry_ms=4_000)
    q = attempts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    end, want = time.time() + 120, [("j3", 1, "busy"), ("j3", 2, None)]
    while time.time() < end and q.exception() is None:
        time.sleep(1)
        try:
            rows = spark.read.schema(streams.ATTEMPTS).parquet(out).collect()
        except Exception:  # nothing is written yet
            continue
        if sum(r.identity == "slow" for r in rows) >= 8 and sum(r.identity == "broken" for r in rows) >= 2:
            break
    q.stop()
    assert q.exception() is None
    log = {t: [(r.job_id, r.attempt, r.error) for r in sorted(rows, key=lambda r: r.turn) if r.identity == t] for t in ("good", "slow", "broken")}
    assert [r.turn for r in sorted(rows, key=lambda r: r.turn) if r.identity == "good"] == list(range(1, 6))
    assert log["good"] == [("j3", 1, None), ("j2", 1, None), ("j1", 1, None), ("j9", 1, None), ("j0", 1, None)]
    assert log["slow"][:2] == want and [x[0] for x in log["slow"]] == ["j3", "j3", "j2", "j2", "j1", "j1", "j9", "j9"]
    assert log["broken"][0] == ("j3", 1, "TimeoutError") and {x[0] for x in log["broken"]} == {"j3"}
    assert [x[1] for x in log["broken"]] == list(range(1, len(log["broken"]) + 1))


STEPS = "run string, job_id string, seq long, status string, failed long, failure string"


def stepped(batches):
    """The rows of each micro-batch one by one, in the order of seq."""
    from assetlake.operators.ledger import ACTIVE, INTERRUPTED, LEGAL

    states, out = {}, []
    for batch in batches:
        seen = {}
        for run, job, seq, status, failed, failure in sorted(batch, key=lambda x: (x[1], x[2])):
            now, bad, last, taken = states.get(job, ("", 0, -1, None))
            turned = now == "running" and status == "completed" and (bad or failed or failure is not None)
            new, why = ("failed", failure or "partial_failure") if turned else (status, failure)
            legal = (now, new) in {(a or "", b) for a, b in LEGAL} or (now in ACTIVE and new == "failed" and why == INTERRUPTED)
            legal = bool(legal and seq > last and seq != taken)
            out.append((job, seq, now, new, why, legal))
            states[job] = (new, bad or failed, last, seq) if legal else (now, bad, last, taken)
            seen[job] = max(seq, seen.get(job, -1))
        for job, top in seen.items():
            now, bad, last, _ = states[job]
            states[job] = (now, bad, max(last, top), None)
    return sorted(out, key=str)


def test_job_steps_in_segments_are_those_one_by_one(spark):
    """Jobs with many steps and few, segments that reach into each other, repeated and late steps."""
    import random

    rnd = random.Random(9)
    names = ["queued", "running", "running", "cancelling", "completed", "failed", "cancelled", "odd"]

    def step(job, seq):
        why = rnd.choice([None, None, None, "service_interrupted", "io"])
        return ("r", job, seq, rnd.choice(names), rnd.choice([0, 0, 0, 2]), why)

    batches = []
    for low in (0, 200, 150):
        rows = [step("big", n) for n in rnd.sample(range(low, low + 300), 120)]
        rows += [step(f"j{n}", low + rnd.randint(0, 5)) for n in range(30)]
        rows = list({(r[1], r[2]): r for r in rows}.values())
        rows += rows[:15]
        rnd.shuffle(rows)
        batches.append(rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    for size in ("9", "10000"):
        src, out, state = (scratch_path(spark, n) for n in ("steps", "out", "state"))
        for rows in batches:
            spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(src)
        spark.conf.set(key, size)
        try:
            q = streams.stream_jobs(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            q.trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(key, before)
        got = [(r.job_id, r.seq, r.from_status, r.to_status, r.failure, r.accepted) for r in spark.read.parquet(out).collect()]
        assert sorted(got, key=str) == stepped(batches)
