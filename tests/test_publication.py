"""Publication counters over successive versions, ledger scenarios, client addresses and streams."""

import pytest
from assetlake.operators import ledger, logs, publication
from assetlake.session import scratch_path
from assetlake.sources import readers, writers
from assetlake.streaming import streams
from pyspark.sql import functions as F

ENTRY = "run string, path string, bytes long, sha256 string, content_type string, source string, kind string, class_id int, container string, name string"
SHELF = {f"shelf/book{i}.txt": f"text {i}" for i in range(7)}


def manifest(spark, files):
    return spark.createDataFrame([("r", p, 1, s, "t", f"src/{p}", "k", None, None, None) for p, s in files.items()], ENTRY)


def counts(spark, entries, previous, failed=(), prune=True):
    failed = spark.createDataFrame([("r", f) for f in failed], "run string, source string")
    row = publication.stable_counts(manifest(spark, entries), manifest(spark, previous), failed, prune=prune).first()
    return row.files, row.uploaded, row.unchanged, row.pruned, row.failed_resources, row.carried_forward


def test_counters(spark):
    """Seven books; two are rewritten, one is new, one is gone, and of the last the source may have failed."""
    later = {k: v + "!" if k[-5] in "25" else v for k, v in SHELF.items() if k != "shelf/book0.txt"} | {"shelf/map.png": "m"}
    assert counts(spark, SHELF, {}) == (7, 7, 0, 0, 0, 0)
    assert counts(spark, SHELF, SHELF) == (7, 0, 7, 0, 0, 0)
    assert counts(spark, later, SHELF) == (7, 3, 4, 1, 0, 0)
    assert counts(spark, later, SHELF, prune=False) == (7, 3, 4, 0, 0, 0)
    assert counts(spark, later, SHELF, ["src/shelf/book0.txt"]) == (7, 3, 4, 0, 1, 1)


def test_claimed_key_is_not_carried(spark):
    kept = publication.carried(
        manifest(spark, SHELF), spark.createDataFrame([("r", "src/shelf/book3.txt")], "run string, source string"),
        manifest(spark, {"Shelf/BOOK3.txt": "7"}),
    )
    assert kept.count() == 0


JOBS = "run string, position long, id string, region string, status string, updated_at timestamp, outcome string"


def jobs(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([("l", i, f"j{i}", r, s, datetime(2024, 1, 1, 0, i), "o") for i, (r, s) in enumerate(rows)], JOBS)


def test_claims_skip_busy_regions(spark):
    def next_jobs(*states):
        return [r.id for r in ledger.claimable(jobs(spark, list(zip(["jp", "jp", "en"], states))), 2).orderBy("slot").collect()]

    assert next_jobs("queued", "queued", "queued") == ["j0", "j2"]
    assert next_jobs("cancelling", "queued", "queued") == ["j2"]
    assert next_jobs("cancelling", "queued", "running") == []
    assert next_jobs("cancelled", "queued", "completed") == ["j1"]


def test_retention_and_outbox(spark):
    done = jobs(spark, [("jp", "completed")] * 4)
    targets = spark.createDataFrame([("l", "jp", "a"), ("l", "jp", "b")], "run string, region string, identity string")
    acks = spark.createDataFrame([("l", "j0", "a"), ("l", "j0", "b"), ("l", "j1", "a")], "run string, job_id string, identity string")
    assert [r.id for r in ledger.retain(done, 1).collect()] == ["j3"]
    pending = ledger.outbox(done, targets, acks)
    assert pending.count() == 5 and pending.select("job_id").distinct().count() == 3
    states = spark.createDataFrame([("l", "b", None)], "run string, identity string, due timestamp")
    first = {r.identity: r.job_id for r in ledger.due_deliveries(pending, states, F.current_timestamp()).collect()}
    assert first == {"a": "j2", "b": "j1"}


def test_lineage_with_a_cycle(spark):
    rows = [("l", f"n{i}", f"n{i - 1}" if i else None) for i in range(70)] + [("l", "x", "y"), ("l", "y", "x"), ("l", "lost", "gone")]
    got = {r.id: (r.root, r.attempt) for r in ledger.lineage(spark.createDataFrame(rows, "run string, id string, retry_of string")).collect()}
    assert got["n69"] == ("n0", 70) and got["x"] == (None, None) and got["lost"] == ("lost", 1)


@pytest.mark.parametrize(
    "peer, forwarded, client",
    [
        ("8.20.30.40", "9.1.1.1", "8.20.30.40"),
        ("172.16.5.5", "9.1.1.1, 192.168.7.7", "9.1.1.1"),
        ("172.16.5.5", "9.9.9.9, 8.8.1.1, 192.168.7.7", "8.8.1.1"),
        ("172.16.5.5", "nobody, 192.168.7.7", "172.16.5.5"),
        ("::ffff:172.16.5.5", "9.1.1.1", "9.1.1.1"),
        ("fe80::5", "2400:cb00::77, fe80::6", "2400:cb00::77"),
        ("172.16.5.5", "192.168.1.2,192.168.3.4", "192.168.1.2"),
        ("172.16.5.5", None, "172.16.5.5"),
        ("172.16.5.5", ",".join(["192.168.0.9"] * 33), "172.16.5.5"),
    ],
)
def test_client_address(spark, peer, forwarded, client):
    df = spark.createDataFrame([(peer, forwarded)], "peer_ip string, forwarded string")
    trusted = ["172.16.0.0/12", "192.168.0.0/16", "fe80::/10"]
    assert logs.client_ip(df, trusted).first().client_ip == client


@pytest.mark.parametrize("template", ["", "${nope}", "${time", "a\nb", "x" * 1025])
def test_bad_templates(spark, template):
    with pytest.raises(ValueError):
        logs.render_line(template)


def test_unfinished_publications_are_invisible(spark):
    prefix = scratch_path(spark, "pub")
    df = spark.range(3)
    writers.write_publication(df, prefix, "jp", "one")
    df.write.parquet(f"{prefix}/jp/publications/two/files")
    assert {r.publication_id for r in writers.read_publications(spark, prefix).collect()} == {"one"}
    with pytest.raises(Exception):
        writers.write_publication(df, prefix, "jp", "one")


def test_journal_lines(spark):
    good = '{"source":"s","output_directory":"00000","source_sha256":"a","objects":1,"selected_objects":1,"skipped_objects":0,"outputs":[{"path":"p","kind":"k","bytes":3,"sha256":"x"}],"errors":[]}'
    lacking = [good.replace(x, "") for x in ('"path":"p",', ',"sha256":"x"', '"kind":"k",')] + [good.replace('"errors":[]', '"errors":[null]')]
    lacking.append(good.replace('"sha256":"x"}', '"sha256":"x","object":{"source_file":"f","path_id":1}}'))
    whole = good.replace('"sha256":"x"}', '"sha256":"x","object":{"source_file":"f","path_id":1,"class_id":2}}')
    cut = ['{"source":"s","output_directory":"00000"}', good[:30], "[]", ""]
    lines = spark.createDataFrame([("r", x) for x in (good, whole, *cut, *lacking)], "run string, value string")
    journal, bad = readers.parse_journal(lines)
    assert journal.count() == 2 and bad.count() == 9


FULL = {
    "locations": {"locations": [{"id": 1, "primary_key": "a", "internal_id": "b", "provider_id": "c", "dependencies": [2]}]},
    "ledgers": {
        "schema_version": 2,
        "jobs": [{"id": "i", "request": {"region": "jp", "profile": "p", "operation": "update"}, "status": "queued",
                  "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z",
                  "progress": {"phase": "x", "completed": 1, "failed": 0, "bytes": 0}}],
        "completions": [{"event": {"schema_version": 1, "job_id": "i", "request": {"region": "jp", "profile": "p", "operation": "update"},
                                   "outcome": {"verification": 1}, "completed_at": "2024-01-01T00:00:00Z"}, "pending_targets": ["t"]}],
    },
}


def without_one(value):
    """All copies of a nested value that lack one field or have one null instead of an element."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield {a: b for a, b in value.items() if a != k}
            if k != "outcome":
                yield from ({**value, k: x} for x in without_one(v))
    elif isinstance(value, list):
        for n, v in enumerate(value):
            yield [*value[:n], None, *value[n + 1 :]]
            yield from ([*value[:n], x, *value[n + 1 :]] for x in without_one(v))


@pytest.mark.parametrize("kind", FULL)
def test_documents_need_every_nested_field(spark, kind):
    import json

    copies = [x for x in without_one(FULL[kind]) if x != {k: v for k, v in FULL[kind].items() if k != "completions"}]
    root = scratch_path(spark, kind)
    docs = [("good", json.dumps(FULL[kind]))] + [(f"b{n}", json.dumps(x)) for n, x in enumerate(copies)]
    spark.createDataFrame(docs, "folder string, value string").write.partitionBy("folder").text(root)
    bad = {r.run for r in readers.document_violations(spark, root, kind).collect()}
    assert bad == {f"b{n}" for n in range(len(copies))} and len(copies) > 6
    read = readers.read_locations(spark, root) if kind == "locations" else readers.read_ledger(spark, root)[1]
    assert [r.run for r in read.collect()] == ["good"]


STEPS = "run string, job_id string, seq long, status string, failed long, failure string"


def streamed_jobs(spark, files, trigger=None):
    src, out, state = (scratch_path(spark, n) for n in ("steps", "out", "state"))
    for steps in files:
        spark.createDataFrame(steps, STEPS).coalesce(1).write.mode("append").parquet(src)
    reader = spark.readStream.schema(STEPS)
    stream = (reader.option("maxFilesPerTrigger", trigger) if trigger else reader).parquet(src)
    q = streams.stream_jobs(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return [(r.to_status, r.failure, r.accepted) for r in spark.read.parquet(out).orderBy("job_id", "seq").collect()]


def test_stream_of_job_steps(spark):
    steps = [("r", "a", 1, "queued", 0, None), ("r", "a", 2, "running", 1, None), ("r", "a", 3, "completed", 0, None), ("r", "a", 4, "running", 0, None),
             ("r", "b", 1, "queued", 0, None), ("r", "b", 2, "running", 0, None), ("r", "b", 3, "completed", 0, "disk_full")]
    want = [("queued", None, True), ("running", None, True), ("failed", "partial_failure", True), ("running", None, False),
            ("queued", None, True), ("running", None, True), ("failed", "disk_full", True)]
    assert streamed_jobs(spark, [[s] for s in steps], 1) == want


def test_stream_of_job_steps_in_any_order_and_batch_size(spark):
    steps = [("r", "a", i, "queued" if i == 0 else "running", 0, None) for i in range(60)]
    want = [("queued" if i == 0 else "running", None, True) for i in range(60)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    try:
        for size in ("10", "10000"):
            spark.conf.set(key, size)
            assert streamed_jobs(spark, [steps[30:][::-1], steps[:30][::-1]]) == want
    finally:
        spark.conf.set(key, before)
