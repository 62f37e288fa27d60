"""What keeps large inputs within their time: few files, few calls, small segments."""

import glob
import json
import pickle
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from assetlake.plans import source_queries
from assetlake.plans.bound import QUERIES, Bound
from assetlake.session import scratch_path
from assetlake.sources import readers
from assetlake.streaming import streams

REQUEST = {"region": "jp", "profile": "p", "operation": "update"}
STAMP = "2024-01-01T00:00:00Z"


def ledger(job_id):
    progress = {"phase": "x", "completed": 1, "failed": 0, "bytes": 0}
    job = {"id": job_id, "request": REQUEST, "status": "queued", "created_at": STAMP, "updated_at": STAMP, "progress": progress}
    return json.dumps({"schema_version": 2, "jobs": [job]})


def test_documents_of_a_table_are_read_like_files(spark):
    docs = [("a", ledger("i")), ("b", ledger("j")[:-1]), ("c", ledger("k").replace('"status": "queued", ', ""))]
    root = scratch_path(spark, "tree")
    rows = spark.createDataFrame(docs, "folder string, value string")
    rows.write.partitionBy("folder").text(root)
    table = rows.selectExpr("folder AS run", "'jobs.json' AS file", "value")
    for source in (root, table):
        assert [(r.run, r.id) for r in readers.read_ledger(spark, source)[0].collect()] == [("a", "i")]
        assert {r.run for r in readers.document_violations(spark, source, "ledgers").collect()} == {"b", "c"}


def events(spark, users):
    at = scratch_path(spark, "sf")
    rows = spark.range(2000).selectExpr(
        "id AS event_id", "timestamp '2024-01-01' AS ts", f"id % {users} AS user_id", "'click' AS event_type", "1.0D AS value", "'' AS props")
    rows.write.parquet(f"{at}/events.parquet")
    return at


def test_ledgers_take_no_file_each(spark):
    """Ledgers are one to some ten events; what they are stored in must not grow like that."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for users in (40, 2000):
        docs = source_queries._ledger_files(Bound(spark, events(spark, users)))
        assert len(docs.inputFiles()) <= int(before) * 3
        assert docs.count() == (12 if users == 40 else 3 * docs.where("run NOT LIKE '%\\_cut' AND run NOT LIKE '%\\_gap'").count())


def test_a_segment_of_one_step_is_small_and_steps_are_judged(spark):
    names = ["run", "job_id", "seq", "status", "failed", "failure"]
    rows = [["r", f"j{n}", n, "queued", None, None] for n in range(5000)] + [["r", "j0", 9000, "running", 2, None], ["r", "j0", 9001, "completed", 0, None]]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names=names)
    (out,) = streams._segments([batch])
    assert out.num_rows == 5000 and max(len(x) for x in out.column("steps").to_pylist()[1:]) < 100
    first = out.slice(0, 1).to_pylist()[0]
    placed = pa.RecordBatch.from_pylist([{k: first[k] for k in ("run", "job_id", "first", "steps")} | {"start": 0, "late": -1}])
    got = [tuple(r.values())[2:] for b in streams._outcomes([placed], most=1) for r in b.to_pylist()]
    assert got == [(0, "", "queued", None, True), (9000, "queued", "running", None, True), (9001, "running", "failed", "partial_failure", True)]


class Kept:
    """A state variable in memory."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))

    def exists(self):
        return bool(self.rows)

    def update(self, value):
        self.rows[None] = value

    def clear(self):
        self.rows.clear()


def test_a_group_of_keys_is_one_call_and_forgets_passed_owners():
    owners, timers = Kept(), []
    op = streams.Submissions(100)
    op.init(SimpleNamespace(getMapState=lambda *a: owners, getValueState=lambda *a: Kept(), registerTimer=timers.append))

    def kept():
        return sum(len(pickle.loads(x[0])) for x in owners.rows.values())

    def clock(now):
        return SimpleNamespace(getCurrentWatermarkInMs=lambda: now)

    def sent(rows, now):
        part = pd.DataFrame(rows, columns=["run", "digest", "position", "request", "at"]).assign(known=False, known_request=None, known_id=None)
        out = pd.concat(op.handleInputRows((0,), iter([part.iloc[: len(part) // 2], part.iloc[len(part) // 2 :]]), clock(now)))
        return {r.position: (r.result, None if pd.isna(r.first_position) else r.first_position) for r in out.itertuples()}

    rows = [("r", f"k{n % 500}", n, "ab"[n // 500 % 2], 1000 + n % 500) for n in range(1500)][::-1]
    got = sent(rows, 0)
    assert owners.calls <= 32 and kept() == 500
    assert all(got[n] == ("new", None) and got[n + 500] == ("conflict", n) and got[n + 1000] == ("reuse", n) for n in range(500))
    # The watermark has passed the first ones: their keys are free again, the others are not.
    assert sent([("r", "k0", 2000, "a", 1400), ("r", "k499", 2001, "a", 1400), (None, "k0", 2002, "a", None)], 1300) == {
        2000: ("new", None), 2001: ("reuse", 499), 2002: ("new", None)}
    assert timers == [1599]
    list(op.handleExpiredTimer((0,), clock(1450), None))
    assert kept() == 150
    list(op.handleExpiredTimer((0,), clock(1600), None))
    assert not owners.rows


def test_pages_are_files_without_a_folder_each(spark, monkeypatch):
    at, seen = scratch_path(spark, "sf"), []
    rows = [(n, "u", f"<p>{n}</p>") for n in range(60)] + [(7, "u", "again"), (8, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    listed = readers.file_inventory
    monkeypatch.setattr(readers, "file_inventory", lambda s, root: seen.append(root) or listed(s, root))
    lengths = sorted(r.length for r in QUERIES["file_inventory"](spark, at).collect())
    assert lengths == sorted([9] * 8 + [10] * 50 + [9 + 6, 9 + 1])
    root = seen[0].removeprefix("file:")
    assert len(glob.glob(f"{root}/**/*.txt", recursive=True)) == 60
    assert len(glob.glob(f"{root}/**/*/", recursive=True)) <= 6
