"""Readers for catalogs, receipts, journals, manifests, file trees, ledgers and logs.

Each kind of file has its own root, with one folder per run below it (``root/<run>/<file>`` or
``root/<column>=<run>/<file>``); the run is taken from the folder. Where there are very many small documents, a file
and a folder for each of them cost more than what is in them; readers of documents take a table of documents
``(run, file, value)`` in place of the root as well.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators.logs import parse_access
from assetlake.violations import violation

LOCATION = (
    "STRUCT<id: LONG, primary_key: STRING, internal_id: STRING, provider_id: STRING, dependencies: ARRAY<LONG>>"
)
ASSET = (
    "STRUCT<relative_path: STRING, provider: STRING, bytes: LONG, downloaded_sha256: STRING, "
    "stored_sha256: STRING, decrypted: BOOLEAN>"
)
SELECTION = "STRUCT<keys: ARRAY<STRING>, include: ARRAY<STRING>, exclude: ARRAY<STRING>, priority: ARRAY<STRING>>"
SNAPSHOT = (
    "STRUCT<region: STRING, schema_version: INT, environment: STRING, platform: STRING, client_version: STRING, "
    "protocol_version: STRING, master_version: STRING, resource_version: STRING, platform_hash: STRING, "
    "effective_cdn_root: STRING, credential_ref: STRING, observed_at: TIMESTAMP, source: STRING, "
    "catalog_layout: STRING, catalog_url: STRING, bundle_base_url: STRING, cdn_authorization: STRING>"
)
RECEIPT = (
    f"snapshot {SNAPSHOT}, catalog_url STRING, bytes LONG, sha256 STRING, downloaded_at TIMESTAMP, "
    "catalog_layout STRING, bundle_base_url STRING, catalog_locale STRING, catalog_hash STRING, "
    f"update STRUCT<selection: {SELECTION}, cache_hits: LONG, assets: ARRAY<{ASSET}>, "
    "embedded_locations: LONG, logical_locations: LONG, total_bytes: LONG>"
)
OUTPUT = (
    "STRUCT<path: STRING, kind: STRING, bytes: LONG, sha256: STRING, object: STRUCT<source_file: STRING, "
    "path_id: LONG, class_id: INT, name: STRING, container: STRING>>"
)
REPORT = (
    "cache_hit BOOLEAN, source STRING, output_directory STRING, source_sha256 STRING, objects LONG, "
    f"selected_objects LONG, skipped_objects LONG, outputs ARRAY<{OUTPUT}>, errors ARRAY<STRING>"
)
SUMMARY = (
    "schema_version INT, region STRING, platform STRING, complete BOOLEAN, retained BOOLEAN, full_catalog BOOLEAN, "
    "full_export BOOLEAN, input_files LONG, catalog_files LONG, succeeded LONG, failed LONG, cache_hits LONG, "
    "output_files LONG, output_bytes LONG, unity_objects LONG, selected_unity_objects LONG, "
    "skipped_unity_objects LONG, catalog_sha256 STRING, payloads MAP<STRING, LONG>"
)
ENTRY = (
    "path STRING, bytes LONG, sha256 STRING, content_type STRING, source STRING, kind STRING, class_id INT, "
    "container STRING, name STRING"
)
REQUEST = "STRUCT<region: STRING, profile: STRING, operation: STRING>"
JOB = (
    f"STRUCT<id: STRING, request: {REQUEST}, status: STRING, created_at: TIMESTAMP, updated_at: TIMESTAMP, "
    "progress: STRUCT<phase: STRING, completed: LONG, failed: LONG, total: LONG, bytes: LONG>, failure: STRING, "
    "retry_of: STRING, outcome: VARIANT, idempotency_sha256: STRING>"
)
COMPLETION = (
    f"STRUCT<event: STRUCT<schema_version: INT, job_id: STRING, request: {REQUEST}, outcome: VARIANT, completed_at: TIMESTAMP>, "
    "pending_targets: ARRAY<STRING>>"
)
MAX_REPORT = 16 * 1024 * 1024


def run_of() -> Column:
    """The folder a file lies in; a partition folder ``<column>=<run>`` gives its value."""
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+\z", 1)
    return F.url_decode(F.replace(F.regexp_replace(folder, r"\A[^=]*=", ""), F.lit("+"), F.lit("%2B"))).alias("run")


def _has(of: str, fields: str) -> str:
    return " AND ".join(f"{of}.{field} IS NOT NULL" for field in fields.split())


def _each(array: str, rule: str) -> str:
    """Every element is there and keeps ``rule`` (over ``x``)."""
    return f"({array} IS NOT NULL AND forall({array}, x -> x IS NOT NULL AND {rule}))"


def _optional(value: str, rule: str) -> str:
    return f"({value} IS NULL OR ({rule}))"


_REQUEST = "region profile operation"
_OUTPUT = f"{_has('x', 'path kind bytes sha256')} AND {_optional('x.object', _has('x.object', 'source_file path_id class_id'))}"
_LIST = "forall({0}, y -> y IS NOT NULL)"

#: Per kind of document: its schema, and what must be there for it to be read at all, at every level. Fields that are
#: not named may be missing.
DOCUMENTS: dict[str, tuple[str, str]] = {
    "locations": (
        f"locations ARRAY<{LOCATION}>",
        _each("d.locations", _has("x", "id primary_key internal_id provider_id dependencies") + f" AND {_LIST.format('x.dependencies')}"),
    ),
    "receipts": (
        RECEIPT,
        " AND ".join([
            _has("d", "snapshot catalog_url bytes sha256 downloaded_at"),
            _has("d.snapshot", "schema_version environment platform client_version protocol_version resource_version "
                 "platform_hash effective_cdn_root credential_ref observed_at source"),
            _optional("d.update", _has("d.update", "embedded_locations logical_locations total_bytes") + " AND " + _each(
                "d.update.assets", _has("x", "relative_path provider bytes downloaded_sha256 stored_sha256 decrypted"))),
        ]),
    ),
    "summaries": (
        SUMMARY,
        _has("d", "schema_version region platform complete full_catalog input_files catalog_files succeeded failed "
             "output_files output_bytes unity_objects catalog_sha256 payloads retained"),
    ),
    "ledgers": (
        f"schema_version INT, jobs ARRAY<{JOB}>, completions ARRAY<{COMPLETION}>",
        " AND ".join([
            "d.schema_version IN (1, 2)",
            _each("d.jobs", " AND ".join([
                _has("x", "id request status created_at updated_at progress"), _has("x.request", _REQUEST),
                _has("x.progress", "phase completed failed bytes")])),
            _optional("d.completions", _each("d.completions", " AND ".join([
                _has("x", "event pending_targets"), _has("x.event", "schema_version job_id request outcome completed_at"),
                _has("x.event.request", _REQUEST), _LIST.format("x.pending_targets")]))),
        ]),
    ),
}
_MANIFEST = "d.path IS NOT NULL AND d.bytes IS NOT NULL AND d.sha256 IS NOT NULL"


def _parsed(rows: DataFrame, schema: str, required: str) -> DataFrame:
    """``(run, file, value)`` with the parsed ``d`` and ``_good``: well-formed, of the right types, nothing missing."""
    d = F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    good = F.expr(f"d IS NOT NULL AND d._bad IS NULL AND {required}")
    return rows.withColumn("d", d).withColumn("_good", F.coalesce(good, F.lit(False)))


def _whole_files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One row per file; a document is one value, so it is limited to 2 GiB."""
    if isinstance(path, DataFrame):
        return path.select("run", "file", "value")
    return spark.read.text(f"{path}/*/*", wholetext=True).select(run_of(), F.col("_metadata.file_name").alias("file"), "value")


def _documents(spark: SparkSession, path: str | DataFrame, kind: str) -> DataFrame:
    return _parsed(_whole_files(spark, path), *DOCUMENTS[kind]).where("_good").select("run", "d.*").drop("_bad")


def document_violations(spark: SparkSession, path: str | DataFrame, kind: str) -> DataFrame:
    """Files (for ``manifests`` lines) that the reader of their kind leaves out: cut, of a wrong type, or without a
    required field. A caller that must not go on without them passes this to ``require_none``."""
    if kind == "keys":
        rows = _whole_files(spark, path).withColumn("_good", _keys().isNotNull())
    elif kind == "manifests":
        lines = spark.read.text(f"{path}/*/*").select(run_of(), F.col("_metadata.file_name").alias("file"), "value")
        rows = _parsed(lines, ENTRY, _MANIFEST)
    else:
        rows = _parsed(_whole_files(spark, path), *DOCUMENTS[kind])
    return violation(rows.where("NOT _good"), f"bad_{kind}", F.col("file"), F.sha2("value", 256))


def read_locations(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return _documents(spark, path, "locations").select("run", F.inline("locations"))


def _keys() -> Column:
    return F.from_json("value", "MAP<STRING, ARRAY<LONG>>")


def read_keys(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One row per (run, key, id); a key without locations keeps one row with a null id."""
    keys = _whole_files(spark, path).select("run", F.explode(_keys()).alias("key", "ids"))
    return keys.select("run", "key", F.explode_outer("ids").alias("id"))


def read_receipts(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipt heads and received files. Older receipts state no layout; they are of the first one."""
    docs = _documents(spark, path, "receipts")
    heads = docs.select(
        "run", "snapshot.region", "snapshot.platform", "snapshot.resource_version", "snapshot.effective_cdn_root",
        "catalog_url", "bytes", "sha256", F.coalesce("catalog_layout", F.lit("jp")).alias("catalog_layout"),
        "bundle_base_url", "catalog_locale", "update.selection", "update.cache_hits",
        "update.embedded_locations", "update.logical_locations", "update.total_bytes",
    )
    return heads, docs.select("run", F.inline("update.assets"))


def parse_journal(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Journal rows, and violations for lines that are too long or no report. ``lines``: ``(run, value)``."""
    long_line = F.octet_length("value") + 1 > MAX_REPORT
    report = F.from_json("value", f"{REPORT}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("r", F.when(~long_line, report))
    # All but ``cache_hit`` must be there.
    fields = _has("r", "source output_directory source_sha256 objects selected_objects skipped_objects errors")
    rule = f"r IS NOT NULL AND r._bad IS NULL AND {fields} AND {_each('r.outputs', _OUTPUT)} AND {_LIST.format('r.errors')}"
    good = F.coalesce(F.expr(rule), F.lit(False))
    journal = parsed.where(good).select("run", "r.*").drop("_bad")
    journal = journal.withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
    bad = parsed.where(~good)
    return journal, violation(
        bad, F.when(long_line, F.lit("journal_line_too_long")).otherwise(F.lit("journal_line")),
        F.sha2("value", 256), F.octet_length("value"),
    )


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_journal(spark.read.text(f"{path}/*/*").select(run_of(), "value"))


def read_summaries(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return _documents(spark, path, "summaries")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; a place nothing was published to yet gives no rows."""
    try:
        lines = spark.read.text(f"{path}/*/*").select(run_of(), "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"run STRING, {ENTRY}")
    return _parsed(lines, ENTRY, _MANIFEST).where("_good").select("run", "d.*").drop("_bad")


def file_inventory(spark: SparkSession, root: str, digests: bool = True) -> DataFrame:
    """Every file below ``root/<run>/`` with its size and, if asked, SHA-256 and leading bytes.

    Without digests no content is read. One file is one row, so files are limited to 2 GiB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = re.escape(re.sub(r"\A[a-z0-9]+:/*", "/", root).rstrip("/")) + r"/([^/]+)/(.*)\z"
    return files.select(
        F.regexp_extract("path", f"(?s){below}", 1).alias("run"),
        F.regexp_extract("path", f"(?s){below}", 2).alias("path"),
        "length",
        *([F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 8).alias("prefix8")] if digests else []),
    )


def read_ledger(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs in ledger order and undelivered notices (one row per target) of every ledger."""
    docs = _documents(spark, path, "ledgers")
    rows = docs.select("run", F.posexplode("jobs").alias("position", "j"))
    jobs = rows.select(
        "run", F.col("position").cast("long").alias("position"), "j.id", "j.request.*", "j.status", "j.created_at",
        "j.updated_at", "j.progress.phase", "j.progress.completed", "j.progress.failed", "j.progress.total",
        "j.failure", "j.retry_of", "j.outcome", "j.idempotency_sha256",
    )
    events = docs.select("run", F.explode("completions").alias("c")).select(
        "run", F.col("c.event.job_id").alias("job_id"), F.col("c.event.request.region").alias("region"),
        F.col("c.event.completed_at").alias("completed_at"), F.explode("c.pending_targets").alias("identity"),
    )
    return jobs, events


def read_access_log(spark: SparkSession, path: str, form: str = "json") -> tuple[DataFrame, DataFrame]:
    return parse_access(spark.read.text(f"{path}/*/*").select(run_of(), "value"), form)
