"""Registered queries: integrity, incremental reuse and export reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators import exports, incremental, integrity
from assetlake.plans.bound import Bound, query

NONE = "cast(NULL AS VARCHAR)"


def rules(key: str, checks: dict[str, str], source: str, detail: str = NONE) -> str:
    """One SELECT per rule: rows for which the condition does not hold."""
    return "\nUNION ALL ".join(
        f"SELECT run, '{code}' AS code, cast({key} AS VARCHAR) AS key, cast({detail} AS VARCHAR) AS detail FROM {source} WHERE NOT coalesce({ok}, false)"
        for code, ok in checks.items()
    )


def plan_of(b: Bound):
    """The plan the receipts should follow: one file of twenty is planned otherwise."""
    r = b.receipts
    return (
        r.where("id % 20 <> 3")
        .unionByName(r.where("id % 41 = 3").withColumn("relative_path", F.concat("relative_path", F.lit(".new"))))
        .withColumn("provider", F.when(F.col("id") % 33 == 1, "cri").otherwise(F.col("provider")))
        .select("run", "relative_path", "provider")
    )


def doubled(b: Bound):
    return b.receipts.unionByName(b.receipts.where("id % 77 = 9"))


@query(
    "receipt_vs_plan",
    """WITH plan AS (SELECT run, relative_path, CASE WHEN id % 33 = 1 THEN 'cri' ELSE provider END AS provider FROM receipts WHERE id % 20 <> 3
      UNION ALL SELECT run, relative_path || '.new', CASE WHEN id % 33 = 1 THEN 'cri' ELSE provider END FROM receipts WHERE id % 41 = 3),
    got AS (SELECT run, relative_path, provider, count(*) AS n FROM (SELECT * FROM receipts UNION ALL SELECT * FROM receipts WHERE id % 77 = 9) GROUP BY ALL),
    j AS (SELECT coalesce(p.run, g.run) AS run, coalesce(p.relative_path, g.relative_path) AS path, p.provider AS pp, g.provider AS gp, g.n
      FROM plan p FULL JOIN got g ON g.run = p.run AND g.relative_path = p.relative_path) """
    + rules("path", {"receipt_missing": "n IS NOT NULL", "receipt_unplanned": "pp IS NOT NULL", "receipt_repeated": "coalesce(n, 0) <= 1",
                     "receipt_provider": "pp IS NULL OR gp IS NULL OR pp = gp"}, "j"),
    "receipts",
)
def _(b):
    return integrity.receipt_vs_plan(doubled(b), plan_of(b))


@query(
    "receipt_rules",
    rules("relative_path", {"receipt_bytes": "bytes BETWEEN 1 AND 2147483648", "receipt_decrypted": "NOT decrypted OR provider = 'encrypted_bundle'",
                            "receipt_digest": "decrypted OR stored_sha256 = downloaded_sha256"}, "receipts"),
    "receipts",
)
def _(b):
    return integrity.receipt_rules(b.receipts)


@query(
    "content_check",
    "WITH j AS (SELECT r.*, i.length, i.sha256, i.prefix FROM receipts r LEFT JOIN inventory i ON i.run = r.run AND i.path = r.relative_path) "
    + rules("relative_path", {"file_missing": "length IS NOT NULL", "file_size": "length IS NULL OR length = bytes",
                              "file_digest": "length IS NULL OR sha256 = stored_sha256",
                              "file_signature": "length IS NULL OR NOT (decrypted OR provider = 'unity_bundle') OR prefix = 'UnityFS' || chr(0)"}, "j"),
    "receipts", "inventory",
)
def _(b):
    files = b.inventory.withColumn("prefix8", F.substring(F.col("prefix").cast("binary"), 1, 8))
    return integrity.content_check(b.receipts, files)


@query(
    "receipt_totals",
    "SELECT run, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (decrypted) AS decrypted FROM receipts GROUP BY run",
    "receipts",
)
def _(b):
    return integrity.receipt_totals(b.receipts)


@query(
    "total_violations",
    """SELECT run, 'total_bytes' AS code, run AS key, cast(cast(sum(bytes) AS BIGINT) AS VARCHAR) AS detail FROM receipts GROUP BY run
    HAVING sum(bytes) <> sum(bytes) + CASE WHEN run = 'x1' THEN 1 ELSE 0 END""",
    "receipts",
)
def _(b):
    heads = b.receipts.groupBy("run").agg(F.sum("bytes").alias("total_bytes")).withColumn(
        "total_bytes", F.col("total_bytes") + F.when(F.col("run") == "x1", 1).otherwise(0)
    )
    return integrity.total_violations(b.receipts, heads)


_GRAPH = """SELECT run, sha256(to_json({{'id': id, 'primary_key': primary_key, 'internal_id': {internal}, 'provider_id': provider_id, 'dependencies': dependencies}})) AS h FROM locations"""
_WORDS = " || ',' || ".join(f"cast(sum(cast('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
_DIGEST = f"sha256(cast(count(*) AS VARCHAR) || ',' || {_WORDS})"
_TREE = """c0 AS (SELECT run, count(*) AS rows_, h || ':' || count(*) AS part FROM rows_ GROUP BY run, h),
    c1 AS (SELECT run, sum(rows_) AS rows_, substr(part, 1, 6) || ':' || sha256(string_agg(part, ',' ORDER BY part)) AS part FROM c0 GROUP BY run, substr(part, 1, 6)),
    c2 AS (SELECT run, sum(rows_) AS rows_, substr(part, 1, 3) || ':' || sha256(string_agg(part, ',' ORDER BY part)) AS part FROM c1 GROUP BY run, substr(part, 1, 3))
    SELECT run, cast(sum(rows_) AS BIGINT) AS locations, sha256(string_agg(part, ',' ORDER BY part)) AS graph_sha256 FROM c2 GROUP BY run"""


@query(
    "graph_digest",
    f"WITH rows_ AS ({_GRAPH.format(internal='internal_id')}), {_TREE}",
    "locations",
)
def _(b):
    return integrity.graph_digest(b.locations)


@query(
    "summary_rules",
    rules(
        "run",
        {
            "schema_version": "schema_version = 4", "region": "region = 'jp'", "read_kinds": "kinds_valid", "raw_config": "raw_mode IS NULL OR raw_valid", "retained": "retained", "all_finished": "succeeded + failed = input_files",
            "failed_allowed": "failed <= 2", "complete_flag": "complete = (failed = 0)", "some_succeeded": "succeeded > 0",
            "some_input": "input_files > 0", "input_limit": "input_files <= 100000", "input_in_catalog": "input_files <= catalog_files",
            "some_output": "output_files > 0", "media_full": "NOT full_export OR media_full",
            "raw_not_full": "NOT (full_export AND coalesce(raw_mode, '') = 'only')", "catalog_digest": "regexp_full_match(catalog_sha256, '[0-9a-f]{64}')",
            "full_needs_catalog": "NOT full_export OR full_catalog", "full_needs_native": "NOT full_export OR native_kinds",
            "full_catalog_size": "NOT full_catalog OR input_files = catalog_files",
        },
        "summaries",
    ),
    "summaries",
)
def _(b):
    return integrity.summary_rules(b.summaries, 2)


@query(
    "journal_rules",
    """WITH j AS (SELECT b.*, s.input_files, CASE WHEN regexp_full_match(output_directory, '[0-9]{1,18}') THEN cast(output_directory AS BIGINT) END AS i
      FROM (SELECT *, CASE WHEN regexp_full_match(output_directory, '[0-9]+') THEN output_directory END AS d FROM bad_journal) b JOIN journal_sizes s ON s.run = b.run) """.replace("cast(output_directory AS BIGINT)", "try_cast(output_directory AS BIGINT)")
    + rules("output_directory", {"directory_name": "output_directory = CASE WHEN i < 100000 THEN lpad(cast(i AS VARCHAR), 5, '0') ELSE cast(i AS VARCHAR) END",
                                 "directory_index": "i < input_files", "source_path": "NOT starts_with(source, '../')",
                                 "source_digest": "regexp_full_match(source_sha256, '[0-9a-f]{64}')"}, "j", "source")
    + """
    UNION ALL SELECT run, 'directory_repeated', output_directory, cast(count(*) AS VARCHAR) FROM bad_journal GROUP BY run, output_directory HAVING count(*) > 1
    UNION ALL SELECT run, 'source_repeated', source, cast(count(*) AS VARCHAR) FROM bad_journal GROUP BY run, source HAVING count(*) > 1""",
    "bad_journal", "journal_sizes",
)
def _(b):
    return integrity.journal_rules(b.bad_journal, b.journal_sizes)


def with_errors(df):
    return df.withColumn("errors", F.when(F.col("failed"), F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")))


@query(
    "failure_rules",
    """SELECT run, 'too_many_failed' AS code, run AS key, cast(count(*) AS VARCHAR) AS detail FROM bad_journal WHERE failed GROUP BY run HAVING count(*) > 3
    UNION ALL SELECT run, 'cached_failure', source, NULL FROM bad_journal WHERE failed AND cache_hit""",
    "bad_journal",
)
def _(b):
    return integrity.failure_rules(with_errors(b.bad_journal), 3)


def marked(b: Bound):
    """Outputs with some containers, raw files, bad digests and unsafe paths among them."""
    return b.flat.withColumn(
        "kind",
        F.expr("CASE doc_id % 40 WHEN 1 THEN 'cri_acb_container' WHEN 2 THEN 'cri_usm_container' WHEN 3 THEN 'raw_bundle' ELSE kind END"),
    ).withColumn("path", F.expr("CASE doc_id % 90 WHEN 5 THEN 'x//y' WHEN 6 THEN 'same' WHEN 3 THEN 'raw/' || source ELSE path END")).withColumn(
        "sha256", F.expr("CASE WHEN doc_id % 55 = 6 THEN upper(sha256) WHEN doc_id % 90 = 3 THEN source_sha256 ELSE sha256 END")
    )


_MARKED = """marked AS (SELECT f.* REPLACE (CASE doc_id % 40 WHEN 1 THEN 'cri_acb_container' WHEN 2 THEN 'cri_usm_container' WHEN 3 THEN 'raw_bundle' ELSE kind END AS kind,
  CASE doc_id % 90 WHEN 5 THEN 'x//y' WHEN 6 THEN 'same' WHEN 3 THEN 'raw/' || source ELSE path END AS path,
  CASE WHEN doc_id % 55 = 6 THEN upper(sha256) WHEN doc_id % 90 = 3 THEN source_sha256 ELSE sha256 END AS sha256) FROM flat f)"""


@query(
    "output_rules",
    f"""WITH {_MARKED}, j AS (SELECT m.*, output_directory || '/' || path AS k, t.acb_preserve, t.usm_preserve, t.raw_mode FROM marked m JOIN totals t ON t.run = m.run WHERE NOT m.failed) """
    + rules("k", {"output_path": "path <> 'x//y'", "output_digest": "regexp_full_match(sha256, '[0-9a-f]{64}')",
                  "container_kind": "NOT ((kind = 'cri_acb_container' AND NOT acb_preserve) OR (kind = 'cri_usm_container' AND NOT usm_preserve))",
                  "raw_allowed": "kind <> 'raw_bundle' OR raw_mode IS NOT NULL",
                  "raw_content": "kind <> 'raw_bundle' OR (path = 'raw/' || source AND sha256 = source_sha256 AND class_id IS NULL)"}, "j")
    + """ UNION ALL SELECT run, 'output_repeated', any_value(k), cast(count(*) AS VARCHAR) FROM j GROUP BY run, output_directory, path HAVING count(*) > 1""",
    "flat", "totals",
)
def _(b):
    return integrity.output_rules(marked(b), b.totals)


@query(
    "raw_only_rules",
    """SELECT run, c AS code, source AS key, cast(NULL AS VARCHAR) AS detail FROM (SELECT DISTINCT run, source, resource_index FROM flat WHERE NOT failed AND run = 'x1'), (VALUES ('raw_only_outputs'), ('raw_only_objects')) v(c)
    WHERE resource_index % 6 <> 2""",
    "flat",
)
def _(b):
    tidy = F.col("output_directory").cast("long") % 6 == 2
    journal = b.journal.withColumns(
        {
            "outputs": F.when(tidy, F.slice("outputs", 1, 1)).otherwise(F.concat("outputs", F.slice("outputs", 1, 1))),
            **{c: F.when(tidy, 0).otherwise(F.col(c)) for c in ("objects", "selected_objects", "skipped_objects")},
        }
    )
    modes = journal.select("run").distinct().withColumn("raw_mode", F.when(F.col("run") == "x1", "only"))
    return integrity.raw_only_rules(journal, modes)


@query(
    "exact_tree",
    """WITH tree AS (SELECT run, output_directory, path FROM flat WHERE doc_id % 45 <> 7 UNION ALL SELECT run, output_directory, path || '.tmp' FROM flat WHERE doc_id % 50 = 8),
    ok AS (SELECT * FROM flat WHERE NOT failed), dirs AS (SELECT DISTINCT run, output_directory FROM flat WHERE resource_index % 8 <> 3)
    SELECT run, 'tree_missing' AS code, output_directory || '/' || path AS key, cast(NULL AS VARCHAR) AS detail
      FROM (SELECT run, output_directory, path FROM ok EXCEPT SELECT run, output_directory, path FROM tree)
    UNION ALL SELECT run, 'tree_unlisted', output_directory || '/' || path, NULL FROM (SELECT run, output_directory, path FROM tree EXCEPT SELECT run, output_directory, path FROM ok)
    UNION ALL SELECT run, 'directory_missing', output_directory, NULL FROM (SELECT run, output_directory FROM ok EXCEPT SELECT * FROM dirs)
    UNION ALL SELECT run, 'directory_unlisted', output_directory, NULL FROM (SELECT * FROM dirs EXCEPT SELECT run, output_directory FROM ok)""",
    "flat",
)
def _(b):
    flat = b.flat
    tree = flat.where("doc_id % 45 <> 7").select("run", "output_directory", "path").unionByName(
        flat.where("doc_id % 50 = 8").select("run", "output_directory", F.concat("path", F.lit(".tmp")).alias("path"))
    )
    dirs = flat.where("resource_index % 8 <> 3").select("run", "output_directory").distinct()
    return integrity.exact_tree(flat, tree, b.journal, dirs)


def stated(b: Bound):
    kinds = b.stated_kinds.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("kind", "files"))).alias("payloads"))
    return b.totals.join(kinds, "run")


@query(
    "reconcile",
    """SELECT run, 'total_output_files' AS code, run AS key, cast(NULL AS VARCHAR) AS detail FROM totals WHERE run = 'x1'
    UNION ALL SELECT run, 'total_output_bytes', run, NULL FROM totals WHERE run = 'x2'
    UNION ALL SELECT coalesce(a.run, s.run), 'payload_count', coalesce(a.kind, s.kind), NULL
      FROM (SELECT run, kind, count(*) AS files FROM flat GROUP BY 1, 2) a FULL JOIN stated_kinds s ON s.run = a.run AND s.kind = a.kind WHERE a.files IS DISTINCT FROM s.files""",
    "flat", "totals", "stated_kinds",
)
def _(b):
    return integrity.reconcile(b.journal, stated(b))


@query(
    "verified_inventory",
    """SELECT run, output_directory || '/' || path AS path, bytes, sha256 FROM flat WHERE NOT failed
    UNION ALL SELECT DISTINCT run, 'summary.json', cast(100 AS BIGINT), sha256(run) FROM flat""",
    "flat",
)
def _(b):
    files = b.flat.select("run").distinct().select(
        "run", F.lit("summary.json").alias("path"), F.lit(100).cast("long").alias("bytes"), F.sha2("run", 256).alias("sha256")
    )
    return integrity.verified_inventory(b.flat, files)


@query(
    "changed_between",
    """SELECT coalesce(a.run, c.run) AS run, CASE WHEN c.path IS NULL THEN 'file_removed' WHEN a.path IS NULL THEN 'file_added' ELSE 'file_changed' END AS code,
    coalesce(a.path, c.path) AS key, cast(NULL AS VARCHAR) AS detail
    FROM (SELECT run, relative_path AS path, stored_sha256 AS sha256 FROM receipts) a FULL JOIN inventory c ON c.run = a.run AND c.path = a.path
    WHERE a.sha256 IS DISTINCT FROM c.sha256""",
    "receipts", "inventory",
)
def _(b):
    before = b.receipts.select("run", F.col("relative_path").alias("path"), F.col("stored_sha256").alias("sha256"))
    return integrity.changed_between(before, b.inventory)


@query(
    "plan_in_inventory",
    """SELECT e.run, 'unverified_entry' AS code, e.local AS key, e.path AS detail FROM entries e
    WHERE NOT EXISTS (SELECT 1 FROM previous p WHERE p.run = e.run AND p.local = e.local AND p.bytes = e.bytes AND p.sha256 = e.sha256)""",
    "entries", "previous",
)
def _(b):
    return integrity.plan_in_inventory(b.entries, b.previous.select("run", F.col("local").alias("path"), "bytes", "sha256"))


@query(
    "outcome_consistency",
    "WITH j AS (SELECT run, run AS job_id, platform, region, n FROM snapshots WHERE NOT stale) "
    + rules("job_id", {"outcome_catalog_sha256": "n % 31 <> 2", "outcome_region": "n % 5 <> 1 OR region IS NULL", "outcome_platform": "n % 37 <> 3 OR platform = 'iOS'",
                       "outcome_full_catalog": "n % 3 <> 0"}, "j"),
    "snapshots",
)
def _(b):
    s = b.snapshots.where("NOT stale").withColumn("job_id", F.col("run"))
    verified = s.select("run", "job_id", F.sha2("run", 256).alias("catalog_sha256"), "region", "platform", F.lit(True).alias("full_catalog"))
    exported = s.select(
        "run", "job_id",
        F.expr("CASE WHEN n % 31 = 2 THEN 'x' ELSE sha2(run, 256) END").alias("catalog_sha256"),
        F.expr("CASE WHEN n % 5 = 1 AND region IS NOT NULL THEN 'zz' ELSE region END").alias("region"),
        F.expr("CASE WHEN n % 37 = 3 THEN 'iOS' ELSE platform END").alias("platform"),
        F.expr("n % 3 <> 0").alias("full_catalog"),
    )
    return integrity.outcome_consistency(exported, verified)


_SIGNS = ["556E697479465300FF", "4055544601", "43524944", "C8C3C100", "48434100", "800001", "FF", ""]


@query(
    "classify_signature",
    """SELECT page_id % 8 AS slot, CASE page_id % 8 WHEN 0 THEN 'bundle' WHEN 1 THEN 'utf_table' WHEN 2 THEN 'movie' WHEN 3 THEN 'hca' WHEN 4 THEN 'hca' WHEN 5 THEN 'adx'
      ELSE 'other' END AS family, count(*) AS files FROM pages GROUP BY 1, 2""",
)
def _(b):
    signs = F.array(*[F.lit(s) for s in _SIGNS])
    head = F.unhex(F.get(signs, (F.col("page_id") % 8).cast("int")))
    files = b.table("pages").select(
        (F.col("page_id") % 8).alias("slot"), F.substring(F.concat(head, F.col("html").cast("binary")), 1, 8).alias("prefix8")
    )
    return integrity.classify_signature(files).groupBy("slot", "family").agg(F.count(F.lit(1)).alias("files"))


def media(b: Bound):
    """Orders as media: nested metadata, and probes of what was decoded."""
    return b.spark.sql(f"""
      SELECT 'm' || cast(o_orderkey % 3 as string) AS run, cast(o_orderkey as string) AS resource, o_orderkey AS n, array(
        named_struct('kind', 'video_header', 'data', named_struct('rows', array(
          named_struct('total_frames', o_custkey % 50, 'audio_codec', cast(null as int)),
          named_struct('total_frames', CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 60 END, 'audio_codec', cast(null as int))))),
        named_struct('kind', CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'audio_header' END, 'data', named_struct('rows', array(
          named_struct('total_frames', CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 70 END, 'audio_codec', CASE WHEN o_orderkey % 4 > 0 THEN 2 END))))) AS sections
      FROM parquet.`{b.sf_dir}/orders.parquet`""")


_FACTS = """facts AS (SELECT 'm' || cast(o_orderkey % 3 as VARCHAR) AS run, cast(o_orderkey as VARCHAR) AS resource, o_orderkey AS n,
  CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 70 WHEN o_orderkey % 3 = 0 THEN o_custkey % 60 ELSE o_custkey % 50 END AS declared_frames,
  o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0 AS legacy_audio FROM orders)"""


@query("media_facts", f"WITH {_FACTS} SELECT run, resource, declared_frames, legacy_audio FROM facts")
def _(b):
    from assetlake.operators.relations import media_facts

    return media_facts(media(b))


_PROBES = """SELECT run, resource, 'out/' || resource AS path, CASE n % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'pcm' WHEN 2 THEN 'lossy' ELSE 'lossless' END AS kind,
  CASE WHEN n % 4 = 0 THEN CASE WHEN n % 3 = 1 THEN {frames} END WHEN n % 8 = 2 THEN 4000 + n % 1500 ELSE 4000 END AS decoded_frames,
  CASE WHEN n % 9 = 1 THEN 0 ELSE 16000 END AS pcm_bytes, CASE WHEN n % 11 = 2 THEN 1 ELSE 2 END AS channels, 44100 AS rate, 4000 AS original_frames, 2 AS original_channels,
  CASE WHEN n % 13 = 3 THEN 48000 ELSE 44100 END AS original_rate, 'p' || resource AS pcm_sha256, CASE WHEN n % 17 = 3 THEN 'q' ELSE 'p' || resource END AS original_pcm_sha256 FROM {source}"""


@query(
    "media_conformance",
    f"WITH {_FACTS}, probes AS (SELECT p.*, f.declared_frames FROM ({_PROBES.format(frames='declared_frames', source='facts')}) p JOIN facts f ON f.run = p.run AND f.resource = p.resource) "
    + rules("path", {"video_frames": "kind <> 'video' OR declared_frames = decoded_frames",
                     "pcm_form": "kind <> 'pcm' OR (channels = original_channels AND rate = original_rate AND pcm_bytes = original_frames * channels * 2)",
                     "lossy_form": "kind <> 'lossy' OR (channels = original_channels AND rate = original_rate AND decoded_frames > 0 AND abs(original_frames - decoded_frames) <= 1152)",
                     "lossless_roundtrip": "kind <> 'lossless' OR pcm_sha256 = original_pcm_sha256"}, "probes"),
)
def _(b):
    from assetlake.operators.relations import media_facts

    facts = media_facts(media(b))
    rows = facts.withColumn("n", F.col("resource").cast("long"))
    probes = b.spark.sql(_PROBES.format(frames="declared_frames", source="{rows}"), rows=rows)
    return integrity.media_conformance(facts, probes)


# --- exports ---------------------------------------------------------------------------------------

_WANTED_PATHS = "SELECT run, CASE WHEN id % 9 = 1 THEN relative_path || '.gone' ELSE relative_path END AS relative_path FROM receipts WHERE id % 3 = 1"


@query(
    "filter_resources",
    f"""WITH wanted AS ({_WANTED_PATHS}) SELECT run, relative_path, provider, bytes FROM receipts r WHERE provider <> 'cri'
    AND EXISTS (SELECT 1 FROM wanted w WHERE w.run = r.run AND w.relative_path = r.relative_path)
    AND regexp_matches(relative_path, '^en/|/src1') AND NOT regexp_matches(relative_path, '7\\.bundle$')""",
    "receipts",
)
def _(b):
    paths = b.spark.sql(_WANTED_PATHS.replace("receipts", "{receipts}"), receipts=b.receipts)
    return exports.filter_resources(
        b.receipts, ["unity"], paths, raw_only=True, include=["^en/", "/src1"], exclude=[r"7\.bundle$"]
    ).select("run", "relative_path", "provider", "bytes")


@query(
    "unknown_paths",
    f"""WITH wanted AS ({_WANTED_PATHS}) SELECT run, 'unknown_path' AS code, relative_path AS key, cast(NULL AS VARCHAR) AS detail FROM wanted w
    WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.run = w.run AND r.relative_path = w.relative_path)""",
    "receipts",
)
def _(b):
    paths = b.spark.sql(_WANTED_PATHS.replace("receipts", "{receipts}"), receipts=b.receipts)
    return exports.unknown_paths(b.receipts, paths)


def objects(b: Bound):
    return b.flat.where("class_id IS NOT NULL").withColumn("resource", F.col("source"))


@query(
    "filter_objects",
    """SELECT run, source AS resource, count(*) AS objects, count(*) FILTER (class_id IN (28, 213, 114)) AS selected_objects,
    count(*) FILTER (class_id NOT IN (28, 213, 114)) AS skipped_objects FROM flat WHERE class_id IS NOT NULL GROUP BY 1, 2""",
    "flat",
)
def _(b):
    return exports.filter_objects(objects(b), [28, 213, 114])


_POLICY = {28: "image", 114: "typetree_json", 49: "font", 128: "font", 187: "image_archive", 83: "video"}
_KIND = "CASE class_id WHEN 28 THEN 'image' WHEN 114 THEN 'typetree_json' WHEN 49 THEN 'font' WHEN 128 THEN 'font' WHEN 187 THEN 'image_archive' WHEN 83 THEN 'video' ELSE 'object_raw' END"


@query(
    "apply_policy",
    f"SELECT run, class_id, {_KIND} AS kind, class_id NOT IN (49, 83) AS supported, count(*) AS objects FROM flat WHERE class_id IS NOT NULL GROUP BY ALL",
    "flat",
)
def _(b):
    done = exports.apply_policy(objects(b).drop("kind"), _POLICY, "object_raw")
    return done.groupBy("run", "class_id", "kind", "supported").agg(F.count(F.lit(1)).alias("objects"))


@query(
    "policy_violations",
    f"SELECT run, 'unsupported_kind' AS code, cast(class_id AS VARCHAR) AS key, {_KIND} AS detail FROM flat WHERE class_id IN (49, 83) GROUP BY run, class_id",
    "flat",
)
def _(b):
    return exports.policy_violations(exports.apply_policy(objects(b).drop("kind"), _POLICY, "object_raw"))


_RES = """res AS (SELECT run, resource_index, any_value(failed) AS failed, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes FROM flat GROUP BY 1, 2),
sums AS (SELECT run, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND resource_index % 3 = 0) AS cache_hits,
  cast(sum(files) AS BIGINT) AS output_files, cast(sum(bytes) AS BIGINT) AS output_bytes, cast(sum(files) AS BIGINT) AS unity_objects,
  cast(sum(files) - count(*) AS BIGINT) AS selected_unity_objects, count(*) AS skipped_unity_objects FROM res GROUP BY run)"""


@query("export_totals", f"WITH {_RES} SELECT * FROM sums", "flat")
def _(b):
    return exports.export_totals(b.journal)


@query(
    "summarize",
    f"""WITH {_RES}, k AS (SELECT run, string_agg(kind || '=' || cast(n AS VARCHAR), ';' ORDER BY kind) AS kinds FROM (SELECT run, kind, count(*) AS n FROM flat GROUP BY 1, 2) GROUP BY 1)
    SELECT s.*, k.kinds FROM sums s JOIN k ON k.run = s.run""",
    "flat",
)
def _(b):
    text = F.array_join(F.transform(F.map_entries("payloads"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return exports.summarize(b.journal).withColumn("kinds", text).drop("payloads")


@query("payload_counts", "SELECT run, kind, count(*) AS files FROM flat GROUP BY 1, 2", "flat")
def _(b):
    return exports.payload_counts(b.journal)


@query(
    "completeness",
    f"""WITH {_RES} SELECT s.run, s.run <> 'x1' AS full_catalog, s.run <> 'x1' AS full_export, s.failed = 0 AND s.output_files > 0 AS complete FROM sums s""",
    "flat",
)
def _(b):
    journal = b.journal
    scope = journal.groupBy("run").agg(F.count(F.lit(1)).alias("input_files")).withColumns(
        {"catalog_files": F.col("input_files") + F.when(F.col("run") == "x1", 1).otherwise(0), "complete_selection": F.lit(True)}
    )
    return exports.completeness(exports.export_totals(journal), scope)


@query(
    "partial_decision",
    """SELECT run, failed, CASE WHEN failed > 0 AND failed <= 2 AND succeeded > 0 AND succeeded + failed = input_files AND output_files > 0 THEN 'partial'
    WHEN complete AND failed = 0 THEN 'complete' ELSE 'rejected' END AS decision FROM summaries""",
    "summaries",
)
def _(b):
    return exports.partial_decision(b.summaries, [5, 2, 9])


@query(
    "resource_budget",
    """WITH t AS (SELECT run, output_directory, position, cast(sum(bytes) OVER (PARTITION BY run, output_directory ORDER BY position) AS BIGINT) AS total FROM flat),
    f AS (SELECT run, output_directory, min(position) AS position, arg_min(total, position) AS total FROM t WHERE total > 9000 GROUP BY 1, 2)
    SELECT run, 'resource_too_large' AS code, output_directory || ':' || cast(position AS VARCHAR) AS key, cast(total AS VARCHAR) AS detail FROM f""",
    "flat",
)
def _(b):
    return exports.resource_budget(b.flat, 9000)


@query(
    "classify_failures",
    """SELECT run, CASE WHEN resource_index % 2 = 0 THEN 'transient' ELSE 'final' END AS failure_class, count(DISTINCT resource_index) AS errors FROM flat WHERE failed GROUP BY 1, 2""",
    "flat",
)
def _(b):
    return exports.classify_failures(b.journal)


@query(
    "expected_renditions",
    """WITH o AS (SELECT 'm' || cast(o_orderkey % 3 AS VARCHAR) AS run, o_orderkey AS object_id, CASE o_orderkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'hca' ELSE 'video' END AS media FROM orders),
    f(media, kind) AS (VALUES ('image', 'image_png'), ('image', 'image_webp'), ('hca', 'hca_mp3'), ('hca', 'hca_wav'), ('video', 'usm_mp4'), ('video', 'usm_mkv'))
    SELECT run, 'rendition_missing' AS code, cast(object_id AS VARCHAR) AS key, kind AS detail FROM o JOIN f ON f.media = o.media
    WHERE NOT (object_id % 7 > 1 OR (object_id % 7 = 1 AND kind NOT IN ('image_webp', 'hca_wav', 'usm_mkv')))""",
)
def _(b):
    o = b.table("orders").select(
        F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("run"), F.col("o_orderkey").alias("object_id"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'hca' ELSE 'video' END").alias("media"),
    )
    kinds = exports.expected_kinds(["png", "webp"], ["mp3"], "mkv_and_mp4")
    have = F.expr(
        "CASE WHEN object_id % 7 > 1 THEN CASE media WHEN 'image' THEN array('image_png','image_webp') WHEN 'hca' THEN array('hca_mp3','hca_wav') ELSE array('usm_mp4','usm_mkv') END"
        " WHEN object_id % 7 = 1 THEN CASE media WHEN 'image' THEN array('image_png') WHEN 'hca' THEN array('hca_mp3') ELSE array('usm_mp4') END END"
    )
    actual = o.select("run", "object_id", F.explode(have).alias("kind"))
    return exports.expected_renditions(o, actual, kinds)


# --- incremental -----------------------------------------------------------------------------------

_TAG = "CASE provider WHEN 'encrypted_bundle' THEN 'encrypted' WHEN 'unity_bundle' THEN 'unity' ELSE 'cri' END"


def scoped(b: Bound):
    return b.receipts.withColumns(
        {"region": F.lit("jp"), "environment": F.lit("release"), "platform": F.lit("iOS"),
         "catalog_url": F.concat(F.lit("https://c.example/"), "run"), "catalog_sha256": F.sha2("run", 256)}
    )


@query(
    "download_identity",
    f"""SELECT run, relative_path, sha256('jp:release:iOS:https://c.example/' || run || chr(0) || sha256(run) || chr(0) || relative_path || chr(0) || {_TAG} || chr(0)) AS identity FROM receipts""",
    "receipts",
)
def _(b):
    return incremental.download_identity(scoped(b)).select("run", "relative_path", "identity")


def dependencies(b: Bound):
    """Each file depends on the files at half and a third of its number."""
    r = b.receipts.select("run", "relative_path", "id")
    need = r.select("run", F.col("relative_path").alias("owner"), "id", F.explode(F.array(F.expr("id div 6 * 3 + id % 3"), F.expr("id div 9 * 3 + id % 3"))).alias("need"))
    found = r.select("run", F.col("id").alias("need"), F.col("relative_path").alias("dependency"))
    return need.join(found, ["run", "need"]).where("owner <> dependency").select("run", "owner", "dependency").distinct()


_DEPS = """deps AS (SELECT DISTINCT o.run, o.relative_path AS owner, r.relative_path AS dependency FROM
  (SELECT run, relative_path, id, unnest([id // 6 * 3 + id % 3, id // 9 * 3 + id % 3]) AS need FROM receipts) o
  JOIN receipts r ON r.run = o.run AND r.id = o.need WHERE r.relative_path <> o.relative_path)"""
_IDENT = f"""{_DEPS}, h AS (SELECT d.run, d.owner, sha256(to_json({{'dependency': d.dependency, 'sha': r.stored_sha256}})) AS h FROM deps d JOIN receipts r ON r.run = d.run AND r.relative_path = d.dependency),
dd AS (SELECT run, owner, {_DIGEST} AS dependency_sha256 FROM h GROUP BY 1, 2),
ids AS (SELECT r.*, coalesce(dd.dependency_sha256, '') AS dependency_sha256,
  sha256(to_json({{'scope': 's', 'relative_path': relative_path, 'provider': provider, 'stored_sha256': stored_sha256, 'decrypted': decrypted}})) AS own_sha256
  FROM receipts r LEFT JOIN dd ON dd.run = r.run AND dd.owner = r.relative_path)"""


@query(
    "content_identity",
    f"WITH {_IDENT} SELECT run, relative_path, own_sha256, dependency_sha256, sha256(own_sha256 || dependency_sha256) AS identity FROM ids",
    "receipts",
)
def _(b):
    return incremental.content_identity(b.receipts, dependencies(b), "s").select(
        "run", "relative_path", "own_sha256", "dependency_sha256", "identity"
    )


@query(
    "dependency_violations",
    f"""WITH {_DEPS} SELECT run, 'dependency_not_received' AS code, dependency AS key, owner AS detail FROM deps
    WHERE dependency IN (SELECT relative_path FROM receipts WHERE id % 14 = 3)""",
    "receipts",
)
def _(b):
    return incremental.dependency_violations(b.receipts.where("id % 14 <> 3"), dependencies(b))


def cache_index(b: Bound):
    return b.spark.sql(
        """SELECT run AS cache_id, stored_sha256 AS identity, CASE WHEN id % 21 = 1 THEN 2 ELSE 1 END AS schema,
        CASE WHEN id % 23 = 2 THEN 'other' ELSE stored_sha256 END AS entry_identity, CASE WHEN id % 25 = 3 THEN 1 ELSE 0 END AS errors,
        sha2('r' || id, 256) AS report_sha256, CASE WHEN id % 27 = 4 THEN 'x' ELSE sha2('r' || id, 256) END AS actual_sha256, bytes,
        timestamp_micros(id * 7919 % 1000) AS accessed_at, id FROM {r} WHERE id % 3 <> 1""",
        r=b.receipts.groupBy("stored_sha256").agg(F.min(F.struct("id", "run", "bytes")).alias("s")).select("stored_sha256", "s.*"),
    )


_INDEX = """idx AS (SELECT arg_min(run, id) AS cache_id, stored_sha256 AS identity, min(id) AS id, arg_min(bytes, id) AS bytes FROM receipts GROUP BY stored_sha256 HAVING min(id) % 3 <> 1)"""


@query(
    "cache_plan",
    f"""WITH {_INDEX} SELECT r.run, r.relative_path, r.stored_sha256 AS identity,
    CASE WHEN i.id IS NULL THEN 'miss' WHEN i.id % 21 <> 1 AND i.id % 23 <> 2 AND i.id % 25 <> 3 AND i.id % 27 <> 4 AND i.bytes BETWEEN 1 AND 9000 THEN 'hit' ELSE 'invalid' END AS status,
    CASE WHEN i.id % 21 <> 1 AND i.id % 23 <> 2 AND i.id % 25 <> 3 AND i.id % 27 <> 4 AND i.bytes BETWEEN 1 AND 9000 THEN i.bytes END AS cached_bytes
    FROM receipts r LEFT JOIN idx i ON i.identity = r.stored_sha256""",
    "receipts",
)
def _(b):
    wanted = b.receipts.select("run", "relative_path", F.col("stored_sha256").alias("identity"))
    return incremental.cache_plan(wanted, cache_index(b), 9000)


@query(
    "lru_survivors",
    f"""WITH {_INDEX}, w AS (SELECT *, row_number() OVER o AS n, sum(bytes) OVER o AS total FROM idx WINDOW o AS (PARTITION BY cache_id ORDER BY id * 7919 % 1000 DESC, identity DESC ROWS UNBOUNDED PRECEDING))
    SELECT cache_id, identity, bytes FROM w WHERE total <= 150000 AND n <= 120""",
    "receipts",
)
def _(b):
    return incremental.lru_survivors(cache_index(b), 150_000, 120).select("cache_id", "identity", "bytes")


@query("admit", f"WITH {_INDEX} SELECT cache_id, identity, bytes FROM idx WHERE bytes <= 1500", "receipts")
def _(b):
    return incremental.admit(cache_index(b), 1500).select("cache_id", "identity", "bytes")


@query(
    "reuse_report",
    f"""WITH {_DEPS}, a AS (SELECT run, relative_path, stored_sha256 AS s, bytes FROM receipts WHERE id % 30 <> 4),
    z AS (SELECT run, relative_path, CASE WHEN id % 19 = 2 THEN sha256('new' || stored_sha256) ELSE stored_sha256 END AS s, bytes FROM receipts WHERE id % 30 <> 5),
    touched AS (SELECT DISTINCT d.run, d.owner FROM deps d LEFT JOIN a ON a.run = d.run AND a.relative_path = d.dependency LEFT JOIN z ON z.run = d.run AND z.relative_path = d.dependency WHERE a.s IS DISTINCT FROM z.s),
    j AS (SELECT coalesce(a.run, z.run) AS run, coalesce(a.relative_path, z.relative_path) AS p, a.s AS sa, z.s AS sz, coalesce(z.bytes, a.bytes) AS bytes
      FROM a FULL JOIN z ON z.run = a.run AND z.relative_path = a.relative_path),
    c AS (SELECT j.*, CASE WHEN sa IS NULL THEN 'added' WHEN sz IS NULL THEN 'removed' WHEN sa <> sz THEN 'changed' WHEN t.owner IS NOT NULL THEN 'dependency_only' ELSE 'reused' END AS reason
      FROM j LEFT JOIN touched t ON t.run = j.run AND t.owner = j.p)
    SELECT run, reason, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY 1, 2""",
    "receipts",
)
def _(b):
    deps = dependencies(b)
    before = b.receipts.where("id % 30 <> 4")
    after = b.receipts.where("id % 30 <> 5").withColumn(
        "stored_sha256", F.expr("CASE WHEN id % 19 = 2 THEN sha2('new' || stored_sha256, 256) ELSE stored_sha256 END")
    )
    return incremental.reuse_report(
        incremental.content_identity(before, deps, "s"), incremental.content_identity(after, deps, "s")
    )
