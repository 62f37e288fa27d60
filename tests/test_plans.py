"""Large tables are not dealt out by run when they meet a table with a row per run."""

import re

from assetlake.operators import integrity, planning, publication
from assetlake.plans.bound import Bound

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def no_exchange_by_run(df):
    text = plan_of(df)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert not re.search(r"hashpartitioning\(run#\d+, \d+\)", text)


def test_paths_and_locations(spark):
    b = Bound(spark, SMALL)
    targets = b.locations.selectExpr("run", "'base' AS base", "cast(null AS string) AS placeholder").distinct()
    no_exchange_by_run(planning.resolve_paths(planning.classify_provider(b.locations), targets))
    runs = b.entries.selectExpr("run", "'jp' AS region", "'p1' AS publication_id").distinct()
    providers = [{"name": "a", "prefix": "x/{region}", "public_base_url": None, "stable": False}]
    no_exchange_by_run(publication.locations_of(b.entries, runs, providers))


def test_output_rules(spark):
    b = Bound(spark, SMALL)
    modes = b.flat.selectExpr("run", "true AS acb_preserve", "true AS usm_preserve", "'none' AS raw_mode").distinct()
    no_exchange_by_run(integrity.output_rules(b.flat, modes))
