"""Labels, patterns, closure and plan conflicts on the small labelled catalog."""

import random

import pytest
from assetlake.operators import planning, selection
from assetlake.violations import ViolationError, require_none
from pyspark.sql import functions as F

PLAIN = "UnityEngine.ResourceManagement.ResourceProviders.AssetBundleProvider"
CRI = "CriWare.Assets.CriResourceProvider"
R = planning.REMOTE_PREFIX
SCHEMA = "run string, id long, primary_key string, internal_id string, provider_id string, dependencies array<long>"


def catalog(spark, rows):
    return spark.createDataFrame([("r", *row) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    locations = catalog(
        spark,
        [(1, "fixture", R + "root.bundle", PLAIN, [2]), (2, "fixture", R + "shared.bundle", PLAIN, []), (3, "fixture", R + "other.bundle", PLAIN, [])],
    )
    keys = spark.createDataFrame(
        [("r", "InitialDownload", 1), ("r", "Everything", 1), ("r", "Everything", 2), ("r", "MV", 3), ("r", "Empty", None)], "run string, key string, id long"
    )
    return locations, keys


@pytest.mark.parametrize(
    "names, expected",
    [(["InitialDownload"], {1, 2}), (["InitialDownload", "Everything", "InitialDownload"], {1, 2}), (["InitialDownload", "MV"], {1, 2, 3}), ([], {1, 2, 3})],
)
def test_labels_close_over_dependencies(labelled, names, expected):
    locations, keys = labelled
    roots, violations = selection.resolve_keys(keys, locations, names)
    require_none(violations)
    assert {r.id for r in selection.closure(roots, locations).collect()} == expected


def test_unknown_and_empty_labels_are_violations(labelled):
    locations, keys = labelled
    _, violations = selection.resolve_keys(keys, locations, ["StartApp", "Empty", "MV"])
    assert sorted(v.key for v in violations.collect()) == ["Empty", "StartApp"]
    with pytest.raises(ViolationError):
        require_none(violations)


def test_excluded_dependency_comes_back_and_priority_orders(labelled, spark):
    locations, keys = labelled
    roots = selection.filter_roots(locations.select("run", "id"), locations, [r"/root\.bundle$"], [r"/shared\.bundle$"])
    chosen = selection.select_locations(selection.closure(roots, locations), locations)
    targets = spark.createDataFrame([("r", "https://c.example/x", None)], "run string, base string, placeholder string")
    assets = planning.plan_assets(planning.resolve_paths(planning.classify_provider(chosen), targets))
    ordered = selection.prioritize(assets, [r"^shared\.bundle$"]).orderBy("rank", "relative_path").collect()
    assert [a.relative_path for a in ordered] == ["shared.bundle", "root.bundle"]


def test_nothing_selected_is_a_violation(labelled):
    locations, _ = labelled
    roots = selection.filter_roots(locations.select("run", "id"), locations, ["^missing$"])
    assert [v.code for v in selection.require_roots(locations, roots).collect()] == ["empty_selection"]


@pytest.mark.parametrize("pattern", [r"(?=x)", r"(a)\1", r"(?<!a)b", "a" * 3000, r"(?>a)", r"(a", r"a)", r"*a", r"[a", r"a{x", r"[a--b]", r"\k<x>"])
def test_unsupported_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        selection.java_pattern(pattern)


def test_dollar_means_the_very_end(spark):
    row = spark.range(1).select(selection.matches_any(["a$"], F.lit("a\n")).alias("nl"), selection.matches_any(["[$]$"], F.lit("x$")).alias("c")).first()
    assert (row.nl, row.c) == (False, True)


@pytest.mark.parametrize(
    "rows, code",
    [
        ([(1, "k", "https://other.example/x", PLAIN, [])], "asset_path"),
        ([(1, "k", R + "../secret", PLAIN, [])], "asset_path"),
        ([(1, "k", R + "%2e%2e/file", PLAIN, [])], "asset_path"),
        ([(1, "k", R + "/evil", PLAIN, [])], "asset_path"),
        ([(1, "k", "{Unknown}/x", PLAIN, [])], "asset_path"),
        ([(1, "k", R + "x?y=1", PLAIN, [])], "asset_path"),
        ([(1, "k", R + "x", "Other", [])], "unknown_provider"),
        ([(1, "k", R + "x", PLAIN, []), (2, "k", R + "x", CRI, [])], "provider_conflict"),
        ([(1, "k", R + "a", PLAIN, []), (2, "k", R + "a/b", PLAIN, [])], "ancestor_conflict"),
        ([(1, "k", R + "A", PLAIN, []), (2, "k", R + "a", PLAIN, [])], "casefold_conflict"),
        ([(1, "k", R + "A", PLAIN, []), (2, "k", R + "a/b", PLAIN, [])], "ancestor_conflict"),
    ],
)
def test_plan_conflicts(spark, rows, code):
    targets = spark.createDataFrame([("r", "https://c.example/x", None)], "run string, base string, placeholder string")
    classified = planning.classify_provider(catalog(spark, rows))
    resolved = planning.resolve_paths(classified, targets)
    assets = planning.plan_assets(resolved)
    found = planning.provider_violations(classified)
    for more in (planning.path_violations(resolved), planning.provider_conflicts(resolved), planning.casefold_conflicts(assets), planning.ancestor_conflicts(assets)):
        found = found.unionByName(more)
    assert {v.code for v in found.collect()} == {code}


def test_runtime_path_is_embedded(spark):
    targets = spark.createDataFrame([("r", "b", None)], "run string, base string, placeholder string")
    classified = planning.classify_provider(catalog(spark, [(1, "k", planning.RUNTIME_PREFIX + "x.bundle", PLAIN, [])]))
    row = planning.plan_counts(classified, planning.resolve_paths(classified, targets)).first()
    assert (row.remote_files, row.embedded_locations, row.logical_locations) == (0, 1, 0)


def test_closure_on_random_graphs(spark):
    rng = random.Random(5)
    rows, expected, roots = [], set(), []
    for run in range(6):
        n = 40
        deps = {i: [rng.randrange(n) for _ in range(rng.randint(0, 2))] for i in range(n)}
        start = rng.sample(range(n), 2)
        seen, todo = set(), list(start)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += deps[x]
        rows += [(f"g{run}", i, "k", "i", "p", d) for i, d in deps.items()]
        roots += [(f"g{run}", s) for s in start]
        expected |= {(f"g{run}", i) for i in seen}
    got = selection.closure(spark.createDataFrame(roots, "run string, id long"), spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.run, r.id) for r in got.collect()) == sorted(expected)


def reach(deps, start):
    seen, todo = set(), list(start)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += deps.get(x, [])
    return seen


def test_labels_travel_as_bits(spark):
    """More labels than a block holds, cycles, and labels that meet again after different numbers of rounds."""
    rng = random.Random(8)
    rows, keys, want = [], [], set()
    for run, labels in (("a", 210), ("b", 3)):
        deps = {i: [rng.randrange(60) for _ in range(rng.randint(0, 2))] for i in range(50)}
        rows += [(run, i, "k", "i", "p", d) for i, d in deps.items()]
        for n in range(labels):
            start = rng.sample(range(50), rng.randint(0, 2))
            keys += [(run, f"k{n}", s) for s in start] or [(run, f"k{n}", None)]
            want |= {(run, f"k{n}", x) for x in reach(deps, start)}
    keys = spark.createDataFrame(keys, "run string, key string, id long")
    labels, reached = selection.label_closure(keys, spark.createDataFrame(rows, SCHEMA))
    of = {(r.run, r.block, r.bit): r.key for r in labels.collect()}
    found = reached.collect()
    got = [(r.run, of[r.run, r.block, b], r.id) for r in found for b in range(64) if r.bits >> b & 1]
    assert sorted(got) == sorted(want)
    assert max(r.block for r in found) == 2


def test_a_round_of_the_closure_moves_neither_edges_nor_what_was_found(spark, monkeypatch):
    plans, add = [], selection.Grown.add

    def spied(self, rows, round_=0):
        if round_:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return add(self, rows, round_)

    monkeypatch.setattr(selection.Grown, "add", spied)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("r", i, "k", "i", "p", [i + 1, i + 2]) for i in range(6)]
        locations = spark.createDataFrame(rows, SCHEMA)
        selection.closure(spark.createDataFrame([("r", 0)], "run string, id long"), locations)
        selection.label_closure(spark.createDataFrame([("r", "a", 0), ("r", "b", 3)], "run string, key string, id long"), locations)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) >= 8
    for plan in plans:
        # What the rows found last lead to is dealt out, and with labels these rows themselves; nothing else.
        labelled = "bit_or" in plan
        assert plan.count("Exchange hashpartitioning") == (2 if labelled else 1), plan
        assert plan.count("Bucketed: true") >= 2


@pytest.mark.parametrize(
    "pattern, text, found",
    [
        (r"(?m)^a$", "b\na\n", True), (r"^a$", "b\na\n", False), (r"a$", "a\n", False), (r"(?P<x_1>a)b", "ab", True),
        (r"^[*+]$", "+", True), (r"^x{2}+$", "xxxx", True), (r"^x{2}+$", "xxx", False), (r"^a++$", "aaa", True),
        (r"a[]$]b", "a]b", True), (r"a[]$]b", "a$b", True), (r"^[^]a]$", "a", False), (r"(?i:A$)", "a", True),
        (r"(?m:a$)\nb$", "a\nb", True), (r"^[[:alpha:]_]+$", "a_b", True), (r"^\p{L}+$", "é", True), (r"^a.b$", "a\rb", True),
    ],
)
def test_patterns_mean_what_they_say(spark, pattern, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(selection.matches_any([pattern], F.col("t"))).first()[0] is found


def test_bad_patterns_fail_before_any_job(spark):
    with pytest.raises(ValueError):
        selection.matches_any([r"\p{Nonsense}"], F.col("t"))
