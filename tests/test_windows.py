"""Chunked running values equal the plain ones, and eviction equals the one-by-one loop."""

import random

from assetlake.operators.incremental import lru_survivors
from assetlake.operators.integrity import tree_digest
from assetlake.operators.ledger import retain
from assetlake.operators.windows import newest, previous, running
from pyspark.sql import functions as F


def rows(n, seed=1):
    rng = random.Random(seed)
    return [("hot" if i % 3 else f"g{i % 7}", i * 7919 % n, rng.randint(1, 9)) for i in range(n)]


def test_running_in_chunks(spark):
    table = rows(800)
    got = running(spark.createDataFrame(table, "g string, o long, v long"), ["g"], [F.col("o").desc()], row_number="n", sums={"s": "v"})
    want, seen = set(), {}
    for g, o, v in sorted(table, key=lambda r: -r[1]):
        n, s = seen.get(g, (0, 0))
        seen[g] = (n + 1, s + v)
        want.add((g, o, v, n + 1, s + v))
    assert {(r.g, r.o, r.v, r.n, r.s) for r in got.collect()} == want


def test_previous_in_chunks(spark):
    table = rows(500, 2)
    got = previous(spark.createDataFrame(table, "g string, o long, v long"), ["g"], [F.col("o")], {"p": "v"})
    want, seen = set(), {}
    for g, o, v in sorted(table, key=lambda r: r[1]):
        want.add((g, o, v, seen.get(g), g not in seen))
        seen[g] = v
    assert {(r.g, r.o, r.v, r.p, r._first) for r in got.collect()} == want


def test_eviction_equals_the_loop(spark):
    rng = random.Random(3)
    table, expected = [], set()
    for cache in range(60):
        entries = {f"i{k}": (rng.randint(0, 6), rng.randint(0, 4)) for k in range(rng.randint(1, 9))}
        table += [(f"c{cache}", i, b, t) for i, (b, t) in entries.items()]
        while entries and (sum(b for b, _ in entries.values()) > 12 or len(entries) > 5):
            del entries[min(entries, key=lambda i: (entries[i][1], i))]
        expected |= {(f"c{cache}", i) for i in entries}
    df = spark.createDataFrame(table, "cache_id string, identity string, bytes long, accessed_at long")
    assert {(r.cache_id, r.identity) for r in lru_survivors(df, 12, 5).collect()} == expected


def test_newest_keeps_the_head(spark):
    table = [*rows(3000), ("hot", None, 1), ("none", None, 2)]
    df = spark.createDataFrame(table, "g string, o long, v long")
    for most, limit in ((40, None), (None, 90), (40, 90), (5000, None)):
        got = [(r.g, r.o, r.v) for r in newest(df, ["g"], "o", most, {} if limit is None else {"v": limit}).collect()]
        for group in {r[0] for r in table}:
            ordered = sorted((r for r in table if r[0] == group), key=lambda r: -1 if r[1] is None else r[1], reverse=True)
            head, total = [], 0
            for n, row in enumerate(ordered):
                total += row[2]
                if (most is None or n < most) and (limit is None or total <= limit):
                    head.append(row)
            kept = sorted((r for r in got if r[0] == group), key=lambda r: -1 if r[1] is None else r[1], reverse=True)
            assert kept[: len(head)] == head and len(kept) <= len(head) + len(ordered) // 500 + 2
    assert newest(df.limit(0), ["g"], "o", 3).count() == 0


def test_retained_jobs(spark):
    table = [("hot" if i % 3 else f"l{i % 5}", f"j{i:04}", i % 97, "queued" if i % 50 == 7 else "completed") for i in range(4000)]
    df = spark.createDataFrame(table, "run string, id string, updated_at long, status string")
    for keep in (3, 1200):
        want = {r[1] for r in table if r[3] == "queued"}
        for run in {r[0] for r in table}:
            done = sorted(((r[2], r[1]) for r in table if r[0] == run and r[3] == "completed"), reverse=True)
            want |= {i for _, i in done[:keep]}
        assert sorted(r.id for r in retain(df, keep).collect()) == sorted(want)
    plan = retain(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and plan.index("Partial") > plan.index("Exchange hashpartitioning")


def test_hash_tree(spark):
    def root(values, parts=3):
        df = spark.createDataFrame([("a", v) for v in values], "g string, v string").repartition(parts)
        (row,) = tree_digest(df.select("g", F.sha2("v", 256).alias("h")), "g", "h").collect()
        return row.rows, row.root

    base = [f"v{i}" for i in range(5000)]
    n, digest = root(base)
    assert n == 5000 and len(digest) == 64 and root(base[::-1], 7) == (n, digest)
    others = [base[1:], [*base, "v7"], [*base[:-1], "other"], [*base[1:], "v1"]]
    assert len({digest, *(root(o)[1] for o in others)}) == 5
    empty = spark.createDataFrame([], "g string, h string")
    assert tree_digest(empty, "g", "h").count() == 0
