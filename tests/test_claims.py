"""Claiming keys against the sequential rule, including components mixing real and generated ``__dupN``."""

import random

import pytest
from assetlake.operators.claims import claim_keys

SCHEMA = "run string, key string, resource_index long, position long, alias long, bytes long, sha256 string, source string"


def split_ext(name):
    at = name.rfind(".")
    return (name, "") if at <= 0 else (name[:at], name[at + 1 :])


def sequential(rows):
    """The rule as stated: first free name, or the name already holding this content."""
    held, entries, deduplicated, renamed = {}, {}, 0, 0
    for key, content in rows:
        n = 1
        while True:
            if n == 1:
                name = key
            else:
                folder, slash, file = key.rpartition("/")
                stem, ext = split_ext(file)
                name = folder + slash + f"{stem}__dup{n}" + (f".{ext}" if ext else "")
            owner = held.get(name.lower())
            if owner is None:
                held[name.lower()] = content
                entries[name] = content
                renamed += n > 1
                break
            if owner == content:
                deduplicated += 1
                break
            n += 1
    return entries, deduplicated, renamed


KEYS = ["a.json", "A.json", "a__dup2.json", "a__dup3.json", "a__dup2__dup2.json", "a__DUP2.json", "a__dup02.json", "d/a", "d/a__dup2", ".x", ".x__dup2"]


def cases(seed, runs, length, contents):
    rng = random.Random(seed)
    rows, expected = [], {}
    for r in range(runs):
        keys = rng.sample(KEYS, rng.randint(1, 5))
        seq = [(rng.choice(keys), f"c{rng.randint(0, contents)}") for _ in range(rng.randint(1, length))]
        expected[f"r{r}"] = sequential(seq)
        rows += [(f"r{r}", k, i // 3, i % 3, 0, 1, c, "s") for i, (k, c) in enumerate(seq)]
    return rows, expected


def compare(spark, rows, expected):
    entries, counts = claim_keys(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for e in entries.collect():
        assert e.path not in got.setdefault(e.run, {})
        got[e.run][e.path] = e.sha256
    tallies = {c.run: (c.deduplicated, c.renamed) for c in counts.collect()}
    for run, (wanted, deduplicated, renamed) in expected.items():
        assert got[run] == wanted, (run, got[run], wanted)
        assert tallies[run] == (deduplicated, renamed)


def test_small_components(spark):
    compare(spark, *cases(1, 300, 14, 6))


def test_large_components(spark):
    compare(spark, *cases(3, 3, 60, 30))


def test_one_hot_key_is_numbered_in_chunks(spark):
    rows = [("r", "same.png", i // 7, i % 7, 0, 1, f"c{i * 37 % 900}", "s") for i in range(2000)]
    seq = [(r[1], r[6]) for r in rows]
    compare(spark, rows, {"r": sequential(seq)})


@pytest.mark.parametrize("lowercase", [True, False])
def test_known_example(spark, lowercase):
    keys = ["Same.json", "Same.json", "Same.json", "SAME.json"]
    rows = [("r", k.lower() if lowercase else k, 0, i, 0, 1, c, "s") for i, (k, c) in enumerate(zip(keys, "aabc"))]
    entries, counts = claim_keys(spark.createDataFrame(rows, SCHEMA))
    paths = sorted(e.path for e in entries.collect())
    assert paths == (["same.json", "same__dup2.json", "same__dup3.json"] if lowercase else ["SAME__dup3.json", "Same.json", "Same__dup2.json"])
    assert [(c.deduplicated, c.renamed) for c in counts.collect()] == [(1, 2)]
