"""URL filter and mixing by hand and against SQL, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assetlake.llm import mixing, queries, url_filter

from .conftest import rows
from .test_documents import judged, linked

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/")]


def test_urls(spark):
    pages = [
        (1, "http://A.Example.ORG/es/1?x"), (2, "http://a.example.org/en"), (3, "https://x.com/de/7#t"), (4, "http://x.com/de"),
        (5, None), (6, "no scheme"), (7, "http://WWW.bad.net/p/"), (8, "https://bad.net/p?q=http://x.org/"), (8, "https://bad.net/p"),
        (9, "http://good.net/p"), (10, "http://notexample.org"), (11, "://"), (12, ""), (None, "http://org/"), (13, "http://xcom/de/"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS listed", "1 AS block")
    listed = spark.createDataFrame([("https://bad.net/p",), ("http://www.bad.net/p#x",), (None,), ("nothing",)], "url string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame, listed, RULES).collect())
    assert got == Counter([
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "a.example.org", "/en", "org/", "allow"),
        (3, "x.com", "/de/7", "com/de/", "block"), (4, "x.com", "/de", None, "allow"), (5, "", "", None, "allow"),
        (6, "", "", None, "allow"), (7, "www.bad.net", "/p/", None, "block"), (8, "bad.net", "/p", None, "block"),
        (8, "bad.net", "/p", None, "block"), (9, "good.net", "/p", None, "allow"), (10, "notexample.org", "", None, "allow"),
        (11, "", "", None, "allow"), (12, "", "", None, "allow"), (None, "org", "/", "org/", "allow"), (13, "xcom", "/de/", None, "allow"),
    ])
    assert url_filter.judge_urls(frame.limit(0), listed, RULES).count() == 0
    assert url_filter.judge_urls(frame, listed.limit(0), RULES).where("listed").count() == 0


@pytest.mark.parametrize("sent", [1 << 17, 0])
def test_filter_loses_no_listed_url(spark, monkeypatch, sent):
    monkeypatch.setattr(url_filter, "SENT_BLOCKS", sent)
    urls = spark.range(5000).selectExpr("id AS page_id", "concat('http://h', id % 7, '.net/', id) AS url")
    got = url_filter.judge_urls(urls, urls.where("page_id % 3 = 0").select("url"), []).where("listed")
    assert got.count() == 1667 and got.where("page_id % 3 != 0").count() == 0


def budgets(spark, leaves, weights, total, epochs=2):
    frame = spark.createDataFrame(leaves, "domain string, lang string, tokens long")
    named = spark.createDataFrame(weights, "level string, name string, weight long")
    from pyspark.sql import functions as F

    out = mixing.budgets(frame, ["domain", "lang"], named, F.lit(total) + 0 * F.sum("tokens"), epochs)
    return {(r.domain, r.lang): r.budget for r in out.collect()}


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "en", 1000), ("a", "de", 10), ("b", "en", 1000), ("b", None, 1000)]
    got = budgets(spark, leaves, [("domain", "a", 3), ("lang", "de", 2)], 800)
    # a: 600 of 800, of which German can give 20 instead of 400; English takes the rest. b: half and half.
    assert got == {("a", "en"): 580, ("a", "de"): 20, ("b", "en"): 100, ("b", None): 100}
    # With all of a used up, b takes what a lacks.
    got = budgets(spark, [("a", "en", 50), ("b", "en", 1000)], [("domain", "a", 9)], 1000)
    assert got == {("a", "en"): 100, ("b", "en"): 900}
    got = budgets(spark, [("a", "en", 5), ("b", "en", 7)], [], 10**6)
    assert got == {("a", "en"): 10, ("b", "en"): 14}
    assert sum(budgets(spark, [("a", str(i), 100 + i) for i in range(7)], [], 1001).values()) == 1001


def con(docs):
    c = duckdb.connect()
    c.register("frame", docs.toArrow())
    c.execute("CREATE VIEW documents AS SELECT * FROM frame")
    return c


def test_mixing_of_odd_rows(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd.dropDuplicates(["doc_id", "text"])), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        stored = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        df = queries.mixing(spark, f"{tmp_path}/{name}")
        got = Counter(map(tuple, df.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken").collect()))
        assert got == Counter(con(stored).execute(queries.ORACLES["op9_mixing"]).fetchall())


@pytest.mark.parametrize("budget", [0, 9, 10, 1505, 4000, 9005, 10_000, 12_005, 19_999, 30_000])
def test_a_prefix_ends_among_rows_of_one_place_and_size(spark, budget):
    """Half of the rows have no id or all the same one; what is taken is the budget to the token."""
    size = "doc_id long, lang string, n_tokens long, note string"
    for shared in (None, 7):
        docs = [(shared, "en", 10, f"n{i % 3}") for i in range(1000)] + [(2000 + i, "en", 10, "x") for i in range(500)]
        sizes = mixing.materialize(spark.createDataFrame(docs, size).repartition(5), "sizes")
        weights = spark.createDataFrame([("lang", "en", 1)], "level string, name string, weight long")
        ended = mixing.ends(sizes, ["lang"], weights, F.lit(budget) + 0 * F.sum("tokens"), 2, 3)
        got = mixing.take(sizes, ["lang"], ended, 3).groupBy().agg(F.sum("taken"), F.count(F.when(F.col("taken") < 10, 1))).first()
        assert (got[0] or 0) == budget and got[1] == (1 if budget % 10 else 0)


@pytest.mark.parametrize("stage", ["mixing", "personal_data", "quality", "near_duplicates"])
def test_stages_keep_columns_of_any_name(spark, odd, stage):
    docs = odd.select("*", F.lit(1).alias("a.b"), F.lit(2).alias("_end_end_at"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns and out.count() > 0
    plain = dict(corpus_pipeline.STAGES)[stage](spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in plain.collect())


def test_pipeline_stage_by_stage(spark, odd, tmp_path, words_file):
    """Each stage on what the one before kept, against a plain version."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        odd.selectExpr("-1000 - doc_id AS doc_id", "text", "lang", "source", "n_chars")
    )
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, given, "").collect()
    plain = judged([(r.doc_id, r.text, r.lang, r.source) for r in given.collect()])
    assert Counter(r.doc_id for r in good) == Counter({k[0]: n for k, n in plain.items() if k[-1]})

    docs = spark.createDataFrame(good, given.schema)
    single = stages["near_duplicates"](spark, docs, "").collect()
    assert Counter(r.doc_id for r in single) == Counter(set(c for _, _, c in linked([(r.doc_id, r.text) for r in good])))

    from assetlake.llm import surrogates

    docs = spark.createDataFrame(single, given.schema)
    safe = stages["personal_data"](spark, docs, "").collect()
    assert docs.columns == given.columns and len(safe) == len(single)
    for old, new in zip(sorted(single), sorted(safe, key=lambda r: r.doc_id), strict=False):
        spans = surrogates.find(old.text)
        want = surrogates.replaced(old.text, [
            {"start": a, "end": b, "kind": k, "made": surrogates.surrogate(queries.KEY, k, g, p, 0)} for a, b, k, g, p in spans
        ])
        assert new.doc_id == old.doc_id and new.text == want and new.n_chars == (len(want) if spans else old.n_chars)

    docs = spark.createDataFrame(safe, given.schema)
    mixed = stages["mixing"](spark, docs, "").collect()
    sql = queries.ORACLES["op9_mixing"].replace("sum(tokens) * 3 // 5", "sum(tokens)")
    assert Counter(r.doc_id for r in mixed) == Counter(r[0] for r in con(docs).execute(sql).fetchall())

    docs = spark.createDataFrame(mixed, given.schema)
    packed = stages["packing"](spark, docs, "").collect()
    from assetlake.llm.vocabulary import load

    lengths = [len(load(words_file).encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed]
    assert sum(r.length for r in packed) == sum(lengths)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)


def test_pipeline_of_no_documents(spark, none, tmp_path):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0


assert rows
