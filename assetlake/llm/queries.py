"""The registered queries of this subpackage and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import configure, materialize, scratch_path, small_batches

CAPACITY = 2_048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.suffix_dedup import removal_report

    return removal_report(table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.token_files import read_token_files, token_digest, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_digest(read_token_files(spark, path))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.token_counts import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > CAPACITY)


def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.best_fit import cut_pieces, pack

    pieces = cut_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 0, CAPACITY)
    with small_batches(spark):
        pieces = materialize(pieces, "pieces")
    return pack(pieces, CAPACITY)


RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: A host with one of these words is listed; its pages' canonical URLs make the list.
LISTED = r"(^|[.-])(adult|bets|casino|spam)([.-]|$)"


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.url_filter import host_of, judge_urls

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    return judge_urls(pages, pages.where(host_of(F.col("url")).rlike(LISTED)).select("url"), RULES)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.quality_rules import report

    return report(table(spark, sf_dir, "documents"))


LEVELS = ("domain", "lang", "source")
WEIGHTS = [
    ("domain", "crawl", 2), ("domain", "reference", 5), ("domain", "forum", 3),
    ("lang", "en", 4), ("lang", "de", 2), ("lang", "es", 2), ("lang", "fr", 2),
]
EPOCHS, SEED = 2, 17


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """The tree's first level: the one large source by itself, the others by the form of their name."""
    source = F.col("source")
    domain = F.when(source == "src0", "crawl").when(source.rlike("^src[0-9]$"), "reference").otherwise("forum")
    return docs.withColumn(name, domain)


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.columns import words
    from assetlake.llm.mixing import ends, take

    docs = with_domain(table(spark, sf_dir, "documents"))
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *LEVELS, F.size(words(F.col("text"))).cast("long").alias("n_tokens")
    )
    sizes = materialize(sizes, "sizes")
    weights = spark.createDataFrame(WEIGHTS, "level string, name string, weight long")
    total = F.call_function("div", F.sum("tokens") * 3, F.lit(5).cast("long"))
    return take(sizes, LEVELS, ends(sizes, LEVELS, weights, total, EPOCHS, SEED), SEED)


#: Stands for a secret that a deployment passes in.
KEY = b"a key for tests"


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.surrogates import pseudonymize

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pseudonymize(docs, KEY)


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.jaccard_join import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


def syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.syncmers import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.simhash_trie import link_by_fingerprint

    return link_by_fingerprint(table(spark, sf_dir, "documents"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlake.llm.source_audit import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup,
    "op2_token_files": token_files,
    "op3_pii_surrogates": pii_surrogates,
    "op4_token_counts": token_counts,
    "op5_url_filter": url_filter,
    "op6_best_fit_packing": best_fit,
    "op7_quality_rules": quality_rules,
    "op8_jaccard_join": jaccard_join,
    "op9_mixing": mixing,
    "op10_syncmer_fingerprints": syncmer_fingerprints,
    "op11_simhash_trie": simhash_trie,
    "op12_vector_codes": vector_codes,
    "op13_source_audit": source_audit,
}

_HOST = "translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _url_sql() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    rule = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in longest)
    return f"""
    WITH u AS (
      SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    c AS (
      SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM u),
    w AS (
      SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{LISTED}') AND canonical <> '')
    SELECT page_id, host, path, CASE {rule} END AS rule,
      coalesce(CASE {verdict} END, CASE WHEN w.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
      w.canonical IS NOT NULL AS listed
    FROM c LEFT JOIN w USING (canonical)
    """


def _quality_sql() -> str:
    from assetlake.llm.quality_rules import LEAST, REACH, RULES as MEASURES

    visible = "[^\\x20\\x09-\\x0D]"
    values = ", ".join(
        f"('{rule}', ({top} * {scale}) // greatest({below}, 1))" for rule, (top, below, scale, *_) in MEASURES.items()
    )
    reach = f"{REACH} * greatest(coalesce(q3 - q1, 0), {LEAST})"
    width = "(1::BIGINT << greatest(length(bin(q3)) - 7, 0)::INT)"
    checks = " AND ".join(
        f"max(CASE WHEN v.rule = '{rule}' THEN v.value <= coalesce(q3 + {width} - 1, 0) + {reach}"
        + (f" AND v.value >= q1 - {reach}" if both else "")
        + " END)"
        for rule, (_, _, _, both, _) in MEASURES.items()
    )
    positive = ", ".join(f"'{rule}'" for rule, (*_, only) in MEASURES.items() if only)
    return f"""
    WITH t AS (
      SELECT doc_id, lang, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{visible}+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{visible}')) AS l
      FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
    g AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
      FROM p WHERE i + 2 <= len(w)),
    r AS (
      SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1)
      GROUP BY 1),
    m AS (
      SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN r ON t.doc_id = r.doc_id),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
    e AS (
      SELECT doc_id, lang, source, base_failed, v.rule, v.value FROM b,
        LATERAL (SELECT * FROM (VALUES {values}) x(rule, value)) v),
    k AS (
      SELECT lang, source, rule, (value >> greatest(length(bin(value)) - 7, 0)::INT)
        << greatest(length(bin(value)) - 7, 0)::INT AS bucket, count(*) AS n
      FROM e WHERE NOT base_failed GROUP BY ALL),
    c AS (
      SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto,
        sum(n) OVER (PARTITION BY lang, source, rule) AS total
      FROM k WHERE bucket > 0 OR rule NOT IN ({positive})),
    q AS (
      SELECT lang, source, rule, min(bucket) FILTER (4 * upto >= total) AS q1,
        min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM c GROUP BY ALL),
    j AS (
      SELECT v.doc_id, {checks} AS inside
      FROM e v LEFT JOIN q ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source
        AND v.rule = q.rule GROUP BY 1)
    SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND coalesce(inside, FALSE) AS kept
    FROM b JOIN j ON b.doc_id = j.doc_id
    """


def _mixing_sql() -> str:
    weights = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in WEIGHTS)
    steps = []
    for n, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: n + 1])
        parent = ", ".join(LEVELS[:n]) or "0"
        up = "root u ON TRUE" if n == 0 else f"b{n - 1} u ON " + " AND ".join(
            f"s.{c} IS NOT DISTINCT FROM u.{c}" for c in LEVELS[:n]
        )
        steps.append(f"""
    s{n} AS (
      SELECT s.*, coalesce(w.weight, 1) AS weight, u.budget AS above,
        s.capacity / coalesce(w.weight, 1) AS rate
      FROM (SELECT {keys}, sum(capacity) AS capacity FROM leaves GROUP BY ALL) s
      LEFT JOIN weights w ON w.level = '{level}' AND w.name IS NOT DISTINCT FROM s.{level} JOIN {up}),
    f{n} AS (
      SELECT *, capacity * sum(weight) OVER (PARTITION BY {parent} ORDER BY rate, {level} NULLS FIRST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= weight * (above - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY rate, {level} NULLS FIRST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM s{n}),
    o{n} AS (
      SELECT *, above - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS rest,
        sum(CASE WHEN filled THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS weights,
        sum(CASE WHEN filled THEN 0 ELSE weight END) OVER (PARTITION BY {parent} ORDER BY rate, {level} NULLS FIRST
          ROWS UNBOUNDED PRECEDING) AS upto FROM f{n}),
    b{n} AS (
      SELECT {keys}, capacity, CASE WHEN filled THEN capacity
        ELSE (rest * upto) // weights - (rest * (upto - weight)) // weights END AS budget FROM o{n})""")
    same_leaf = " AND ".join(f"s.{c} IS NOT DISTINCT FROM p.{c}" for c in LEVELS)
    return f"""
    WITH sizes AS (
      SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '^src[0-9]$') THEN 'reference'
        ELSE 'forum' END AS domain, lang, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
    weights(level, name, weight) AS (VALUES {weights}),
    leaves AS (
      SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {EPOCHS} AS capacity
      FROM sizes GROUP BY ALL HAVING sum(n_tokens) > 0),
    root AS (SELECT least(sum(capacity), sum(tokens) * 3 // 5) AS budget FROM leaves),{",".join(steps)},
    p AS (
      SELECT domain, lang, source, budget // (capacity // {EPOCHS}) AS full_, budget % (capacity // {EPOCHS}) AS rest
      FROM b{len(LEVELS) - 1}),
    d AS (
      SELECT s.*, p.full_, p.rest,
        md5(concat('{SEED}-', p.full_, '-', coalesce(s.doc_id::VARCHAR, ''))) AS place
      FROM sizes s JOIN p ON {same_leaf} WHERE s.n_tokens > 0),
    r AS (
      SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens
        ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM d)
    SELECT doc_id, domain, lang, source, e::BIGINT AS epoch, n_tokens, n_tokens AS taken
    FROM (SELECT *, unnest(range(0, full_::BIGINT)) AS e FROM d)
    UNION ALL
    SELECT doc_id, domain, lang, source, full_::BIGINT, n_tokens, least(n_tokens, rest - before)::BIGINT
    FROM r WHERE before < rest
    """


_PASSAGES = """
    WITH t AS (
      SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    q AS (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM t WHERE n >= 50),
    p AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS passage FROM q),
    f AS (SELECT passage, min(doc_id) AS first FROM p GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    r AS (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new
      FROM p JOIN f ON f.passage = p.passage WHERE first < doc_id),
    k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
    s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 50 AS hi FROM k GROUP BY 1, 2),
    c AS (SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS upto FROM s)
    SELECT t.doc_id, any_value(n) AS n_bytes, coalesce(sum(hi - lo), 0)::BIGINT AS n_removed, count(lo) AS n_spans,
      sha256(unhex(coalesce(substr(any_value(x), 1, 2 * min(lo)) ||
        string_agg(substr(x, 2 * hi + 1, 2 * (coalesce(upto, n) - hi)), '' ORDER BY lo), any_value(x)))) AS kept_sha256
    FROM t LEFT JOIN c ON c.doc_id = t.doc_id GROUP BY 1
    """
_LINKS = """
    WITH RECURSIVE t AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    common AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
    links AS (
      SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
    walk AS (SELECT doc_id, doc_id AS seen FROM t UNION SELECT walk.doc_id, y FROM walk JOIN links ON x = seen)
    SELECT t.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id
    FROM t JOIN walk ON walk.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY 1
    """


def _codes_sql() -> str:
    from assetlake.llm.vector_codes import ENTRIES, PARTS, ROUNDS

    steps = [f"""
    b0 AS (
      SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p
      QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
    d{n} AS (
      SELECT vec_id, part, entry, x, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
      FROM p JOIN b{n} USING (part)),
    a{n} AS (
      SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far, any_value(x) AS x FROM d{n} GROUP BY 1, 2)""")
        if n < ROUNDS:
            steps.append(f"""
    m{n} AS (
      SELECT part, entry, k, floor(sum(x[k])::DOUBLE / count(*))::BIGINT AS v
      FROM a{n}, unnest(range(1, len(x) + 1)) t(k) GROUP BY 1, 2, 3),
    b{n + 1} AS (
      SELECT part, entry, coalesce(any_value(g.e), any_value(b{n}.e)) AS e FROM b{n}
      LEFT JOIN (SELECT part, entry, list(v ORDER BY k) AS e FROM m{n} GROUP BY 1, 2) g USING (part, entry) GROUP BY 1, 2)""")
    return f"""
    WITH v AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (
      SELECT vec_id, part, x[part * (len(x) // {PARTS}) + 1:(part + 1) * (len(x) // {PARTS})] AS x
      FROM v, unnest(range(0, {PARTS})) t(part)),{",".join(steps)},
    h AS (
      SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
    c AS (
      SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
      FROM a{ROUNDS} GROUP BY 1)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM c JOIN v USING (vec_id), h
    """


def _audit_sql() -> str:
    from assetlake.llm.source_audit import LEAST_DOCS, SCALE, TOP

    def far(p: str, q: str) -> str:
        return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

    return f"""
    WITH t AS (
      SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    o AS (
      SELECT lang, source, w, count(*) AS c, count(DISTINCT d) AS docs
      FROM (SELECT d, lang, source, unnest(w) AS w FROM t) GROUP BY ALL),
    k AS (SELECT lang, w, sum(c) AS c FROM o GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
    l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM t),
    s AS (SELECT lang, source, sum(o.c) AS n FROM o SEMI JOIN k USING (lang, w) GROUP BY ALL),
    p AS (
      SELECT g.lang, g.source, k.w, coalesce(o.c, 0) AS c,
        1 + ({SCALE}::HUGEINT * (coalesce(o.c, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
        1 + ({SCALE}::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
      FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.w = k.w),
    f AS (
      SELECT a.lang, a.source, b.source AS item, sum({far('a.p', 'b.p')}) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
    r AS (
      SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
      LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
      UNION ALL
      SELECT lang, source, 'term', w, ({far('p', 'q')})::BIGINT FROM p WHERE c > 0 AND p > q),
    n AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
    SELECT * FROM n WHERE part = 'pair' OR rank <= {TOP}
    """


ORACLES: dict[str, str] = {
    "op1_suffix_dedup": _PASSAGES,
    "op5_url_filter": _url_sql(),
    "op7_quality_rules": _quality_sql(),
    "op8_jaccard_join": _LINKS,
    "op9_mixing": _mixing_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_source_audit": _audit_sql(),
}
