"""URL rules, then a list of canonical URLs behind a blocked Bloom filter.

The list becomes a table of 256-bit blocks, six bits per URL in one block, about twelve bits per URL in all.
Rows whose bits are not all set cannot be listed and are done; the others go to an exact join with the list,
which removes the false hits. Everything is column expressions and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.session import materialize, materialize_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, BITS = 4, 6
#: Blocks (40 bytes each as a row) that may be sent to every executor: 5 MB. A larger filter is joined by its key.
SENT_BLOCKS = 1 << 17

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without trailing slashes; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (its text, its verdict), or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _masks(url: Column) -> list[Column]:
    """The block's words with this URL's bits set."""
    second = F.xxhash64(F.lit(1), url)
    places = [F.shiftright(second, 8 * j).bitwiseAND(255) for j in range(BITS)]

    def word(w: int) -> Column:
        bits = [
            F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int")))
            .otherwise(F.lit(0).cast("long"))
            for p in places
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return [word(w) for w in range(WORDS)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), url), F.lit(blocks))


def blocked_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block`` and its words, from the column ``canonical``; blocks without URLs have no row."""
    rows = listed.select(
        _block(F.col("canonical"), blocks).alias("block"),
        *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("canonical")))],
    )
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per row of ``pages`` (``page_id``, ``url``): ``host``, ``path``, ``rule``, ``verdict``, ``listed``.

    ``listed`` has a column ``url``. A rule decides; without one, listed URLs are blocked and others allowed.
    Null URLs and those without ``://`` have an empty host and path and are never listed. Repeated rows are judged
    each. Empty tables: no rows, or nothing listed. Other columns are ignored.
    """
    url = listed["url"]
    wanted = listed.select(canonical(host_of(url), path_of(url)).alias("canonical")).where("canonical != ''").distinct()
    wanted, n = materialize_counted(wanted, "listed-urls")
    blocks = 1 << max(0, (-(-12 * n // (64 * WORDS)) - 1).bit_length())
    bloom = materialize(blocked_filter(wanted, blocks), "url-filter")
    if blocks <= SENT_BLOCKS:
        bloom = F.broadcast(bloom)

    host, path = host_of(pages["url"]), path_of(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "page_id", "host", "path", text.alias("rule"), verdict.alias("_ruled"),
        canonical(F.col("host"), F.col("path")).alias("canonical"),
    ).withColumn("block", _block(F.col("canonical"), blocks))
    all_set = reduce(
        lambda a, b: a & b,
        [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("canonical")))],
    )
    probed = rows.join(bloom, "block", "left").withColumn("maybe", F.coalesce(all_set, F.lit(False)))
    probed = materialize(probed.select("page_id", "host", "path", "rule", "_ruled", "canonical", "maybe"), "probed-urls")
    exact = wanted.withColumn("listed", F.lit(True)).hint("shuffle_hash")
    hits = probed.where("maybe").join(exact, "canonical", "left")
    passed = probed.where("NOT maybe").withColumn("listed", F.lit(False))
    both = hits.select(*passed.columns).unionByName(passed)
    found = F.coalesce("listed", F.lit(False))
    return both.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_ruled", F.when(found, "block").otherwise("allow")).alias("verdict"), found.alias("listed"),
    )
