"""Registered queries: scalar functions over the given texts, names and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake import functions as fn
from assetlake.plans.bound import query
from assetlake.plans.integrity_queries import _DIGEST

_P = "CASE page_id % 6 WHEN 0 THEN regexp_extract(url, '//(.*)$', 1) WHEN 1 THEN 'a/../' || cast(page_id AS {s}) WHEN 2 THEN 'dir/x(1)_' || cast(page_id AS {s}) || '.bin' WHEN 3 THEN '/' || url WHEN 4 THEN 'a//b' ELSE repeat('n', cast(page_id * 3 AS int)) || '/f' END"


def _pages(b, text):
    return b.table("pages").select("page_id", F.expr(text.format(s="string")).alias("p"), "url")


@query(
    "safe_relative",
    f"""WITH q AS (SELECT page_id, {_P.format(s='VARCHAR')} AS p FROM pages) SELECT page_id, regexp_full_match(p, '[A-Za-z0-9._()-]{{1,255}}(/[A-Za-z0-9._()-]{{1,255}})*')
    AND NOT regexp_matches(p, '(^|/)\\.\\.?(/|$)') AND strlen(p) <= 2048 AS ok FROM q""",
)
def _(b):
    return _pages(b, _P).select("page_id", fn.safe_relative(F.col("p")).alias("ok"))


@query(
    "safe_path",
    f"""WITH q AS (SELECT page_id, {_P.format(s='VARCHAR')} AS p FROM pages),
    r AS (SELECT page_id, p, NOT regexp_matches(p, '(^|/)\\.?\\.?(/|$)') AS parts FROM q)
    SELECT page_id, parts AND strlen(p) <= 4096 AND NOT regexp_matches(p, '[\\\\:]') AS listed, parts AND strlen(p) <= 2048 AND NOT regexp_matches(p, '[\\\\:]') AS raw,
    parts AND NOT regexp_matches(p, '[\\\\:]') AS cached, parts AND strlen(p) <= 1024 AND (SELECT max(strlen(x)) FROM (SELECT unnest(string_split(p, '/')) AS x)) <= 255 AS key FROM r""",
)
def _(b):
    p = F.col("p")
    return _pages(b, _P).select(
        "page_id", fn.safe_path(p).alias("listed"), fn.safe_path(p, 2048).alias("raw"), fn.safe_path(p, None, control=False).alias("cached"), fn.valid_key(p).alias("key")
    )


@query("component", "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9._-]{1,256}') AS name_ok, regexp_full_match(p_brand, '[A-Za-z0-9._-]{1,256}') AS brand_ok, true AS type_ok FROM part")
def _(b):
    return b.table("part").select("p_partkey", *[fn.component(F.col(c)).alias(n) for c, n in (("p_name", "name_ok"), ("p_brand", "brand_ok"), ("p_type", "type_ok"))])


_URL = "CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN 'https://h.example' WHEN 2 THEN 'https://h.example/a/../b' WHEN 3 THEN 'https://u@h.example/a' WHEN 4 THEN 'https://h.example:8443/a-b_c.d' WHEN 5 THEN 'http://h.example' WHEN 6 THEN 'https://h.example/a%20b' WHEN 7 THEN 'https://h.example/x y' ELSE 'https://h.example/' END"


@query(
    "cdn_root_ok",
    f"""SELECT page_id, CASE WHEN page_id % 9 IN (1, 4) THEN true WHEN page_id % 9 = 0 THEN starts_with(url, 'https') AND NOT regexp_matches(url, '[?#]') AND NOT ends_with(url, '/') ELSE false END AS ok FROM pages""",
)
def _(b):
    return _pages(b, _URL).select("page_id", fn.cdn_root_ok(F.col("p")).alias("ok"))


@query(
    "public_base_ok",
    f"""SELECT page_id, CASE WHEN page_id % 9 IN (1, 2, 4, 6, 8) THEN true WHEN page_id % 9 = 0 THEN starts_with(url, 'https') AND NOT regexp_matches(url, '[?#]') ELSE false END AS ok FROM pages""",
)
def _(b):
    return _pages(b, _URL).select("page_id", fn.public_base_ok(F.col("p")).alias("ok"))


@query("valid_digest", "SELECT doc_id, doc_id % 5 NOT IN (1, 2, 3) AS ok, doc_id % 5 = 3 AS hex32 FROM documents")
def _(b):
    d = F.expr("CASE doc_id % 5 WHEN 1 THEN upper(sha2(text, 256)) || '' WHEN 2 THEN sha2(text, 256) || '\n' WHEN 3 THEN left(sha2(text, 256), 32) ELSE sha2(text, 256) END")
    rows = b.table("documents").select("doc_id", d.alias("d"))
    return rows.select("doc_id", fn.valid_digest(F.col("d")).alias("ok"), fn.hex32(F.col("d")).alias("hex32"))


@query("catalog_hash", "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN left(sha256(text), 32) END AS hash FROM documents")
def _(b):
    d = F.expr("CASE doc_id % 4 WHEN 0 THEN ' ' || upper(left(sha2(text, 256), 32)) || '\n' WHEN 1 THEN left(sha2(text, 256), 32) WHEN 2 THEN left(sha2(text, 256), 31) ELSE text END")
    return b.table("documents").select("doc_id", fn.catalog_hash(d).alias("hash"))


@query(
    "fix_file_name",
    """WITH t AS (SELECT doc_id, trim(regexp_replace(translate(text, '<>:"/\\|?*#%', '___________'), '[\\x00-\\x1f\\x7f]', '_', 'g')) AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 220 THEN s ELSE left(s, 209) || '__truncated' END AS name FROM t""",
)
def _(b):
    return b.table("documents").select("doc_id", fn.fix_file_name(F.col("text")).alias("name"))


@query("compress_clones", "SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' (Clone)' WHEN 2 THEN '__clone2' ELSE '__clone3' END AS name FROM part")
def _(b):
    tail = F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' (Clone)' WHEN 2 THEN ' (Clone)(Clone)' ELSE '(Clone)(Clone)(Clone)' END")
    return b.table("part").select("p_partkey", fn.compress_clones(F.concat("p_name", tail)).alias("name"))


@query("loose", "SELECT doc_id, lower(regexp_replace(text, '[\\s_-]', '', 'g')) AS loose FROM documents")
def _(b):
    return b.table("documents").select("doc_id", fn.loose(F.col("text")).alias("loose"))


_WORDS = "replace(p_type, 'ARD', 'ard') || CASE p_partkey % 3 WHEN 0 THEN 'LODGroup' WHEN 1 THEN 'Texture2DArray' ELSE 'aBC' END || upper(left(p_name, 2)) || lower(p_brand)"


@query("snake_case", f"SELECT p_partkey, lower(regexp_replace(regexp_replace({_WORDS}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')) AS snake FROM part")
def _(b):
    return b.table("part").select("p_partkey", fn.snake_case(F.expr(_WORDS)).alias("snake"))


_FILES = "CASE page_id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN '.hidden' WHEN 2 THEN 'a.b.c' || cast(page_id AS {s}) WHEN 3 THEN 'ends.' ELSE regexp_extract(url, '([^/]*)$', 1) || '.html' END"


@query(
    "split_ext",
    f"""WITH q AS (SELECT page_id, {_FILES.format(s='VARCHAR')} AS f FROM pages), s AS (SELECT *, regexp_matches(f, '^.+\\.[^.]*$') AS has FROM q),
    t AS (SELECT page_id, CASE WHEN has THEN regexp_extract(f, '^(.+)\\.([^.]*)$', 1) ELSE f END AS stem, CASE WHEN has THEN regexp_extract(f, '^(.+)\\.([^.]*)$', 2) ELSE '' END AS ext FROM s)
    SELECT page_id, stem, ext, stem || '.png' AS png, CASE WHEN ext = '' THEN stem ELSE stem || '.' || ext END AS joined FROM t""",
)
def _(b):
    rows = _pages(b, _FILES)
    stem, ext = fn.split_ext(F.col("p"))
    return rows.select("page_id", stem.alias("stem"), ext.alias("ext"), fn.with_extension(F.col("p"), F.lit("png")).alias("png"), fn.join_ext(stem, ext).alias("joined"))


@query("container_key", "SELECT p_partkey, lower(p_brand || '/' || p_type || '/' || p_name || '.Asset') AS key FROM part")
def _(b):
    return b.table("part").select("p_partkey", fn.container_key(F.array("p_brand", "p_type"), F.concat("p_name", F.lit(".Asset"))).alias("key"))


@query("latency_text", "SELECT event_id, CASE WHEN value * 20 >= 1000 THEN printf('%.2fs', value * 20 / 1000.0) ELSE printf('%.2fms', value * 20) END AS latency FROM events")
def _(b):
    return b.table("events").select("event_id", fn.latency_text(F.col("value") * 20).alias("latency"))


@query(
    "escape_line",
    """SELECT doc_id, replace(replace(replace(replace(replace(text || CASE doc_id % 3 WHEN 0 THEN chr(27) WHEN 1 THEN chr(8232) ELSE '' END, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t'), chr(27), '\\u{1b}'), chr(8232), '\\u{2028}') AS line FROM documents""",
)
def _(b):
    extra = F.expr("CASE doc_id % 3 WHEN 0 THEN chr(27) WHEN 1 THEN ' ' ELSE '' END")
    return b.table("documents").select("doc_id", fn.escape_line(F.concat("text", extra)).alias("line"))


@query("canonical_json", """SELECT event_id, '{"a":[2,1],"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"z":{"b":1,"c":"x"}}' AS canon FROM events""")
def _(b):
    text = F.concat(F.lit('{"z":{"c":"x", "b":1}, "k":'), F.regexp_extract("props", "([0-9]+)", 1), F.lit(', "a":[2,1]}'))
    return b.table("events").select("event_id", fn.canonical_json(text).alias("canon"))


@query("fingerprint", "SELECT doc_id, sha256(to_json({'source': source, 'lang': lang, 'n_chars': n_chars})) AS digest FROM documents")
def _(b):
    return b.table("documents").select("doc_id", fn.fingerprint(F.col("source"), F.col("lang"), F.col("n_chars")).alias("digest"))


@query("empty_mesh", "SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 5 < 3 AND o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 AS empty FROM orders")
def _(b):
    mesh = F.expr(
        """'{"m_VertexData":{"m_VertexCount":' || cast(o_orderkey % 3 as string) || '},"m_IndexBuffer":[' || CASE WHEN o_orderkey % 7 = 0 THEN '1' ELSE '' END
        || '],"m_SubMeshes":[{"indexCount":0,"vertexCount":0},{"indexCount":' || cast(o_orderkey % 2 as string) || ',"vertexCount":0}]'
        || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 3 THEN ',"m_StreamData":{"size":9}' WHEN 4 THEN ',"m_StreamData":{}' ELSE ',"m_StreamData":{"size":0}' END || '}'"""
    )
    return b.table("orders").select("o_orderkey", fn.empty_mesh(mesh).alias("empty"))


@query("multiset_digest", f"SELECT source, {_DIGEST} AS digest FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def _(b):
    rows = b.table("documents").select("source", fn.sha256_text(F.col("text")).alias("h"))
    return rows.groupBy("source").agg(fn.multiset_digest(F.col("h")).alias("digest"))
