"""Access and application logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions.binding import let
from assetlake.functions import escape_line, ip_hex, ip_text, in_networks, latency_text
from assetlake.operators.windows import previous

ACCESS_SCHEMA = (
    "timestamp STRING, request_id STRING, method STRING, route STRING, peer_ip STRING, client_ip STRING, "
    "status INT, outcome STRING, duration_ms LONG, queue_dropped_records LONG"
)
_TEXT_LINE = (
    r"\A(\S+) id=(\S+) peer=(\S+) client=(\S+) method=(\S+) route=\"((?:[^\"\\]|\\.)*)\" "
    r"status=(\S+) outcome=(\S+) duration_ms=(\d+) queue_dropped_records=(\d+)\z"
)
# Fixed values.
METHODS = ["GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "CONNECT", "TRACE"]
UNMATCHED = "<unmatched>"
LEVELS = ["off", "error", "warn", "info", "debug", "trace"]
FIELDS = [
    "message", "event", "stage", "region", "job_id", "status", "error_code", "completed", "failed",
    "total", "bytes", "cache_hits", "listen", "operation", "attempt",
]
MAX_HOPS = 32
MAX_HEADER = 4096
MAX_FIELD = 1024


def parse_access(lines: DataFrame, form: str = "json") -> tuple[DataFrame, DataFrame]:
    """Records and the lines that are none. ``lines``: ``(run, value)``."""
    if form == "json":
        rec = F.from_json("value", ACCESS_SCHEMA)
        parsed = lines.withColumn("r", F.when(F.try_parse_json("value").isNotNull(), rec))
        parsed = parsed.withColumn("r", F.when(F.col("r.request_id").isNotNull() & F.col("r.timestamp").isNotNull(), F.col("r")))
    elif form == "text":
        marked = F.regexp_replace("value", _TEXT_LINE, "\x00".join(f"${i}" for i in range(1, 11)))
        fields = F.when(F.col("value").rlike(_TEXT_LINE), F.split(marked, "\x00"))
        parsed = lines.withColumn("f", fields)
        part = [F.get("f", F.lit(i)) for i in range(10)]

        def dash(c: Column) -> Column:
            return F.when(c != "-", c)

        route = F.replace(F.replace(part[5], F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
        rec = F.struct(
            part[0].alias("timestamp"), part[1].alias("request_id"), part[4].alias("method"), route.alias("route"),
            dash(part[2]).alias("peer_ip"), dash(part[3]).alias("client_ip"), dash(part[6]).cast("int").alias("status"),
            part[7].alias("outcome"), part[8].cast("long").alias("duration_ms"), part[9].cast("long").alias("queue_dropped_records"),
        )
        parsed = parsed.withColumn("r", F.when(F.col("f").isNotNull(), rec))
    else:
        raise ValueError(f"unknown log form {form!r}")
    good = parsed.where(F.col("r").isNotNull()).select("run", "r.*").withColumn(
        "timestamp", F.try_to_timestamp("timestamp")
    )
    return good, parsed.where(F.col("r").isNull()).select("run", "value")


def client_address(peer: Column, forwarded: Column, trusted: Sequence[str]) -> Column:
    """Address of the client behind trusted hops, walking the forwarded list from its end.

    The result is the first hop that is not trusted, else the last one. A malformed or oversized list,
    or an untrusted peer, leaves the peer.
    """
    hops = F.transform(F.split(forwarded, ","), lambda p: ip_hex(F.regexp_replace(p, r"(?U)\A\s+|\s+\z", "")))
    readable = (F.octet_length(forwarded) <= MAX_HEADER) & forwarded.rlike(r"\A[\x20-\x7e\t]*\z")

    def walk(x: Column) -> Column:
        good = F.coalesce((F.size(x["hops"]) <= MAX_HOPS) & ~F.exists(x["hops"], lambda h: h.isNull()), F.lit(False))
        chain = F.when(good, F.concat(F.array(x["peer"]), F.reverse(x["hops"]))).otherwise(F.array(x["peer"]))
        return let(
            chain,
            lambda c: F.coalesce(F.get(F.filter(c, lambda h: ~in_networks(h, trusted)), F.lit(0)), F.element_at(c, -1)),
        )

    start = F.struct(ip_hex(peer).alias("peer"), F.when(readable, hops).alias("hops"))
    return ip_text(let(start, walk))


def client_ip(df: DataFrame, trusted: Sequence[str], header: str = "forwarded") -> DataFrame:
    return df.withColumn("client_ip", client_address(F.col("peer_ip"), F.col(header), trusted))


def normalize_access(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "method": F.when(F.col("method").isin(METHODS), F.col("method")).otherwise(F.lit("OTHER")),
            "route": F.coalesce("route", F.lit(UNMATCHED)),
            "peer_ip": ip_text(ip_hex(F.col("peer_ip"))),
        }
    )


# The placeholders of a template, their columns, and which show "-" when there is no value.
_PLACEHOLDERS = {
    "time": "timestamp", "status": "status", "method": "method", "path": "route", "route": "route",
    "latency": "", "request_id": "request_id", "peer_ip": "peer_ip", "client_ip": "client_ip",
    "outcome": "outcome", "duration_ms": "duration_ms", "queue_dropped_records": "queue_dropped_records",
}
_DASHED = ["status", "peer_ip", "client_ip"]


def render_line(template: str) -> Column:
    """A template such as ``${method} ${path} ${latency}`` as one expression over the access columns.

    Latency comes from ``elapsed_ms`` (fractional milliseconds). A bad template is refused.
    """
    text = template[:-1] if template.endswith("\n") else template
    if not text or len(text.encode()) > 1024 or re.search("[\x00-\x1f\x7f-\x9f\u2028\u2029]", text):
        raise ValueError("bad template")
    parts: list[Column] = []
    at = 0
    while (start := text.find("${", at)) >= 0:
        end = text.find("}", start)
        name = text[start + 2 : end] if end >= 0 else ""
        if name not in _PLACEHOLDERS:
            raise ValueError(f"bad placeholder in {template!r}")
        if start > at:
            parts.append(F.lit(text[at:start]))
        if name == "latency":
            value = latency_text(F.col("elapsed_ms"))
        else:
            value = F.col(_PLACEHOLDERS[name]).cast("string")
            if name in _DASHED:
                value = F.coalesce(value, F.lit("-"))
        parts.append(escape_line(value))
        at = end + 1
    if at < len(text):
        parts.append(F.lit(text[at:]))
    return F.concat(*parts)


def render(df: DataFrame, template: str) -> DataFrame:
    return df.withColumn("line", render_line(template))


def parse_levels(spec: str, app: str | None = None) -> tuple[str, list[tuple[str, str]]]:
    """``default[,target=level...]`` as the default and the target rules, longest first."""
    if len(spec) > 1024:
        raise ValueError("level specification too long")
    default, *items = spec.split(",")
    rules: dict[str, str] = {}
    for item in items:
        target, eq, level = item.partition("=")
        known = app is None or target == app or target.startswith(app + "::")
        if not eq or level not in LEVELS or not known or target in rules or len(rules) == 64 or not re.fullmatch(r"[A-Za-z0-9_:]+", target):
            raise ValueError(f"bad level rule {item!r}")
        rules[target] = level
    if default not in LEVELS:
        raise ValueError(f"bad level {default!r}")
    return default, sorted(rules.items(), key=lambda r: -len(r[0]))


def accepted_level(target: Column, spec: str, app: str | None = None) -> Column:
    default, rules = parse_levels(spec, app)
    out = F.lit(default)
    for name, level in reversed(rules):
        out = F.when((target == name) | target.startswith(name + "::"), F.lit(level)).otherwise(out)
    return out


def filter_levels(df: DataFrame, spec: str, app: str | None = None) -> DataFrame:
    """Keep records whose level the most specific rule for their target accepts."""
    order = F.array(*[F.lit(x) for x in LEVELS])
    wanted = F.array_position(order, accepted_level(F.col("target"), spec, app))
    return df.where(F.array_position(order, F.lower("level")).between(2, wanted))


def bounded_text(c: Column, limit: int = MAX_FIELD) -> Column:
    """At most ``limit`` bytes, cut between characters."""
    raw = c.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, limit - i).cast("string")) for i in range(4)]
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*cuts))


def permit_fields(df: DataFrame) -> DataFrame:
    allowed = F.map_filter("fields", lambda k, v: k.isin(FIELDS))
    return df.withColumn("fields", F.transform_values(allowed, lambda k, v: bounded_text(v)))


def rotation_period(ts: Column, period: str) -> Column:
    return {
        "hourly": F.date_format(ts, "yyyy-MM-dd-HH"),
        "daily": F.date_format(ts, "yyyy-MM-dd"),
        "never": F.lit("all"),
    }[period]


def rotate(df: DataFrame, period: str = "daily", keep: int | None = None) -> DataFrame:
    """Add the UTC ``period`` partition and keep the newest ``keep`` of each run.

    The ranking sees one row per (run, period), not the records.
    """
    df = df.withColumn("period", rotation_period(F.col("timestamp"), period))
    if keep is None:
        return df
    periods = df.select("run", "period").distinct()
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.col("period").desc()))
    kept = periods.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    return df.join(kept, ["run", "period"], "left_semi")


def access_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("run", "route", "method", "outcome", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("duration_ms").alias("duration_ms"), F.max("duration_ms").alias("slowest_ms")
    )


def dropped_records(df: DataFrame) -> DataFrame:
    """Records lost per run, from the writer's cumulative counter; a counter that falls was restarted."""
    seen = previous(
        df.select("run", "timestamp", "request_id", "queue_dropped_records"),
        ["run"], [F.col("timestamp"), F.col("request_id")], {"_before": "queue_dropped_records"},
    )
    now, before = F.col("queue_dropped_records"), F.coalesce("_before", F.lit(0))
    lost = F.when(now >= before, now - before).otherwise(now)
    return seen.groupBy("run").agg(F.sum(lost).alias("dropped"), F.count(F.lit(1)).alias("records"))
