"""Validating version snapshots and deriving what they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import cdn_root_ok, component, hex32
from assetlake.violations import rule_violations, violation

# Oldest acceptable snapshot, regions, and the legacy alias of one of them.
MAX_AGE_MS = 300_000
REGIONS = ["jp", "hk", "en", "kr", "cn"]
GLOBAL_REGIONS = ["hk", "en", "kr"]
RESERVED_REGION = "cn"
ALIASES = {"tw": "hk"}
PROTOCOLS = {"jp": "1.0.4", "cn": "", "hk": "1.0.1", "en": "1.0.1", "kr": "1.0.1"}
AREA_IDS = {"hk": "2", "en": "3", "kr": "4"}
PLATFORMS = ["iOS", "Android"]
PLACEHOLDER_ROOT = "https://dummy.net"
CATALOG_FILE = "catalog_main.bin"
LOCALES = ["en", "zh-Hant", "zh-Hans", "ko"]
# Known service hosts, first match wins: (host suffix, host infix, path prefix, region).
# A null region on a matching host means that the address belongs to no region.
HOST_RULES = [
    (".bang-dream-on.jp", "", "", "jp"),
    (".gamerfusiontech.com", "-prod-hk-", "", "hk"),
    (".bilibiligame.net", "-prod-va-", "", "en"),
    (".bilibiligame.net", "-prod-kr-", "", "kr"),
    (".bilibiligame.net", "-prod-sg-patch-", "/prod/en_", "en"),
    (".bilibiligame.net", "-prod-sg-patch-", "/prod/kr_", "kr"),
    (".bilibiligame.net", "-prod-sg-patch-", "", "none"),
]
# Fields that must not move between a pinned snapshot and the current one.
PINNED = [
    "region", "environment", "client_version", "resource_version", "platform_hash", "platform",
    "protocol_version", "effective_cdn_root", "credential_ref", "schema_version", "catalog_layout",
    "catalog_url", "bundle_base_url", "cdn_authorization",
]


def canonical(region: Column) -> Column:
    """Canonical region name; null for an unknown one."""
    out = F.when(region.isin(REGIONS), region)
    for old, new in ALIASES.items():
        out = F.when(region == old, F.lit(new)).otherwise(out)
    return out


def canonical_region(df: DataFrame) -> DataFrame:
    return df.withColumn("canonical", canonical(F.col("region")))


def region_violations(df: DataFrame) -> DataFrame:
    unknown = df.where(F.col("region").isNotNull() & canonical(F.col("region")).isNull())
    return violation(unknown, "unknown_region", F.col("region"))


def layout_of(region: Column) -> Column:
    return F.when(region.isin(GLOBAL_REGIONS), "global").otherwise("jp")


def _eq(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def with_profile(snaps: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach the expected profile of each run (columns prefixed ``want_``)."""
    fields = ["region", "environment", "platform", "client_version", "protocol_version", "catalog_locale"]
    return snaps.join(profiles.select("run", *[F.col(f).alias(f"want_{f}") for f in fields]), "run", "left")


def validate_snapshots(snaps: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Identity and freshness against the expected profile; one row per broken rule."""
    df = with_profile(snaps, profiles)
    c = F.col
    age = F.unix_millis(now) - F.unix_millis("observed_at")
    explicit = [c(x).isNotNull() for x in ("catalog_layout", "catalog_url", "bundle_base_url", "cdn_authorization")]
    three = c("schema_version") == 3
    all_or_none = F.lit(True)
    for present in explicit:
        all_or_none = all_or_none & (present == three)
    first = (
        c("region").isNull() & (c("want_region") == "jp") & (c("want_platform") == "iOS") & (c("protocol_version") == "1.0.3")
    )
    return rule_violations(
        df,
        c("run"),
        {
            "stale": ~c("stale"),
            "age": age.between(0, MAX_AGE_MS),
            "schema": F.when(c("schema_version") == 1, first)
            .when(c("schema_version").isin(2, 3), _eq("region", "want_region"))
            .otherwise(F.lit(False)),
            "explicit_layout": all_or_none,
            "environment": _eq("environment", "want_environment"),
            "platform": _eq("platform", "want_platform"),
            "client_version": _eq("client_version", "want_client_version"),
            "protocol_version": _eq("protocol_version", "want_protocol_version"),
            "source": c("source") == "remote",
            "resource_version": component(c("resource_version")),
            "platform_hash": component(c("platform_hash")),
        },
    )


def validate_layout(snaps: DataFrame, profiles: DataFrame, roots: DataFrame) -> DataFrame:
    """Layout fits the region, and the authorization is exactly the configured root's.

    ``roots``: ``(run, root, authorization, credential_ref)``.
    """
    df = with_profile(snaps, profiles).join(
        roots.select(
            "run", F.col("root").alias("effective_cdn_root"),
            F.col("authorization").alias("_auth"), F.col("credential_ref").alias("_cred"),
        ),
        ["run", "effective_cdn_root"],
        "left",
    )
    c = F.col
    layout = F.coalesce("catalog_layout", F.lit("jp"))
    expected_ref = F.when(c("_auth") == "basic", c("_cred")).otherwise(F.lit(""))
    return rule_violations(
        df,
        c("run"),
        {
            "layout_region": layout == layout_of(c("want_region")),
            "layout_hash": (layout != "global") | hex32(c("platform_hash")),
            "layout_locale": (layout != "jp") | c("want_catalog_locale").isNull(),
            "cdn_root": c("_auth").isNotNull() & cdn_root_ok(c("effective_cdn_root")),
            "authorization": c("_auth").isNull() | (F.coalesce("cdn_authorization", F.lit("basic")) == c("_auth")),
            "credential": c("_auth").isNull() | (c("credential_ref") == expected_ref),
        },
    )


def derive_targets(snaps: DataFrame, profiles: DataFrame) -> DataFrame:
    """Catalog, hash and bundle addresses of each snapshot, and whether explicit ones agree."""
    df = with_profile(snaps, profiles)
    c = F.col
    layout = F.coalesce("catalog_layout", F.lit("jp"))
    glob = layout == "global"
    jp_base = F.concat_ws("/", "effective_cdn_root", F.lit("asset"), "resource_version", "want_platform", "platform_hash")
    base = F.when(glob, F.concat_ws("/", "effective_cdn_root", F.lit("asset"), "want_platform")).otherwise(jp_base)
    plain = F.concat(base, F.lit("/catalog_"), c("resource_version"))
    stem = F.when(c("want_catalog_locale").isNull(), plain).otherwise(F.concat(plain, F.lit("_"), c("want_catalog_locale")))
    url = F.when(glob, F.concat(stem, F.lit(".bin"))).otherwise(F.concat(base, F.lit("/" + CATALOG_FILE)))
    stated = F.when(glob, F.concat(plain, F.lit(".bin"))).otherwise(url)
    return df.select(
        "run",
        layout.alias("layout"),
        url.alias("catalog_url"),
        F.when(glob, F.concat(stem, F.lit(".hash"))).alias("hash_url"),
        base.alias("bundle_base_url"),
        F.when(glob, F.concat(F.lit(PLACEHOLDER_ROOT + "/asset/"), c("want_platform"))).alias("placeholder"),
        (
            F.coalesce(c("catalog_url") == stated, F.lit(True)) & F.coalesce(c("bundle_base_url") == base, F.lit(True))
        ).alias("consistent"),
    )


def region_identity(snaps: DataFrame) -> DataFrame:
    """Region a snapshot belongs to, or null when schema, region, platform and layout do not fit together."""
    c = F.col
    known = (
        c("region").isNotNull() & c("region").isin(REGIONS) & (c("region") != RESERVED_REGION) & c("platform").isin(PLATFORMS)
    )
    identity = (
        F.when(
            (c("schema_version") == 1) & c("region").isNull() & (c("platform") == "iOS") & (c("protocol_version") == "1.0.3"),
            F.lit("jp"),
        )
        .when((c("schema_version") == 2) & known & c("catalog_layout").isNull(), c("region"))
        .when((c("schema_version") == 3) & known & (c("catalog_layout") == layout_of(c("region"))), c("region"))
    )
    return snaps.withColumn("identity_region", identity)


def snapshot_drift(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """Changed fields per run, one row each, with both values."""
    a, b = pinned.alias("a"), current.alias("b")
    fields = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"a.{f}").cast("string").alias("pinned"),
                F.col(f"b.{f}").cast("string").alias("current"),
            )
            for f in PINNED
        ]
    )
    changed = F.filter(fields, lambda x: ~x["pinned"].eqNullSafe(x["current"]))
    return (
        a.join(b, F.col("a.run") == F.col("b.run"))
        .select(F.col("a.run").alias("run"), F.explode(changed).alias("x"))
        .select("run", "x.field", "x.pinned", "x.current")
    )


def receipt_base(receipts: DataFrame) -> DataFrame:
    """Base directory and placeholder a receipt's paths resolve against; null base if inconsistent.

    Older receipts state no layout or base; both follow from the catalog address.
    """
    c = F.col
    layout = F.coalesce("catalog_layout", F.lit("jp"))
    suffix = "/" + CATALOG_FILE
    derived = F.when(
        c("catalog_url").endswith(suffix),
        F.substring("catalog_url", F.lit(1), F.length("catalog_url") - len(suffix)),
    )
    jp = F.when(
        F.coalesce(c("bundle_base_url") == derived, F.lit(True)) & c("catalog_locale").isNull(), derived
    )
    expected = F.concat_ws("/", "effective_cdn_root", F.lit("asset"), "platform")
    tail = F.coalesce(F.concat(F.lit("_"), c("catalog_locale")), F.lit(""))
    stem = F.concat(expected, F.lit("/catalog_"), c("resource_version"), tail, F.lit(".bin"))
    glob = F.when(
        (c("bundle_base_url") == expected)
        & (c("catalog_url") == stem)
        & F.coalesce(c("catalog_locale").isin(LOCALES), F.lit(True)),
        expected,
    )
    base = F.when(c("platform").isin(PLATFORMS), F.when(layout == "global", glob).otherwise(jp))
    return receipts.select(
        "run",
        base.alias("base"),
        F.when(
            base.isNotNull() & (layout == "global"), F.concat(F.lit(PLACEHOLDER_ROOT + "/asset/"), c("platform"))
        ).alias("placeholder"),
    )


def owning_region(url: Column, rules=HOST_RULES) -> Column:
    """Region owning an address: null if the host is unknown, ``none`` if it is known but nobody's."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    out = F.lit(None).cast("string")
    for suffix, infix, prefix, region in reversed(rules):
        out = F.when(
            host.endswith(suffix) & host.contains(infix) & path.startswith(prefix), F.lit(region)
        ).otherwise(out)
    return out


def attribute_region(urls: DataFrame, rules=HOST_RULES) -> DataFrame:
    """Add ``owner`` and ``mismatch`` against the configured ``region``."""
    owner = owning_region(F.col("url"), rules)
    return urls.withColumn("owner", owner).withColumn(
        "mismatch", F.col("owner").isNotNull() & (F.col("owner") != F.col("region"))
    )
