"""Path and URL predicates. Limits are in bytes, as stored keys are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# An empty, "." or ".." part anywhere in a slash-separated path.
_BAD_PART = r"(?:\A|/)\.{0,2}(?:/|\z)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def safe_relative(c: Column) -> Column:
    """1..2048 bytes of plain ASCII parts, each at most 255 long."""
    return (
        c.rlike(r"\A[A-Za-z0-9._()/-]{1,2048}\z")
        & ~c.rlike(_BAD_PART)
        & ~c.rlike(r"[^/]{256}")
    )


def safe_path(c: Column, max_bytes: int | None = 4096, forbidden: str = r"\\:", control: bool = True) -> Column:
    """Relative path without escapes. ``forbidden`` is the inside of a regex character class."""
    bad = rf"[{forbidden}\x00{r'\p{Cc}' if control else ''}]"
    ok = ~c.rlike(bad) & ~c.rlike(_BAD_PART)
    return ok if max_bytes is None else ok & (F.octet_length(c) <= max_bytes)


def valid_key(c: Column) -> Column:
    """A publishable key: at most 1024 bytes, parts at most 255 bytes, no control characters."""
    return safe_path(c, 1024, r"\\") & F.forall(F.split(c, "/"), lambda p: F.octet_length(p) <= 255)


def component(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9._-]{1,256}\z") & ~c.isin(".", "..")


def ancestors(c: Column) -> Column:
    """Every proper ancestor directory of a path: ``a/b/c`` gives ``[a, a/b]``."""
    parts = F.split(c, "/")
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )


_HOST = r"(?:[^\s/?#@\\%:\[\]<>^|]+|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?"


def cdn_root_ok(c: Column) -> Column:
    """HTTPS root with a plain path: no user info, query, fragment, escapes, dot parts or final slash."""
    return (
        c.rlike(rf"\A(?i:https)://{_HOST}(?:/[A-Za-z0-9._-]*)*\z")
        & ~c.endswith("/")
        & ~c.rlike(r"/\.{1,2}(?:/|\z)")
    )


def public_base_ok(c: Column) -> Column:
    return (
        c.rlike(rf"\A(?i:https)://{_HOST}(?:/[^?#\\]*)?\z")
        & ~c.rlike(r"(?U)\s")
        & (F.octet_length(c) <= 2048)
    )


# Printable characters a URL path segment keeps unescaped besides letters, digits and "-._*".
_KEPT = "!$&'()+,:;=@[]^|~"


def encode_segments(c: Column) -> Column:
    """Percent-encode a path segment by segment (slashes kept, space is %20)."""

    def one(part: Column) -> Column:
        out = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
        for ch in _KEPT:
            out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
        return out

    return F.array_join(F.transform(F.split(c, "/"), one), "/")
