"""Text, hash-file and mesh helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions.binding import let


def catalog_hash(c: Column) -> Column:
    """The 32 hexadecimal digits of a hash file, lower case; null when it holds anything else."""
    text = F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{32}\z"), F.lower(text))


def latency_text(ms: Column) -> Column:
    """Two decimals; seconds from one second upward."""
    seconds = F.concat(F.call_function("format_number", ms / 1000.0, F.lit("0.00")), F.lit("s"))
    return F.when(ms >= 1000.0, seconds).otherwise(
        F.concat(F.call_function("format_number", ms, F.lit("0.00")), F.lit("ms"))
    )


# Characters with an escape of their own.
_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r", "\x00": "\\0"}
_BREAKING = r"[\p{Cc}\u2028\u2029]"


def escape_line(c: Column) -> Column:
    """Escape backslashes and line-breaking characters so that one record stays one line.

    Only the distinct other control characters of a text (hardly ever any) are looked at one by one.
    """
    out = c
    for char, escape in _ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(escape))

    def code(ch: Column) -> Column:
        return F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(ch))), F.lit("}"))

    def rest(text: Column) -> Column:
        others = F.array_distinct(F.regexp_extract_all(text, F.lit(_BREAKING), F.lit(0)))
        return F.when(
            text.rlike(_BREAKING), F.aggregate(others, text, lambda t, ch: F.replace(t, ch, code(ch)))
        ).otherwise(text)

    return let(out, rest)


_MESH = (
    "m_VertexData STRUCT<m_VertexCount: LONG>, m_IndexBuffer ARRAY<VARIANT>, "
    "m_SubMeshes ARRAY<STRUCT<indexCount: LONG, vertexCount: LONG>>, m_StreamData STRUCT<size: LONG>"
)


def empty_mesh(json: Column) -> Column:
    """True for a mesh object that holds no geometry at all."""
    v = F.from_json(json, _MESH)
    return F.coalesce(
        (v["m_VertexData"]["m_VertexCount"] == 0)
        & (F.size(v["m_IndexBuffer"]) == 0)
        & F.forall(
            v["m_SubMeshes"],
            lambda s: F.coalesce((s["indexCount"] == 0) & (s["vertexCount"] == 0), F.lit(False)),
        )
        & (v["m_StreamData"].isNull() | F.coalesce(v["m_StreamData"]["size"] == 0, F.lit(False))),
        F.lit(False),
    )
