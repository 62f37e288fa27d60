"""Relations between bundles, objects, chunks, cues and media facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import ascii_lower
from assetlake.violations import all_of, violation

# Members per emitted segment: bounds what one task concatenates, however large the whole is.
# The longest text or document that is put together in one row; what is longer is a violation.
MAX_DOCUMENT = 256 << 20


def bundle_dependencies(locations: DataFrame, asset_locations: DataFrame) -> DataFrame:
    """Owner bundle (that of a location's first dependency) and each other bundle it needs, one per row."""
    by_id = asset_locations.where(F.col("provider") != "cri").select("run", "id", "relative_path")
    pairs = (
        locations.where(F.size("dependencies") > 0)
        .select("run", F.element_at("dependencies", 1).alias("first"), F.explode("dependencies").alias("other"))
        .distinct()
    )
    owners = by_id.select("run", F.col("id").alias("first"), F.col("relative_path").alias("owner"))
    others = by_id.select("run", F.col("id").alias("other"), F.col("relative_path").alias("dependency"))
    return (
        pairs.join(owners, ["run", "first"])
        .join(others, ["run", "other"])
        .where(F.col("owner") != F.col("dependency"))
        .select("run", "owner", "dependency")
        .distinct()
    )


def resource_weight(receipts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Own bytes plus the bytes of every distinct dependency."""
    size = receipts.select("run", F.col("relative_path").alias("dependency"), "bytes")
    extra = (
        dependencies.join(size, ["run", "dependency"])
        .groupBy("run", F.col("owner").alias("relative_path"))
        .agg(F.sum("bytes").alias("dependency_bytes"), F.count(F.lit(1)).alias("dependencies"))
    )
    zero = F.lit(0).cast("long")
    return receipts.join(extra, ["run", "relative_path"], "left").select(
        "run",
        "relative_path",
        (F.col("bytes") + F.coalesce("dependency_bytes", zero)).alias("weight"),
        F.coalesce("dependencies", zero).alias("dependencies"),
    )


def _references(objects: DataFrame) -> DataFrame:
    refs = objects.select("run", "object_id", F.posexplode("chunks").alias("position", "ref"))
    return refs.select("run", "object_id", F.col("position").cast("long").alias("position"), "ref.file_id", "ref.path_id")


def _parts(objects: DataFrame, chunks: DataFrame) -> DataFrame:
    texts = chunks.select("run", "file_id", "path_id", "text")
    return _references(objects).join(texts, ["run", "file_id", "path_id"], "left")


def _text_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("run", "object_id").agg(
        F.count(F.lit(1)).alias("chunks"), (F.count("text") == F.count(F.lit(1))).alias("_whole"),
        F.sum(F.octet_length("text").cast("long")).alias("bytes"),
    )


def reassemble_chunks(objects: DataFrame, chunks: DataFrame, max_bytes: int = MAX_DOCUMENT) -> DataFrame:
    """Ordered chunk references replaced by their text and joined in order: one row per object.

    Objects with a null or lost chunk, and texts of more than ``max_bytes`` bytes, are left out; both are in
    :func:`chunk_violations`. Sizes are summed first, so no text beyond the limit is ever built.
    """
    parts = _parts(objects, chunks)
    fit = _text_sizes(parts).where(F.col("_whole") & (F.col("bytes") <= max_bytes)).select("run", "object_id", "chunks")
    ordered = F.sort_array(F.collect_list(F.struct("position", "text")))
    texts = parts.join(fit.select("run", "object_id"), ["run", "object_id"], "left_semi").groupBy("run", "object_id").agg(
        F.count(F.lit(1)).alias("chunks"), ordered.alias("_parts")
    )
    return texts.select("run", "object_id", "chunks", F.array_join("_parts.text", "").alias("text"))


def chunk_violations(objects: DataFrame, chunks: DataFrame, max_bytes: int = MAX_DOCUMENT) -> DataFrame:
    empty = objects.where(F.coalesce(F.size("chunks"), F.lit(0)) <= 0)
    refs = _references(objects)
    null_ref = refs.where(F.col("file_id").isNull() | F.col("path_id").isNull())
    missing = refs.where(F.col("file_id").isNotNull() & F.col("path_id").isNotNull()).join(
        chunks.select("run", "file_id", "path_id"), ["run", "file_id", "path_id"], "left_anti"
    )
    long = _text_sizes(_parts(objects, chunks)).where(F.col("bytes") > max_bytes)
    return all_of(
        violation(empty, "no_chunks", F.col("object_id")),
        violation(null_ref, "null_chunk", F.col("object_id"), F.col("position")),
        violation(missing, "missing_chunk", F.col("object_id"), F.col("position")),
        violation(long, "text_too_long", F.col("object_id"), F.col("bytes")),
    )


def cue_tracks(tracks: DataFrame, waveforms: DataFrame) -> DataFrame:
    """Cues of each waveform, one per row in cue order; a waveform without cues keeps one row."""
    w = waveforms.select("run", "resource", F.col("position").alias("track"), "wave_id")
    t = tracks.select("run", "resource", "wave_id", F.col("position").alias("cue_position"), "name", "cue_id")
    return w.join(t, ["run", "resource", "wave_id"], "left").select(
        "run", "resource", "track", "cue_position", "name", "cue_id", "wave_id"
    )


def cue_violations(tracks: DataFrame, waveforms: DataFrame) -> DataFrame:
    lost = tracks.join(
        waveforms.select("run", "resource", "wave_id").distinct(), ["run", "resource", "wave_id"], "left_anti"
    )
    return violation(lost, "absent_waveform", F.concat_ws(":", "resource", F.col("cue_id").cast("string")), F.col("wave_id"))


def _timeline_objects(objects: DataFrame) -> DataFrame:
    container = F.replace(F.col("container"), F.lit("\\"), F.lit("/"))
    unnamed = F.concat(F.lit("MonoBehaviour_#"), F.col("index").cast("string"))
    return (
        objects.where((F.col("class_id") == 114) & (F.trim("container") != ""))
        .withColumn("container", container)
        .where(ascii_lower(F.col("container")).endswith(".playable"))
        .withColumn("name", F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(unnamed))
    )


_CONTAINER = ["run", "resource", "container"]


def _container_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_CONTAINER).agg(F.sum(F.octet_length("data").cast("long")).alias("bytes"))


def merge_containers(objects: DataFrame, max_bytes: int = MAX_DOCUMENT) -> DataFrame:
    """All behaviours of one timeline container as one document, ordered by name, then bundle order.

    One row per container with its ``identity`` (the first object's), ``object_count`` and ``document``:
    ``{container, object_count, objects}``. Containers whose data exceed ``max_bytes`` bytes are left out and in
    :func:`container_violations`; sizes are summed first, so none of them is ever built.
    """
    rows = _timeline_objects(objects)
    fit = _container_sizes(rows).where(F.col("bytes") <= max_bytes).select(*_CONTAINER)
    order = F.struct("name", "index")
    merged = rows.join(fit, _CONTAINER, "left_semi").groupBy(*_CONTAINER).agg(
        F.count(F.lit(1)).alias("object_count"),
        F.min_by(F.struct("source_file", "path_id", "name"), order).alias("identity"),
        F.sort_array(F.collect_list(F.struct("name", "index", "data"))).alias("members"),
    )
    members = F.transform(
        "members",
        lambda m: F.struct(
            m["name"].alias("name"), F.lit("MonoBehaviour").alias("asset_type"), F.parse_json(m["data"]).alias("data")
        ),
    )
    document = F.to_json(F.struct("container", "object_count", members.alias("objects")))
    return merged.select(*_CONTAINER, "object_count", "identity", document.alias("document"))


def container_violations(objects: DataFrame, max_bytes: int = MAX_DOCUMENT) -> DataFrame:
    long = _container_sizes(_timeline_objects(objects)).where(F.col("bytes") > max_bytes)
    return violation(long, "document_too_long", F.concat_ws(":", "resource", "container"), F.col("bytes"))


# The class whose items carry bytes inline, and the signature those bytes start with.
INLINE_CLASS = "CriSerializedBytesAssetImpl"
TABLE_SIGNATURE = "40555446"
_REFERENCES = (
    "references STRUCT<RefIds: ARRAY<STRUCT<type: STRUCT<class: STRING>, data: STRUCT<data: ARRAY<LONG>>>>>"
)


def inline_payloads(behaviours: DataFrame) -> DataFrame:
    """Inline byte arrays of behaviour objects, with ``problem`` naming what is wrong with a bad one."""
    parsed = behaviours.select("run", "resource", "path_id", F.from_json("json", _REFERENCES).alias("j"))
    inline = F.filter(F.col("j.references.RefIds"), lambda r: r["type"]["class"] == INLINE_CLASS)
    items = parsed.select("run", "resource", "path_id", F.posexplode(inline).alias("ordinal", "item"))
    values = F.col("item.data.data")
    bad = F.exists(values, lambda v: v.isNull() | ~v.between(0, 255))
    hexed = F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    problem = (
        F.when(values.isNull(), "array_missing")
        .when(bad, "byte_range")
        .when(~hexed.startswith(TABLE_SIGNATURE), "signature")
    )
    return items.select(
        "run",
        "resource",
        "path_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        problem.alias("problem"),
        F.when(problem.isNull(), F.unhex(hexed)).alias("payload"),
    )


def media_facts(metadata: DataFrame) -> DataFrame:
    """Last declared frame count, and whether an audio header lacks its codec. No shuffle: one pass per row."""
    frames = F.filter(
        F.flatten(F.transform("sections", lambda s: F.coalesce(s["data"]["rows"]["total_frames"], F.array().cast("array<bigint>")))),
        lambda n: n >= 0,
    )
    legacy = F.exists(
        "sections",
        lambda s: (s["kind"] == "audio_header")
        & F.exists(F.coalesce(s["data"]["rows"]["audio_codec"], F.array().cast("array<int>")), lambda c: c.isNull()),
    )
    return metadata.select(
        "run",
        "resource",
        F.when(F.size(frames) > 0, F.element_at(frames, -1)).alias("declared_frames"),
        F.coalesce(legacy, F.lit(False)).alias("legacy_audio"),
    )
