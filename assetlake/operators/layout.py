"""Readable, stable keys for exported outputs.

Input is the flat output table of :func:`assetlake.operators.exports.explode_outputs`; ``class_id`` is
null for outputs that belong to no object. Order is ``(resource_index, position)``: the resource's place
in its receipt, then the output's place in the resource, so numbering does not depend on timing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions.binding import let
from assetlake.functions import (
    ascii_lower, container_key, fix_file_name, join_ext, loose, split_ext, valid_key,
    with_extension,
)
from assetlake.operators.windows import running
from assetlake.session import materialize
from assetlake.violations import violation

DEFAULT_STRIP = ("Assets/AddressableResources",)
BUNDLES = "_bundles"
MAX_CUE_FILE = 1024 * 1024

# Class ids and their names.
CLASS_NAMES = {
    1: "GameObject", 2: "Component", 4: "Transform", 8: "Behaviour", 20: "Camera", 21: "Material",
    23: "MeshRenderer", 25: "Renderer", 28: "Texture2D", 33: "MeshFilter", 43: "Mesh", 48: "Shader",
    49: "TextAsset", 50: "Rigidbody2D", 54: "Rigidbody", 56: "Collider", 61: "BoxCollider2D",
    64: "MeshCollider", 65: "BoxCollider", 74: "AnimationClip", 81: "AudioListener", 82: "AudioSource",
    83: "AudioClip", 84: "RenderTexture", 89: "Cubemap", 90: "Avatar", 91: "AnimatorController",
    95: "Animator", 96: "TrailRenderer", 102: "TextMesh", 108: "Light", 111: "Animation",
    114: "MonoBehaviour", 115: "MonoScript", 117: "Texture3D", 120: "LineRenderer", 128: "Font",
    135: "SphereCollider", 136: "CapsuleCollider", 137: "SkinnedMeshRenderer", 142: "AssetBundle",
    152: "MovieTexture", 187: "Texture2DArray", 198: "ParticleSystem", 199: "ParticleSystemRenderer",
    205: "LODGroup", 210: "SortingGroup", 212: "SpriteRenderer", 213: "Sprite",
    221: "AnimatorOverrideController", 222: "CanvasRenderer", 223: "Canvas", 224: "RectTransform",
    225: "CanvasGroup", 290: "AssetBundleManifest", 320: "PlayableDirector", 328: "VideoPlayer",
    329: "VideoClip", 331: "SpriteMask", 687078895: "SpriteAtlas",
}
# Directories that are the plain lower-case class name, and two that are neither.
PLAIN_DIRS = [
    "sprite", "mesh", "animator", "monobehaviour", "monoscript", "gameobject", "material", "transform",
    "recttransform", "canvas", "camera", "avatar", "animation", "cubemap", "texture3d", "shader", "texture2d",
]
SPECIAL_DIRS = {"texture2darray": "texture2d_array", "shadervariantcollection": "shader"}
# Classes that keep their container's path.
LEAF_CLASSES = [83, 329, 152, 687078895]
TEXT, BEHAVIOUR, TEXTURE, FONT, TEXTURE_ARRAY = 49, 114, 28, 128, 187


def _literal_map(items: dict) -> Column:
    """A constant map, parsed once: the optimizer folds it to a single literal."""

    def text(x: object) -> str:
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in items.items()) + ")")


def _directory(name: str) -> str:
    low = name.lower()
    if low in SPECIAL_DIRS:
        return SPECIAL_DIRS[low]
    if low in PLAIN_DIRS:
        return low
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


# One directory per class, worked out once instead of per row.
CLASS_DIRS = {class_id: _directory(name) for class_id, name in CLASS_NAMES.items()}


def known_class(class_id: Column) -> Column:
    return F.try_element_at(_literal_map(CLASS_NAMES), class_id)


def class_label(class_id: Column) -> Column:
    return F.coalesce(known_class(class_id), F.concat(F.lit("ClassID"), class_id.cast("string")))


def class_dir(class_id: Column) -> Column:
    return F.coalesce(
        F.try_element_at(_literal_map(CLASS_DIRS), class_id), F.concat(F.lit("class_id"), class_id.cast("string"))
    )


def class_dirs(class_ids: DataFrame) -> DataFrame:
    """The class dimension for the ids in use: ``(class_id, class_name, directory)``."""
    c = F.col("class_id")
    return class_ids.select("class_id").distinct().select(
        "class_id", class_label(c).alias("class_name"), class_dir(c).alias("directory")
    )


def _normal(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~p.isin("", ".", ".."))


def strip_container(c: Column, prefixes: Sequence[str] = DEFAULT_STRIP) -> Column:
    """Path parts of a container without the first matching prefix."""
    path = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"\A/+", "")
    out = path
    for prefix in reversed([p.strip("/") for p in prefixes]):
        rest = F.regexp_replace(F.substring(path, F.lit(len(prefix) + 1), F.length(path)), r"\A/+", "")
        out = F.when(path.startswith(prefix + "/") & (rest != ""), rest).otherwise(out)
    return F.transform(_normal(F.split(out, "/")), lambda p: F.regexp_replace(p, r"\p{Cc}", "_"))


def source_location(c: Column) -> Column:
    """Struct ``(dirs, stem)`` of a resource name: the hash suffix and a doubled group are removed."""
    hashed = r"(?s)\A(.+)_[0-9A-Fa-f]{32}\z"

    def head(first: Column) -> Column:
        at = F.instr(first, "_assets_")
        group = F.substring(first, F.lit(1), at - 1)
        return F.when((at > 1) & (group == F.substring(first, at + 8, F.length(first))), group).otherwise(first)

    def located_(parts: Column) -> Column:
        size = F.size(parts)
        dirs = F.when(
            size > 1,
            F.concat(F.array(let(F.get(parts, F.lit(0)), head)), F.slice(parts, 2, F.greatest(size - 2, F.lit(0)))),
        ).otherwise(F.array().cast("array<string>"))
        stem = let(
            F.coalesce(F.get(parts, size - 1), F.lit("resource")),
            lambda last: F.when(last.rlike(hashed), F.regexp_extract(last, hashed, 1)).otherwise(last),
        )
        return F.struct(dirs.alias("dirs"), stem.alias("stem"))

    return let(F.transform(_normal(F.split(c, "/")), fix_file_name), located_)


def _blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def located(outputs: DataFrame, prefixes: Sequence[str] = DEFAULT_STRIP) -> DataFrame:
    """Succeeded outputs with their file, container and source parts worked out once."""
    df = outputs.where(~F.col("failed"))
    df = df.withColumn("_file", F.regexp_extract("path", r"(?s)([^/]*)\z", 1))
    stem, ext = split_ext(F.col("_file"))
    df = df.withColumn("_file_stem", stem).withColumn("_ext", ext)
    df = df.withColumn("_parts", F.when(~_blank(F.col("container")), strip_container(F.col("container"), prefixes)))
    size = F.size("_parts")
    df = df.withColumn("_dirs", F.when(size > 0, F.slice("_parts", 1, F.greatest(size - 1, F.lit(0)))))
    df = df.withColumn("_leaf", F.when(size > 0, F.element_at("_parts", -1)))
    leaf_stem, leaf_ext = split_ext(F.col("_leaf"))
    df = df.withColumn("_leaf_stem", leaf_stem).withColumn("_leaf_ext", leaf_ext)
    bare = F.regexp_replace("source", r"(?:\.bundle)+\z", "")
    df = df.withColumns(
        {
            "_bundle": source_location(bare)["stem"],
            "_media": F.when(F.col("class_id").isNull(), source_location(F.col("source"))),
            "_name": fix_file_name(F.col("name")),
        }
    )
    return df.withColumn(
        "_scope",
        F.when(F.col("_parts").isNull(), F.concat(F.lit(BUNDLES + "/"), "_bundle")).when(
            size > 0, container_key(F.col("_dirs"), F.col("_leaf"))
        ),
    )


def texture_rule(located_outputs: DataFrame) -> DataFrame:
    """Containers whose only texture is named like the container: ``(run, _scope, textures, flat)``.

    A texture counts once per resource; containers are counted across the resources of a run.
    """
    per_texture = (
        located_outputs.where(F.col("class_id") == TEXTURE)
        .groupBy("run", "output_directory", "source_file", "path_id")
        .agg(F.min_by(F.struct("_scope", "_parts", "_leaf_stem", "_name"), "position").alias("t"))
        .where(F.size("t._parts") > 0)
    )
    named = F.coalesce(F.col("t._name") == fix_file_name(F.col("t._leaf_stem")), F.lit(False))
    return per_texture.groupBy("run", F.col("t._scope").alias("_scope")).agg(
        F.count(F.lit(1)).alias("textures"), F.every(named).alias("_named")
    ).select("run", "_scope", "textures", ((F.col("textures") == 1) & F.col("_named")).alias("flat"))


def branches(located_outputs: DataFrame, textures: DataFrame) -> DataFrame:
    """Add ``_branch``: which rule makes the key of an object's output."""
    df = located_outputs.join(textures.select("run", "_scope", "flat"), ["run", "_scope"], "left")
    cid = F.col("class_id")
    like = F.when(F.col("_name").isNotNull(), loose(F.col("_name")) == loose(F.col("_leaf_stem")))
    bytes_ext = ascii_lower(F.col("_leaf_ext")) == "bytes"
    branch = (
        F.when(cid.isNull(), "media")
        .when(F.col("_parts").isNull(), "bundle")
        .when(F.size("_parts") == 0, "class")
        .when(F.col("kind") == "playable_json", "flat")
        .when((cid == TEXT) & ~F.coalesce(like, F.lit(True)) & ~bytes_ext, "text_nested")
        .when((cid == TEXT) & bytes_ext, "text_stem")
        .when((cid == TEXT) & (F.col("_leaf_ext") == ""), "flat")
        .when(cid == TEXT, "text_file")
        .when((cid == BEHAVIOUR) & F.coalesce(like, F.lit(False)), "flat")
        .when((cid == TEXTURE) & F.coalesce("flat", F.lit(False)), "flat")
        .when(cid == FONT, "font")
        .when(cid.isin(LEAF_CLASSES) | known_class(cid).isNull(), "flat")
        .otherwise("nested")
    )
    return df.withColumn("_branch", branch).drop("flat")


_NEEDS_STEM = ["bundle", "text_nested", "font", "nested"]


def number_unnamed(branched: DataFrame) -> DataFrame:
    """``<Class>_<n>`` for objects whose key needs a name they do not have: ``(run, source_file, path_id, _number_stem)``.

    Numbers follow first appearance within ``(run, scope, class)``; one object gets one number.
    """
    unnamed = branched.where(
        F.col("_branch").isin(_NEEDS_STEM) & (F.coalesce("_name", F.lit("")) == "")
    )
    first = unnamed.groupBy("run", "source_file", "path_id").agg(
        F.min(F.struct("resource_index", "position", "_scope", "class_id")).alias("f")
    ).select("run", "source_file", "path_id", "f.*")
    # Stored: the numbering looks at its input twice, and the input is a long way from the scan.
    first = materialize(first, "unnamed")
    numbered = running(
        first, ["run", "_scope", "class_id"], [F.col("resource_index"), F.col("position")], row_number="_n"
    )
    return numbered.select(
        "run", "source_file", "path_id",
        F.concat(class_label(F.col("class_id")), F.lit("_"), (F.col("_n") - 1).cast("string")).alias("_number_stem"),
    )


def object_parts(df: DataFrame) -> Column:
    """Key parts of an object's output, from the columns of :func:`branches` and a ``_stem``."""
    cid, ext, dirs = F.col("class_id"), F.col("_ext"), F.col("_dirs")
    named = join_ext(F.col("_stem"), ext)
    folder = F.when(cid == TEXT, F.lit("text_asset")).otherwise(class_dir(cid))
    inside = F.concat(dirs, F.array(F.concat(F.col("_leaf_stem"), F.lit(".assets")), folder, named))
    branch = F.col("_branch")
    return (
        F.when(branch == "bundle", F.array(F.lit(BUNDLES), F.col("_bundle"), class_dir(cid), named))
        .when(branch == "class", F.array(join_ext(fix_file_name(class_label(cid)), ext)))
        .when(branch == "flat", F.concat(dirs, F.array(with_extension(F.col("_leaf"), ext))))
        .when(branch == "text_stem", F.concat(dirs, F.array(F.col("_leaf_stem"))))
        .when(branch == "text_file", F.concat(dirs, F.array(F.col("_leaf"))))
        .when(branch == "font", F.concat(dirs, F.array(named)))
        .when(branch.isin("text_nested", "nested"), inside)
    )


def layer_parts(parts: Column, class_id: Column, file_stem: Column, ext: Column) -> Column:
    """Array layers become files of a directory named after the array."""
    layer = F.regexp_extract(file_stem, r"_layer_([0-9]{4})\z", 1)
    size = F.size(parts)
    return F.when(
        (class_id == TEXTURE_ARRAY) & (layer != ""),
        F.concat(
            F.slice(parts, 1, F.greatest(size - 1, F.lit(0))),
            F.array(split_ext(F.element_at(parts, -1))[0], join_ext(F.concat(F.lit("layer_"), layer), ext)),
        ),
    ).otherwise(parts)


def object_keys(outputs: DataFrame, prefixes: Sequence[str] = DEFAULT_STRIP) -> DataFrame:
    """Add ``_key_parts`` to every succeeded output that belongs to an object (null for the others)."""
    # Stored: three steps below read these rows, and behind them lies the parsing of the journal.
    rows = materialize(located(outputs, prefixes), "located")
    branched = branches(rows, texture_rule(rows))
    numbers = number_unnamed(branched)
    df = branched.join(numbers, ["run", "source_file", "path_id"], "left")
    df = df.withColumn("_stem", F.when(F.coalesce("_name", F.lit("")) != "", F.col("_name")).otherwise(F.col("_number_stem")))
    df = df.withColumn("_key_parts", object_parts(df))
    return df.withColumn(
        "_key_parts", layer_parts(F.col("_key_parts"), F.col("class_id"), F.col("_file_stem"), F.col("_ext"))
    )


def media_parts(cue: Column) -> Column:
    """Key parts of an output outside any object; ``cue`` names the track or is null."""
    dirs, stem = F.col("_media.dirs"), F.col("_media.stem")
    file, ext = F.col("_file"), F.col("_ext")
    dot = F.instr(file, ".")
    rest = F.when(dot > 0, F.substring(file, dot + 1, F.length(file))).otherwise(ext)
    name_stem = F.when(F.startswith("path", F.lit("alpha/")), F.concat(stem, F.lit(".alpha"))).otherwise(stem)
    name = (
        F.when(F.substring_index(file, ".", 1).rlike(r"\A[0-9]{5}\z"), join_ext(name_stem, rest))
        .when(F.col("_file_stem") == "movie", join_ext(name_stem, ext))
        .otherwise(F.concat(name_stem, F.lit("."), file))
    )
    last = F.when(cue.isNotNull(), join_ext(cue, rest)).otherwise(name)
    return F.concat(dirs, F.array(stem, last))


def media_keys(outputs: DataFrame) -> DataFrame:
    """Outputs outside any object with their key parts, before cue names are considered."""
    rows = located(outputs).where(F.col("class_id").isNull())
    return rows.withColumn("_key_parts", media_parts(F.lit(None).cast("string")))


def cue_names(outputs: DataFrame, cues: DataFrame) -> DataFrame:
    """Distinct usable cue names of every cue file: ``(run, output_directory, _cue_path, _names)``.

    ``cues`` has ``(run, output_directory, path, cues ARRAY<STRUCT<name, cue_id, wave_id>>)``.
    """
    files = outputs.where(~F.col("failed") & (F.col("kind") == "cue_metadata")).select(
        "run", "output_directory", "path", "bytes"
    ).dropDuplicates(["run", "output_directory", "path"])
    named = files.join(cues.select("run", "output_directory", "path", "cues"), ["run", "output_directory", "path"], "left")
    names = F.filter(F.transform("cues.name", fix_file_name), lambda n: n.isNotNull() & (n != ""))
    named = named.withColumn("_n", F.when(F.col("bytes") <= MAX_CUE_FILE, names)).withColumn(
        "_low", F.transform("_n", ascii_lower)
    )
    first = F.filter("_n", lambda n, i: F.array_position(F.col("_low"), ascii_lower(n)) == i + 1)
    return named.select(
        "run", "output_directory", F.col("path").alias("_cue_path"),
        F.coalesce(first, F.array().cast("array<string>")).alias("_names"),
    )


def cue_aliases(keyed: DataFrame, names: DataFrame) -> DataFrame:
    """One row per key of an output: ``alias`` counts the cue names a track is published under.

    Metadata is published under the first name only.
    """
    index = F.substring_index("_file", ".", 1)
    folder = F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)
    cue_path = F.when(
        index.rlike(r"\A[0-9]{5}\z"),
        F.concat(F.when(F.contains("path", F.lit("/")), F.concat(folder, F.lit("/"))).otherwise(F.lit("")), index, F.lit(".cues.json")),
    )
    df = keyed.withColumn("_cue_path", cue_path).join(names, ["run", "output_directory", "_cue_path"], "left")
    tracks = F.when(F.size("_names") > 0, F.col("_names")).when(F.col("_names").isNotNull(), F.array(index))
    tracks = F.when(F.col("kind") == "cue_metadata", F.slice(tracks, 1, 1)).otherwise(tracks)
    nested = F.col("class_id").isNotNull() & F.contains("path", F.lit("/"))
    plain = F.array(F.when(nested, index))
    use = F.when(F.col("class_id").isNotNull() & ~nested, F.array(F.lit(None).cast("string"))).otherwise(
        F.coalesce(tracks, plain)
    )
    df = df.select(*keyed.columns, F.posexplode(use).alias("alias", "_track"))
    size = F.size("_key_parts")
    dot = F.instr("_file", ".")
    rest = F.when(dot > 0, F.substring("_file", dot + 1, F.length("_file"))).otherwise(F.lit(""))
    below = F.concat(
        F.slice("_key_parts", 1, F.greatest(size - 1, F.lit(0))),
        F.array(split_ext(F.element_at("_key_parts", -1))[0], join_ext(F.col("_track"), rest)),
    )
    parts = (
        F.when(F.col("class_id").isNull(), media_parts(F.col("_track")))
        .when(nested, below)
        .otherwise(F.col("_key_parts"))
    )
    return df.withColumn("_key_parts", parts).withColumn("alias", F.col("alias").cast("long"))


def fold_keys(df: DataFrame, lowercase: bool = True) -> DataFrame:
    """Add ``key``, lower-cased when asked."""
    key = F.array_join("_key_parts", "/")
    return df.withColumn("key", F.lower(key) if lowercase else key)


def key_violations(df: DataFrame) -> DataFrame:
    bad = df.where(~F.coalesce(valid_key(F.col("key")), F.lit(False)))
    return violation(bad, "invalid_key", F.concat_ws("/", "output_directory", "path"), F.col("key"))


def readable_keys(
    outputs: DataFrame,
    cues: DataFrame,
    prefixes: Sequence[str] = DEFAULT_STRIP,
    lowercase: bool = True,
) -> DataFrame:
    """Every output of succeeded resources with its wanted key, one row per alias, ready to be claimed."""
    keyed = cue_aliases(object_keys(outputs, prefixes), cue_names(outputs, cues))
    return fold_keys(keyed, lowercase).select(
        "run", "key", "resource_index", "position", "alias",
        F.concat_ws("/", "output_directory", "path").alias("local"),
        "bytes", "sha256", "source", "kind", "class_id", "container", "name", "output_directory", "path",
    )


def split_failed(journal: DataFrame, max_failed: int) -> tuple[DataFrame, DataFrame]:
    """Sources of failed resources ``(run, source)`` and a violation for runs with too many of them."""
    failed = journal.where(F.size("errors") > 0).select("run", "source")
    over = failed.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_failed)
    return failed, violation(over, "too_many_failed", F.col("run"), F.col("n"))


# Extension to content type.
CONTENT_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
    "json": "application/json", "jsonl": "application/x-ndjson",
    "txt": "text/plain; charset=utf-8", "shader": "text/plain; charset=utf-8",
    "obj": "text/plain; charset=utf-8", "csv": "text/plain; charset=utf-8",
    "wav": "audio/wav", "flac": "audio/flac", "mp3": "audio/mpeg", "ogg": "audio/ogg",
    "mp4": "video/mp4", "mkv": "video/x-matroska", "m2v": "video/mpeg", "ivf": "video/x-ivf",
    "webm": "video/webm", "ttf": "font/ttf", "otf": "font/otf",
}


def content_type(key: Column) -> Column:
    ext = ascii_lower(F.regexp_extract(key, r"\.([^./]*)\z", 1))
    return F.coalesce(F.try_element_at(_literal_map(CONTENT_TYPES), ext), F.lit("application/octet-stream"))
