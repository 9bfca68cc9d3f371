"""Project packages: folders with ``manifest.json`` and ``images/*.png``, read into frames of documents, layers and pixels, and written from them.

All files are read through Spark's own readers, so packages may lie in any store that Spark reaches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.sources import png

VERSIONS = range(1, 12)
MOST_MANIFEST, MOST_ASSET, MOST_LAYERS, MOST_SIDE = 4 << 20, 512 << 20, 10_000, 30_000
#: Fields and the format version from which each may be set.
SINCE = {"isGroup": 2, "opacity": 3, "blendMode": 3, "maskFile": 4, "maskSourceID": 5, "adjustment": 7}
_PAIR = T.ArrayType(T.DoubleType())
TRANSFORM = T.StructType().add("origin", _PAIR).add("size", _PAIR).add("rotation", "double").add("flipX", "boolean").add("flipY", "boolean").add("sampling", "string")
LAYER = (
    T.StructType()
    .add("id", "string").add("name", "string").add("imageFile", "string").add("isVisible", "boolean").add("parentID", "string").add("isGroup", "boolean").add("opacity", "double").add("blendMode", "string")
    .add("maskFile", "string").add("maskEnabled", "boolean").add("maskLinked", "boolean").add("maskSourceID", "string").add("transform", TRANSFORM).add("adjustment", T.MapType(T.StringType(), T.StringType()))
)
HEADER = T.StructType().add("format", "string").add("version", "integer")
MANIFEST = T.StructType(HEADER.fields.copy()).add("colorSpace", "string").add("documentID", "string").add("width", "integer").add("height", "integer").add("resolution", "double").add("activeLayerID", "string").add("layers", T.ArrayType(LAYER))
PIXELS = "package string, image_file string, y int, x int, r int, g int, b int, a int"


def _package() -> F.Column:
    return F.regexp_extract(F.col("path"), r"^(.*)/(?:images/[^/]+|[^/]+)$", 1)


def manifests(spark: SparkSession, folder: str, format_name: str | None = None) -> DataFrame:
    """(package, manifest): of all packages below ``folder``; files too long, not parsed, of another format or an unknown version are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", True).load(folder).filter(F.col("length") <= MOST_MANIFEST)
    return parsed(files.select(_package().alias("package"), F.col("content").cast("string").alias("text")), format_name)


def parsed(texts: DataFrame, format_name: str | None = None) -> DataFrame:
    """(package, manifest) of manifests' ``texts`` (package, text): the header is parsed first, the whole record only where it fits."""
    head = texts.withColumn("header", F.from_json("text", HEADER)).filter(F.col("header.version").between(VERSIONS[0], VERSIONS[-1]))
    if format_name:
        head = head.filter(F.col("header.format") == format_name)
    return head.select("package", F.from_json("text", MANIFEST).alias("manifest")).filter(F.size("manifest.layers") <= MOST_LAYERS)


def documents(found: DataFrame) -> DataFrame:
    m = "manifest."
    return found.select("package", F.col(m + "documentID").alias("document_id"), F.col(m + "width").alias("width"), F.col(m + "height").alias("height"), F.coalesce(m + "resolution", F.lit(72.0)).alias("resolution"), F.col(m + "activeLayerID").alias("active_layer_id"), F.col(m + "version").alias("version"))


def layers(found: DataFrame) -> DataFrame:
    """One row per layer with its place ``z`` from the bottom; fields that are missing have their defaults."""
    each = found.select("package", F.col("manifest.documentID").alias("document_id"), F.col("manifest.version").alias("version"), F.posexplode("manifest.layers").alias("z", "l"))
    default = {"isVisible": True, "isGroup": False, "opacity": 1.0, "blendMode": "Normal", "maskEnabled": True, "maskLinked": True}
    return each.select("package", "document_id", "version", "z", *[F.coalesce(f"l.{f.name}", F.lit(default[f.name])).alias(f.name) if f.name in default else F.col(f"l.{f.name}").alias(f.name) for f in LAYER])


def violations(found: DataFrame) -> DataFrame:
    """(package, rule, id): what breaks a package's rules; none for those that may be loaded."""
    one = layers(found)
    raw = found.select("package", F.col("manifest.version").alias("version"), F.explode("manifest.layers").alias("l"))
    rules = [one.filter(~F.col("opacity").between(0, 1)).select("package", F.lit("opacity").alias("rule"), "id")]
    rules.append(one.groupBy("package", "id").count().filter("count > 1").select("package", F.lit("repeated id").alias("rule"), "id"))
    rules.append(one.filter("(imageFile IS NOT NULL AND imageFile <> concat(id, '.png')) OR (maskFile IS NOT NULL AND maskFile <> concat(id, '.mask.png'))").select("package", F.lit("file name").alias("rule"), "id"))
    rules.append(one.filter("length(trim(name)) = 0 OR octet_length(name) > 16384 OR name IS NULL").select("package", F.lit("name").alias("rule"), "id"))
    rules += [raw.filter((F.col("version") < v) & F.col(f"l.{f}").isNotNull()).select("package", F.lit(f"{f} before {v}").alias("rule"), F.col("l.id").alias("id")) for f, v in SINCE.items()]
    parents = one.select("package", F.col("id").alias("parentID"), F.col("isGroup").alias("into_group"))
    rules.append(one.filter("parentID IS NOT NULL").join(parents, ["package", "parentID"], "left").filter("coalesce(into_group, false) = false").select("package", F.lit("parent").alias("rule"), "id"))
    sides = documents(found).filter(~(F.col("width").between(1, MOST_SIDE) & F.col("height").between(1, MOST_SIDE))).select("package", F.lit("size").alias("rule"), F.col("document_id").alias("id"))
    out = sides
    for r in rules:
        out = out.unionByName(r)
    return out


def written(records: DataFrame) -> DataFrame:
    """(package, text): manifests of ``records`` (package, version, width, height, z, and a layer's fields), one for each package, its layers in order of z; fields that are null are left out."""
    fields = [f.name for f in LAYER if f.name in records.columns]
    listed = records.groupBy("package", "version", "width", "height").agg(F.array_sort(F.collect_list(F.struct("z", *fields))).alias("all"))
    layers_ = F.transform("all", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return listed.select("package", F.to_json(F.struct(F.lit("project").alias("format"), "version", F.col("package").alias("documentID"), "width", "height", layers_.alias("layers"))).alias("text"))


def pixels(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Premultiplied pixels of the images that ``wanted`` (package, image_file) names; files beyond the limit are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(folder).filter(F.col("length") <= MOST_ASSET)
    named = files.select(F.regexp_extract("path", r"^(.*)/images/[^/]+$", 1).alias("package"), F.regexp_extract("path", r"([^/]+)$", 1).alias("image_file"), "content")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, name, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rgba = png.premultiplied(png.decode(content)).astype(np.int32)
                height, width = rgba.shape[:2]
                step = max(1, 100_000 // width)
                for top in range(0, height, step):
                    part = rgba[top : top + step]
                    y, x = (a.reshape(-1).astype(np.int32) for a in np.mgrid[top : top + len(part), :width])
                    n = len(y)
                    yield pa.RecordBatch.from_arrays([pa.array([package] * n), pa.array([name] * n), pa.array(y), pa.array(x), *[pa.array(part[:, :, k].reshape(-1)) for k in range(4)]], names=["package", "image_file", "y", "x", "r", "g", "b", "a"])

    return named.join(wanted.select("package", "image_file").distinct(), ["package", "image_file"], "left_semi").mapInArrow(decoded, PIXELS)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """(package, digest): SHA-256 over a manifest's hash and its images' names and sizes in order; unchanged by touching files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    images = files.filter(F.col("path").rlike("/images/[^/]+$")).select(F.regexp_extract("path", r"^(.*)/images/[^/]+$", 1).alias("package"), F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), "length").alias("entry"))
    listed = images.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("entry")), ";").alias("entries"))
    heads = files.filter(F.col("path").endswith("/manifest.json")).select(_package().alias("package"), F.sha2("content", 256).alias("head"))
    return heads.join(listed, "package", "left").select("package", F.sha2(F.concat_ws("|", "head", F.coalesce("entries", F.lit(""))), 256).alias("digest"))


def write(path: str, manifest: dict, images: dict[str, np.ndarray]) -> None:
    """One package in a local folder: images first, then the manifest by a rename, so that no reader sees half of it."""
    from pathlib import Path

    folder = Path(path)
    (folder / "images").mkdir(parents=True, exist_ok=True)
    for name, rgba in images.items():
        draft = folder / "images" / f".{name}.tmp"
        draft.write_bytes(png.encode(rgba))
        draft.rename(folder / "images" / name)
    draft = folder / ".manifest.json.tmp"
    draft.write_text(json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
    draft.rename(folder / "manifest.json")
