"""Textures: the folders of a catalogue's items, names that models use, decoded images."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.catalogue import extension, stem
from tesserae.operators.tables import shared_dir
from tesserae.sources import sinks
from tesserae.sources.binary import TEXTURE_HEADERS, _rows, texture_payload, tga

NAMES = "*.[oO][zZ][jJtT]"
IMAGE_SCHEMA = "path string, width int, height int, rgba binary, error string"


def _bare(path: Column | str) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the texture files below folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(folder).select("path")


def item_textures(spark: SparkSession, item_dir: str, *extra: str) -> DataFrame:
    """stem, ozj, ozt: for each stem (lower case) the first file of each kind.

    Files count below item_dir/texture, then below Texture or texture of each folder in item_dir, by name, then below each extra
    folder; those elsewhere in item_dir don't. Within a folder they go by name, step by step of the path.
    """
    root = F.length(F.regexp_replace(_bare(F.lit(item_dir)), "/+$", "")) + 2
    own = listed(spark, item_dir).withColumn("steps", F.split(F.substring(_bare("path"), root, F.lit(1 << 30)), "/"))
    first, second, deep = F.col("steps")[0], F.get("steps", F.lit(1)), F.size("steps")
    beside = (second.isin("Texture", "texture")) & (deep > 2)
    own = own.withColumn("rank", F.when((first == "texture") & (deep > 1), 0).when(beside, 1)).where("rank is not null")
    for k, folder in enumerate(extra):
        own = own.unionByName(listed(spark, folder).select("path", F.split(_bare("path"), "/").alias("steps"), F.lit(2 + k).alias("rank")))
    name = F.substring_index("path", "/", -1)
    rows = own.select("path", F.struct("rank", "steps").alias("place"), F.lower(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"))
    of = lambda e: F.min_by(F.when(F.col("ext") == e, F.col("path")), F.when(F.col("ext") == e, F.col("place")))
    return rows.groupBy("stem").agg(of(".ozj").alias("ozj"), of(".ozt").alias("ozt"))


def resolve(meshes: DataFrame, index: DataFrame, name: str = "path") -> DataFrame:
    """meshes with texture_path: names that ask for a JPEG get one before the kind with alpha, all others the reverse; null where the index has neither."""
    i = index.select(F.col("stem").alias("_stem"), F.col("ozj").alias("_j"), F.col("ozt").alias("_t"))
    rows = meshes.join(i, F.lower(stem(F.col(name))) == F.col("_stem"), "left")
    wanted = F.when(extension(F.col(name)).isin(".jpg", ".jpeg"), F.coalesce("_j", "_t")).otherwise(F.coalesce("_t", "_j"))
    return rows.withColumn("texture_path", wanted).drop("_stem", "_j", "_t")


def _rgba(height: int, width: int, channels: int, data: bytes) -> bytes:
    """Rows of grey, BGR or BGRA as RGBA; what has no alpha is opaque."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = px[..., 2::-1] if channels > 1 else px
    if channels == 4:
        out[..., 3] = px[..., 3]
    return out.tobytes()


def decode(files: DataFrame) -> DataFrame:
    """Images (path, width, height, rgba, error) of texture files (path, content), one row a file; what can't be decoded is an error row.

    JPEGs are written without their header into the shared folder, where Spark's image source reads them, baseline and progressive;
    their colours may differ from other decoders' by how chroma is spread over pixels. Four-colour JPEGs are errors.
    """
    spark = files.sparkSession
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = files.select("path", ext.alias("ext"), texture_payload(F.col("content"), ext).alias("payload"))
    known = rows.where(F.col("ext").isin(*TEXTURE_HEADERS))

    def one(path, content):
        width, height, rgba = tga(content)
        return [{"path": path, "width": width, "height": height, "rgba": rgba}]

    targa = _rows(known.where("ext = '.ozt' and payload is not null").select("path", "payload"), one, IMAGE_SCHEMA)
    folder = f"{shared_dir(spark)}/tesserae-jpeg-{uuid.uuid4().hex}"
    key = F.concat(F.sha2("path", 256), F.lit(".jpg"))
    sinks.write_file(*(lambda s, p: (s, f"{p}/none.txt", [b""]))(*sinks.place(folder)))  # the folder is there even if no file comes
    jpegs = known.where("ext = '.ozj'")
    sinks.write_files(jpegs.where("payload is not null").select(key.alias("path"), F.col("payload").alias("content")), folder)
    read = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", "*.jpg").load(folder).select(F.substring_index("image.origin", "/", -1).alias("key"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")

    def spread(batches):
        for batch in batches:
            k, h, w, c, d = (batch.column(i).to_pylist() for i in range(5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(list(map(_rgba, h, w, c, d)), pa.binary())], names=["key", "width", "height", "rgba"])

    decoded = read.mapInArrow(spread, "key string, width int, height int, rgba binary")
    opened = jpegs.select("path", "payload", key.alias("key")).join(decoded, "key", "left")
    failed = F.when(F.col("payload").isNull(), "no longer than its header").when(F.col("width").isNull(), "not a JPEG that can be read")
    short = rows.where("payload is null and not ext <=> '.ozj'").select("path", *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("rgba", "binary"))], F.when(F.col("ext").isin(*TEXTURE_HEADERS), "no longer than its header").otherwise("no kind of texture").alias("error"))
    return targa.unionByName(opened.select("path", "width", "height", "rgba", failed.alias("error"))).unionByName(short)


def with_images(meshes: DataFrame, index: DataFrame, images: DataFrame, name: str = "path") -> DataFrame:
    """meshes with texture_path and the image's width, height, rgba; each file is decoded once however many meshes name it, and one that failed is null like one that isn't there."""
    found = images.where("error is null").select(F.col("path").alias("texture_path"), "width", "height", "rgba")
    return resolve(meshes, index, name).join(found, "texture_path", "left")


def opacity(images: DataFrame) -> DataFrame:
    """path, visible, opaque, percent: pixels with any alpha, with all of it, and the share in per cent, 0 where nothing is visible. Rows without an image don't count."""

    def run(batches):
        for batch in batches:
            alphas = [np.frombuffer(b, np.uint8)[3::4] for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int((a > 0).sum()) for a in alphas], pa.int64()), pa.array([int((a == 255).sum()) for a in alphas], pa.int64())], names=["path", "visible", "opaque"])

    counts = images.where("rgba is not null").select("path", "rgba").mapInArrow(run, "path string, visible long, opaque long")
    return counts.withColumn("percent", F.coalesce(100.0 * F.col("opaque") / F.nullif(F.col("visible"), F.lit(0)), F.lit(0.0)))
