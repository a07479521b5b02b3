"""Audits of model files as read_models gives them: expressions over the arrays of a row, so that no mesh is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.catalogue import extension, stem

AXES = "xyz"


def _axis(numbers: Column, k: int) -> Column:
    """Every third number, from the k-th on."""
    return F.filter(numbers, lambda v, i: i % 3 == k)


def mesh_audit(models: DataFrame) -> DataFrame:
    """A row a mesh: file, ordinal, texture with stem and kind, counts, box, bones used in order, quads. Files with errors have none; a mesh without vertices has a null box."""
    rows = models.where("error is null").select("path", F.posexplode("meshes").alias("mesh", "m"))
    box = [f(_axis(F.col("m.vertices"), k)).alias(f"{n}_{a}") for k, a in enumerate(AXES) for n, f in (("min", F.array_min), ("max", F.array_max))]
    bones = F.array_sort(F.array_distinct("m.nodes"))
    texture = F.col("m.texture")
    counts = [F.size("m.nodes").alias("vertices"), F.size("m.polygons").alias("triangles"), (F.size("m.uvs") / 2).cast("int").alias("uvs"), F.size(F.filter("m.polygons", lambda p: p == 4)).alias("quads")]
    return rows.select("path", "mesh", texture.alias("texture"), stem(texture).alias("stem"), extension(texture).alias("ext"), *counts, *box, bones.alias("bones"))


def shape_audit(models: DataFrame) -> DataFrame:
    """A row a file with vertices: numbers of meshes and bones, sizes, and the least size over the greatest (0 for a point)."""
    every = F.flatten(F.transform("meshes", lambda m: m["vertices"]))
    rows = models.where("error is null").select("path", F.size("meshes").alias("meshes"), F.size("bones").alias("bones"), every.alias("v"))
    sizes = [(F.array_max(_axis(F.col("v"), k)) - F.array_min(_axis(F.col("v"), k))).cast("double").alias(f"size_{a}") for k, a in enumerate(AXES)]
    rows = rows.where(F.size("v") > 0).select("path", "meshes", "bones", *sizes)
    size = [F.col(f"size_{a}") for a in AXES]
    return rows.withColumn("flat_ratio", F.coalesce(F.least(*size) / F.nullif(F.greatest(*size), F.lit(0.0)), F.lit(0.0)))


def leaf_chains(models: DataFrame) -> DataFrame:
    """A row for each bone that is no other's parent: the way from it up to its root. A parent that isn't in the file, or leads back, ends it."""
    rows = models.where("error is null").select("path", F.transform("bones", lambda b: b["parent"]).alias("p"))
    rows = rows.select("path", "p", F.posexplode("p").alias("bone", "_up")).where(~F.array_contains("p", F.col("bone")))

    def step(way: Column, _: Column) -> Column:
        up = F.get(F.col("p"), F.element_at(way, -1))
        return F.when((up >= 0) & (up < F.size("p")) & ~F.array_contains(way, up), F.concat(way, F.array(up))).otherwise(way)

    return rows.select("path", "bone", F.aggregate(F.sequence(F.lit(1), F.size("p")), F.array("bone"), step).alias("chain"))
