"""Bone hierarchies: world transforms along parent chains, skinning, leaf-to-root chains, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import linalg as L
from tesserae.operators.tables import cut


def local_matrix(rx: Column, ry: Column, rz: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """The 4x4 transform of a bone as an array, from Euler angles in radians and a position."""
    return F.array(*L.compose(L.quaternion_matrix(L.quaternion(rx, ry, rz)), [tx, ty, tz]))


def chains(bones: DataFrame) -> DataFrame:
    """(bone, ancestor, steps): each bone with itself and all its ancestors, by doubling: a round joins chains with chains, so depth d
    takes log2(d) joins, and rounds end when no chain goes on. A parent that isn't below its bone makes the bone a root. bones: bone, parent."""
    up = bones.select("bone", F.when((F.col("parent") >= 0) & (F.col("parent") < F.col("bone")), F.col("parent")).alias("parent"))
    known = up.select("bone", F.col("bone").alias("ancestor"), F.lit(0).alias("steps"))
    jump = up.where("parent is not null").select(F.col("bone").alias("b"), F.col("parent").alias("p"))
    reach = 1
    while True:
        jump = cut(jump, "jump")
        if jump.isEmpty():
            break
        more = known.join(jump, F.col("ancestor") == F.col("b")).select("bone", F.col("p").alias("ancestor"), (F.col("steps") + reach).alias("steps"))
        known = cut(known.union(more), "chains")
        jump = jump.join(jump.select(F.col("b").alias("b2"), F.col("p").alias("p2")), F.col("p") == F.col("b2")).select("b", F.col("p2").alias("p"))
        reach *= 2
    return known


def world_matrices(bones: DataFrame) -> DataFrame:
    """(bone, world): the product of the local transforms from the root down. A chain's transforms meet in one row, as long as the chain is deep."""
    c = chains(bones).join(bones.select(F.col("bone").alias("ancestor"), "local"), "ancestor")
    path = c.groupBy("bone").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("k"), "local"))).alias("path"))

    def product(a: Column, b: Column) -> Column:
        cell = lambda k: sum((F.get(a, k - k % 4 + j) * F.get(b["local"], k % 4 + 4 * j) for j in range(1, 4)), F.get(a, k - k % 4) * F.get(b["local"], k % 4))
        return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)

    start = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    return path.select("bone", F.aggregate("path", start, product).alias("world"))


def skin(vertices: DataFrame, worlds: DataFrame) -> DataFrame:
    """Vertices moved by their bone and rounded to single precision; a node that no bone has leaves its vertex."""
    rows = vertices.join(worlds, F.col("node") == F.col("bone"), "left")
    moved = L.transform_point([F.get("world", F.lit(i)) for i in range(16)], [F.col(k) for k in "xyz"])
    return rows.withColumns({k: F.when(F.col("bone").isNull(), F.col(k)).otherwise(m).cast("float") for k, m in zip("xyz", moved, strict=True)}).select(*vertices.columns)


def leaves(bones: DataFrame) -> DataFrame:
    return bones.join(bones.select(F.col("parent").alias("_p")).distinct(), F.col("bone") == F.col("_p"), "left_anti")


def fit_scale(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Scale and margin that fit a box (span_x, span_y) into a canvas; spans are 0.001 at least, the margin a sixteenth and 4 at least."""
    margin = F.greatest(F.floor(F.lit(min(width, height) * 16 / 256)).cast("int"), F.lit(4))
    fit = lambda n, s: (n - 2 * margin) / F.greatest(F.col(s), F.lit(0.001))
    return boxes.withColumn("margin", margin).withColumn("scale", F.least(fit(width, "span_x"), fit(height, "span_y")))


def orthographic(vertices: DataFrame, width: int, height: int, scale: float) -> DataFrame:
    """Screen places about the middle of each item's box, y up; z unscaled."""
    item = Window.partitionBy("item")
    centre = lambda k: (F.min(k).over(item) + F.max(k).over(item)) / 2
    return vertices.withColumns({"cx": centre("x"), "cy": centre("y")}).withColumns({"px": (F.col("x") - F.col("cx")) * scale + width / 2, "py": height / 2 - (F.col("y") - F.col("cy")) * scale, "pz": F.col("z")}).drop("cx", "cy")


def perspective(vertices: DataFrame, strength: float = 0.3) -> DataFrame:
    """x and y grow with nearness within the depth range of the vertex's own mesh."""
    mesh = Window.partitionBy("item", "mesh")
    low, high = F.min("z").over(mesh), F.max("z").over(mesh)
    rows = vertices.withColumns({"lo": low, "hi": high})
    t = F.coalesce((F.col("z") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.5))
    return rows.withColumn("factor", 1.0 + strength * (t - 0.5)).withColumns({"px": F.col("x") * F.col("factor"), "py": F.col("y") * F.col("factor")}).drop("lo", "hi")
