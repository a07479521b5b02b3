"""View matrices by camera route, and a camera that stands before the model and above its middle."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import linalg as L
from tesserae.operators.config import camera_route


def turn(axis: str, degrees: float) -> list[float]:
    c, s = cos(radians(degrees)), sin(radians(degrees))
    return {"x": [1, 0, 0, 0, c, -s, 0, s, c], "y": [c, 0, s, 0, 1, 0, -s, 0, c], "z": [c, -s, 0, s, c, 0, 0, 0, 1]}[axis]


def product(*ms: list[float]) -> list[float]:
    out = ms[0]
    for m in ms[1:]:
        out = [sum(out[3 * i + k] * m[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]
    return out


#: The mirror, the angles of the reference view, of the usual weapon and of the camera that doesn't flip.
MIRROR = [-1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
FALLBACK = product(MIRROR, turn("x", -15), turn("y", 12), turn("x", -90))
USUAL = product(turn("z", 15), turn("y", 270), turn("x", 180))
#: A rotation's inverse is its transpose.
CORRECTION = product(FALLBACK, [USUAL[3 * j + i] for i in range(3) for j in range(3)])
NOFLIP = product(MIRROR, turn("x", -15))
#: Field of view without an entry's own, least half width, length and depth.
FOV, LEAST, NEAREST = 75.0, 0.001, 0.1


def literal(m: list[float]) -> list[Column]:
    return [F.lit(float(x)) for x in m]


def view_matrix(rot_x: Column, rot_y: Column, rot_z: Column, camera: Column | None = None, has_entry: Column | None = None) -> list[Column]:
    """Nine columns: the entry's rotation (z after y after x, in degrees) behind the matrix of its route; the reference view for the route fallback and where there is no entry."""
    own = L.matmul(L.matmul(L.rotation("z", rot_z), L.rotation("y", rot_y)), L.rotation("x", rot_x))
    route = camera_route(rot_y, camera)
    if has_entry is not None:
        route = F.when(has_entry, route).otherwise("fallback")
    fixed, turned = literal(FALLBACK), {k: L.matmul(literal(m), own) for k, m in (("correction", CORRECTION), ("noflip", NOFLIP))}
    return [F.when(route == "fallback", fixed[i]).when(route == "correction", turned["correction"][i]).otherwise(turned["noflip"][i]) for i in range(9)]


def rotated(vertices: DataFrame, matrix: list[Column]) -> DataFrame:
    """vertices with tx, ty, tz: the place that a matrix gives them."""
    return vertices.withColumns(dict(zip(("tx", "ty", "tz"), L.apply(matrix, [F.col(k) for k in "xyz"]), strict=True)))


def camera_of(vertices: DataFrame, height: Column, fov: Column) -> DataFrame:
    """item, middle, cam_h, cam_dist, look_len of the box of each item's rotated vertices (tx, ty, tz): height is a share of the box's,
    the distance makes half the larger of width and height fill half the field of view (degrees; 0: FOV)."""
    box = vertices.groupBy("item").agg(*[f(f"t{k}").alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    span = lambda k: F.col(f"max_{k}") - F.col(f"min_{k}")
    box = box.withColumns({"cam_h": height * span("y"), "cam_dist": F.greatest(span("x") / 2, span("y") / 2, F.lit(LEAST)) / F.tan(L.deg2rad(F.when(fov == 0, FOV).otherwise(fov) / 2))})
    box = box.withColumn("look_len", F.greatest(F.sqrt(F.col("cam_h") * F.col("cam_h") + F.col("cam_dist") * F.col("cam_dist")), F.lit(LEAST)))
    return box.select("item", *[((F.col(f"min_{k}") + F.col(f"max_{k}")) / 2).alias(f"c{k}") for k in "xyz"], "cam_h", "cam_dist", "look_len")


def seen() -> tuple[Column, Column]:
    """Where a rotated vertex stands in the picture, y down, before it is fitted to a canvas: the camera looks at the box's middle."""
    h, dist, length = F.col("cam_h"), F.col("cam_dist"), F.col("look_len")
    x, y, z = F.col("tx") - F.col("cx"), F.col("ty") - F.col("cy") - h, F.col("tz") - F.col("cz") - dist
    up, back = (dist * y - h * z) / length, (h * y + dist * z) / length
    factor = length / F.greatest(-back, F.lit(NEAREST))
    return x * factor, -up * factor


def positioned(vertices: DataFrame, height: Column, fov: Column, width: int, tall: int, margin: int) -> DataFrame:
    """vertices (item, tx, ty, tz) with px, py, pz: seen by the camera of their item and fitted to the canvas. Two aggregates on item, each joined back."""
    rows = vertices.join(camera_of(vertices, height, fov), "item")
    sx, sy = seen()
    rows = rows.withColumns({"sx": sx, "sy": sy})
    fit = rows.groupBy("item").agg(*[f(k).alias(f"{n}_{k}") for k in ("sx", "sy") for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda k: F.greatest(F.col(f"hi_{k}") - F.col(f"lo_{k}"), F.lit(LEAST))
    fit = fit.select("item", *[((F.col(f"lo_{k}") + F.col(f"hi_{k}")) / 2).alias(f"mid_{k}") for k in ("sx", "sy")], F.least((width - 2 * margin) / span("sx"), (tall - 2 * margin) / span("sy")).alias("fit"))
    rows = rows.join(fit, "item")
    place = {"px": (F.col("sx") - F.col("mid_sx")) * F.col("fit") + width / 2, "py": (F.col("sy") - F.col("mid_sy")) * F.col("fit") + tall / 2, "pz": F.col("tz")}
    return rows.withColumns(place).select(*vertices.columns, "px", "py", "pz")


def screen_boxes(projected: DataFrame) -> DataFrame:
    """item, mesh and the box of its projected vertices (px, py)."""
    return projected.groupBy("item", "mesh").agg(*[f(k).alias(f"{n}_{k}") for k in ("px", "py") for n, f in (("min", F.min), ("max", F.max))])
