"""Rasterization as relations: triangles to fragments by an exploded pixel grid, depth by arg-max, blending by folds.

A triangle explodes into the pixels of its own clipped box, so there is no range join; the barycentric filter runs in the same stage.
Depth is max_by over (z, draw order), which sums partially before the shuffle on (image, x, y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the inside test and of thin triangles, and tone curve, gamma and exposure.
INSIDE, THIN, WIDEST = -0.001, 1.5, -2.0
GAMMA, EXPOSURE = 2.2, 1.05


def clamp_round(v: Column) -> Column:
    """To 0..255, halves up."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def tone_map(x: Column) -> Column:
    return (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14)


def to_linear(c: Column) -> Column:
    return F.pow(c / 255.0, F.lit(GAMMA))


def shade_colour(c: Column, shade: Column) -> Column:
    """An 8-bit channel after light, exposure and tone curve."""
    return clamp_round(F.round(F.pow(tone_map(to_linear(c) * shade * EXPOSURE), F.lit(1.0 / GAMMA)) * 255, 6))


def thin_threshold(det: Column, edge2: Column) -> Column:
    """Lets an edge of a thin triangle pass pixels up to a pixel beyond it."""
    height = F.abs(det) / F.sqrt(edge2)
    return F.when((edge2 > 1) & (height < THIN), F.greatest(F.lit(WIDEST), -1.0 / height)).otherwise(INSIDE)


def fragments(triangles: DataFrame, width: int, height: int, keys: list[str]) -> DataFrame:
    """triangles (keys, x0..z2) to covered pixels (keys, sx, sy, z, w0, w1, w2). Triangles without area, or whose clipped box is one
    pixel wide or high, give none."""
    c = F.col
    lo = lambda k, n: F.greatest(F.lit(0), F.floor(F.least(c(f"{k}0"), c(f"{k}1"), c(f"{k}2"))).cast("int"))
    hi = lambda k, n: F.least(F.lit(n - 1), F.floor(F.greatest(c(f"{k}0"), c(f"{k}1"), c(f"{k}2"))).cast("int") + 1)
    det = (c("y1") - c("y2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("y0") - c("y2"))
    edge2 = lambda a, b: (c(f"x{a}") - c(f"x{b}")) ** 2 + (c(f"y{a}") - c(f"y{b}")) ** 2
    rows = triangles.withColumns({"det": det, "x_lo": lo("x", width), "x_hi": hi("x", width), "y_lo": lo("y", height), "y_hi": hi("y", height)})
    rows = rows.where("abs(det) >= 1e-8 and x_lo < x_hi and y_lo < y_hi")
    rows = rows.withColumns({"t0": thin_threshold(c("det"), edge2(1, 2)), "t1": thin_threshold(c("det"), edge2(2, 0)), "t2": thin_threshold(c("det"), edge2(0, 1))})
    rows = rows.withColumn("sx", F.explode(F.sequence("x_lo", "x_hi"))).withColumn("sy", F.explode(F.sequence("y_lo", "y_hi")))
    dx, dy = c("sx") - c("x2"), c("sy") - c("y2")
    rows = rows.withColumns({"w0": ((c("y1") - c("y2")) * dx + (c("x2") - c("x1")) * dy) / c("det"), "w1": ((c("y2") - c("y0")) * dx + (c("x0") - c("x2")) * dy) / c("det")})
    rows = rows.withColumn("w2", 1.0 - c("w0") - c("w1")).where("w0 >= t0 and w1 >= t1 and w2 >= t2")
    return rows.withColumn("z", c("w0") * c("z0") + c("w1") * c("z1") + c("w2") * c("z2"))


def nearest(frags: DataFrame, image: list[str], value: Column, order: str) -> DataFrame:
    """The value of the fragment with most z at each pixel; of equal ones the one drawn last."""
    return frags.groupBy(*image, "sx", "sy").agg(F.max("z").alias("z"), F.max_by(value, F.struct("z", order)).alias("value"), F.count("*").alias("overdraw"))


def additive(base: DataFrame, frags: DataFrame, keys: list[str], bias: float = 0.5) -> DataFrame:
    """base (keys, z, colour) plus the colours of the fragments (keys, z, add) that are at most bias behind it, up to 255. Order doesn't matter, for contributions are whole numbers."""
    add = frags.select(*keys, F.col("z").alias("fz"), "add")
    summed = add.join(base.select(*keys, "z"), keys).where(F.col("fz") >= F.col("z") - bias).groupBy(*keys).agg(F.sum("add").alias("added"), F.count("*").alias("layers"))
    return base.join(summed, keys, "left").withColumns({"added": F.coalesce("added", F.lit(0)), "layers": F.coalesce("layers", F.lit(0))}).withColumn("colour", F.least(F.lit(255), F.col("colour") + F.col("added")))


def alpha_fold(layers: Column, start: Column) -> Column:
    """Layers (array of struct order, c, a) over a start channel in order, rounded to 8 bits at each step."""
    step = lambda dst, s: clamp_round(s["c"] * (s["a"] / 255.0) + dst * (1.0 - s["a"] / 255.0))
    return F.aggregate(F.array_sort(layers), start.cast("int"), step)


def composite_over(dst: Column, dst_a: Column, src: Column, src_a: Column) -> tuple[Column, Column]:
    """Colour and coverage of src on top of dst."""
    s, d = src_a / 255.0, dst_a / 255.0
    colour = F.when(src_a == 0, dst).otherwise(clamp_round(src * s + dst * (1.0 - s)))
    cover = F.when(src_a == 0, dst_a).otherwise(F.floor(F.least(s + d * (1.0 - s), F.lit(1.0)) * 255.0 + 0.5).cast("int"))
    return colour, cover


def composite_under(dst: Column, dst_a: Column, bg: Column, bg_a: Column) -> tuple[Column, Column]:
    """bg below dst. Its share is what dst leaves open, and coverage takes that share a second time."""
    d = dst_a / 255.0
    share = bg_a / 255.0 * (1.0 - d)
    skip = (bg_a == 0) | (share < 1.0 / 255.0)
    cover = F.floor(F.least(d + share * (1.0 - d), F.lit(1.0)) * 255.0 + 0.5).cast("int")
    return F.when(skip, dst).otherwise(clamp_round(dst + bg * share)), F.when(skip, dst_a).otherwise(cover)


def luminance_alpha(r: Column, g: Column, b: Column, alpha: Column, floor: int) -> Column:
    """Alpha from the strongest channel: 0 below the floor, then a ramp; the product is cut off, so white can stay at 254."""
    most = F.greatest(r, g, b)
    ramp = F.least(F.floor((most - floor) * F.lit(255.0 / (255.0 - floor))).cast("int"), F.lit(255))
    return F.when((alpha == 0) | (most < floor), 0).otherwise(ramp)


def tint(c: Column, t: Column) -> Column:
    return F.floor(F.least(c * t, F.lit(255.0))).cast("int")


def wrap(u: Column) -> Column:
    """Texture coordinates to [0, 1): cut towards zero, then up by one if negative."""
    cut = F.when(u >= 0, F.floor(u)).otherwise(F.ceil(u))
    return F.when(u - cut < 0, u - cut + 1.0).otherwise(u - cut)


def bilinear(channel: Column, width: int, height: int, u: Column, v: Column) -> Column:
    """A channel (array, row by row) at wrapped coordinates, rounded to 8 bits."""
    fx, fy = wrap(u) * (width - 1), wrap(v) * (height - 1)
    x0, y0 = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    x1, y1 = (x0 + 1) % width, (y0 + 1) % height
    dx, dy = fx - x0, fy - y0
    at = lambda x, y: F.get(channel, y * width + x)
    sum4 = at(x0, y0) * ((1 - dx) * (1 - dy)) + at(x1, y0) * (dx * (1 - dy)) + at(x0, y1) * ((1 - dx) * dy) + at(x1, y1) * (dx * dy)
    return F.floor(F.round(sum4, 6) + 0.5).cast("int")
