"""Image statistics and shapes over pixel tables (image, x, y, alpha, ...): all aggregates on the image key."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tesserae.operators.tables import cut


def alpha_statistics(px: DataFrame) -> DataFrame:
    n = F.count("*")
    return px.groupBy("image").agg(F.min("alpha").alias("least"), F.max("alpha").alias("most"), F.round(F.avg("alpha"), 6).alias("mean"), F.count_if(F.col("alpha") == 255).alias("opaque"), F.round(100.0 * F.count_if(F.col("alpha") == 255) / n, 6).alias("percent"))


def opaque_ratio(px: DataFrame) -> DataFrame:
    """Share of the visible pixels that are opaque, in per cent; 0 where nothing is visible."""
    visible, opaque = F.count_if(F.col("alpha") > 0), F.count_if(F.col("alpha") == 255)
    return px.groupBy("image").agg(visible.alias("visible"), opaque.alias("opaque"), F.round(F.coalesce(100.0 * opaque / F.nullif(visible, F.lit(0)), F.lit(0.0)), 6).alias("percent"))


def brightness(px: DataFrame) -> DataFrame:
    return px.groupBy("image").agg(F.round(F.avg((F.col("r") + F.col("g") + F.col("b")) / 3), 6).alias("brightness"))


def mean_colour(px: DataFrame) -> DataFrame:
    """Means rounded halves up, alpha 255. An image without pixels has no row here; callers give it (160, 160, 170)."""
    return px.groupBy("image").agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"]).withColumn("alpha", F.lit(255))


def covariance(px: DataFrame, least: int = 10) -> DataFrame:
    """Population covariance of visible pixel places; images with fewer than least visible pixels pass through and have no row.

    Places are whole numbers, so the sums are exact in any order and only the last division rounds.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    s = px.where("alpha > 0").groupBy("image").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y))])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    over = lambda v: v.cast("double") / (n * n).cast("double")
    moments = [over(n * F.col("sxx") - sx * sx).alias("xx"), over(n * F.col("sxy") - sx * sy).alias("xy"), over(n * F.col("syy") - sy * sy).alias("yy")]
    return s.where(n >= least).select("image", "n", (sx / n).alias("mx"), (sy / n).alias("my"), *moments)


def eigen2(a: Column, b: Column, d: Column) -> dict[str, Column]:
    """Eigenvalues of ((a, b), (b, d)), greater first, and the direction of the first: along an axis where b is next to nothing.

    (x, y) is the direction as it comes, (vx, vy) of length 1.
    """
    half, root = (a + d) / 2, F.sqrt(F.greatest((a - d) * (a - d) / 4 + b * b, F.lit(0.0)))
    l1 = half + root
    length = F.sqrt((l1 - d) * (l1 - d) + b * b)
    flat = F.abs(b) < 1e-9
    x = F.when(flat & (a >= d), 1.0).when(flat, 0.0).otherwise(l1 - d)
    y = F.when(flat & (a >= d), 0.0).when(flat, 1.0).otherwise(b)
    vx = F.when(flat & (a >= d), 1.0).when(flat, 0.0).otherwise((l1 - d) / F.nullif(length, F.lit(0.0)))
    vy = F.when(flat & (a >= d), 0.0).when(flat, 1.0).otherwise(b / F.nullif(length, F.lit(0.0)))
    return {"l1": l1, "l2": half - root, "x": x, "y": y, "vx": vx, "vy": vy}


@F.arrow_udf(returnType=DoubleType())
def atan2(y: pa.Array, x: pa.Array) -> pa.Array:
    """The C library's. The JVM's rounds y / x first, so their last bits differ at times."""
    return pc.atan2(y, x)


def round_signed(v: Column, places: int) -> Column:
    """Halves away from zero, judged on the scaled double as C and SQL do; what is left of a negative number is never +0.0."""
    r = F.round(v * 10.0**places) / 10.0**places
    return F.when(v < 0, -F.abs(r)).otherwise(r)


def standardise_angle(px: DataFrame, target: float = -45.0) -> DataFrame:
    """Degrees to turn each image by so that its main axis lies at target, in [-90, 90].

    A main axis across the target is turned by 90 or -90, as the last bit of its angle has it, so nothing may round on the way
    there that needn't: the direction is not brought to length 1.
    """
    e = eigen2(F.col("xx"), F.col("xy"), F.col("yy"))
    c = covariance(px).select("image", "n", (F.lit(target) - F.degrees(atan2(e["y"], e["x"]))).alias("turn"))
    turn = F.col("turn") - 180 * F.floor((F.col("turn") + 90) / 180)
    return c.select("image", "n", round_signed(turn, 4).alias("turn"))


def stddev_floor(values: Column, least: int = 10) -> Column:
    """Population deviation as an aggregate; 0 below so many values."""
    return F.when(F.count(values) < least, 0.0).otherwise(F.coalesce(F.stddev_pop(values), F.lit(0.0)))


def flip_needed(px: DataFrame, degrees: float = -45.0) -> DataFrame:
    """Whether the visible pixels ahead of their box's middle along an axis, the dividing line included, spread over 1.2 times as wide across it as those behind; below 20 pixels not."""
    from math import cos, radians, sin

    ux, uy = cos(radians(degrees)), sin(radians(degrees))
    v = px.where("alpha > 0")
    centre = v.groupBy("image").agg(*[((F.min(k) + F.max(k)) / 2).alias("c" + k) for k in "xy"], F.count("*").alias("n"))
    v = v.join(centre, "image")
    along = F.round((F.col("x") - F.col("cx")) * ux + (F.col("y") - F.col("cy")) * uy, 6)
    across = -(F.col("x") - F.col("cx")) * uy + (F.col("y") - F.col("cy")) * ux
    s = v.groupBy("image").agg(F.first("n").alias("n"), stddev_floor(F.when(along >= 0, across)).alias("ahead"), stddev_floor(F.when(along < 0, across)).alias("behind"))
    return s.select("image", "n", F.round("ahead", 4).alias("ahead"), F.round("behind", 4).alias("behind"), ((F.col("n") >= 20) & (F.round("ahead", 4) > F.round(1.2 * F.round("behind", 4), 4))).alias("flip"))


def crop_box(px: DataFrame) -> DataFrame:
    """The box of visible pixels; an image whose box is one pixel wide or high, or that has none, keeps its whole box."""
    shown = lambda c: F.when(F.col("alpha") > 0, F.col(c))
    g = px.groupBy("image").agg(*[f(s(c)).alias(f"{n}_{c}_{k}") for c in "xy" for n, f in (("min", F.min), ("max", F.max)) for k, s in (("shown", shown), ("all", F.col))])
    thin = F.coalesce((F.col("max_x_shown") <= F.col("min_x_shown")) | (F.col("max_y_shown") <= F.col("min_y_shown")), F.lit(True))
    return g.select("image", *[F.when(thin, F.col(f"{n}_{c}_all")).otherwise(F.col(f"{n}_{c}_shown")).alias(f"{n}_{c}") for c in "xy" for n in ("min", "max")])


def crop(px: DataFrame) -> DataFrame:
    b = crop_box(px)
    return px.join(b, "image").where("x between min_x and max_x and y between min_y and max_y").withColumns({"x": F.col("x") - F.col("min_x"), "y": F.col("y") - F.col("min_y")}).select(*px.columns)


def turn_half(px: DataFrame, width: int, height: int) -> DataFrame:
    return px.withColumns({"x": width - 1 - F.col("x"), "y": height - 1 - F.col("y")})


def mirror(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("x", width - 1 - F.col("x"))


def components(px: DataFrame) -> DataFrame:
    """(image, x, y, label) of visible pixels, 8-connected; the label is the least pixel number of the component.

    A neighbour step is one aggregate: each pixel sends its label to its nine places and takes the least that arrives; then it
    takes the label of its label, which halves chains. Each round is cut; the rounds end when no label changes.
    """
    side = 1 << 16
    v = cut(px.where("alpha > 0").select("image", "x", "y", (F.col("y") * side + F.col("x")).alias("id")), "pixels")
    state, before = v.withColumn("label", F.col("id")), None
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    while True:
        sent = state.select("image", F.explode(steps).alias("s"), "x", "y", "label").select("image", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "label")
        low = cut(v.join(sent.groupBy("image", "x", "y").agg(F.min("label").alias("label")), ["image", "x", "y"]), "labels")
        roots = low.select("image", F.col("id").alias("label"), F.col("label").alias("up"))
        state = cut(low.join(roots, ["image", "label"]).select("image", "x", "y", "id", F.col("up").alias("label")), "labels")
        after = state.agg(F.sum("label")).first()[0]
        if after == before:
            break
        before = after
    return state.select("image", "x", "y", "label")


def drop_small(px: DataFrame, labels: DataFrame, share: float = 0.02) -> DataFrame:
    """Visible pixels of components that aren't smaller than the share of all visible ones, cut to a whole number; one component stays."""
    sizes = labels.groupBy("image", "label").agg(F.count("*").alias("size"))
    whole = sizes.groupBy("image").agg(F.sum("size").alias("visible"), F.count("*").alias("parts"))
    keep = sizes.join(whole, "image").where((F.col("parts") <= 1) | (F.col("size") >= F.floor(F.col("visible") * share)))
    return labels.join(keep.select("image", "label", "size"), ["image", "label"])


def largest_component(labels: DataFrame) -> DataFrame:
    """The greatest component of each image, of equal ones the first."""
    sizes = labels.groupBy("image", "label").agg(F.count("*").alias("size"))
    return sizes.groupBy("image").agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("label"), F.max("size").alias("size"))
