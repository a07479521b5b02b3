"""Mesh features, sibling tests and blend-pass classes of catalogue items.

Vertices are summed to one feature row a mesh first (partial aggregation before the shuffle), and all sibling tests are equi-joins
on the item between feature rows, so the width of a join is the number of meshes of an item and never that of vertices. Tests that
only ask whether some sibling exists are one aggregate over that join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.catalogue import extension, keep_unless_all, stem, stem_base

AXES = ("x", "y", "z")
JPEG = (".jpg", ".jpeg")


def features(vertices: DataFrame, keys: tuple[str, ...] = ("item", "mesh")) -> DataFrame:
    """Vertex count and bounding box of each mesh."""
    return vertices.groupBy(*keys).agg(F.count("*").alias("nv"), *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def span(a: str, prefix: str = "") -> Column:
    return F.col(f"{prefix}max_{a}") - F.col(f"{prefix}min_{a}")


def siblings(f: DataFrame) -> DataFrame:
    """Each mesh with each other mesh of its item; the other's columns begin with o_."""
    other = f.select(F.col("item"), *[F.col(c).alias(f"o_{c}") for c in f.columns if c != "item"])
    return f.join(other, "item").where("mesh <> o_mesh")


def is_jpeg(path: Column) -> Column:
    return extension(path).isin(*JPEG)


def is_tga(path: Column) -> Column:
    return extension(path) == ".tga"


def is_additive(path: Column) -> Column:
    return F.endswith(F.lower(stem(path)), F.lit("_r"))


def in_list(path: Column, names: Column) -> Column:
    """Whether the stem is in a list, letter case aside."""
    return F.array_contains(F.transform(names, F.lower), F.lower(stem(path)))


def tint_applies(path: Column, names: Column) -> Column:
    """An empty list means all meshes."""
    return (F.size(names) == 0) | in_list(path, names)


def is_billboard(nv: Column, nt: Column, path: Column) -> Column:
    return nv.between(1, 16) & (nt <= 12) & is_jpeg(path)


def is_effect(path: Column, nv: Column, nt: Column, largest: Column, patterns: dict) -> Column:
    """By name (an anchored pattern, parts, beginnings), or by being small: up to 8 vertices and 4 triangles within a span of 20."""
    s = F.lower(stem(path))
    named = s.rlike(patterns["anchored"])
    for p in patterns["parts"]:
        named |= F.contains(s, F.lit(p))
    for p in patterns["beginnings"]:
        named |= F.startswith(s, F.lit(p))
    return named | ((nv <= 8) & (nt <= 4) & (nv > 0) & (largest <= 20))


def ratio_exceeds(ratio: float, a: str = "", b: str = "o_") -> Column:
    """Some axis of a is longer than ratio times that of b; axes where b is flat don't count."""
    return reduce(lambda x, y: x | y, [F.coalesce((span(k, b) >= 0.001) & (span(k, a) / F.nullif(span(k, b), F.lit(0.0)) > ratio), F.lit(False)) for k in AXES])


def boxes_overlap(a: str = "", b: str = "o_", least: float = 0.40) -> Column:
    """On each axis the boxes share so much of the longer span; axes where both are flat don't count."""

    def axis(k: str) -> Column:
        longest = F.greatest(span(k, a), span(k, b))
        shared = F.least(F.col(f"{a}max_{k}"), F.col(f"{b}max_{k}")) - F.greatest(F.col(f"{a}min_{k}"), F.col(f"{b}min_{k}"))
        return (longest < 0.001) | ((shared > 0) & (shared / F.nullif(longest, F.lit(0.0)) >= least))

    return reduce(lambda x, y: x & y, [F.coalesce(axis(k), F.lit(False)) for k in AXES])


def within_factor(a: str, b: str, factor: int = 2) -> Column:
    return (F.col(a) <= F.col(b) * factor) & (F.col(b) <= F.col(a) * factor)


def sibling_flags(f: DataFrame) -> DataFrame:
    """f with alpha_overlay, has_additive_twin, contained, jpeg_under_tga, has_tga_sibling. f has nv, nt, boxes, path, width, height."""
    p, o = F.col("path"), F.col("o_path")
    alpha = is_tga(p) & is_jpeg(o) & (F.col("o_nv") > 0) & (F.col("o_nt") > 0) & ~is_additive(o) & ~F.coalesce((F.col("o_nv") <= 12) & (F.col("o_width") <= 32) & (F.col("o_height") <= 32), F.lit(False)) & within_factor("nv", "o_nv") & within_factor("nt", "o_nt") & boxes_overlap() & ~ratio_exceeds(1.7)
    twin = is_additive(o) & (F.col("nv") == F.col("o_nv")) & (F.col("nt") == F.col("o_nt"))
    inside = sum(((F.col(f"min_{k}") >= F.col(f"o_min_{k}") - 1) & (F.col(f"max_{k}") <= F.col(f"o_max_{k}") + 1)).cast("int") for k in AXES)
    contained = (F.col("o_nv") > F.col("nv")) & (F.col("nv") > 0) & (inside >= 2)
    under = is_jpeg(p) & is_tga(o) & (F.lower(stem(p)) == F.lower(stem(o))) & (F.col("o_nv") >= 0.5 * F.col("nv")) & ratio_exceeds(1.5)
    tests = {"alpha_overlay": alpha, "has_additive_twin": twin, "contained": contained, "jpeg_under_tga": under, "has_tga_sibling": is_tga(o)}
    found = siblings(f).groupBy("item", "mesh").agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    return f.join(found, ["item", "mesh"], "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in tests})


def duplicate_overlay(f: DataFrame) -> DataFrame:
    """f with duplicate_overlay: not TGA, and an earlier mesh has the same counts and the same stem without closing digits."""
    earlier = F.count("*").over(Window.partitionBy("item", "nv", "nt", stem_base(F.col("path"))).orderBy("mesh").rowsBetween(Window.unboundedPreceding, -1))
    return f.withColumn("duplicate_overlay", (earlier > 0) & ~is_tga(F.col("path")))


def mean_brightness(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3


def is_bright_glow(path: Column, r: Column, g: Column, b: Column) -> Column:
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    saturation = F.when(most > 0, (most - least) / most).otherwise(0.0)
    return F.coalesce(is_jpeg(path) & (mean_brightness(r, g, b) > 180) & (saturation < 0.25), F.lit(False))


def is_dark_filler(width: Column, height: Column, r: Column, g: Column, b: Column) -> Column:
    return F.coalesce((width <= 16) & (height <= 16) & (mean_brightness(r, g, b) < 10), F.lit(False))


def is_paired_glow(path: Column, has_tga_sibling: Column, nv: Column, width: Column, height: Column) -> Column:
    return F.coalesce(is_jpeg(path) & has_tga_sibling & (nv <= 12) & (width <= 32) & (height <= 32), F.lit(False))


def glow_filter(f: DataFrame) -> DataFrame:
    """f without glow layers. Groups of equal counts with both kinds of files go as a whole; of the rest the first mesh with most
    triangles is the body and stays; bright JPEGs, dark fillers and unresolved textures go; an item keeps all if nothing is left.
    f has path, nv, nt, width, height, r, g, b; an unresolved texture has null width."""
    same = Window.partitionBy("item", "nv", "nt")
    path = F.col("path")
    rows = f.withColumn("_pair", (F.count("*").over(same) >= 2) & F.bool_or(is_jpeg(path)).over(same) & F.bool_or(is_tga(path)).over(same))
    best = F.max(F.when(~F.col("_pair") & (F.col("nt") > 0), F.struct("nt", (-F.col("mesh")).alias("m")))).over(Window.partitionBy("item"))
    rows = rows.withColumn("_body", F.coalesce(-best["m"] == F.col("mesh"), F.lit(False)))
    go = is_bright_glow(path, F.col("r"), F.col("g"), F.col("b")) | is_dark_filler(F.col("width"), F.col("height"), F.col("r"), F.col("g"), F.col("b")) | F.col("width").isNull()
    return keep_unless_all(rows.withColumn("_go", F.col("_pair") | (~F.col("_body") & go)), F.col("_go"), ["item"]).drop("_pair", "_body", "_go")


def passes(f: DataFrame, force_additive: Column, on_top: bool) -> DataFrame:
    """f with pass: force_top or force_under, additive, alpha or opaque; an item without an opaque mesh gets its first one made so."""
    path = F.col("path")
    kind = F.when(force_additive, "force_top" if on_top else "force_under").when(is_additive(path) | (is_billboard(F.col("nv"), F.col("nt"), path) & ~F.col("has_additive_twin") & ~F.col("contained")) | F.col("duplicate_overlay"), "additive")
    kind = kind.when(is_paired_glow(path, F.col("has_tga_sibling"), F.col("nv"), F.col("width"), F.col("height")), "additive").when(F.col("alpha_overlay"), "alpha").otherwise("opaque")
    rows = f.withColumn("pass", kind)
    item = Window.partitionBy("item")
    none = F.count_if(F.col("pass") == "opaque").over(item) == 0
    first = F.min(F.when(F.col("pass").isin("additive", "alpha"), F.struct(F.when(F.col("pass") == "additive", 0).otherwise(1).alias("k"), "mesh"))).over(item)["mesh"]
    return rows.withColumn("pass", F.when(none & (F.col("mesh") == first), "opaque").otherwise(F.col("pass")))


def inside_earlier(f: DataFrame, slack: float = 2.0) -> DataFrame:
    """f (pass, path, screen box min_px..max_py) with decoration: an opaque TGA mesh whose box on the screen lies within that of an
    earlier opaque mesh of its item, slack pixels aside; such meshes are drawn nearer."""
    opaque = f.where("pass = 'opaque'")
    earlier = (F.col("o_mesh") < F.col("mesh")) & is_tga(F.col("path"))
    for k in ("px", "py"):
        earlier &= (F.col(f"min_{k}") >= F.col(f"o_min_{k}") - slack) & (F.col(f"max_{k}") <= F.col(f"o_max_{k}") + slack)
    found = siblings(opaque).groupBy("item", "mesh").agg(F.bool_or(earlier).alias("decoration"))
    return f.join(found, ["item", "mesh"], "left").withColumn("decoration", F.coalesce("decoration", F.lit(False)))


def draw_order(f: DataFrame) -> DataFrame:
    """f (pass) with order: the union of an item's passes, one after the other, each by mesh."""
    rank = F.array_position(F.array(*map(F.lit, ("force_under", "opaque", "alpha", "additive", "force_top"))), F.col("pass"))
    return f.withColumn("order", F.row_number().over(Window.partitionBy("item").orderBy(rank, "mesh")))


def flatness(f: DataFrame) -> DataFrame:
    """f with flat: the shortest span is under a twentieth of the longest."""
    s = [span(k) for k in AXES]
    return f.withColumn("flat", F.coalesce(F.least(*s) / F.nullif(F.greatest(*s), F.lit(0.0)) < 0.05, F.lit(False)))


def area_by_direction(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """Summed area by the axis that the face normal points along most. triangles: keys, ax..cz."""
    e = {f"e{i}{k}": F.col(f"{p}{k}") - F.col(f"a{k}") for i, p in ((1, "b"), (2, "c")) for k in AXES}
    n = {"nx": e["e1y"] * e["e2z"] - e["e1z"] * e["e2y"], "ny": e["e1z"] * e["e2x"] - e["e1x"] * e["e2z"], "nz": e["e1x"] * e["e2y"] - e["e1y"] * e["e2x"]}
    rows = triangles.select(*keys, *[c.alias(k) for k, c in n.items()])
    ax, ay, az = F.abs("nx"), F.abs("ny"), F.abs("nz")
    sign = lambda c: F.when(F.col(c) >= 0, F.lit("+")).otherwise(F.lit("-"))
    way = F.when((ax >= ay) & (ax >= az), F.concat(sign("nx"), F.lit("x"))).when(ay >= az, F.concat(sign("ny"), F.lit("y"))).otherwise(F.concat(sign("nz"), F.lit("z")))
    return rows.select(*keys, way.alias("direction"), (F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) / 2).alias("area")).groupBy(*keys, "direction").agg(F.sum("area").alias("area"), F.count("*").alias("faces"))
