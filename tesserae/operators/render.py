"""From projected triangles to pixels: light, texture, and one fold of each pixel's layers in the order in which they are drawn.

Fragments come from operators.raster; a fragment is shaded where it arises, and the layers of a pixel meet once, by (image, pixel). A
pixel's layers are as many as meshes are drawn over it, so the fold is as long as the picture is deep and not as the mesh is large.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import raster as R


def _unit(x: float, y: float, z: float) -> tuple[float, float, float]:
    n = sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n


#: Directions of light, rim and view, and strengths.
LIGHT, RIM, VIEW = _unit(180, 260, 140), _unit(-160, 130, -210), _unit(0, -110, -400)
HALF = _unit(*(a - b for a, b in zip(LIGHT, VIEW, strict=True)))
AMBIENT, HEMISPHERE, DIRECT, RIM_LIGHT, SPECULAR, POWER = 0.55, 0.50, 1.50, 0.60, 0.45, 12.0
#: Texels below this alpha aren't drawn, additive ones below this luminance neither, and how far behind they may lie.
LEAST_ALPHA, DARK, BEHIND = 8, 80.0, 0.5
#: The colour of a mesh without a texture.
PLAIN = (160, 160, 170, 255)
#: Passes in the order in which they are drawn. Unlit is opaque without light; overlay is additive over geometry only.
PASSES = ("opaque", "unlit", "alpha", "additive", "overlay")


def normal() -> list[Column]:
    """Of the triangle x0..z2, not scaled; its length is nothing for a triangle without area."""
    e = lambda i, k: F.col(f"{k}{i}") - F.col(f"{k}0")
    return [e(1, "y") * e(2, "z") - e(1, "z") * e(2, "y"), e(1, "z") * e(2, "x") - e(1, "x") * e(2, "z"), e(1, "x") * e(2, "y") - e(1, "y") * e(2, "x")]


def shade(n: list[Column]) -> Column:
    """Light on a face with unit normal n, seen from both sides: ambient, hemisphere, main and rim light, highlight."""
    dot = lambda v: n[0] * v[0] + n[1] * v[1] + n[2] * v[2]
    fill = ((1.0 - F.abs(n[1])) * 0.5 + 0.5) * HEMISPHERE
    spot = F.pow(F.greatest(dot(HALF), F.lit(0.0)), F.lit(POWER)) * SPECULAR
    return AMBIENT + fill + F.abs(dot(LIGHT)) * DIRECT + F.abs(dot(RIM)) * RIM_LIGHT + spot


def with_shade(triangles: DataFrame) -> DataFrame:
    """triangles with shade; those without area go."""
    n = normal()
    rows = triangles.withColumns({"_nx": n[0], "_ny": n[1], "_nz": n[2]}).withColumn("_n", F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz")))
    return rows.where("_n >= 1e-8").withColumn("shade", shade([F.col(f"_n{k}") / F.col("_n") for k in "xyz"])).drop("_nx", "_ny", "_nz", "_n")


def lit(c: Column, light: Column, exposure: Column) -> Column:
    """An 8-bit channel after light, exposure and tone curve, not yet rounded to 8 bits."""
    return F.round(F.pow(R.tone_map(R.to_linear(c) * light * exposure), F.lit(1.0 / R.GAMMA)) * 255, 6)


def gather(meshes: DataFrame) -> DataFrame:
    """A row for each triangle of meshes (keys, vertices array<struct x y z>, uvs array<struct u v>, tris array<struct vi array, ti array>):
    its corners x0..z2 and texture places u0..v2. One with a corner that isn't there goes; one with a texture place that isn't there has null places."""
    keys = [c for c in meshes.columns if c not in ("vertices", "uvs", "tris")]
    rows = meshes.select(*keys, "vertices", "uvs", F.posexplode("tris").alias("tri", "t"))
    here = lambda i, n: (i >= 0) & (i < F.size(n))
    vi, ti = [F.col("t.vi")[i] for i in range(3)], [F.col("t.ti")[i] for i in range(3)]
    rows = rows.where(here(vi[0], "vertices") & here(vi[1], "vertices") & here(vi[2], "vertices"))
    textured = F.coalesce(here(ti[0], "uvs") & here(ti[1], "uvs") & here(ti[2], "uvs"), F.lit(False))
    corner = [F.get("vertices", v)[k].alias(f"{k}{i}") for i, v in enumerate(vi) for k in "xyz"]
    place = [F.when(textured, F.get("uvs", v)[k]).alias(f"{k}{i}") for i, v in enumerate(ti) for k in "uv"]
    return rows.select(*keys, "tri", *corner, *place)


def sampled(frags: DataFrame, textures: DataFrame) -> DataFrame:
    """frags (texture, w0..w2, u0..v2) with cr, cg, cb, ca: the texture's bilinear sample; without a texture or a place the mean colour of the texture, or PLAIN.

    textures: texture, width, height, r, g, b, a (arrays, row by row), mr, mg, mb (means). An unresolved one has no row.
    """
    t = textures.select(F.col("texture").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("width", "height", "r", "g", "b", "a", "mr", "mg", "mb")])
    rows = frags.join(t, F.col("texture") == F.col("_t"), "left")
    at = lambda k: sum((F.col(f"w{i}") * F.col(f"{k}{i}") for i in (1, 2)), F.col("w0") * F.col(f"{k}0"))
    sample = lambda c: R.bilinear(F.col(f"_{c}"), F.col("_width"), F.col("_height"), at("u"), at("v"))
    own = F.col("_t").isNotNull() & F.col("u0").isNotNull()
    out = {f"c{c}": F.when(own, sample(c)).otherwise(F.coalesce(F.col(f"_m{c}"), F.lit(PLAIN[i]))).cast("int") for i, c in enumerate("rgb")}
    out["ca"] = F.when(own, sample("a")).otherwise(PLAIN[3]).cast("int")
    return rows.withColumns(out).select(*frags.columns, *out)


def shaded(frags: DataFrame, passes: Column) -> DataFrame:
    """frags (shade, cr, cg, cb, ca) with fr, fg, fb: what they give to a pixel. Fragments that are next to transparent go; additive ones
    that are dark get no pass and are passed over when the pixel is drawn (a filter here would carry all of the light's expressions down to the scan)."""
    plain = passes == "unlit"
    light, exposure = F.when(plain, 1.0).otherwise(F.col("shade")), F.when(plain, 1.0).otherwise(R.EXPOSURE)
    rows = frags.where(F.col("ca") >= LEAST_ALPHA).withColumns({f"f{c}": lit(F.col(f"c{c}"), light, exposure) for c in "rgb"} | {"pass": passes})
    rows = rows.withColumn("lum", F.round(F.col("fr") * 0.299 + F.col("fg") * 0.587 + F.col("fb") * 0.114, 6))
    return rows.withColumn("pass", F.when(F.col("pass").isin("additive", "overlay") & (F.col("lum") < DARK), F.lit(None)).otherwise(F.col("pass")))


def _draw(s: Column, x: Column) -> Column:
    """The pixel s (z null: nothing there yet) after the layer x."""
    front = s["z"].isNull() | (x["z"] >= s["z"])
    near = s["z"].isNull() | (x["z"] >= s["z"] - BEHIND)
    adds = ((x["pass"] == "additive") | ((x["pass"] == "overlay") & s["z"].isNotNull())) & near
    covers, blends = x["pass"].isin("opaque", "unlit") & front, (x["pass"] == "alpha") & front
    a = x["ca"] / 255.0
    channel = lambda c: F.when(covers, R.clamp_round(x[f"f{c}"])).when(blends, R.clamp_round(x[f"f{c}"] * a + s[c] * (1.0 - a))).when(adds, R.clamp_round(s[c] + x[f"f{c}"])).otherwise(s[c])
    alpha = F.when(covers, x["ca"]).when(blends, R.clamp_round(x["ca"] + s["a"] * (1.0 - a))).when(adds, F.greatest(s["a"], R.clamp_round(x["lum"]))).otherwise(s["a"])
    return F.struct(F.when(covers, x["z"]).otherwise(s["z"]).alias("z"), *[channel(c).alias(c) for c in "rgb"], alpha.alias("a"))


def pixels(frags: DataFrame, image: list[str]) -> DataFrame:
    """image, sx, sy, z, r, g, b, a of all pixels that something is drawn on. frags: shaded() rows with z and order; a pixel's layers are drawn by pass and order."""
    rank = F.array_position(F.array(*map(F.lit, PASSES)), F.col("pass"))
    # opaque and unlit are one pass
    rank = F.when(rank <= 2, 1).otherwise(rank)
    layer = F.struct(rank.alias("rank"), "order", "z", "fr", "fg", "fb", "ca", "lum", "pass")
    empty = F.struct(F.lit(None).cast("double").alias("z"), *[F.lit(0).alias(c) for c in "rgba"])
    out = frags.groupBy(*image, "sx", "sy").agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    return out.select(*image, "sx", "sy", F.aggregate("layers", empty, _draw).alias("p")).select(*image, "sx", "sy", "p.*").where("a > 0")


def render(triangles: DataFrame, textures: DataFrame, width: int, height: int, image: list[str]) -> DataFrame:
    """Pixels of images from projected triangles (image, order, pass, z_bias, texture, x0..z2, u0..v2): a row for each pixel that is drawn, the rest is empty."""
    t = with_shade(triangles)
    keys = [c for c in t.columns if c not in [f"{k}{i}" for i in range(3) for k in "xyz"]]
    f = R.fragments(t, width, height, keys).withColumn("z", F.col("z") + F.col("z_bias"))
    return pixels(shaded(sampled(f, textures), F.col("pass")), image)
