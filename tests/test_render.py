"""Whole pictures against a painter that draws triangle by triangle, textures against sampling by hand, and the parts that a mesh keeps."""

from math import floor

from pyspark.sql import functions as F

from tesserae.operators import components, render
from tesserae.plans import registry
from tesserae.plans.render_queries import drawn

SF = "/root/testdata/sf0.001"


def clamp(v):
    return floor(min(max(v, 0.0), 255.0) + 0.5)


def lit(c, light, exposure):
    x = (c / 255.0) ** 2.2 * light * exposure
    return round((x * (2.51 * x + 0.03) / (x * (2.43 * x + 0.59) + 0.14)) ** (1 / 2.2) * 255, 6)


def test_painter(spark):
    layers = {}
    for r in drawn(spark, SF).select("image", "sx", "sy", "z", "tri", "kind", "shade", "cr", "cg", "cb", "ca").collect():
        layers.setdefault((r.image, r.sx, r.sy), []).append(r)
    want = {}
    stage = {"opaque": 0, "unlit": 0, "alpha": 1, "additive": 2, "overlay": 3}
    for pixel, rows in layers.items():
        depth, colour, alpha = float("-inf"), [0, 0, 0], 0
        for r in sorted(rows, key=lambda r: (stage[r.kind], r.tri)):
            if r.ca < 8:
                continue
            plain = r.kind == "unlit"
            f = [lit(c, 1.0 if plain else r.shade, 1.0 if plain else 1.05) for c in (r.cr, r.cg, r.cb)]
            lum = f[0] * 0.299 + f[1] * 0.587 + f[2] * 0.114
            if stage[r.kind] == 0 and r.z >= depth:
                depth, colour, alpha = r.z, [clamp(x) for x in f], r.ca
            elif r.kind == "alpha" and r.z >= depth:
                a = r.ca / 255.0
                colour, alpha = [clamp(x * a + c * (1 - a)) for x, c in zip(f, colour, strict=True)], clamp(r.ca + alpha * (1 - a))
            elif stage[r.kind] >= 2 and lum >= 80 and r.z >= depth - 0.5 and (r.kind == "additive" or depth > float("-inf")):
                colour, alpha = [clamp(c + x) for x, c in zip(f, colour, strict=True)], max(alpha, clamp(lum))
        if alpha:
            want[pixel] = (*colour, alpha)
    got = {(r.image, r.sx, r.sy): (r.r, r.g, r.b, r.a) for r in registry.QUERIES["R1_render"](spark, SF).collect()}
    assert got.keys() == want.keys()
    near = sum(max(abs(a - b) for a, b in zip(got[k], want[k], strict=True)) <= 1 for k in want)
    assert near == len(want) and sum(got[k] == want[k] for k in want) > 0.999 * len(want)


def test_textured_square_and_empty_picture(spark):
    """Two triangles facing the viewer with a 2 x 2 texture; a mesh whose texture isn't there is plain; nothing gives nothing."""
    row = lambda order, texture, corners, uv, kind="opaque": {"image": 1, "order": order, "pass": kind, "z_bias": 0.0, "texture": texture} | {f"{k}{i}": float(c) for i, p in enumerate(corners) for k, c in zip("xyz", p, strict=True)} | {f"{k}{i}": c for i, p in enumerate(uv) for k, c in zip("uv", p, strict=True)}
    a, b, c, d = (0, 0, 0), (9, 0, 0), (9, 9, 0), (0, 9, 0)
    schema = "image long, order long, pass string, z_bias double, texture string, " + ", ".join(f"{k}{i} double" for i in range(3) for k in "xyzuv")
    rows = [row(1, "t", (a, b, c), ((0.0, 0.0), (0.999, 0.0), (0.999, 0.999))), row(2, "t", (a, c, d), ((0.0, 0.0), (0.999, 0.999), (0.0, 0.999))), row(3, "gone", ((12, 0, 0), (15, 0, 0), (15, 9, 0)), ((None, None),) * 3, "unlit")]
    tri = spark.createDataFrame(rows, schema)
    tex = spark.createDataFrame([("t", 2, 2, [0, 255, 0, 255], [10] * 4, [0, 0, 255, 255], [255] * 4, 127, 10, 127)], "texture string, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>, mr int, mg int, mb int")
    got = {(x.sx, x.sy): x for x in render.render(tri, tex, 16, 10, ["image"]).collect()}
    assert got[0, 0].r < got[4, 0].r < got[8, 0].r and got[0, 0].b < got[0, 4].b < got[0, 8].b and all(x.a == 255 for x in got.values())
    assert (got[14, 1].r, got[14, 1].g, got[14, 1].b) == tuple(clamp(lit(v, 1.0, 1.0)) for v in (160, 160, 170))
    assert render.render(tri.where("false"), tex, 16, 10, ["image"]).count() == 0


def test_kept_parts_by_distance(spark):
    """A flat part 10 x 10 keeps a small one a unit above it and another 3.9 away, drops one 4.1 away; small meshes and single parts keep all; lone vertices are no parts."""
    points = []

    def part(mesh, label, n, x, y, z, size=0.0):
        points.extend((mesh, label, x + size * (i % 2), y + size * (i // 2 % 2), z) for i in range(n))

    part(1, 0, 40, 0.0, 0.0, 0.0, 10.0)
    part(1, 100, 5, 5.0, 5.0, 1.0)
    part(1, 200, 5, 13.9, 5.0, 0.0)
    part(1, 300, 5, 14.1, 5.0, 0.0)
    part(1, 400, 6, 99.0, 0.0, 0.0)
    part(2, 0, 7, 0.0, 0.0, 0.0, 1.0)
    part(2, 100, 5, 50.0, 0.0, 0.0)
    part(3, 0, 20, 0.0, 0.0, 0.0, 1.0)
    part(3, 100, 1, 50.0, 0.0, 0.0)
    df = spark.createDataFrame(points, "mesh int, label int, x double, y double, z double")
    got = {(r.mesh, r.label): r.keep for r in components.kept_parts(components.part_features(df, ["mesh"]), ["mesh"]).collect()}
    assert [k for k, keep in got.items() if not keep] == [(1, 300)]


def test_long_chains_and_wide_ranges(spark):
    """No cap: a chain of 300 bones has all its ancestors, a range of 5,000 indexes all its rows."""
    from tesserae.operators import config, skeleton

    bones = spark.range(300).select(F.col("id").alias("bone"), (F.col("id") - 1).alias("parent"))
    assert skeleton.chains(bones).where("bone = 299").count() == 300
    ranges = spark.createDataFrame([(1, 0, 4999, "1_0-4999"), (1, 10, 12, "1_10-12")], "section int, first int, last int, key string")
    rows = config.expand_ranges(ranges, "key")
    assert rows.count() == 5000 and rows.where("key = '1_10-12'").count() == 3
