"""Cameras, skinning, gathering, light and whole pictures over the driver tables: embeddings are triangles and textures, lineitem has vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import linalg as L
from tesserae.operators import camera as C
from tesserae.operators import raster as R
from tesserae.operators import render as D
from tesserae.operators import skeleton as S
from tesserae.plans.bindings import VERTICES, table, vertices
from tesserae.plans.mesh_queries import TURN, TURNED
from tesserae.plans.raster_queries import FRAGMENTS, N, SIZE, TRIANGLES, triangles
from tesserae.plans.registry import query


def times(*ms: list[str]) -> list[str]:
    """The product of matrices of SQL expressions."""
    out = ms[0]
    for m in ms[1:]:
        out = ["(" + " + ".join(f"{out[3 * i + k]} * {m[3 * k + j]}" for k in range(3)) + ")" for i in range(3) for j in range(3)]
    return out


def turn(axis: str, degrees: str) -> list[str]:
    c, s, n = f"cos(radians({degrees}))", f"sin(radians({degrees}))", f"(-sin(radians({degrees})))"
    one, zero = "1.0::double", "0.0::double"
    return {"x": [one, zero, zero, zero, c, n, zero, s, c], "y": [c, zero, s, zero, one, zero, n, zero, c], "z": [c, n, zero, s, c, zero, zero, zero, one]}[axis]


MIRROR = [f"{x}::double" for x in ("-1", "0", "0", "0", "1", "0", "0", "0", "1")]
FALLBACK = times(MIRROR, turn("x", "-15"), turn("y", "12"), turn("x", "-90"))
USUAL = times(turn("z", "15"), turn("y", "270"), turn("x", "180"))
NOFLIP = times(MIRROR, turn("x", "-15"))
FIXED = f"fixed as (select {', '.join(f'{x} as f{i}, {USUAL[i]} as u{i}, {NOFLIP[i]} as n{i}' for i, x in enumerate(FALLBACK))}), fix as (select *, {', '.join(f'{x} as c{i}' for i, x in enumerate(times([f'f{i}' for i in range(9)], [f'u{3 * j + i}' for i in range(3) for j in range(3)])))} from fixed)"
NEAR = lambda a: f"least((rot_y - {a} + 7200) % 360, 360 - (rot_y - {a} + 7200) % 360) <= 45"
ENTRIES = "entries as (select p_partkey, ((p_size * 15) % 360)::double as rot_x, ((p_partkey * 37) % 720 - 360)::double as rot_y, (p_partkey % 90)::double as rot_z, case p_partkey % 7 when 0 then 'noflip' when 1 then 'correction' when 2 then 'fallback' else '' end as camera, p_partkey % 11 <> 0 as has_entry from part)"


@query(f"with {FIXED} select " + ", ".join(f"round(f{i}, 6) + 0.0 as f{i}, round(c{i}, 6) + 0.0 as c{i}, round(n{i}, 6) + 0.0 as n{i}" for i in range(9)) + " from fix")
def G16_camera_constants(spark, sf):
    return spark.range(1).select(*[(F.round(F.lit(float(x)), 6) + 0.0).alias(f"{k}{i}") for i in range(9) for k, x in (("f", C.FALLBACK[i]), ("c", C.CORRECTION[i]), ("n", C.NOFLIP[i]))])


OWN = times(turn("z", "rot_z"), turn("y", "rot_y"), turn("x", "rot_x"))


@query(f"""with {FIXED}, {ENTRIES}, o as (select *, {', '.join(f'{x} as o{i}' for i, x in enumerate(OWN))}, case when not has_entry then 'fallback' when camera <> '' then camera when {NEAR(270)} then 'correction' when {NEAR(90)} then 'fallback' else 'noflip' end as route from entries)
select p_partkey, """ + ", ".join(f"round(case route when 'fallback' then f{i} when 'correction' then {times([f'c{k}' for k in range(9)], [f'o{k}' for k in range(9)])[i]} else {times([f'n{k}' for k in range(9)], [f'o{k}' for k in range(9)])[i]} end, 6) + 0.0 as m{i}" for i in range(9)) + " from o, fix")
def G4_view_matrix(spark, sf):
    """All nine cells, over all routes and without an entry."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    camera = F.when(k % 7 == 0, "noflip").when(k % 7 == 1, "correction").when(k % 7 == 2, "fallback").otherwise("")
    m = C.view_matrix(((F.col("p_size") * 15) % 360).cast("double"), ((k * 37) % 720 - 360).cast("double"), (k % 90).cast("double"), camera, k % 11 != 0)
    return p.select("p_partkey", *[(F.round(x, 6) + 0.0).alias(f"m{i}") for i, x in enumerate(m)])


@query(f"""with {VERTICES}, r as (select item, mesh, {', '.join(f'{t} as t{k}' for t, k in zip(TURNED, 'xyz'))} from vertices),
b as (select item, {', '.join(f'(min(t{k}) + max(t{k})) / 2 as c{k}' for k in 'xyz')}, 0.3::double * (max(ty) - min(ty)) as h, greatest((max(tx) - min(tx)) / 2, (max(ty) - min(ty)) / 2, 0.001) / tan(radians(case when item % 4 = 0 then 75.0 else 40.0 end / 2)) as d from r group by item),
l as (select *, greatest(sqrt(h * h + d * d), 0.001) as len from b),
e as (select r.item, mesh, tz, tx - cx as x, ty - cy - h as y, tz - cz - d as z, h, d, len from r join l on r.item = l.item),
s as (select item, mesh, tz, x * len / greatest(-(h * y + d * z) / len, 0.1) as sx, -((d * y - h * z) / len) * (len / greatest(-(h * y + d * z) / len, 0.1)) as sy from e),
f as (select item, (min(sx) + max(sx)) / 2 as mx, (min(sy) + max(sy)) / 2 as my, least(224 / greatest(max(sx) - min(sx), 0.001), 224 / greatest(max(sy) - min(sy), 0.001)) as fit from s group by item)
select s.item, mesh, round((sx - mx) * fit + 128, 3) as px, round((sy - my) * fit + 128, 3) as py, round(tz, 4) as pz from s join f on s.item = f.item""")
def G6_positioned_camera(spark, sf):
    """The camera of each item's box, and G7, the projection it gives each vertex."""
    v = C.rotated(vertices(spark, sf), [F.lit(c) for row in TURN for c in row])
    v = C.positioned(v, F.lit(0.3), F.when(F.col("item") % 4 == 0, 0.0).otherwise(40.0), 256, 256, 16)
    return v.select("item", "mesh", *[F.round(k, n).alias(k) for k, n in (("px", 3), ("py", 3), ("pz", 4))])


BONE = "b as (select s as bone, 0.3::double * s as a, 1.5::double * s as t from generate_series(0, 4) as g(s))"


@query(f"with {VERTICES}, {BONE}, r as (select item, mesh, node, case when bone is null then x else x + t end as x, case when bone is null then y else y * cos(a) - z * sin(a) end as y, case when bone is null then z else y * sin(a) + z * cos(a) end as z from vertices left join b on node = bone) select item, mesh, node, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from r")
def G2_skinning(spark, sf):
    """Each vertex moved by its bone's turn about x and step along x; nodes 5 and 6 have no bone."""
    b = spark.range(5).select(F.col("id").alias("bone"), (F.col("id") * 0.3).alias("a"), (F.col("id") * 1.5).alias("t"))
    worlds = b.select("bone", S.local_matrix(F.col("a"), F.lit(0.0), F.lit(0.0), F.col("t"), F.lit(0.0), F.lit(0.0)).alias("world"))
    return S.skin(vertices(spark, sf), worlds).select("item", "mesh", "node", *[F.round(F.col(k).cast("double"), 3).alias(k) for k in "xyz"])


@query(f"with {VERTICES}, {BONE}, r as (select item, x, case when bone is null then y else y * cos(a) - z * sin(a) end as y2, y from vertices left join b on node = bone) select item, round(min(y), 3) as before_min, round(max(y), 3) as before_max, round(min(y2), 3) as after_min, round(max(y2), 3) as after_max from r group by item")
def X6_before_and_after_bones(spark, sf):
    """The inspector of what bones do to an item's height."""
    box = lambda df, n: df.groupBy("item").agg(*[F.round(f(F.col("y").cast("double")), 3).alias(f"{n}_{m}") for m, f in (("min", F.min), ("max", F.max))])
    v = vertices(spark, sf)
    b = spark.range(5).select(F.col("id").alias("bone"), (F.col("id") * 0.3).alias("a"), (F.col("id") * 1.5).alias("t"))
    worlds = b.select("bone", S.local_matrix(F.col("a"), F.lit(0.0), F.lit(0.0), F.col("t"), F.lit(0.0), F.lit(0.0)).alias("world"))
    return box(v, "before").join(box(S.skin(v, worlds), "after"), "item")


def models(spark, sf):
    """An embedding as a mesh of 21 corners and 10 texture places, with four triangles whose indexes now and then lead nowhere."""
    e = table(spark, sf, "embeddings").where("embedding is not null and size(embedding) >= 63")
    at = lambda i: F.round(F.get("embedding", i).cast("double"), 4)
    corners = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(at(3 * i).alias("x"), at(3 * i + 1).alias("y"), at(3 * i + 2).alias("z")))
    places = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(at(2 * i).alias("u"), at(2 * i + 1).alias("v")))
    index = lambda k, n: F.array(*[((F.col("vec_id") * (j + 2) + k * 5 + j) % n - 1).cast("int") for j in range(3)])
    tris = F.array(*[F.struct(index(k, 23).alias("vi"), index(k, 12).alias("ti")) for k in range(4)])
    return e.select("vec_id", corners.alias("vertices"), places.alias("uvs"), tris.alias("tris"))


INDEX = lambda j, n: f"((vec_id * {j + 2} + k * 5 + {j}) % {n} - 1)::int"


@query(f"""with t as (select vec_id, embedding as e, k, {', '.join(f'{INDEX(j, 23)} as v{j}, {INDEX(j, 12)} as t{j}' for j in range(3))} from embeddings, generate_series(0, 3) as g(k) where embedding is not null and len(embedding) >= 63)
select vec_id, k::int as tri, {', '.join(f'round(e[3 * v{j} + {c + 1}]::double, 4) as {n}{j}' for j in range(3) for c, n in enumerate('xyz'))}, case when least(t0, t1, t2) >= 0 and greatest(t0, t1, t2) < 10 then round(e[2 * t0 + 1]::double, 4) end as u0, case when least(t0, t1, t2) >= 0 and greatest(t0, t1, t2) < 10 then round(e[2 * t2 + 2]::double, 4) end as v2 from t where least(v0, v1, v2) >= 0 and greatest(v0, v1, v2) < 21""")
def J11_corner_gather(spark, sf):
    return D.gather(models(spark, sf)).select("vec_id", "tri", *[f"{k}{i}" for i in range(3) for k in "xyz"], "u0", "v2")


#: The unit vectors and strengths of the light as SQL.
DOT = lambda v: "(nx * {!r}::double + ny * {!r}::double + nz * {!r}::double)".format(*v)
SHADE = f"""n0 as (select *, {', '.join(f'{v} as mx{k[1]}' for k, v in N.items())} from tri), n1 as (select *, sqrt(mxx * mxx + mxy * mxy + mxz * mxz) as nl from n0),
n2 as (select *, mxx / nl as nx, mxy / nl as ny, mxz / nl as nz from n1 where nl >= 1e-8),
lit as (select image, tri, 0.55::double + ((1.0 - abs(ny)) * 0.5 + 0.5) * 0.5 + abs({DOT(D.LIGHT)}) * 1.5 + abs({DOT(D.RIM)}) * 0.6 + pow(greatest({DOT(D.HALF)}, 0.0), 12) * 0.45 as shade from n2)"""


@query(f"with {TRIANGLES}, {SHADE} select image, tri, round(shade, 6) as shade from lit")
def R8_light(spark, sf):
    return D.with_shade(triangles(spark, sf)).select("image", "tri", F.round("shade", 6).alias("shade"))


def drawn(spark, sf):
    """The triangles as meshes: colours, alpha and pass by key; every seventh is next to transparent."""
    t = D.with_shade(triangles(spark, sf))
    f = R.fragments(t, SIZE, SIZE, [])
    k = F.col("tri")
    kind = F.element_at(F.array(*map(F.lit, ("opaque", "opaque", "alpha", "additive", "unlit", "overlay"))), (k % 6 + 1).cast("int"))
    return f.withColumns({"cr": (k * 37 % 256).cast("int"), "cg": (k * 91 % 256).cast("int"), "cb": (k * 13 % 256).cast("int"), "ca": F.when(k % 7 == 0, 4).otherwise(k % 200 + 56).cast("int"), "order": k, "kind": kind})


TONE = lambda c: f"(pow({c} / 255.0, 2.2) * shade * 1.05::double)"
LIT = lambda c: f"round(pow(({TONE(c)} * (2.51::double * {TONE(c)} + 0.03::double)) / ({TONE(c)} * (2.43::double * {TONE(c)} + 0.59::double) + 0.14::double), 1.0::double / 2.2) * 255, 6)"
BYTE = lambda v: f"floor(least(greatest({v}, 0.0), 255.0) + 0.5)::int"


@query(f"""with {FRAGMENTS}, {SHADE}, o as (select f.*, row_number() over (partition by f.image, sx, sy order by z desc, f.tri desc) as n from frag f where f.tri % 6 < 2 and f.tri % 7 <> 0),
c as (select o.image, sx, sy, o.tri, z, shade, (o.tri * 37 % 256)::double as cr, (o.tri * 91 % 256)::double as cg, o.tri % 200 + 56 as a from o join lit on o.image = lit.image and o.tri = lit.tri where n = 1)
select image, sx, sy, round(z, 4) as z, {BYTE(LIT('cr'))} as r, {BYTE(LIT('cg'))} as g, a::int as a from c""")
def R2_opaque_pass(spark, sf):
    """The opaque pass: light, tone curve and depth."""
    f = D.shaded(drawn(spark, sf).where("kind = 'opaque'"), F.col("kind"))
    return D.pixels(f, ["image"]).select("image", "sx", "sy", F.round("z", 4).alias("z"), "r", "g", "a")


@query()
def R1_render(spark, sf):
    """All passes; a pixel's layers in order, as SQL's aggregates can't fold them. Tests hold it against a painter that goes triangle by triangle."""
    return D.pixels(D.shaded(drawn(spark, sf), F.col("kind")), ["image"])
