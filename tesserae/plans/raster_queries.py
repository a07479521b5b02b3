"""Geometry and rasterization over embeddings as triangles on a 32x32 canvas, and suppliers as a bone forest."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from tesserae.functions import linalg as L
from tesserae.operators import mesh as M
from tesserae.operators import raster as R
from tesserae.operators import skeleton as S
from tesserae.plans.bindings import TEXELS, VERTICES, table, texels, vertices
from tesserae.plans.registry import query

SIZE = 32
XYZ = [f"{k}{i}" for i in range(3) for k in "xyz"]


def triangles(spark, sf):
    """Three corners from nine components, scaled to the canvas and rounded; the label is the image, the key the draw order."""
    e = table(spark, sf, "embeddings").where("embedding is not null and size(embedding) >= 9")
    at = lambda i: F.round((F.get("embedding", F.lit(i)).cast("double") + 0.55) * 29, 3)
    return e.select(F.col("label").alias("image"), F.col("vec_id").alias("tri"), *[at(i).alias(n) for i, n in enumerate(XYZ)])


TRIANGLES = "tri as (select label as image, vec_id as tri, " + ", ".join(f"round((embedding[{i + 1}]::double + 0.55) * 29, 3) as {n}" for i, n in enumerate(XYZ)) + " from embeddings where embedding is not null and len(embedding) >= 9)"
E2 = lambda a, b: f"((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))"
T = lambda a, b: f"case when {E2(a, b)} > 1 and abs(det) / sqrt({E2(a, b)}) < 1.5 then greatest(-2.0::double, -1.0 / (abs(det) / sqrt({E2(a, b)}))) else -0.001::double end"
FRAGMENTS = f"""{TRIANGLES}, t1 as (select *, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) as det, greatest(0, floor(least(x0, x1, x2))::int) as x_lo, least(31, floor(greatest(x0, x1, x2))::int + 1) as x_hi, greatest(0, floor(least(y0, y1, y2))::int) as y_lo, least(31, floor(greatest(y0, y1, y2))::int + 1) as y_hi from tri),
t2 as (select *, {T(1, 2)} as t0, {T(2, 0)} as t1, {T(0, 1)} as t2 from t1 where abs(det) >= 1e-8 and x_lo < x_hi and y_lo < y_hi),
sxs as (select *, unnest(generate_series(x_lo, x_hi))::int as sx from t2), sys as (select *, unnest(generate_series(y_lo, y_hi))::int as sy from sxs),
w as (select *, ((y1 - y2) * (sx - x2) + (x2 - x1) * (sy - y2)) / det as w0, ((y2 - y0) * (sx - x2) + (x0 - x2) * (sy - y2)) / det as w1 from sys),
frag as (select image, tri, sx, sy, w0, w1, 1.0::double - w0 - w1 as w2, w0 * z0 + w1 * z1 + (1.0::double - w0 - w1) * z2 as z from w where w0 >= t0 and w1 >= t1 and 1.0::double - w0 - w1 >= t2)"""


def frags(spark, sf):
    return R.fragments(triangles(spark, sf), SIZE, SIZE, ["image", "tri"])


@query(f"with {FRAGMENTS} select image, tri, sx, sy, round(w0, 5) as w0, round(w1, 5) as w1, round(z, 4) as z from frag")
def J12_fragments(spark, sf):
    return frags(spark, sf).select("image", "tri", "sx", "sy", F.round("w0", 5).alias("w0"), F.round("w1", 5).alias("w1"), F.round("z", 4).alias("z"))


@query(f"with {TRIANGLES}, d as (select tri, x0, y0, x1, y1, x2, y2, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) as det from tri) select tri, round({T(1, 2)}, 6) as t0, round({T(2, 0)}, 6) as t1, round({T(0, 1)}, 6) as t2 from d")
def R6_thin_thresholds(spark, sf):
    t = triangles(spark, sf).withColumn("det", F.expr("(y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)"))
    e = lambda a, b: F.expr(E2(a, b))
    return t.select("tri", *[F.round(R.thin_threshold(F.col("det"), e(a, b)), 6).alias(n) for n, a, b in (("t0", 1, 2), ("t1", 2, 0), ("t2", 0, 1))])


@query(f"with {FRAGMENTS} select image, sx, sy, tri, round(z, 4) as z, overdraw from (select *, row_number() over (partition by image, sx, sy order by z desc, tri desc) as n, count(*) over (partition by image, sx, sy) as overdraw from frag) where n = 1")
def A22_z_buffer(spark, sf):
    return R.nearest(frags(spark, sf), ["image"], F.col("tri"), "tri").select("image", "sx", "sy", F.col("value").alias("tri"), F.round("z", 4).alias("z"), "overdraw")


BASE = f"{FRAGMENTS}, base as (select image, sx, sy, z, tri % 256 as colour from (select *, row_number() over (partition by image, sx, sy order by z desc, tri desc) as n from frag where tri % 3 <> 0) where n = 1)"


def base(spark, sf):
    return R.nearest(frags(spark, sf).where("tri % 3 <> 0"), ["image"], F.col("tri"), "tri").select("image", "sx", "sy", "z", (F.col("value") % 256).alias("colour"))


@query(f"with {BASE}, a as (select b.image, b.sx, b.sy, sum(f.tri % 40) as added, count(*) as layers from base b join frag f on b.image = f.image and b.sx = f.sx and b.sy = f.sy where f.tri % 3 = 0 and f.z >= b.z - 0.5 group by 1, 2, 3) select b.image, b.sx, b.sy, least(255, b.colour + coalesce(added, 0))::int as colour, coalesce(layers, 0) as layers from base b left join a on b.image = a.image and b.sx = a.sx and b.sy = a.sy")
def A23_additive_fold(spark, sf):
    add = frags(spark, sf).where("tri % 3 = 0").withColumn("add", F.col("tri") % 40)
    return R.additive(base(spark, sf), add, ["image", "sx", "sy"]).select("image", "sx", "sy", F.col("colour").cast("int").alias("colour"), "layers")


@query()
def A24_alpha_fold(spark, sf):
    """An ordered fold for each pixel; layers of a pixel are as many as overlays are drawn there."""
    layers = F.collect_list(F.struct(F.col("tri").alias("o"), (F.col("tri") % 256).cast("int").alias("c"), (F.col("tri") % 200 + 20).cast("int").alias("a")))
    g = frags(spark, sf).groupBy("image", "sx", "sy").agg(layers.alias("l"))
    return g.select("image", "sx", "sy", R.alpha_fold(F.col("l"), F.lit(100)).alias("colour"))


@query(f"with {TRIANGLES}, q as (select image, tri, tri % 4 = 0 as quad from tri) select image, count(*) as polygons, sum(case when quad then 2 else 1 end)::bigint as triangles from q group by image")
def G17_quad_expansion(spark, sf):
    half = F.when(F.col("tri") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    t = triangles(spark, sf).select("image", "tri", F.explode(half).alias("half"))
    return t.groupBy("image").agg(F.count_if(F.col("half") == 0).alias("polygons"), F.count("*").alias("triangles"))


N = {"nx": "((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0))", "ny": "((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0))", "nz": "((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))"}


@query(f"with {TRIANGLES}, n as (select image, {', '.join(f'{v} as {k}' for k, v in N.items())} from tri), d as (select image, case when abs(nx) >= abs(ny) and abs(nx) >= abs(nz) then case when nx >= 0 then '+x' else '-x' end when abs(ny) >= abs(nz) then case when ny >= 0 then '+y' else '-y' end else case when nz >= 0 then '+z' else '-z' end end as direction, sqrt(nx*nx+ny*ny+nz*nz)/2 as area from n) select image, direction, round(sum(area), 4) as area, count(*) as faces from d group by 1, 2")
def A14_area_by_direction(spark, sf):
    t = triangles(spark, sf).select("image", *[F.col(f"{k}{i}").alias(f"{'abc'[i]}{k}") for i in range(3) for k in "xyz"])
    return M.area_by_direction(t, ["image"]).withColumn("area", F.round("area", 4))


@query(f"with {TEXELS} select image, x, y, floor(least(greatest(round(pow((r / 255.0) , 2.2), 6) * 255, 0.0), 255.0) + 0.5)::int as linear, round((r / 100.0::double) * (2.51::double * (r / 100.0::double) + 0.03::double) / ((r / 100.0::double) * (2.43::double * (r / 100.0::double) + 0.59::double) + 0.14::double), 6) as toned, floor(least(r * 1.3::double, 255.0))::int as tinted, case when alpha = 0 or greatest(r, g, b) < 40 then 0 else least(floor((greatest(r, g, b) - 40) * (255.0::double / (255.0::double - 40)))::int, 255) end as luminance from texels")
def R15_channel_operators(spark, sf):
    """Gamma, tone curve, tint and luminance ramp of each texel."""
    r, g, b, a = (F.col(c) for c in ("r", "g", "b", "alpha"))
    return texels(spark, sf).select("image", "x", "y", R.clamp_round(F.round(R.to_linear(r), 6) * 255).alias("linear"), F.round(R.tone_map(r / 100.0), 6).alias("toned"), R.tint(r, F.lit(1.3)).alias("tinted"), R.luminance_alpha(r, g, b, a, 40).alias("luminance"))


CLAMP = lambda v: f"floor(least(greatest({v}, 0.0), 255.0) + 0.5)::int"


@query(f"with {TEXELS}, p as (select image, x, y, r as d, alpha as da, g as s, (b * 5) % 256 as sa from texels), q as (select *, sa / 255.0::double as fs, da / 255.0::double as fd, sa / 255.0::double * (1.0 - da / 255.0::double) as share from p) select image, x, y, case when sa = 0 then d else {CLAMP('s * fs + d * (1.0 - fs)')} end as over_c, case when sa = 0 then da else floor(least(fs + fd * (1.0 - fs), 1.0) * 255.0 + 0.5)::int end as over_a, case when sa = 0 or share < 1.0::double / 255.0 then d else {CLAMP('d + s * share')} end as under_c, case when sa = 0 or share < 1.0::double / 255.0 then da else floor(least(fd + share * (1.0 - fd), 1.0) * 255.0 + 0.5)::int end as under_a from q")
def R16_composites(spark, sf):
    sa = (F.col("b") * 5) % 256
    over = R.composite_over(F.col("r"), F.col("alpha"), F.col("g"), sa)
    under = R.composite_under(F.col("r"), F.col("alpha"), F.col("g"), sa)
    return texels(spark, sf).select("image", "x", "y", *[c.alias(n) for c, n in zip((*over, *under), ("over_c", "over_a", "under_c", "under_a"), strict=True)])


@query("with p as (select vec_id, embedding[1]::double * 4 as u, embedding[2]::double * 4 as v, embedding from embeddings where embedding is not null and len(embedding) >= 64), w as (select vec_id, embedding, case when u - trunc(u) < 0 then u - trunc(u) + 1.0 else u - trunc(u) end * 7 as fx, case when v - trunc(v) < 0 then v - trunc(v) + 1.0 else v - trunc(v) end * 7 as fy from p), t as (select vec_id, embedding as e, fx, fy, floor(fx)::int as x0, floor(fy)::int as y0 from w) select vec_id, round(fx, 5) as fx, floor(round(floor((e[y0 * 8 + x0 + 1]::double + 1) * 100) * (1 - (fx - x0)) * (1 - (fy - y0)) + floor((e[y0 * 8 + (x0 + 1) % 8 + 1]::double + 1) * 100) * (fx - x0) * (1 - (fy - y0)) + floor((e[(y0 + 1) % 8 * 8 + x0 + 1]::double + 1) * 100) * (1 - (fx - x0)) * (fy - y0) + floor((e[(y0 + 1) % 8 * 8 + (x0 + 1) % 8 + 1]::double + 1) * 100) * (fx - x0) * (fy - y0), 6) + 0.5)::int as sample from t")
def R12_bilinear(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding is not null and size(embedding) >= 64")
    u, v = (F.get("embedding", F.lit(i)).cast("double") * 4 for i in (0, 1))
    channel = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100))
    return e.select("vec_id", F.round(R.wrap(u) * 7, 5).alias("fx"), R.bilinear(channel, 8, 8, u, v).alias("sample"))


BONES = "bones as (select s_suppkey as bone, case when s_suppkey = 0 then -1 else s_suppkey // 2 end as parent, s_acctbal / 1000 as a from supplier)"


def bones(spark, sf):
    s = table(spark, sf, "supplier")
    a = F.col("s_acctbal") / 1000
    local = S.local_matrix(a, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))
    return s.select(F.col("s_suppkey").alias("bone"), F.when(F.col("s_suppkey") == 0, -1).otherwise(F.floor(F.col("s_suppkey") / 2)).alias("parent"), local.alias("local"))


@query(f"with recursive {BONES}, w as (select bone, a as turn, 1 as depth from bones where parent < 0 or parent >= bone union all select b.bone, w.turn + b.a, w.depth + 1 from bones b join w on b.parent = w.bone where b.parent >= 0 and b.parent < b.bone) select bone, depth, round(cos(turn), 5) + 0.0 as yy, round(sin(turn), 5) + 0.0 as zy, round(depth * 1.0, 5)::double as tx from w")
def G1_world_matrices(spark, sf):
    """Turns about x and steps along x, so the product has a closed form that SQL can say."""
    b = bones(spark, sf)
    depth = S.chains(b).groupBy("bone").agg(F.count("*").cast("int").alias("depth"))
    m = lambda i: F.round(F.get("world", F.lit(i)), 5) + 0.0
    return S.world_matrices(b).join(depth, "bone").select("bone", "depth", m(5).alias("yy"), m(9).alias("zy"), m(3).alias("tx"))


@query(f"with {BONES} select b.bone from bones b where not exists (select 1 from bones c where c.parent = b.bone and c.bone <> b.bone)")
def G18_leaves(spark, sf):
    b = bones(spark, sf)
    return S.leaves(b.withColumn("parent", F.when(F.col("parent") == F.col("bone"), -1).otherwise(F.col("parent")))).select("bone")


@query(f"with recursive {BONES}, c as (select bone, bone as ancestor, 0 as steps from bones union all select c.bone, b.parent, c.steps + 1 from c join bones b on c.ancestor = b.bone where b.parent >= 0 and b.parent < b.bone) select bone, ancestor, steps from c")
def J15_ancestor_chains(spark, sf):
    return S.chains(bones(spark, sf))


LINE = "select l_orderkey, l_linenumber, l_partkey, l_quantity as a, l_discount * 10 as b, l_tax * 10 as c from lineitem"


@query(f"with v as ({LINE}) select l_orderkey, l_linenumber, l_partkey, round(sqrt(a*a+b*b+c*c), 6) as length, round(a / sqrt(a*a+b*b+c*c), 6) as nx, round(b * 3 - c * 2, 6) as cx, round(c * 1 - a * 3, 6) as cy, round(a * 2 - b * 1, 6) as cz, round(a + 2 * b + 3 * c, 6) as dot from v")
def G14_vectors(spark, sf):
    v = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"))
    w, k = [F.col(x) for x in "abc"], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    x = L.cross(w, k)
    return v.select("l_orderkey", "l_linenumber", "l_partkey", F.round(L.norm(w), 6).alias("length"), F.round(L.normalise(w)[0], 6).alias("nx"), *[F.round(c, 6).alias(n) for c, n in zip(x, ("cx", "cy", "cz"), strict=True)], F.round(L.dot(w, k), 6).alias("dot"))


@query("with p as (select p_partkey, p_size * 7.0 * pi() / 180 as t from part) select p_partkey, round(cos(t), 6) + 0.0 as m00, round(-sin(t), 6) + 0.0 as m01, 1.0::double as det, round(sin(t), 6) + 0.0 as inv01, round(2 * sin(t / 2) * cos(t / 2), 6) + 0.0 as q10, round(cos(t / 2), 6) + 0.0 as qw from p")
def G9_rotations(spark, sf):
    """A turn about z as a matrix and as a quaternion: determinant, inverse and both forms."""
    t = F.col("p_size") * 7.0
    m, q = L.rotation("z", t), L.quaternion(F.lit(0.0), F.lit(0.0), t * F.lit(pi) / 180)
    r = lambda c: F.round(c, 6) + 0.0
    return table(spark, sf, "part").select("p_partkey", r(m[0]).alias("m00"), r(m[1]).alias("m01"), r(L.determinant(m)).alias("det"), r(L.inverse(m)[1]).alias("inv01"), r(L.quaternion_matrix(q)[3]).alias("q10"), r(q[3]).alias("qw"))


@query("with p as (select p_partkey, p_size * 1.0::double as a, p_retailprice / 100 as b from part) select p_partkey, round(a * 2 + b * 4, 4) as c00, round(a * 3 + b * 5, 4) as c01, round(2.0 * a + 3 * b, 4) as p0, a = 1 and b = 0 as is_identity from p")
def G12_matrix_products(spark, sf):
    a, b, z, one = F.col("p_size") * 1.0, F.col("p_retailprice") / 100, F.lit(0.0), F.lit(1.0)
    m, n = [a, b, z, z, one, z, z, z, one], [F.lit(float(x)) for x in (2, 3, 0, 4, 5, 0, 0, 0, 1)]
    c, p = L.matmul(m, n), L.apply(m, [F.lit(2.0), F.lit(3.0), z])
    return table(spark, sf, "part").select("p_partkey", F.round(c[0], 4).alias("c00"), F.round(c[1], 4).alias("c01"), F.round(p[0], 4).alias("p0"), L.is_identity(m, 3).alias("is_identity"))


@query(f"with {VERTICES}, b as (select item, greatest(max(x) - min(x), 0.001) as sx, greatest(max(y) - min(y), 0.001) as sy from vertices group by item) select item, 16 as margin, round(least((256 - 32) / sx, (256 - 32) / sy), 5) as scale from b")
def G8_fit_scale(spark, sf):
    box = vertices(spark, sf).groupBy("item").agg((F.max("x") - F.min("x")).alias("span_x"), (F.max("y") - F.min("y")).alias("span_y"))
    return S.fit_scale(box, 256, 256).select("item", "margin", F.round("scale", 5).alias("scale"))


@query(f"with {VERTICES}, c as (select item, x, y, z, mesh, (min(x) over w + max(x) over w) / 2 as cx, (min(y) over w + max(y) over w) / 2 as cy from vertices window w as (partition by item)) select item, mesh, z as pz, round((x - cx) * 4 + 128, 5) as px, round(128 - (y - cy) * 4, 5) as py from c")
def G5_orthographic(spark, sf):
    return S.orthographic(vertices(spark, sf), 256, 256, 4.0).select("item", "mesh", "pz", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


@query(f"with {VERTICES}, p as (select *, min(z) over w as lo, max(z) over w as hi from vertices window w as (partition by item, mesh)) select item, mesh, x, y, z, round(1.0 + 0.3 * (coalesce((z - lo) / nullif(hi - lo, 0), 0.5) - 0.5), 6) as factor from p")
def G5_perspective_per_mesh(spark, sf):
    return S.perspective(vertices(spark, sf)).select("item", "mesh", "x", "y", "z", F.round("factor", 6).alias("factor"))
