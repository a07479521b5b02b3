"""Mesh features, sibling tests and blend passes over the lineitem binding; names and texture sizes come from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import catalogue as C
from tesserae.operators import images as I
from tesserae.operators import mesh as M
from tesserae.operators.camera import screen_boxes
from tesserae.operators.skeleton import orthographic
from tesserae.plans.bindings import MESH_NAME, TEXELS, VERTICES, mesh_names, texels, vertices
from tesserae.plans.registry import query

PATTERNS = {"anchored": "^glow_?r$", "parts": ["ade0"], "beginnings": ["skin"]}


def meshes(spark, sf):
    """Feature rows with triangle counts, paths, and texture sizes and colours; every eleventh texture is unresolved."""
    f = M.features(vertices(spark, sf)).withColumn("nt", ((F.col("nv") * 2 + F.col("item") % 3) % 9).cast("int")).withColumn("path", mesh_names(F.col("item"), F.col("mesh")))
    k = F.col("item") * 5 + F.col("mesh")
    known = k % 11 != 0
    size = F.element_at(F.array(*map(F.lit, (8, 16, 32, 64))), (k % 4 + 1).cast("int"))
    colour = {"r": 150 + k % 106, "g": 160 + k * 3 % 96, "b": 170 + k * 7 % 86}
    return f.withColumns({"width": F.when(known, size), "height": F.when(known, size)} | {c: F.when(known, F.when(k % 13 == 0, k % 20).otherwise(v)) for c, v in colour.items()})


FEATURES = f"""{VERTICES},
feat0 as (select item, mesh, count(*) as nv, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from vertices group by item, mesh),
feat as (select *, ((nv * 2 + item % 3) % 9)::int as nt, {MESH_NAME} as path, item * 5 + mesh as k, lower(split_part(split_part({MESH_NAME}, chr(92), 3), '.', 1)) as stem, right({MESH_NAME}, 4) as ext from feat0),
m as (select *, case when k % 11 <> 0 then case k % 4 when 0 then 8 when 1 then 16 when 2 then 32 else 64 end end as width, case when k % 11 <> 0 then case when k % 13 = 0 then k % 20 else 150 + k % 106 end end as r, case when k % 11 <> 0 then case when k % 13 = 0 then k % 20 else 160 + k * 3 % 96 end end as g, case when k % 11 <> 0 then case when k % 13 = 0 then k % 20 else 170 + k * 7 % 86 end end as b from feat)"""
JPG, TGA = "{0}.ext in ('.jpg', '.jpeg')", "{0}.ext = '.tga'"
SPAN = lambda t, k: f"({t}.max_{k} - {t}.min_{k})"
RATIO = lambda a, b, r: "(" + " or ".join(f"({SPAN(b, k)} >= 0.001 and {SPAN(a, k)} / {SPAN(b, k)} > {r})" for k in "xyz") + ")"
OVERLAP = lambda a, b: "(" + " and ".join(f"(greatest({SPAN(a, k)}, {SPAN(b, k)}) < 0.001 or (least({a}.max_{k}, {b}.max_{k}) - greatest({a}.min_{k}, {b}.min_{k}) > 0 and (least({a}.max_{k}, {b}.max_{k}) - greatest({a}.min_{k}, {b}.min_{k})) / greatest({SPAN(a, k)}, {SPAN(b, k)}) >= 0.4))" for k in "xyz") + ")"
ADD = lambda t: f"ends_with({t}.stem, '_r')"
FLAGS = f"""{FEATURES},
flag as (select a.item, a.mesh,
  bool_or({TGA.format('a')} and {JPG.format('o')} and o.nv > 0 and o.nt > 0 and not {ADD('o')} and not coalesce(o.nv <= 12 and o.width <= 32, false) and a.nv <= o.nv * 2 and o.nv <= a.nv * 2 and a.nt <= o.nt * 2 and o.nt <= a.nt * 2 and {OVERLAP('a', 'o')} and not {RATIO('a', 'o', 1.7)}) as alpha_overlay,
  bool_or({ADD('o')} and a.nv = o.nv and a.nt = o.nt) as has_additive_twin,
  bool_or(o.nv > a.nv and (case when a.min_x >= o.min_x - 1 and a.max_x <= o.max_x + 1 then 1 else 0 end + case when a.min_y >= o.min_y - 1 and a.max_y <= o.max_y + 1 then 1 else 0 end + case when a.min_z >= o.min_z - 1 and a.max_z <= o.max_z + 1 then 1 else 0 end) >= 2) as contained,
  bool_or({JPG.format('a')} and {TGA.format('o')} and a.stem = o.stem and o.nv >= 0.5 * a.nv and {RATIO('a', 'o', 1.5)}) as jpeg_under_tga,
  bool_or({TGA.format('o')}) as has_tga_sibling
  from m a join m o on a.item = o.item and a.mesh <> o.mesh group by a.item, a.mesh),
f as (select m.*, coalesce(alpha_overlay, false) as alpha_overlay, coalesce(has_additive_twin, false) as has_additive_twin, coalesce(contained, false) as contained, coalesce(jpeg_under_tga, false) as jpeg_under_tga, coalesce(has_tga_sibling, false) as has_tga_sibling,
  m.ext <> '.tga' and count(*) over (partition by m.item, m.nv, m.nt, regexp_replace(m.stem, '[0-9]+$', '') order by m.mesh rows between unbounded preceding and 1 preceding) > 0 as duplicate_overlay
  from m left join flag on m.item = flag.item and m.mesh = flag.mesh)"""


def flags(spark, sf):
    return M.duplicate_overlay(M.sibling_flags(meshes(spark, sf)))


@query(f"with {FEATURES} select item, mesh, nv, min_x, max_x, min_y, max_y, min_z, max_z from feat0")
def A1_mesh_bounds(spark, sf):
    return M.features(vertices(spark, sf))


#: A turn by 30 degrees about z, as the fixed rows of a matrix.
TURN = ((0.866025, -0.5, 0.0), (0.5, 0.866025, 0.0), (0.0, 0.0, 1.0))
TURNED = [" + ".join(f"{c} * {k}" for c, k in zip(r, "xyz", strict=True)) for r in TURN]


@query(f"with {VERTICES}, t as (select item, {TURNED[0]} as x, {TURNED[1]} as y, {TURNED[2]} as z from vertices) select item, " + ", ".join(f"round(greatest(max({k}) - min({k}), 0.001), 6) as span_{k}" for k in "xyz") + " from t group by item")
def A2_rotated_item_bounds(spark, sf):
    t = vertices(spark, sf).select("item", *[sum((F.col(k) * c for c, k in list(zip(r, "xyz", strict=True))[1:]), F.col("x") * r[0]).alias(n) for r, n in zip(TURN, "xyz", strict=True)])
    return t.groupBy("item").agg(*[F.round(F.greatest(F.max(k) - F.min(k), F.lit(0.001)), 6).alias(f"span_{k}") for k in "xyz"])


@query(f"with {FEATURES} select item, nv, nt, count(*) as meshes, bool_or(ext in ('.jpg', '.jpeg')) and bool_or(ext = '.tga') as mixed from m group by item, nv, nt having count(*) >= 2")
def A4_count_groups(spark, sf):
    p = F.col("path")
    return meshes(spark, sf).groupBy("item", "nv", "nt").agg(F.count("*").alias("meshes"), (F.bool_or(M.is_jpeg(p)) & F.bool_or(M.is_tga(p))).alias("mixed")).where("meshes >= 2")


@query(f"with {FEATURES} select item, mesh, nt from (select *, row_number() over (partition by item order by nt desc, mesh) as n from m where nt > 0) where n = 1")
def A5_most_triangles(spark, sf):
    best = F.max_by("mesh", F.struct("nt", -F.col("mesh")))
    return meshes(spark, sf).where("nt > 0").groupBy("item").agg(best.alias("mesh"), F.max("nt").alias("nt"))


@query(f"with {VERTICES} select mesh, node, count(*) as vertices from vertices group by mesh, node")
def A15_bone_histogram(spark, sf):
    return vertices(spark, sf).groupBy("mesh", "node").agg(F.count("*").alias("vertices"))


@query(f"with {VERTICES} select item, string_agg(distinct node::varchar, ',' order by node::varchar) as nodes from vertices group by item")
def O4_sorted_bone_ids(spark, sf):
    return vertices(spark, sf).groupBy("item").agg(F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ",").alias("nodes"))


@query(f"with {FEATURES} select item, sum(case when k % 3 = 0 then 2 else 1 end * nt)::bigint as triangles, count(*) filter (where k % 3 = 0) as quads from m group by item")
def A16_expanded_triangles(spark, sf):
    quad = (F.col("item") * 5 + F.col("mesh")) % 3 == 0
    return meshes(spark, sf).groupBy("item").agg(F.sum(F.when(quad, 2).otherwise(1) * F.col("nt")).alias("triangles"), F.count_if(quad).alias("quads"))


EFFECT = "(regexp_matches(stem, '^glow_?r$') or contains(stem, 'ade0') or starts_with(stem, 'skin') or (nv <= 8 and nt <= 4 and nv > 0 and greatest(max_x - min_x, max_y - min_y, max_z - min_z) <= 20))"


def effect():
    return M.is_effect(F.col("path"), F.col("nv"), F.col("nt"), F.greatest(*[M.span(k) for k in "xyz"]), PATTERNS)


@query(f"with {FEATURES} select item, mesh, {EFFECT} as effect from m")
def P6_effect_meshes(spark, sf):
    return meshes(spark, sf).select("item", "mesh", effect().alias("effect"))


@query(f"with {FEATURES} select item, mesh from (select *, count(*) filter (where not {EFFECT}) over (partition by item) as kept from m) where not {EFFECT} or kept = 0")
def P5_effect_filter(spark, sf):
    return C.keep_unless_all(meshes(spark, sf), effect(), ["item"]).select("item", "mesh")


@query(f"with {FEATURES} select item, mesh from (select *, count(*) filter (where stem not in ('glow', 'blade', 'hilt01')) over (partition by item) as kept from m) where stem not in ('glow', 'blade', 'hilt01') or kept = 0")
def P4_exclude_textures(spark, sf):
    return C.keep_unless_all(meshes(spark, sf), M.in_list(F.col("path"), F.array(*map(F.lit, ("GLOW", "Blade", "hilt01")))), ["item"]).select("item", "mesh")


@query(f"with {FEATURES} select item, mesh, count(*) filter (where stem <> 'glow') over (partition by item) = 0 or stem <> 'glow' as kept from m")
def W5_keep_if_empty_guard(spark, sf):
    f = meshes(spark, sf)
    kept = C.keep_unless_all(f, M.in_list(F.col("path"), F.array(F.lit("glow"))), ["item"]).select("item", "mesh", F.lit(True).alias("kept"))
    return f.select("item", "mesh").join(kept, ["item", "mesh"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query(f"with {FEATURES} select item, mesh, regexp_matches(stem, '^(skin_hair|hilt)') as body, stem in ('glow', 'glow_r') as force_additive, stem = 'hilt' as excluded, {ADD('m')} as additive, nv between 1 and 16 and nt <= 12 and ext in ('.jpg', '.jpeg') as billboard from m")
def P7_name_predicates(spark, sf):
    p = F.col("path")
    lists = lambda *x: F.array(*map(F.lit, x))
    return meshes(spark, sf).select("item", "mesh", C.stem(p).rlike("(?i)^(?:skin_hair|hilt)").alias("body"), M.in_list(p, lists("Glow", "GLOW_R")).alias("force_additive"), M.in_list(p, lists("HILT")).alias("excluded"), M.is_additive(p).alias("additive"), M.is_billboard(F.col("nv"), F.col("nt"), p).alias("billboard"))


@query(f"with {FEATURES} select item, mesh, item % 2 = 0 or stem = 'blade' as tinted from m")
def P12_tint_predicate(spark, sf):
    names = F.when(F.col("item") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("BLADE")))
    return meshes(spark, sf).select("item", "mesh", M.tint_applies(F.col("path"), names).alias("tinted"))


BRIGHT = "coalesce(ext in ('.jpg', '.jpeg') and (r + g + b) / 3.0 > 180 and case when greatest(r, g, b) > 0 then (greatest(r, g, b) - least(r, g, b)) * 1.0 / greatest(r, g, b) else 0.0 end < 0.25, false)"
DARK = "coalesce(width <= 16 and (r + g + b) / 3.0 < 10, false)"


@query(f"with {FEATURES} select item, mesh, {BRIGHT} as bright_glow, {DARK} as dark_filler from m")
def P15_colour_predicates(spark, sf):
    r, g, b = (F.col(c) for c in "rgb")
    return meshes(spark, sf).select("item", "mesh", M.is_bright_glow(F.col("path"), r, g, b).alias("bright_glow"), M.is_dark_filler(F.col("width"), F.col("height"), r, g, b).alias("dark_filler"))


@query(f"""with {FEATURES}, a as (select *, count(*) over w >= 2 and bool_or(ext in ('.jpg', '.jpeg')) over w and bool_or(ext = '.tga') over w as pair from m window w as (partition by item, nv, nt)),
c as (select *, coalesce(mesh = first_value(case when not pair and nt > 0 then mesh end) over (partition by item order by case when not pair and nt > 0 then 0 else 1 end, nt desc, mesh), false) as body from a),
d as (select *, pair or (not body and ({BRIGHT} or {DARK} or width is null)) as gone from c)
select item, mesh from (select *, count(*) filter (where not gone) over (partition by item) as kept from d) where not gone or kept = 0""")
def P9_glow_filter(spark, sf):
    return M.glow_filter(meshes(spark, sf)).select("item", "mesh")


@query(f"with {FLAGS} select item, mesh, alpha_overlay, has_additive_twin, contained, jpeg_under_tga, has_tga_sibling from f")
def J13_sibling_flags(spark, sf):
    return M.sibling_flags(meshes(spark, sf)).select("item", "mesh", "alpha_overlay", "has_additive_twin", "contained", "jpeg_under_tga", "has_tga_sibling")


@query(f"with {FLAGS} select item, mesh, duplicate_overlay from f")
def W1_duplicate_overlay(spark, sf):
    return M.duplicate_overlay(meshes(spark, sf)).select("item", "mesh", "duplicate_overlay")


@query(f"with {FEATURES} select a.item, a.mesh, o.mesh as o_mesh, {RATIO('a', 'o', 1.7)} as ratio_exceeds, {OVERLAP('a', 'o')} as overlap from m a join m o on a.item = o.item and a.mesh <> o.mesh")
def M3_box_tests(spark, sf):
    return M.siblings(meshes(spark, sf)).select("item", "mesh", "o_mesh", M.ratio_exceeds(1.7).alias("ratio_exceeds"), M.boxes_overlap().alias("overlap"))


@query(f"with {FLAGS} select item, mesh, coalesce(ext in ('.jpg', '.jpeg') and has_tga_sibling and nv <= 12 and width <= 32, false) as paired_glow from f")
def M9_paired_glow(spark, sf):
    f = M.sibling_flags(meshes(spark, sf))
    return f.select("item", "mesh", M.is_paired_glow(F.col("path"), F.col("has_tga_sibling"), F.col("nv"), F.col("width"), F.col("height")).alias("paired_glow"))


PASS = f"case when stem = 'hilt' then 'force_under' when {ADD('f')} or (nv between 1 and 16 and nt <= 12 and ext in ('.jpg', '.jpeg') and not has_additive_twin and not contained) or duplicate_overlay then 'additive' when coalesce(ext in ('.jpg', '.jpeg') and has_tga_sibling and nv <= 12 and width <= 32, false) then 'additive' when alpha_overlay then 'alpha' else 'opaque' end"


@query(f"""with {FLAGS}, p as (select item, mesh, {PASS} as pass0 from f),
q as (select *, count(*) filter (where pass0 = 'opaque') over (partition by item) = 0 as none, first_value(mesh) over (partition by item order by case pass0 when 'additive' then 0 when 'alpha' then 1 else 2 end, mesh) as first from p)
select item, mesh, case when none and mesh = first and pass0 in ('additive', 'alpha') then 'opaque' else pass0 end as pass from q""")
def M1_pass_classifier(spark, sf):
    f = flags(spark, sf)
    return M.passes(f, M.in_list(F.col("path"), F.array(F.lit("hilt"))), False).select("item", "mesh", "pass")


PASSES = f"""{FLAGS}, p as (select item, mesh, ext, {PASS} as pass0 from f),
q as (select *, count(*) filter (where pass0 = 'opaque') over (partition by item) = 0 as none, first_value(mesh) over (partition by item order by case pass0 when 'additive' then 0 when 'alpha' then 1 else 2 end, mesh) as first from p),
passes as (select item, mesh, ext, case when none and mesh = first and pass0 in ('additive', 'alpha') then 'opaque' else pass0 end as pass from q),
mid as (select item, (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy from vertices group by item),
screen as (select v.item, mesh, min((x - cx) * 4 + 128) as min_px, max((x - cx) * 4 + 128) as max_px, min(128 - (y - cy) * 4) as min_py, max(128 - (y - cy) * 4) as max_py from vertices v join mid on v.item = mid.item group by v.item, mesh)"""


def passes(spark, sf):
    """Classified meshes with their boxes on a canvas of 256 by 256."""
    f = M.passes(flags(spark, sf), M.in_list(F.col("path"), F.array(F.lit("hilt"))), False)
    return f.join(screen_boxes(orthographic(vertices(spark, sf), 256, 256, 4.0)), ["item", "mesh"])


@query(f"with {PASSES} select s.item, s.mesh, round(min_px, 4) as min_px, round(max_px, 4) as max_px, round(min_py, 4) as min_py, round(max_py, 4) as max_py from screen s join passes p on s.item = p.item and s.mesh = p.mesh where pass = 'opaque'")
def A3_screen_boxes(spark, sf):
    return passes(spark, sf).where("pass = 'opaque'").select("item", "mesh", *[F.round(f"{n}_{k}", 4).alias(f"{n}_{k}") for k in ("px", "py") for n in ("min", "max")])


@query(f"""with {PASSES}, o as (select s.*, ext from screen s join passes p on s.item = p.item and s.mesh = p.mesh where pass = 'opaque'),
d as (select a.item, a.mesh from o a join o b on a.item = b.item and b.mesh < a.mesh where a.ext = '.tga' and a.min_px >= b.min_px - 2 and a.max_px <= b.max_px + 2 and a.min_py >= b.min_py - 2 and a.max_py <= b.max_py + 2 group by 1, 2)
select p.item, p.mesh, d.item is not null as decoration, case when d.item is not null then 1000000.0 else 0.0 end::double as z_bias from passes p left join d on p.item = d.item and p.mesh = d.mesh""")
def M10_decoration_bias(spark, sf):
    rows = M.inside_earlier(passes(spark, sf))
    return rows.select("item", "mesh", "decoration", F.when(F.col("decoration"), 1e6).otherwise(0.0).alias("z_bias"))


@query(f"with {PASSES} select item, mesh, pass, row_number() over (partition by item order by case pass when 'force_under' then 1 when 'opaque' then 2 when 'alpha' then 3 when 'additive' then 4 else 5 end, mesh) as \"order\" from passes")
def U1_draw_order(spark, sf):
    return M.draw_order(passes(spark, sf)).select("item", "mesh", "pass", F.col("order").cast("long").alias("order"))


@query(f"with {FEATURES} select item, mesh, stem, ext, regexp_replace(stem, '[0-9]+$', '') as stem_base from m")
def H1_stems(spark, sf):
    p = F.col("path")
    return meshes(spark, sf).select("item", "mesh", F.lower(C.stem(p)).alias("stem"), C.extension(p).alias("ext"), C.stem_base(p).alias("stem_base"))


@query(f"with {FEATURES} select item, mesh, coalesce(least(max_x - min_x, max_y - min_y, max_z - min_z) / nullif(greatest(max_x - min_x, max_y - min_y, max_z - min_z), 0) < 0.05, false) as flat from m")
def G19_flatness(spark, sf):
    return M.flatness(meshes(spark, sf)).select("item", "mesh", "flat")


@query(f"with {FEATURES} select m.item, m.mesh from m where not exists (select 1 from m o where o.item = m.item and o.nv = m.nv and o.nt = m.nt and o.mesh <> m.mesh)")
def U2_set_difference(spark, sf):
    f = meshes(spark, sf)
    pairs = M.siblings(f.select("item", "mesh", "nv", "nt")).where("nv = o_nv and nt = o_nt").select("item", "mesh")
    return f.join(pairs, ["item", "mesh"], "left_anti").select("item", "mesh")


@query(f"with {FEATURES}, idx as (select stem as s, max(case when ext = '.jpg' then path end) as jpg, max(case when ext = '.tga' then path end) as tga from m where item % 5 <> 0 group by stem) select m.item, m.mesh, case when m.ext = '.jpg' then coalesce(idx.jpg, idx.tga) else coalesce(idx.tga, idx.jpg) end as resolved from m left join idx on m.stem = idx.s")
def J8_texture_resolution(spark, sf):
    """The index has a row a stem; its size is that of the texture folder's names, and Spark picks the join by measured size."""
    f = meshes(spark, sf).withColumns({"stem": F.lower(C.stem(F.col("path"))), "ext": C.extension(F.col("path"))})
    index = f.where("item % 5 <> 0").groupBy(F.col("stem").alias("s")).agg(F.max(F.when(F.col("ext") == ".jpg", F.col("path"))).alias("jpg"), F.max(F.when(F.col("ext") == ".tga", F.col("path"))).alias("tga"))
    rows = f.join(index, F.col("stem") == F.col("s"), "left")
    return rows.select("item", "mesh", F.when(F.col("ext") == ".jpg", F.coalesce("jpg", "tga")).otherwise(F.coalesce("tga", "jpg")).alias("resolved"))


@query(f"with {VERTICES} select item, mesh, count(*) as vertices, count(distinct node) as bones, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 6) as diagonal from vertices group by item, mesh")
def X5_inspector(spark, sf):
    s = [F.max(k) - F.min(k) for k in "xyz"]
    return vertices(spark, sf).groupBy("item", "mesh").agg(F.count("*").alias("vertices"), F.count_distinct("node").alias("bones"), F.round(F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2]), 6).alias("diagonal"))


@query(f"""with {FEATURES},
used as (select item, mesh, string_agg(distinct node::varchar, ',' order by node::varchar) as bones, count(distinct node) as n_bones from vertices group by item, mesh),
whole as (select item, max(max_x) - min(min_x) as sx, max(max_y) - min(min_y) as sy, max(max_z) - min(min_z) as sz from m group by item)
select m.item, m.mesh, m.stem, m.ext, m.nv, m.nt, round(m.max_x - m.min_x, 6) as size_x, round(m.max_y - m.min_y, 6) as size_y, round(m.max_z - m.min_z, 6) as size_z, n_bones, bones, {EFFECT} as effect,
  round(coalesce(least(sx, sy, sz) / nullif(greatest(sx, sy, sz), 0), 0.0), 6) as flat_ratio
from m join used using (item, mesh) join whole on whole.item = m.item""")
def X3_deep_audit(spark, sf):
    """Each mesh with its size, the bones it uses and its effect test, beside the flatness of its whole item."""
    v, f, p = vertices(spark, sf), meshes(spark, sf), F.col("path")
    nodes = F.array_sort(F.collect_set(F.col("node").cast("string")))
    used = v.groupBy("item", "mesh").agg(F.size(nodes).cast("long").alias("n_bones"), F.array_join(nodes, ",").alias("bones"))
    sides = [F.max(f"max_{k}") - F.min(f"min_{k}") for k in "xyz"]
    whole = f.groupBy("item").agg(F.round(F.coalesce(F.least(*sides) / F.nullif(F.greatest(*sides), F.lit(0.0)), F.lit(0.0)), 6).alias("flat_ratio"))
    sizes = [F.round(M.span(k), 6).alias(f"size_{k}") for k in "xyz"]
    rows = f.select("item", "mesh", F.lower(C.stem(p)).alias("stem"), C.extension(p).alias("ext"), "nv", "nt", *sizes, effect().alias("effect"))
    return rows.join(used, ["item", "mesh"]).join(whole, "item")


@query(f"""with {FEATURES}, {TEXELS},
seen as (select image, count(*) filter (where alpha > 0) as visible, count(*) filter (where alpha = 255) as opaque from texels group by image)
select m.item, m.mesh, m.nv, m.nt, m.ext, {EFFECT} as effect, visible, opaque, case when visible is not null then round(coalesce(100.0 * opaque / nullif(visible, 0), 0.0), 6) end as percent
from m left join seen on m.k % 11 <> 0 and image = m.k""")
def X7_texture_opacity(spark, sf):
    """Each mesh with its effect test and how opaque its texture is; null where the texture isn't found."""
    f = meshes(spark, sf)
    k = F.col("item") * 5 + F.col("mesh")
    rows = f.select("item", "mesh", "nv", "nt", C.extension(F.col("path")).alias("ext"), effect().alias("effect"), F.when(k % 11 != 0, k).alias("image"))
    return rows.join(I.opaque_ratio(texels(spark, sf)), "image", "left").drop("image")
