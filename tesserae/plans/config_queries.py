"""Layered configuration over the part binding, with layers as literal rows that SQL has too."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import config as G
from tesserae.plans.audit_queries import CAMERA_SQL, DIST
from tesserae.plans.bindings import BINARY, ITEMS, binary_config, items, table
from tesserae.plans.registry import query

KEYS = ["14_72-77", "1_4", "1_9-3", "x_1", "5", "1_-3", "2_0-400", "2_100-200", "2_150", "3_7-9", "3_8-20"]
KEY_VALUES = ", ".join(f"('{k}', {i})" for i, k in enumerate(KEYS))
PART = lambda i: rf"regexp_extract(key, '^([+-]?\d+)_([+]?\d+)(?:-([+]?\d+))?$', {i})"
RANGES = rf"""k(key, rank) as (values {KEY_VALUES}),
parsed as (select key, rank, try_cast({PART(1)} as int) as section, try_cast({PART(2)} as int) as first, try_cast(case when {PART(3)} = '' then {PART(2)} else {PART(3)} end as int) as last from k where regexp_matches(key, '^[+-]?\d+_[+]?\d+(-[+]?\d+)?$')),
ranges as (select * from parsed where first <= last),
expanded as (select key, rank, section, unnest(generate_series(first, last))::int as "index", last - first as width from ranges),
narrow as (select * from (select *, row_number() over (partition by section, "index" order by width, key desc) as n from expanded) where n = 1)"""
SECTIONS = [(1, True, False, -90.0, True, 128), (2, False, True, None, None, 64), (4, False, False, -30.0, False, None), (6, True, True, None, True, 512)]
MODELS = [("LARGE_Brand#4.bin", 15.0, 0.9), ("economy_brand#7.bin", 30.0, None), ("MEDIUM_Brand#21.bin", None, 0.5)]
sql_row = lambda r: "(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")"


def ranges(spark):
    return G.parse_ranges(spark.createDataFrame(list(zip(KEYS, range(len(KEYS)), strict=True)), "key string, rank int"), "key")


def layer(df, **fields):
    """df with all FIELDS, those that it lacks null."""
    kinds = {"bones": "boolean", "width": "int", "height": "int", "camera": "string"}
    return df.withColumns({f: fields.get(f, F.lit(None)).cast(kinds.get(f, "double")) for f in G.FIELDS})


@query(f"with {RANGES} select key, section, first, last from ranges")
def C3_parse_ranges(spark, sf):
    return ranges(spark).select("key", "section", "first", "last")


@query(f"with {RANGES} select section, \"index\", key from narrow")
def J4_narrowest_range(spark, sf):
    return G.expand_ranges(ranges(spark), "key").select("section", "index", "key")


@query(f"with {RANGES} select key, last - first as width, row_number() over (order by last - first desc, key) as place from ranges")
def O1_ranges_by_size(spark, sf):
    """A few rows of configuration, so one task may sort them."""
    from pyspark.sql import Window

    return ranges(spark).select("key", (F.col("last") - F.col("first")).alias("width")).withColumn("place", F.row_number().over(Window.orderBy(F.col("width").desc(), "key")).cast("long"))


@query(f"""with {ITEMS}, {BINARY}, {RANGES},
s(section, mrg, ovr, display_angle, bones, width) as (values {', '.join(map(sql_row, SECTIONS))}),
m0(model, rot_x, fill_ratio) as (values {', '.join(map(sql_row, MODELS))}), m as (select lower(model) as model, rot_x, fill_ratio from m0),
r as (select section, "index", rank * 10.0 as rot_y, case when rank % 2 = 0 then 32 else 0 end as width from narrow),
j as (select i.section, i."index", c.section is not null as has_b, c.rot_x as b_rot_x, c.rot_y as b_rot_y, c.scale as b_scale, s.section is not null as has_s, s.mrg, s.ovr, s.display_angle as s_angle, s.bones as s_bones, s.width as s_width,
  m.model is not null as has_m, m.rot_x as m_rot_x, m.fill_ratio as m_fill, r.section is not null as has_r, r.rot_y as r_rot_y, r.width as r_width
  from items i left join cfg c on i.section = c.section and i."index" = c."index" left join s on i.section = s.section left join m on lower(i.model_file) = m.model left join r on i.section = r.section and i."index" = r."index"),
l as (select *, case when has_r then 'item' when has_m then 'model' when has_s and not has_b then 'section' when has_s and mrg then 'merged' when has_s and ovr then 'section' when has_b then 'binary' end as layer from j)
select section, "index", case when layer in ('binary', 'merged') then 'binary' else 'custom' end as source,
  round(case layer when 'item' then 0.0 when 'model' then coalesce(m_rot_x, 0.0) when 'section' then 0.0 else b_rot_x end::double, 6) as rot_x,
  round(case layer when 'item' then r_rot_y when 'model' then 0.0 when 'section' then 0.0 else b_rot_y end::double, 6) as rot_y,
  case layer when 'item' then -45.0 when 'model' then -45.0 when 'section' then coalesce(s_angle, -45.0) when 'merged' then s_angle end::double as display_angle,
  case layer when 'item' then 0.7 when 'model' then coalesce(m_fill, 0.7) when 'section' then 0.7 end::double as fill_ratio,
  case layer when 'section' then s_bones when 'merged' then s_bones end as bones,
  case layer when 'item' then coalesce(nullif(r_width, 0), s_width) when 'section' then s_width when 'merged' then s_width end::int as width
from l where layer is not null""")
def C2_full_overlay(spark, sf):
    sections = layer(spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in SECTIONS], "section int, merge boolean, override boolean, a double, b boolean, w int"), display_angle=F.col("a"), bones=F.col("b"), width=F.col("w"))
    models = layer(spark.createDataFrame(MODELS, "model_file string, a double, b double"), rot_x=F.col("a"), fill_ratio=F.col("b"))
    own = layer(G.expand_ranges(ranges(spark), "key"), rot_y=F.col("rank") * 10.0, width=F.when(F.col("rank") % 2 == 0, 32).otherwise(0))
    b = binary_config(spark, sf)
    out = G.overlay(items(spark, sf), layer(b, rot_x=F.col("rot_x"), rot_y=F.col("rot_y"), scale=F.col("scale")), sections, models, own)
    return out.select("section", "index", "source", F.round("rot_x", 6).alias("rot_x"), F.round("rot_y", 6).alias("rot_y"), "display_angle", "fill_ratio", "bones", "width")


PRESETS = [("wide", 10.0, 90.0), ("narrow", None, 40.0)]


@query(f"with p(preset, rot_x, fov) as (values {', '.join(map(sql_row, PRESETS))}), e as (select event_id, case event_id % 4 when 0 then 'wide' when 1 then 'narrow' when 2 then 'lost' end as preset, event_id * 1.0 as fov from events) select event_id, case when p.preset is not null then p.rot_x end::double as rot_x, (case when p.preset is not null then p.fov else e.fov end)::double as fov from e left join p on e.preset = p.preset where e.preset is null or p.preset is not null")
def J5_presets(spark, sf):
    name = F.when(F.col("event_id") % 4 == 0, "wide").when(F.col("event_id") % 4 == 1, "narrow").when(F.col("event_id") % 4 == 2, "lost")
    entries = layer(table(spark, sf, "events").select("event_id", name.alias("preset")), fov=F.col("event_id"))
    presets = layer(spark.createDataFrame(PRESETS, "preset string, a double, b double"), rot_x=F.col("a"), fov=F.col("b"))
    return G.dereference(entries, presets).select("event_id", "rot_x", "fov")


@query("with r(resolution, w, h) as (values ('hd', 512, 256), ('sd', 0, 128)), e as (select event_id, case event_id % 3 when 0 then 'hd' when 1 then 'sd' end as resolution, case when event_id % 5 = 0 then 64 when event_id % 5 = 1 then 0 end as width from events) select event_id, coalesce(case when width > 0 then width end, case when w > 0 then w end)::int as width, case when h > 0 then h end::int as height from e left join r on e.resolution = r.resolution")
def J6_resolutions(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "hd").when(F.col("event_id") % 3 == 1, "sd").alias("resolution"), F.when(F.col("event_id") % 5 == 0, 64).when(F.col("event_id") % 5 == 1, 0).alias("width"), F.lit(None).cast("int").alias("height"))
    return G.with_resolution(e, spark.createDataFrame([("hd", 512, 256), ("sd", 0, 128)], "resolution string, width int, height int")).select("event_id", "width", "height")


@query(f"with {ITEMS}, m as (select unnest(['LARGE_Brand#4.bin', 'economy_brand#7.bin', 'PROMO_BRAND#8.BIN']) as model) select section, \"index\", model_file from items where lower(model_file) in (select lower(model) from m)")
def J16_preset_model_array(spark, sf):
    arrays = spark.createDataFrame([("wide", ["LARGE_Brand#4.bin", "economy_brand#7.bin"]), ("narrow", ["PROMO_BRAND#8.BIN"])], "preset string, files array<string>")
    files = arrays.select(F.explode("files").alias("f")).select(F.lower("f").alias("m"))
    return items(spark, sf).withColumn("m", F.lower("model_file")).join(files, "m", "left_semi").select("section", "index", "model_file")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, starts_with(trim(props), '{') as is_object from events")
def S4_json_entries(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.startswith(F.trim("props"), F.lit("{")).alias("is_object"))


@query(f"with {BINARY} select \"index\", rot_y, {DIST('(rot_y - 90.0)')} as to_fallback, {DIST('(rot_y - 270.0)')} as to_correction, {CAMERA_SQL} as camera from cfg")
def C8_camera_routing(spark, sf):
    r = F.col("rot_y")
    return binary_config(spark, sf).select("index", "rot_y", G.angle_distance(r, 90.0).alias("to_fallback"), G.angle_distance(r, 270.0).alias("to_correction"), G.camera_route(r).alias("camera"))


@query("with a as (select l_orderkey, l_linenumber, l_quantity * 37 - 900 as a, l_extendedprice as b from lineitem) select l_orderkey, l_linenumber, a, round(" + DIST("(a - b)") + ", 6) as distance from a")
def C9_angle_distance(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 37 - 900).alias("a"), F.col("l_extendedprice").alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "a", F.round(G.angle_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(f"with {ITEMS}, {BINARY}, j as (select i.\"index\", c.section is not null as has_entry, c.rot_y, case i.\"index\" % 7 when 0 then true when 1 then false end as bones, case when i.\"index\" % 2 = 0 then 'binary' else 'custom' end as source from items i left join cfg c on i.section = c.section and i.\"index\" = c.\"index\") select \"index\", case when not has_entry then true when bones is not null then bones when source = 'binary' then {DIST('(rot_y - 90.0)')} <= 45 and not {DIST('(rot_y - 270.0)')} <= 45 else true end as uses_bones from j")
def P17_uses_bones(spark, sf):
    rows = items(spark, sf).join(binary_config(spark, sf).withColumn("e", F.lit(True)), ["section", "index"], "left")
    k = F.col("index")
    return rows.select("index", G.uses_bones(F.coalesce("e", F.lit(False)), F.when(k % 7 == 0, True).when(k % 7 == 1, False), F.when(k % 2 == 0, "binary").otherwise("custom"), F.col("rot_y")).alias("uses_bones"))


@query(f"with {BINARY} select \"index\", {CAMERA_SQL} = 'fallback' as fallback from cfg")
def P18_fallback_path(spark, sf):
    return binary_config(spark, sf).select("index", (G.camera_route(F.col("rot_y")) == "fallback").alias("fallback"))


@query("select p_partkey, coalesce(nullif(p_size % 3, 0), nullif(p_partkey % 4, 0), 256)::bigint as value from part")
def C6_precedence(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.first_set(F.col("p_size") % 3, F.col("p_partkey") % 4, F.lit(256)).cast("long").alias("value"))


@query(f"with {ITEMS}, s(section, w, h) as (values (1, 128, 64), (2, 0, 32)) select i.\"index\", coalesce(nullif(i.\"index\" % 3 * 100, 0), nullif(s.w, 0), 256)::int as width, coalesce(nullif(s.h, 0), 256)::int as height from items i left join s on i.section = s.section")
def J7_dimension_inheritance(spark, sf):
    s = spark.createDataFrame([(1, 128, 64), (2, 0, 32)], "section int, w int, h int")
    rows = items(spark, sf).join(s, "section", "left")
    return rows.select("index", G.first_set(F.col("index") % 3 * 100, F.col("w"), F.lit(256)).cast("int").alias("width"), G.first_set(F.col("h"), F.lit(256)).cast("int").alias("height"))
