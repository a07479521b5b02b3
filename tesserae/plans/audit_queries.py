"""Catalogue filters, classes, counters and audits over the part binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import catalogue as C
from tesserae.operators import config as G
from tesserae.plans.bindings import BINARY, ITEMS, binary_config, items, table
from tesserae.plans.registry import query

#: Classes of our own for the binding's model names; the engine takes any list. The anchor of the third holds for its first branch only.
CLASSES = [("brass", "brass"), ("^promo|rge_brand#1", "plated"), ("brand#[34]|m$", "soft"), ("economy|small", "cheap")]
NAMES = {0: "Swords", 1: "Axes", 2: "Maces and Scepters", 3: "Spears", 4: "Bows and Crossbows", 5: "Staffs", 6: "Shields", 7: "Helms", 12: "Wings and Orbs"}
NAMED = "case section " + " ".join(f"when {k} then '{v}'" for k, v in NAMES.items()) + " else 'Section ' || section end"
CLASS_SQL = "case when regexp_matches(model_file, '(?i)brass') then 'brass' when regexp_matches(model_file, '(?i)^promo|rge_brand#1') then 'plated' when regexp_matches(model_file, '(?i)brand#[34]|m$') then 'soft' when regexp_matches(model_file, '(?i)economy|small') then 'cheap' else 'misc' end"
DIST = lambda c: f"least(({c} - 360 * floor({c} / 360)), 360 - ({c} - 360 * floor({c} / 360)))"
CAMERA_SQL = f"case when {DIST('(rot_y - 270.0)')} <= 45 then 'correction' when {DIST('(rot_y - 90.0)')} <= 45 then 'fallback' else 'noflip' end"


def joined(spark: SparkSession, sf: str, section: int | None = None) -> DataFrame:
    """Items with class and configuration. The section filter stands before the join and reaches both scans."""
    it, cfg = C.select_items(items(spark, sf), section), binary_config(spark, sf)
    if section is not None:
        cfg = cfg.where(F.col("section") == section)
    rows = it.withColumn("kind", C.classify(F.col("model_file"), CLASSES)).join(cfg.withColumn("has_config", F.lit(True)), ["section", "index"], "left")
    return rows.withColumn("has_config", F.coalesce("has_config", F.lit(False)))


JOINED = f"with {ITEMS}, {BINARY}, joined as (select i.*, c.rot_y, c.rot_x, c.scale, c.section is not null as has_config, {CLASS_SQL} as kind from items i left join cfg c on i.section = c.section and i.\"index\" = c.\"index\")"


@query(f"with {ITEMS} select section, \"index\", name, model_file from items where section = 12")
def P1_section_filter(spark, sf):
    return C.select_items(items(spark, sf), 12).select("section", "index", "name", "model_file")


@query(f"with {ITEMS} select count(*) as n, sum(\"index\")::bigint as total from items")
def P1_index_without_section(spark, sf):
    """The index is not looked at, for no section is set."""
    return C.select_items(items(spark, sf), None, 5).agg(F.count("*").alias("n"), F.sum("index").alias("total"))


@query(f"with {ITEMS} select section, \"index\", name from items where section = 3 order by ordinal limit 20")
def P2_first_n(spark, sf):
    return C.select_items(items(spark, sf), 3, first=20).select("section", "index", "name")


@query("""with p as (select page_id, replace('Data/' || substr(url, 9) || '/', '/', case when page_id % 2 = 0 then chr(92) else '/' end) as path from pages where url is not null),
q as (select page_id, regexp_replace(replace(path, chr(92), '/'), '/$', '') as path from p)
select page_id, case when starts_with(path, 'Data/') then substr(path, 6) else path end as sub_dir from q""")
def P3_sub_path(spark, sf):
    path = F.concat(F.lit("Data/"), F.substring("url", 9, 1 << 30), F.lit("/"))
    path = F.when(F.col("page_id") % 2 == 0, F.translate(path, "/", "\\")).otherwise(path)
    return table(spark, sf, "pages").where("url is not null").select("page_id", C.sub_path(path, "Data/").alias("sub_dir"))


@query(f"with {ITEMS} select section, {NAMED} as section_name, count(*) as items from items group by section")
def C11_section_names(spark, sf):
    return items(spark, sf).groupBy("section").agg(F.count("*").alias("items")).withColumn("section_name", C.section_name(F.col("section"), NAMES))


@query(f"with {ITEMS} select \"index\", model_file, {CLASS_SQL} as kind from items")
def C10_classify(spark, sf):
    return items(spark, sf).select("index", "model_file", C.classify(F.col("model_file"), CLASSES).alias("kind"))


@query(f"with {ITEMS} select section, \"index\", model_file, ordinal = min(ordinal) over (partition by lower(model_file)) as is_new from items")
def P20_new_models(spark, sf):
    return C.first_seen(items(spark, sf), F.lower("model_file"), F.col("ordinal")).select("section", "index", "model_file", "is_new")


@query(f"with {ITEMS} select section, \"index\", row_number() over (partition by lower(model_file) order by ordinal) = 1 as is_new from items")
def W3_first_occurrence(spark, sf):
    return C.first_seen(items(spark, sf), F.lower("model_file"), F.col("ordinal")).select("section", "index", "is_new")


@query(JOINED + " select section, \"index\", has_config, rot_y, round(scale, 6) as scale from joined")
def J1_item_config_left_join(spark, sf):
    return joined(spark, sf).select("section", "index", "has_config", "rot_y", F.round("scale", 6).alias("scale"))


@query(f"with {ITEMS} select section, {NAMED} as section_name, \"index\", name, model_file, section || '/' || \"index\" || '.webp' as image from items")
def K1_manifest(spark, sf):
    return C.manifest(items(spark, sf).withColumn("section_name", C.section_name(F.col("section"), NAMES)))


@query(f"with {ITEMS} select section, string_agg('<Item Index=' || chr(34) || \"index\" || chr(34) || ' Name=' || chr(34) || replace(replace(replace(replace(name || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') || chr(34) || '/>', chr(10) order by ordinal) as body from items group by section")
def K3_xml_sections(spark, sf):
    line = F.concat(F.lit('<Item Index="'), F.col("index").cast("string"), F.lit('" Name="'), C.xml_escape(F.concat("name", F.lit(" <&>"))), F.lit('"/>'))
    rows = items(spark, sf).select("section", F.struct("ordinal", line.alias("line")).alias("r"))
    return rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("body"))


@query(JOINED + ", r as (select *, case when \"index\" % 97 = 0 then 'file not found' when \"index\" % 89 = 0 then 'no meshes' end as error from joined) select count(*) as items, count(*) filter (where error is null) as success, count(*) filter (where error is not null) as failed, round(100.0 * count(*) filter (where error is null) / count(*), 6) as percent from r")
def A7_success_counts(spark, sf):
    n, ok = F.count("*"), F.count_if("success")
    return failures(spark, sf).agg(n.alias("items"), ok.alias("success"), (n - ok).alias("failed"), F.round(100.0 * ok / n, 6).alias("percent"))


def failures(spark, sf):
    return C.results(items(spark, sf), F.when(F.col("index") % 97 == 0, "file not found").when(F.col("index") % 89 == 0, "no meshes"))


@query(f"with {ITEMS} select \"index\", name, case when \"index\" % 97 = 0 then 'file not found' else 'no meshes' end as error from items where \"index\" % 97 = 0 or \"index\" % 89 = 0 order by ordinal limit 20")
def O5_first_errors(spark, sf):
    return failures(spark, sf).where(~F.col("success")).orderBy("ordinal").limit(20).select("index", "name", "error")


@query(f"with {ITEMS} select section, \"index\", case when \"index\" % 97 = 0 then 'file not found' when \"index\" % 89 = 0 then 'no meshes' end as error, not (\"index\" % 97 = 0 or \"index\" % 89 = 0) as success from items")
def P19_validity_rows(spark, sf):
    return failures(spark, sf).select("section", "index", "error", "success")


@query(JOINED + " select count(*) as items, count(*) filter (where has_config) as with_config, count(*) filter (where not has_config) as without_config, round(100.0 * count(*) filter (where has_config) / count(*), 6) as percent, count(distinct lower(model_file)) as models, count(*) filter (where kind = 'misc') as misc from joined where section = 7")
def A8_audit_counters(spark, sf):
    return C.audit(joined(spark, sf, 7))


@query(JOINED + " select kind, count(*) as items from joined where section = 12 group by kind")
def A9_group_by_type(spark, sf):
    return joined(spark, sf, 12).groupBy("kind").agg(F.count("*").alias("items"))


@query(JOINED + f" select case when has_config then {CAMERA_SQL} else 'none' end as camera, count(*) as items from joined where section = 12 group by 1")
def A9_group_by_camera(spark, sf):
    camera = F.when(F.col("has_config"), G.camera_route(F.col("rot_y"))).otherwise("none")
    return joined(spark, sf, 12).groupBy(camera.alias("camera")).agg(F.count("*").alias("items"))


@query(f"with {ITEMS} select section, count(distinct lower(model_file)) as models from items group by section")
def A10_distinct_models(spark, sf):
    return items(spark, sf).groupBy("section").agg(F.count_distinct(F.lower("model_file")).alias("models"))


@query(JOINED + f" select kind, case when has_config then {CAMERA_SQL} else 'none' end as camera, count(*) as items, count(distinct lower(model_file)) as models, count(*) filter (where has_config) as with_config, min(\"index\") as first_index from joined where section = 12 group by 1, 2")
def X1_section_audit(spark, sf):
    camera = F.when(F.col("has_config"), G.camera_route(F.col("rot_y"))).otherwise("none")
    return joined(spark, sf, 12).groupBy("kind", camera.alias("camera")).agg(F.count("*").alias("items"), F.count_distinct(F.lower("model_file")).alias("models"), F.count_if("has_config").alias("with_config"), F.min("index").alias("first_index"))


@query(JOINED + " select \"index\", name, kind from joined where section = 12 and not has_config")
def X1_items_without_config(spark, sf):
    cfg = binary_config(spark, sf).where("section = 12")
    return items(spark, sf).where("section = 12").join(cfg, ["section", "index"], "left_anti").select("index", "name", C.classify(F.col("model_file"), CLASSES).alias("kind"))


@query(JOINED + ", q as (select \"index\", case when not has_config then 'no config' end as a, case when kind = 'misc' then 'unclassified' end as b, case when scale > 1.5 then 'large' end as c from joined where section = 7) select \"index\", concat_ws('; ', a, b, c) as problems from q where coalesce(a, b, c) is not null")
def X2_problem_list(spark, sf):
    rows = joined(spark, sf, 7)
    p = F.concat_ws("; ", F.when(~F.col("has_config"), "no config"), F.when(F.col("kind") == "misc", "unclassified"), F.when(F.col("scale") > 1.5, "large"))
    return rows.select("index", p.alias("problems")).where("problems <> ''")


@query(f"with {BINARY}, r as (select unnest(generate_series(1, 60)) as k) select r.k::bigint as \"index\", case when c.section is null then 'NO TRS' else 'found' end as state, c.rot_y from r left join (select * from cfg where section = 5) c on r.k = c.\"index\"")
def X8_config_range(spark, sf):
    cfg = binary_config(spark, sf).where("section = 5")
    return spark.range(1, 61).withColumnRenamed("id", "index").join(cfg, "index", "left").select("index", F.when(F.col("section").isNull(), "NO TRS").otherwise("found").alias("state"), "rot_y")


@query(f"with {BINARY} select section, \"index\", rot_x, rot_y from cfg where section = 9 order by \"index\" limit 1")
def X9_config_lookup(spark, sf):
    return binary_config(spark, sf).where("section = 9").orderBy("index").limit(1).select("section", "index", "rot_x", "rot_y")


@query(f"with {ITEMS} select distinct section from items")
def O2_sections(spark, sf):
    return items(spark, sf).select("section").distinct().orderBy("section")


@query(f"with {ITEMS} select \"index\", name from items where section = 12")
def O3_sorted_items(spark, sf):
    return items(spark, sf).where("section = 12").select("index", "name").orderBy("index")
