"""Image statistics and shapes over embeddings as 8x8 images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import images as I
from tesserae.plans.bindings import TEXELS, texels
from tesserae.plans.registry import query


@query(f"with {TEXELS} select image, min(alpha) as least, max(alpha) as most, round(avg(alpha), 6) as mean, count(*) filter (where alpha = 255) as opaque, round(100.0 * count(*) filter (where alpha = 255) / count(*), 6) as percent from texels group by image")
def A11_alpha_statistics(spark, sf):
    return I.alpha_statistics(texels(spark, sf))


@query(f"with {TEXELS} select image, count(*) filter (where alpha > 0) as visible, count(*) filter (where alpha = 255) as opaque, round(coalesce(100.0 * count(*) filter (where alpha = 255) / nullif(count(*) filter (where alpha > 0), 0), 0.0), 6) as percent from texels group by image")
def A12_opaque_ratio(spark, sf):
    return I.opaque_ratio(texels(spark, sf))


@query(f"with {TEXELS} select image, round(avg((r + g + b) / 3.0), 6) as brightness from texels group by image")
def A13_mean_brightness(spark, sf):
    return I.brightness(texels(spark, sf))


@query(f"with {TEXELS} select image, floor(avg(r) + 0.5)::int as r, floor(avg(g) + 0.5)::int as g, floor(avg(b) + 0.5)::int as b, 255 as alpha from texels group by image")
def A6_mean_colour(spark, sf):
    return I.mean_colour(texels(spark, sf))


COV = f"{TEXELS}, sums as (select image, count(*) as n, sum(x)::bigint as sx, sum(y)::bigint as sy, sum(x * x)::bigint as sxx, sum(x * y)::bigint as sxy, sum(y * y)::bigint as syy from texels where alpha > 0 group by image having count(*) >= 10), cov as (select image, n, (n * sxx - sx * sx)::double / (n * n)::double as xx, (n * sxy - sx * sy)::double / (n * n)::double as xy, (n * syy - sy * sy)::double / (n * n)::double as yy from sums)"


@query(f"with {COV} select image, n, xx, xy, yy from cov")
def A17_covariance(spark, sf):
    return I.covariance(texels(spark, sf)).select("image", "n", "xx", "xy", "yy")


@query(f"with {COV}, e as (select image, (xx + yy) / 2 + sqrt(greatest((xx - yy) * (xx - yy) / 4 + xy * xy, 0.0)) as l1, xx, xy, yy from cov) select image, round(l1, 5) as l1, round(xx + yy - l1, 5) as l2, round(abs(case when abs(xy) < 1e-9 then case when xx >= yy then 1.0 else 0.0 end else (l1 - yy) / sqrt((l1 - yy) * (l1 - yy) + xy * xy) end), 5) as vx from e")
def G15_eigen(spark, sf):
    e = I.eigen2(F.col("xx"), F.col("xy"), F.col("yy"))
    return I.covariance(texels(spark, sf)).select("image", F.round(e["l1"], 5).alias("l1"), F.round(e["l2"], 5).alias("l2"), F.round(F.abs(e["vx"]), 5).alias("vx"))


@query(f"with {COV}, e as (select image, n, (xx + yy) / 2 + sqrt(greatest((xx - yy) * (xx - yy) / 4 + xy * xy, 0.0)) as l1, xx, xy, yy from cov), t as (select image, n, -45.0 - degrees(atan2(case when abs(xy) < 1e-9 then case when xx >= yy then 0.0 else 1.0 end else xy end, case when abs(xy) < 1e-9 then case when xx >= yy then 1.0 else 0.0 end else l1 - yy end)) as turn from e) select image, n, round(turn - 180 * floor((turn + 90) / 180), 4) as turn from t")
def I3_standardise_angle(spark, sf):
    return I.standardise_angle(texels(spark, sf))


@query(f"with {TEXELS} select image, case when count(*) filter (where alpha > 0) < 10 then 0.0 else round(stddev_pop(case when alpha > 0 then r end), 5) end as spread from texels group by image")
def A18_stddev_floor(spark, sf):
    return texels(spark, sf).groupBy("image").agg(F.round(I.stddev_floor(F.when(F.col("alpha") > 0, F.col("r"))), 5).alias("spread"))


@query(f"""with {TEXELS}, v as (select image, x, y, (min(x) over (partition by image) + max(x) over (partition by image)) / 2.0 as cx, (min(y) over (partition by image) + max(y) over (partition by image)) / 2.0 as cy, count(*) over (partition by image) as n from texels where alpha > 0),
h as (select image, n, round((x - cx) * cos(radians(-45)) + (y - cy) * sin(radians(-45)), 6) as along, -(x - cx) * sin(radians(-45)) + (y - cy) * cos(radians(-45)) as across from v),
s as (select image, any_value(n) as n, round(case when count(*) filter (where along >= 0) < 10 then 0.0 else stddev_pop(case when along >= 0 then across end) end, 4) as ahead, round(case when count(*) filter (where along < 0) < 10 then 0.0 else stddev_pop(case when along < 0 then across end) end, 4) as behind from h group by image)
select image, n, ahead, behind, n >= 20 and ahead > round(1.2 * behind, 4) as flip from s""")
def A19_flip_needed(spark, sf):
    return I.flip_needed(texels(spark, sf))


BOX = f"""{TEXELS}, b0 as (select image, min(x) filter (where alpha > 0) as x0, max(x) filter (where alpha > 0) as x1, min(y) filter (where alpha > 0) as y0, max(y) filter (where alpha > 0) as y1, min(x) as ax0, max(x) as ax1, min(y) as ay0, max(y) as ay1 from texels group by image),
box as (select image, case when thin then ax0 else x0 end as min_x, case when thin then ax1 else x1 end as max_x, case when thin then ay0 else y0 end as min_y, case when thin then ay1 else y1 end as max_y from (select *, coalesce(x1 <= x0 or y1 <= y0, true) as thin from b0))"""


@query(f"with {BOX} select * from box")
def A20_alpha_box(spark, sf):
    return I.crop_box(texels(spark, sf))


@query(f"with {BOX} select t.image, t.x - min_x as x, t.y - min_y as y, alpha from texels t join box b on t.image = b.image where x between min_x and max_x and y between min_y and max_y")
def I7_crop(spark, sf):
    return I.crop(texels(spark, sf)).select("image", "x", "y", "alpha")


@query(f"with {TEXELS} select image, 7 - x as x, 7 - y as y, alpha from texels")
def I6_turn_half(spark, sf):
    return I.turn_half(texels(spark, sf), 8, 8).select("image", "x", "y", "alpha")


@query(f"with {TEXELS} select image, 7 - x as x, y, alpha from texels")
def I11_mirror(spark, sf):
    return I.mirror(texels(spark, sf), 8).select("image", "x", "y", "alpha")


COMP = f"""{TEXELS}, v as (select image, x, y, y * 65536 + x as id from texels where alpha > 0),
comp as (with recursive reach(image, id, x, y, label) as (select image, id, x, y, id from v union select v.image, v.id, v.x, v.y, r.label from reach r join v on v.image = r.image and abs(v.x - r.x) <= 1 and abs(v.y - r.y) <= 1 where v.id > r.label) select image, x, y, min(label) as label from reach group by image, x, y)"""


def labels(spark, sf):
    return I.components(texels(spark, sf))


@query(f"with {COMP}, s as (select image, label, count(*) as size from comp group by 1, 2), w as (select image, sum(size) as visible, count(*) as parts from s group by 1) select c.image, c.x, c.y, c.label, s.size from comp c join s on c.image = s.image and c.label = s.label join w on c.image = w.image where parts <= 1 or size >= floor(visible * 0.1)")
def I2_small_clusters(spark, sf):
    px = texels(spark, sf)
    return I.drop_small(px, labels(spark, sf), 0.1).select("image", "x", "y", "label", "size")


@query(f"with {COMP}, s as (select image, label, count(*) as size from comp group by 1, 2) select image, label, size from (select *, row_number() over (partition by image order by size desc, label) as n from s) where n = 1")
def O6_largest_component(spark, sf):
    return I.largest_component(labels(spark, sf))
