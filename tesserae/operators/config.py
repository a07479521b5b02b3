"""Layered configuration: binary rows, then sections, models and item ranges; presets, resolutions, defaults and routing.

Layers are small next to the catalogue, yet nothing is collected or looped over: keys are parsed and exploded, layers are joined on
(section, index), and the last layer that has a row wins by a CASE. A field is null where a layer says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("rot_x", "rot_y", "scale", "display_angle", "fill_ratio", "fov", "bones", "width", "height", "camera")
#: What a custom entry has where it says nothing.
DEFAULTS = {"rot_x": 0.0, "rot_y": 0.0, "scale": 0.0, "display_angle": -45.0, "fill_ratio": 0.70, "fov": 75.0}


def parse_ranges(df: DataFrame, key: str) -> DataFrame:
    """s_a or s_a-b to section, first, last; keys of any other form, or with a > b, give no row."""
    part = lambda i: F.regexp_extract(key, r"^([+-]?\d+)_([+]?\d+)(?:-([+]?\d+))?$", i)
    rows = df.where(F.col(key).rlike(r"^[+-]?\d+_[+]?\d+(-[+]?\d+)?$"))
    rows = rows.withColumns({"section": part(1).cast("int"), "first": part(2).cast("int"), "last": F.when(part(3) == "", part(2)).otherwise(part(3)).cast("int")})
    return rows.where("first <= last")


def expand_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """One row an index: the narrowest range that covers it, then the greater key."""
    rows = ranges.withColumn("index", F.explode(F.sequence("first", "last")))
    order = Window.partitionBy("section", "index").orderBy((F.col("last") - F.col("first")).asc(), F.col(key).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "first", "last")


def dereference(entries: DataFrame, presets: DataFrame) -> DataFrame:
    """Entries that name a preset get its fields; a name that no preset has drops the entry; entries without a name keep their own."""
    p = presets.select(F.col("preset").alias("_p"), *[F.col(f).alias(f"_{f}") for f in FIELDS])
    rows = entries.join(p, F.col("preset") == F.col("_p"), "left").where("preset is null or _p is not null")
    return rows.select(*[c for c in entries.columns if c not in FIELDS], *[F.when(F.col("_p").isNotNull(), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in FIELDS])


def with_resolution(entries: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Width and height of the named resolution where the entry has none above zero."""
    r = resolutions.select(F.col("resolution").alias("_r"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    rows = entries.join(r, F.col("resolution") == F.col("_r"), "left")
    fill = lambda own, other: F.coalesce(F.when(F.col(own) > 0, F.col(own)), F.when(F.col(other) > 0, F.col(other)))
    return rows.withColumns({"width": fill("width", "_w"), "height": fill("height", "_h")}).drop("_r", "_w", "_h")


def with_defaults(prefix: str = "") -> list[Column]:
    return [F.coalesce(F.col(prefix + f), F.lit(DEFAULTS.get(f))).alias(prefix + f) if f in DEFAULTS else F.col(prefix + f) for f in FIELDS]


def overlay(items: DataFrame, binary: DataFrame, sections: DataFrame, models: DataFrame, ranges: DataFrame) -> DataFrame:
    """The effective row of each catalogue item that has one: section, index, source and FIELDS.

    sections: section, merge, override, FIELDS; models: model_file, FIELDS; ranges: section, index, FIELDS (expanded). A section
    makes rows where the binary layer has none; else merge sets the fields it names, override replaces, and otherwise the binary
    row stays; merge goes before override. Models replace, letter case aside; item ranges replace, and take only width and height
    from their section.
    """
    struct = lambda names=FIELDS: F.struct(*names)
    keys = items.select("section", "index", F.lower("model_file").alias("_m"))
    b = binary.select("section", "index", struct().alias("b"))
    s = sections.select("section", "merge", "override", struct().alias("s"))
    m = models.groupBy(F.lower("model_file").alias("_m")).agg(F.max_by(struct(), "model_file").alias("m"))
    r = ranges.select("section", "index", struct().alias("r"))
    rows = keys.join(b, ["section", "index"], "left").join(s, "section", "left").join(m, "_m", "left").join(r, ["section", "index"], "left")
    kind = F.when(F.col("r").isNotNull(), "item").when(F.col("m").isNotNull(), "model").when(F.col("s").isNotNull() & F.col("b").isNull(), "section").when(F.col("s").isNotNull() & F.col("merge"), "merged").when(F.col("s").isNotNull() & F.col("override"), "section").when(F.col("b").isNotNull(), "binary")
    rows = rows.withColumn("layer", kind).where("layer is not null")

    def field(f: str) -> Column:
        default = F.lit(DEFAULTS.get(f))
        custom = lambda layer: F.coalesce(F.col(f"{layer}.{f}"), default)
        inherited = F.coalesce(F.when(F.col(f"r.{f}") > 0, F.col(f"r.{f}")), F.col(f"s.{f}")) if f in ("width", "height") else custom("r")
        return F.when(F.col("layer") == "item", inherited).when(F.col("layer") == "model", custom("m")).when(F.col("layer") == "section", custom("s")).when(F.col("layer") == "merged", F.coalesce(F.col(f"s.{f}"), F.col(f"b.{f}"))).otherwise(F.col(f"b.{f}")).alias(f)

    return rows.select("section", "index", F.when(F.col("layer").isin("binary", "merged"), "binary").otherwise("custom").alias("source"), *map(field, FIELDS))


def angle_distance(a: Column, b) -> Column:
    """The shorter arc in degrees."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def camera_route(rot_y: Column, explicit: Column | None = None) -> Column:
    """The camera that is named, else correction near 270, fallback near 90, noflip elsewhere."""
    route = F.when(angle_distance(rot_y, 270.0) <= 45, "correction").when(angle_distance(rot_y, 90.0) <= 45, "fallback").otherwise("noflip")
    return route if explicit is None else F.coalesce(F.when(explicit != "", explicit), route)


def uses_bones(has_entry: Column, bones: Column, source: Column, rot_y: Column) -> Column:
    """Without an entry yes; as the entry says; a binary row only near 90 degrees and not near 270; a custom row yes."""
    near = (angle_distance(rot_y, 90.0) <= 45) & ~(angle_distance(rot_y, 270.0) <= 45)
    return F.when(~has_entry, True).when(bones.isNotNull(), bones).when(source == "binary", near).otherwise(True)


def first_set(*layers: Column) -> Column:
    """The first that is neither null nor zero: command line, file, detected."""
    return F.coalesce(*[F.when(x != 0, x) for x in layers])
