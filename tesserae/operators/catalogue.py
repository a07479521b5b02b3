"""Catalogue operators: filters, limits, paths, classes, counters, manifest rows. All are expressions, so filters and columns reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_items(items: DataFrame, section: int | None = None, index: int | None = None, first: int | None = None) -> DataFrame:
    """The chosen section, and the index within it: an index without a section is not looked at. first: so many in document order."""
    if section is not None and section >= 0:
        items = items.where(F.col("section") == section)
        if index is not None and index >= 0:
            items = items.where(F.col("index") == index)
    return items.orderBy("ordinal").limit(first) if first else items


def sub_path(path: Column, prefix: str) -> Column:
    """Slashes made alike, one closing slash cut, then the prefix, which is case-sensitive."""
    path = F.regexp_replace(F.translate(path, "\\", "/"), "/$", "")
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def stem(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(F.substring_index(F.translate(path, "\\", "/"), "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(F.translate(path, "\\", "/"), "/", -1), r"(\.[^.]*)$", 1))


def stem_base(path: Column) -> Column:
    """The stem in lower case without closing digits."""
    return F.regexp_replace(F.lower(stem(path)), "[0-9]+$", "")


def classify(text: Column, patterns: Sequence[tuple[str, str]], other: str = "misc") -> Column:
    """The label of the first pattern that is found anywhere in the text, letter case aside."""
    return reduce(lambda rest, p: F.when(text.rlike(f"(?i){p[0]}"), F.lit(p[1])).otherwise(rest), reversed(patterns), F.lit(other))


def section_name(section: Column, names: dict[int, str]) -> Column:
    """From a small fixed dictionary, with a generated name for others."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[section], F.concat(F.lit("Section "), section.cast("string")))


def first_seen(df: DataFrame, key: Column, order: Column, name: str = "is_new") -> DataFrame:
    """True at the first row of each key. The firsts are aggregated and compared, so that a frequent key is no window of its own."""
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    return df.withColumn("_key", key).join(first, "_key").withColumn(name, order == F.col("_first")).drop("_key", "_first")


def manifest(items: DataFrame, kind: str = "webp") -> DataFrame:
    """A row for each selected item, failed ones too, with the path of its image; the numbers stand as they are, without zeros before them."""
    return items.select("section", "section_name", "index", "name", "model_file", F.format_string(f"%d/%d.{kind}", "section", "index").alias("image"))


def audit(items: DataFrame) -> DataFrame:
    """Counters over rows that have has_config, rot_y, kind and model_file."""
    n = F.count("*")
    with_config = F.count_if("has_config")
    return items.agg(n.alias("items"), with_config.alias("with_config"), (n - with_config).alias("without_config"), F.round(100.0 * with_config / n, 6).alias("percent"), F.count_distinct(F.lower("model_file")).alias("models"), F.count_if(F.col("kind") == "misc").alias("misc"))


def keep_unless_all(df: DataFrame, drop: Column, group: Sequence[str]) -> DataFrame:
    """Rows without those to drop, except in groups where all would go: there all stay."""
    kept = F.sum(F.when(drop, 0).otherwise(1)).over(Window.partitionBy(*group))
    return df.withColumn("_drop", drop).withColumn("_kept", kept).where(~F.col("_drop") | (F.col("_kept") == 0)).drop("_drop", "_kept")


def results(items: DataFrame, errors: Column) -> DataFrame:
    """success and error for each item; an error is a row and not an exception."""
    return items.withColumn("error", errors).withColumn("success", F.col("error").isNull())


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
