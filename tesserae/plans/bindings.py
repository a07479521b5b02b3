"""Driver tables as the engine's tables, for queries that check an operator against SQL: each DataFrame and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: 22 sections, some 150 model names, part keys as indexes and as document order."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_size") % 22).alias("section"), F.col("p_partkey").cast("int").alias("index"), F.col("p_name").alias("name"), F.concat("p_type", F.lit("_"), "p_brand", F.lit(".bin")).alias("model_file"), F.col("p_partkey").alias("ordinal"))


ITEMS = "items as (select p_size % 22 as section, p_partkey::int as \"index\", p_name as name, p_type || '_' || p_brand || '.bin' as model_file, p_partkey as ordinal from part)"


def binary_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary layer: a third of the catalogue, angles from size and key."""
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    return p.select((F.col("p_size") % 22).alias("section"), F.col("p_partkey").cast("int").alias("index"), ((F.col("p_partkey") * 37) % 720 - 360).cast("double").alias("rot_y"), ((F.col("p_size") * 15) % 360).cast("double").alias("rot_x"), (F.col("p_retailprice") / 1000).alias("scale"))


BINARY = "cfg as (select p_size % 22 as section, p_partkey::int as \"index\", ((p_partkey * 37) % 720 - 360)::double as rot_y, ((p_size * 15) % 360)::double as rot_x, p_retailprice / 1000 as scale from part where p_partkey % 3 = 0)"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices (item, mesh, x, y, z, node): a mesh is a line number of a part; the bone node is the supplier key mod 7."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("mesh"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), (F.col("l_suppkey") % 7).alias("node"))


VERTICES = "vertices as (select l_partkey as item, l_linenumber as mesh, l_quantity as x, l_discount * 100 as y, l_tax * 100 as z, l_suppkey % 7 as node from lineitem)"


def mesh_names(item, mesh):
    """The texture path of a mesh: four stems, a fifth of them with a digit or an additive ending, two kinds of files."""
    kind = (item * 3 + mesh) % 5
    stem = F.concat(F.element_at(F.array(*map(F.lit, ("Blade", "glow", "Hilt", "skin_hair"))), ((item + mesh) % 4 + 1).cast("int")), F.when(kind == 0, F.lit("_R")).when(kind == 1, F.lit("01")).otherwise(F.lit("")))
    return F.concat(F.lit("Data\\Item\\"), stem, F.when((item + 2 * mesh) % 3 == 0, F.lit(".tga")).otherwise(F.lit(".jpg")))


MESH_NAME = "'Data\\Item\\' || (case (item + mesh) % 4 when 0 then 'Blade' when 1 then 'glow' when 2 then 'Hilt' else 'skin_hair' end) || (case (item * 3 + mesh) % 5 when 0 then '_R' when 1 then '01' else '' end) || (case when (item + 2 * mesh) % 3 = 0 then '.tga' else '.jpg' end)"


def texels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 images: image, x, y, alpha, r, g, b. A pixel is visible where the component is positive."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) >= 64")
    p = e.select(F.col("vec_id").alias("image"), F.posexplode(F.slice("embedding", 1, 64)).alias("k", "v"))
    v = F.col("v").cast("double")
    level = F.floor(F.least(F.greatest(F.abs(v) * 400, F.lit(0.0)), F.lit(255.0)) + F.lit(0.5)).cast("int")
    level = F.least(level, F.lit(255))
    return p.select("image", (F.col("k") % 8).cast("int").alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), F.when(v > 0.1, 255).when(v > 0, 128).otherwise(0).alias("alpha"), level.alias("r"), ((level * 3) % 256).alias("g"), (255 - level).alias("b"))


TEXELS = """texel0 as (select vec_id as image, unnest(generate_series(0, 63)) as k, embedding from embeddings where embedding is not null and len(embedding) >= 64),
texel1 as (select image, k, embedding[k + 1]::double as v from texel0),
texels as (select image, (k % 8)::int as x, (k // 8)::int as y, case when v > 0.1 then 255 when v > 0 then 128 else 0 end as alpha,
  least(floor(least(greatest(abs(v) * 400, 0.0), 255.0) + 0.5)::int, 255) as r, (least(floor(least(greatest(abs(v) * 400, 0.0), 255.0) + 0.5)::int, 255) * 3) % 256 as g, 255 - least(floor(least(greatest(abs(v) * 400, 0.0), 255.0) + 0.5)::int, 255) as b from texel1)"""
