"""Connected parts over part and supplier pairs, a graph for each of three groups of orders.

Labels of whole graphs are too many steps for recursive SQL; tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import components as C
from tesserae.plans.bindings import table
from tesserae.plans.registry import query

def labelled(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3).alias("g"), F.col("l_partkey").alias("a"), (F.lit(1000000) + F.col("l_suppkey")).alias("b")).distinct()
    nodes = p.select("g", F.col("a").alias("v")).union(p.select("g", F.col("b").alias("v")))
    return C.labels(nodes, p, ["g"])


@query()
def G3_component_labels(spark, sf):
    return labelled(spark, sf)


@query()
def A26_component_centres(spark, sf):
    rows = labelled(spark, sf).select("g", "label", *[(F.col("v") % 50).cast("double").alias(k) for k in "xyz"])
    return C.part_features(rows, ["g"]).select("g", "label", "n", F.round("cx", 6).alias("cx"))


@query()
def G3_kept_components(spark, sf):
    rows = labelled(spark, sf).select("g", "label", *[(F.col("v") % 50).cast("double").alias(k) for k in "xyz"])
    return C.kept_parts(C.part_features(rows, ["g"]), ["g"]).select("g", "label", "n", "keep")
