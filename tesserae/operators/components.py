"""Connected parts of meshes: vertices joined by polygon edges, and which parts a mesh keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.tables import cut


def labels(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, label): the least vertex of each vertex's part. nodes: keys, v; edges: keys, a, b. Each round takes the least label
    over edges and then the label of the label, and is cut; rounds end when nothing changes."""
    both = cut(edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    state, before = cut(nodes.select(*keys, "v").distinct().withColumn("label", F.col("v")), "nodes"), None
    while True:
        near = both.join(state.withColumnRenamed("v", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("v")).agg(F.min("label").alias("near"))
        low = cut(state.join(near, [*keys, "v"], "left").select(*keys, "v", F.least("label", F.coalesce("near", "label")).alias("label")), "labels")
        up = low.select(*keys, F.col("v").alias("label"), F.col("label").alias("up"))
        state = cut(low.join(up, [*keys, "label"]).select(*keys, "v", F.col("up").alias("label")), "labels")
        after = state.agg(F.sum("label")).first()[0]
        if after == before:
            break
        before = after
    return state


def kept_parts(parts: DataFrame, keys: list[str], least: int = 6, reach: float = 0.4) -> DataFrame:
    """parts (keys, label, n, boxes min_x.. and centres cx..) with keep: the largest part (of equal ones the first), any with so many
    vertices, and smaller ones whose centre lies within reach: a share of the largest part's longest span, as distance in space from
    its box. A mesh of up to twice least vertices or of one part
    keeps all; a vertex that no edge names counts as a vertex and not as a part."""
    big = parts.groupBy(*keys).agg(F.max_by(F.struct(*parts.columns), F.struct("n", -F.col("label"))).alias("big"), F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("parts"))
    edge = lambda n, k: F.col(f"big.{n}_{k}")
    off = [F.greatest(edge("min", k) - F.col(f"c{k}"), F.col(f"c{k}") - edge("max", k), F.lit(0.0)) for k in "xyz"]
    longest = F.greatest(*[edge("max", k) - edge("min", k) for k in "xyz"])
    near = F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) < reach * longest
    rows = parts.join(big, keys)
    keep = (F.col("total") <= 2 * least) | (F.col("parts") <= 1) | (F.col("label") == F.col("big.label")) | (F.col("n") >= least) | near
    return rows.withColumn("keep", keep).select(*parts.columns, "keep")


def part_features(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Size, box and centre of each part. labelled: keys, label, x, y, z."""
    stats = [f(k).alias(f"{n}{k}") for k in "xyz" for n, f in (("min_", F.min), ("max_", F.max), ("c", F.avg))]
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("n"), *stats)
