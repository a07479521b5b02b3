"""SimHash near-duplicates: fingerprints of word shingles, and exact pairs within a Hamming distance through vantage-point trees.

Fingerprints are a single pass over each text. Distinct fingerprints only go on. A top tree, built by the driver from a bounded
sample, cuts the Hamming space into shards; a fingerprint lives in one shard and is also sent, as a query, to each shard beyond a
boundary that is within the radius (triangle bound), so the shards together see every pair. Within a shard a local tree answers
all queries with the same bound. The sample only balances shards: any vantage points and radii give the same pairs. A shard keeps
a spanning forest of the links it finds, which is all that components need.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Forest, connected_components, cut, join_unique, map_rows, texts_of

SEED = 42
#: Fingerprints of the driver's sample at least and at most, of them for a shard, of a shard as planned and at least, and of a leaf.
SAMPLE, MOST_SAMPLE, SEEDS, SHARD, SMALL, LEAF = 20_000, 2_000_000, 16, 20_000, 2000, 96
#: Shingles whose bits are counted at once.
AT_ONCE = 100_000


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bit i is 1 if set in over half of the hashes of all shingles, repeats included; zero without words. A-Z count as a-z, ASCII white space parts words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - size + 1
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, AT_ONCE):
        part = words[i : i + AT_ONCE + size - 1]
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)), repeat(SEED)), dtype="<u8")
        total += _bit_sums(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit. Up to 255 hashes add up in bytes, all 8 bits of a byte of the hash at once."""
    sums = np.zeros(64, dtype=np.int64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    if full:
        sums += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[full:].sum(axis=0, dtype=np.uint8 if len(bits) - full < 256 else np.int64)


def fingerprints(df: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long: the fingerprint's 64 bits as a signed number."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "fp": pa.array(np.array([fingerprint(t, size) for t in cols["text"].to_pylist()], dtype=np.uint64).view(np.int64))}

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id long, fp long")


class Node:
    """A vantage point with those within its radius inside and the rest outside, or a leaf of fingerprints."""

    __slots__ = ("point", "radius", "inside", "outside", "leaf")

    def __init__(self, fps: np.ndarray, leaf: int, depth: int = 64, rng=None):
        self.leaf = None
        rng = rng or np.random.default_rng(0)
        if len(fps) > leaf and depth:
            self.point = fps[rng.integers(len(fps))]
            d = np.bitwise_count(fps ^ self.point)
            self.radius = int(np.median(d))
            near = d <= self.radius
            if near.all():  # more than half are this far: part the farthest from the rest, if there is a rest
                self.radius -= 1
                near = d <= self.radius
            if near.any() and not near.all():
                self.inside, self.outside = Node(fps[near], leaf, depth - 1, rng), Node(fps[~near], leaf, depth - 1, rng)
                return
        self.leaf = fps


def pairs_within(root: Node, queries: np.ndarray, radius: int):
    """Blocks (indexes of queries, leaf, match matrix) of all fingerprints of the tree within radius of each query."""
    stack = [(root, np.arange(len(queries)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node.leaf is not None:
            for i in range(0, len(at), 4096):
                part = at[i : i + 4096]
                yield part, node.leaf, np.bitwise_count(queries[part, None] ^ node.leaf[None, :]) <= radius
            continue
        d = np.bitwise_count(queries[at] ^ node.point).astype(np.int16)
        stack.append((node.inside, at[d <= node.radius + radius]))
        stack.append((node.outside, at[d > node.radius - radius]))


def leaves_of(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaf is not None:
            out.append(node)
        else:
            stack += [node.outside, node.inside]
    return out


def links(distinct: DataFrame, radius: int = 2, shard: int | None = None) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of the pairs of distinct fingerprints (column fp) within radius.

    The sample is SEEDS fingerprints for each shard that is planned, MOST_SAMPLE at most (16 MB): beyond 2.5 billion distinct
    fingerprints shards grow with them. Small inputs get as many shards as there are cores, if those have SMALL fingerprints each.
    """
    n = distinct.count()
    size = max(1, min(shard or SHARD, max(SMALL, n // distinct.sparkSession.sparkContext.defaultParallelism)) if shard is None else shard)
    want = min(MOST_SAMPLE, max(SAMPLE, n // size * SEEDS))
    part = distinct.select("fp") if n <= want else distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(want / n * (1 << 30)))
    seeds = np.array(part.toArrow().column(0).to_numpy(), dtype=np.int64).view(np.uint64)
    seeds.sort()
    top = Node(seeds, max(1, len(seeds) * size // max(n, 1)))
    number = {id(x): i for i, x in enumerate(leaves_of(top))}
    for x in leaves_of(top):
        x.leaf = np.array([number[id(x)]])  # only its number goes to the tasks

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            stack = [(top, np.arange(len(fp)), np.ones(len(fp), bool))]
            while stack:
                node, at, own = stack.pop()
                if not len(at):
                    continue
                if node.leaf is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), node.leaf[0], np.int32)), pa.array(fp[at].view(np.int64)), pa.array(own)], names=["shard", "fp", "own"])
                    continue
                d = np.bitwise_count(fp[at] ^ node.point).astype(np.int16)
                near, far = d <= node.radius + radius, d > node.radius - radius
                stack.append((node.inside, at[near], own[near] & (d[near] <= node.radius)))
                stack.append((node.outside, at[far], own[far] & (d[far] > node.radius)))

    def search(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        own = table.column("own").to_numpy()
        forest, a, b = Forest(), [], []
        if own.any():
            for at, leaf, hit in pairs_within(Node(fp[own], LEAF), fp, radius):
                q, k = np.nonzero(hit)
                left, right = fp[at[q]], leaf[k]
                for x, y in zip(left[left != right].tolist(), right[left != right].tolist(), strict=True):
                    if forest.join(x, y):
                        a.append(x)
                        b.append(y)
        return pa.table({"a": pa.array(np.array(a, dtype=np.uint64).view(np.int64)), "b": pa.array(np.array(b, dtype=np.uint64).view(np.int64))})

    return distinct.select("fp").mapInArrow(deal, "shard int, fp long, own boolean").groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(df: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Equal fingerprints link, those of texts without words included. Null text: no words. A row with a null id keeps its
    fingerprint and component; it names no component itself unless all ids of the component are null. Repeated rows stay.
    """
    docs = cut(fingerprints(df, size, id_col, text_col), "fingerprints")
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    comp = connected_components(links(distinct, radius))
    rooted = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("root"))
    low = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "roots")
    named = cut(join_unique(rooted, low, "root", "members").select("fp", "n", "component_id"), "named")
    return join_unique(docs, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(df: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with exactly one row of each component: the first by (id, a null one last; place among the rows).

    Rows are numbered and written with their number before anything else reads them, so rows that share an id, or have none,
    are told apart; the rows, not the ids, are what goes or stays. All columns stay.
    """
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    docs = fingerprints(rows, size, "__row", text_col).withColumnRenamed("doc_id", "__row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row"))
    named = docs.join(rows.select("__row", F.col(id_col).alias("id")), "__row")
    distinct = cut(named.groupBy("fp").agg(first.alias("first")), "distinct")
    comp = connected_components(links(distinct, radius))
    rooted = distinct.join(comp, distinct.fp == comp.node, "left").select("first", F.coalesce("component", "fp").alias("root"))
    lead = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(lead, "__row", "left_semi").drop("__row")
