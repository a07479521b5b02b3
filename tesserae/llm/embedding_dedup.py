"""Near-duplicate embeddings: int8 tile products with a rigorous error bound, and full precision for what may reach the threshold.

A unit vector u is s*q + e with q in int8 and the length of e known, so u.v differs from s_u s_v q_u.q_v by at most
|e_u| + |e_v| (1 + |e_u|). A pair whose product and bound stay below the threshold is out for certain; all others are computed in
double precision. Products of int8 codes are exact in float32 up to 1,040 dimensions and are summed in parts beyond.

Only pairs that may reach the threshold are decided in double precision, all by the same sum over the same two vectors: where many
do, a matrix product settles those that are further from the threshold than its rounding, and the sum decides the rest.

Equal vectors are one node with a multiplicity first. Nodes are dealt into blocks, and each pair of blocks is a tile of its own; a
tile returns, for each node, its number of links and a spanning forest of the links, never the pairs. A vector goes to as many tiles
as there are blocks, so blocks are as large as keeps the cores busy, up to BLOCK nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import connected_components, cut, join_unique, map_rows

#: Nodes of a block, at most and at least; of a part of a tile that is multiplied at once.
BLOCK, SMALL, PART = 32_768, 1024, 2048
#: Dimensions whose int8 products sum exactly in float32.
EXACT = 1024
#: From this share of candidates on a part's candidates are first settled by a matrix product, which is exact to ROUNDING.
DENSE, ROUNDING = 0.02, 1e-11


def canonical(x) -> bytes:
    """The components in double precision, or nothing for a vector that can't link: null, empty, zero, with null or non-finite components."""
    if x is None or not len(x):
        return b""
    v = np.array(x, dtype=np.float64) + 0.0  # -0.0 is 0.0
    return v.tobytes() if np.isfinite(v).all() and v.any() else b""


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error lengths (rounded up) of unit rows."""
    scale = np.maximum(np.abs(u).max(axis=1), 1e-300) / 127
    q = np.rint(u / scale[:, None])
    err = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, err


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[:, :EXACT].astype(np.float32) @ b[:, :EXACT].astype(np.float32).T
    for i in range(EXACT, a.shape[1], EXACT):
        out = out.astype(np.float64) + (a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T)
    return out


class Links:
    """Links and components of one tile's nodes, which are numbered from 0."""

    def __init__(self, mult: np.ndarray):
        self.mult, self.n, self.root = mult, np.zeros(len(mult), dtype=np.int64), np.arange(len(mult))

    def union(self, nodes: np.ndarray) -> None:
        found = np.unique(self.root[nodes])
        if len(found) > 1:
            self.root[np.isin(self.root, found[1:])] = found[0]

    def add_pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        self.n += np.bincount(i, self.mult[j], len(self.n)).astype(np.int64) + np.bincount(j, self.mult[i], len(self.n)).astype(np.int64)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if self.root[a] != self.root[b]:
                self.union(np.array([a, b]))

    def add_matrix(self, hit: np.ndarray, i0: int, j0: int) -> None:
        """hit[i, j]: node i0 + i links to node j0 + j."""
        self.n[i0 : i0 + hit.shape[0]] += hit @ self.mult[j0 : j0 + hit.shape[1]]
        self.n[j0 : j0 + hit.shape[1]] += self.mult[i0 : i0 + hit.shape[0]] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            self.union(np.concatenate(([i0 + i], j0 + np.flatnonzero(hit[i]))))


def cosines(u: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows, by a sum that doesn't depend on what else is computed or on the order of a pair."""
    return np.concatenate([(u[x[i : i + 100_000]] * u[y[i : i + 100_000]]).sum(axis=1) for i in range(0, len(x), 100_000)]) if len(x) else np.zeros(0)


def tile(vectors: np.ndarray, first: int, mult: np.ndarray, threshold: float) -> Links:
    """Links between vectors[:first] and vectors[first:], or among all where first is 0."""
    u = unit(vectors)
    q, scale, err = quantise(u)
    links, n = Links(mult), len(u)
    rows, cols = (range(0, n, PART), range(0, n, PART)) if not first else (range(0, first, PART), range(first, n, PART))
    for i in rows:
        a = slice(i, min(i + PART, first or n))
        for j in cols:
            if not first and j < i:
                continue
            b = slice(j, min(j + PART, n))
            gap = threshold - err[a] - err[b].max() * (1 + err[a])
            need = np.where(gap > 0, gap / (scale[a] * scale[b].max()), -np.inf)
            hit = int8_product(q[a], q[b]) >= np.nextafter(need.astype(np.float32), np.float32(-np.inf))[:, None]
            if i == j:
                hit = np.triu(hit, 1)
            at = np.flatnonzero(hit)
            if len(at) > DENSE * hit.size:
                product = u[a] @ u[b].T
                x, y = np.nonzero(hit & (np.abs(product - threshold) <= ROUNDING))
                hit &= product >= threshold
                hit[x, y] = cosines(u, x + i, y + j) >= threshold
                links.add_matrix(hit, i, j)
            elif len(at):
                x, y = at // hit.shape[1] + i, at % hit.shape[1] + j
                ok = cosines(u, x, y) >= threshold
                links.add_pairs(x[ok], y[ok])
    return links


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a row.

    A vector that can't link has no links and is its own component. Vectors of different lengths don't link. Rows with one vector
    link with each other, repeated ids too. A null id stays, and its component is named by an id that isn't null if it has one.
    threshold is in (0, 1].
    """
    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v"))

    def make():
        def step(cols):
            raw = [canonical(None if x is None or None in x else x) for x in cols["v"].to_pylist()]
            return {"vec_id": cols["vec_id"], "raw": pa.array(raw, pa.binary()), "digest": pa.array([hashlib.sha256(x).digest()[:16] if x else None for x in raw], pa.binary())}

        return step

    rows = cut(map_rows(source, make, "vec_id long, raw binary, digest binary"), "vectors")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"), F.first("raw").alias("raw"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    busy = int((6 * df.sparkSession.sparkContext.defaultParallelism) ** 0.5)  # blocks whose pairs are three tiles a core
    blocks = max(1, -(-n // BLOCK), min(busy, -(-n // SMALL)))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    dealt = nodes.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    dealt = dealt.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "mult", "raw")

    def run(key, table):
        out = []
        block, size = table.column("block").to_numpy(), np.array([len(x) for x in table.column("raw").to_pylist()])
        for k in np.unique(size):
            part = table.filter(pa.array(size == k))
            own = block[size == k] != key[0].as_py()
            order = np.argsort(own, kind="stable")
            first = int((~own).sum())
            if key[0].as_py() == key[1].as_py():
                first = 0
            elif first in (0, len(own)):
                continue
            node = part.column("node").to_numpy()[order]
            vectors = np.frombuffer(b"".join(part.column("raw").to_pylist()), dtype=np.float64).reshape(-1, k // 8)[order]
            links = tile(vectors, first, part.column("mult").to_numpy()[order], threshold)
            keep = (links.n > 0) | (links.root != np.arange(len(node)))
            out.append(pa.table({"node": node[keep], "n": links.n[keep], "root": node[links.root[keep]]}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in ("node", "n", "root")})

    found = cut(dealt.groupBy("lo", "hi").applyInArrow(run, "node long, n long, root long"), "links")
    comp = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    full = nodes.select("node", "digest", "low", "mult").join(sums, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    low = full.groupBy("root").agg(F.min("low").alias("component_id"))
    full = cut(full.join(low, "root").select("digest", "mult", "component_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "full")
    out = join_unique(rows.where("digest is not null").select("vec_id", "digest"), full, "digest", "mult").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("digest is null").select("vec_id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
