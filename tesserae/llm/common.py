"""What several operators share: texts as bytes, tables cut off from their lineage, connected components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of label exchange after which connected_components gives up instead of looping on; it halves paths, so no real graph gets there.
MAX_ROUNDS = 60


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or one of our own where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage is those files, so a lost executor costs a reread and no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/tesserae-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch while texts move to Python; Spark's own default of ten thousand long texts takes hundreds of megabytes a task.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches made small unless the session sets their size itself."""
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return df


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): the only columns that the operators take along, so that other columns can have any names. A null text is an empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def lean(run):
    """run for mapInArrow, after whose last batch the worker gives what it has freed back to the system: it is kept for the next task, and others need the memory meanwhile."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library has it
            trim(0)

    return whole


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """make() builds, once a task, a function from one Arrow batch as a dict of columns to a dict of columns."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step({k: batch.column(i) for i, k in enumerate(batch.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[k] for k in names)], names=names)

    return small_batches(df).mapInArrow(lean(run), schema)


class Forest:
    """Union-find over hashable items; the smallest item of a tree is its root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _spanning(edges: DataFrame) -> DataFrame:
    """Each task keeps a star for every tree that its own edges make; others say nothing new."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        nodes = list(forest.up)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


#: A key is hot if it has LEAST_HOT rows and over this share of all; so there are less than HOT_KEYS hot ones, whatever the data, and they can be broadcast.
HOT_KEYS, LEAST_HOT = 500, 1000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined (inner) with the one row that unique has for a key; n is how many rows have it. unique is read several times, so it should be a table.

    Rows of hot keys meet the few rows of those keys by broadcast, where they are; all others by an equi-join.
    """
    total, most = unique.agg(F.sum(n), F.max(n)).first()
    least = max(LEAST_HOT, (total or 0) // HOT_KEYS)
    if (most or 0) <= least:
        return rows.join(unique, key)
    hot = unique.where(F.col(n) > least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(unique, key)
    return rows.join(F.broadcast(hot), key).select(*rest.columns).union(rest)


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    return edges.join(least, "a") if few else join_unique(edges, cut(least, "least"), "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a long, b long), for every node that an edge names.

    Large-star and small-star rounds (Kiveris et al. 2014) on aggregates and equi-joins. Minima are summed partially; the edges of a
    hub meet its minimum by broadcast, so it is never gathered. Each round is cut into the shared folder. Stops when a round changes nothing.
    """
    e = cut(_spanning(edges.where("a <> b")), "edges").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    size, last = e.count(), None
    for _ in range(MAX_ROUNDS):
        few = size <= LEAST_HOT // 2
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, low, few).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = large if few else cut(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, few).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last, size = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def offsets(lengths) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64))))
