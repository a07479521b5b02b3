"""Byte ciphers over whole document texts: the XOR family as Arrow kernels, reduced to checksums. Tests hold them against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.plans.bindings import table
from tesserae.plans.registry import query
from tesserae.sources.binary import chained_xor_bytes

#: Test keys.
KEY3, KEY16 = bytes((1, 2, 3)), bytes(range(16))
SCHEMA = "doc_id long, n long, total long, mixed long"


def repeating_xor_bytes(data: bytes, key: bytes) -> bytes:
    b = np.frombuffer(data, np.uint8)
    return (b ^ np.resize(np.frombuffer(key, np.uint8), len(b))).tobytes()


def checksums(spark, sf, decode):
    """Length, sum, and sum weighted by place of each decoded text; a null text is empty."""

    def run(batches):
        for batch in batches:
            out = [np.frombuffer(decode(t) if t else b"", np.uint8).astype(np.int64) for t in batch.column(1).to_pylist()]
            rows = [[len(x) for x in out], [int(x.sum()) for x in out], [int((x * np.arange(1, len(x) + 1)).sum()) for x in out]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(r, pa.int64()) for r in rows]], names=["doc_id", "n", "total", "mixed"])

    return table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


@query()
def D2_repeating_xor(spark, sf):
    return checksums(spark, sf, lambda t: repeating_xor_bytes(t, KEY3))


@query()
def D1_chained_xor(spark, sf):
    return checksums(spark, sf, lambda t: chained_xor_bytes(t, KEY16))
