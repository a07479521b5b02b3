"""Queries that SQL can't say over whole tables, against plain Python."""

import pyarrow.parquet as pq

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"


def test_xor_checksums(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    sums = lambda b: (len(b), sum(b), sum(x * (i + 1) for i, x in enumerate(b)))
    three = {k: sums(bytes(x ^ (i % 3 + 1) for i, x in enumerate(t))) for k, t in docs.items()}
    chain = {k: sums(bytes(((x ^ i % 16) - ((t[i - 1] + 0x3D) & 255 if i else 0x5E)) & 255 for i, x in enumerate(t))) for k, t in docs.items()}
    for name, want in (("D2_repeating_xor", three), ("D1_chained_xor", chain)):
        assert {r.doc_id: (r.n, r.total, r.mixed) for r in registry.QUERIES[name](spark, SF).collect()} == want


def test_component_labels(spark):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_suppkey"]).to_pylist():
        g = r["l_orderkey"] % 3
        a, b = find((g, r["l_partkey"])), find((g, 1000000 + r["l_suppkey"]))
        up[max(a, b)] = min(a, b)
    got = {(r.g, r.v): r.label for r in registry.QUERIES["G3_component_labels"](spark, SF).collect()}
    assert got == {x: find(x)[1] for x in up}


def test_alpha_fold(spark):
    from tesserae.plans.raster_queries import frags

    pixels: dict = {}
    for r in frags(spark, SF).select("image", "sx", "sy", "tri").collect():
        pixels.setdefault((r.image, r.sx, r.sy), []).append(r.tri)
    want = {}
    for k, tris in pixels.items():
        v = 100
        for t in sorted(tris):
            a = (t % 200 + 20) / 255.0
            v = int(min(max((t % 256) * a + v * (1.0 - a), 0.0), 255.0) + 0.5)
        want[k] = v
    assert {(r.image, r.sx, r.sy): r.colour for r in registry.QUERIES["A24_alpha_fold"](spark, SF).collect()} == want
