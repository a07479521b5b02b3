"""The angle of I3 against its SQL where the last bit decides: main axes along the diagonals."""

import duckdb
import numpy as np

from tesserae.plans import registry


def same_as_sql(spark, folder, vectors):
    spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    want = {r[0]: (r[1], repr(r[2])) for r in db.sql(registry.ORACLES["I3_standardise_angle"]).fetchall()}
    rows = registry.QUERIES["I3_standardise_angle"](spark, str(folder)).collect()
    got = {r.image: (r.n, repr(r.turn)) for r in rows}
    assert len(rows) == len(got) and got == want
    return {t for _, t in got.values()}


def test_diagonal_axes(spark, tmp_path):
    """Pictures that are their own mirror images: turned by 90, -90, 0.0 and -0.0."""
    pictures = np.random.default_rng(5).normal(size=(4000, 8, 8))
    pictures = np.where(np.tri(8, dtype=bool), pictures, pictures.transpose(0, 2, 1))
    pictures[::2] = pictures[::2, ::-1]
    assert {"90.0", "-90.0", "0.0", "-0.0"} <= same_as_sql(spark, tmp_path, pictures.reshape(-1, 64).tolist())


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    bar = lambda a: a.astype(float).ravel().tolist()
    x, y = np.meshgrid(np.arange(8), np.arange(8))
    odd = [None, [], [1.0] * 63, [1.0] * 64, [1.0] * 70, [0.0] * 64, [-1.0] * 64, [float("nan")] * 64, [float("inf"), float("-inf")] * 32, [None, 1.0] * 32, bar(x == 3), bar(x < 2), bar(y < 2), bar(abs(x - y) < 2), bar(abs(x + y - 7) < 2)]
    same_as_sql(spark, tmp_path, odd + rng.normal(size=(200, 64)).tolist())
