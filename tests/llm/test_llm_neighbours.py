"""Problem 1 where lists are long: they are split by centroids of their own, and table sums prune."""

import numpy as np

from kmerframe.llm import neighbours


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 1500)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 64))
    x = (centres[rng.integers(0, 60, 3000)] + 0.4 * rng.standard_normal((3000, 64))).astype(np.float32)
    table = spark.createDataFrame([(i, 1, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, config_id int, embedding array<float>, embedded_at int")
    configs = spark.createDataFrame([(1, 8)], "config_id int, knn_top_k int")
    got = neighbours.nearest(table, configs).toPandas()
    assert not got.duplicated(["vec_id", "neighbour"]).any() and got["rank"].max() == 8 and got["vec_id"].nunique() == 3000
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -9)
    want = np.argsort(-near, axis=1, kind="stable")[:, :8]
    mine = got.groupby("vec_id")["neighbour"].apply(set)
    assert np.mean([len(mine[i] & set(want[i])) / 8 for i in range(3000)]) > 0.95
