import tempfile

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import dense, ivf


def _vectors(spark, n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], i % 12) for i in range(n)]
    return spark.createDataFrame(rows, "owner_id bigint, embedding array<double>, section_id int")


def test_an_inverted_file_sends_a_query_once_to_a_bundle(spark, monkeypatch):
    vectors = _vectors(spark, 400)
    queries = vectors.filter("owner_id % 4 = 0").select(F.col("owner_id").alias("query_id"), "embedding")
    exact = sorted((r.query_id, r.rank, r.owner_id) for r in dense.knn(queries, vectors, 5).collect())
    with tempfile.TemporaryDirectory() as path:
        file = ivf.write(vectors.select("owner_id", "embedding"), path, cells=30)
        assert len(ivf.bundles(file)) == 1
        assert sorted((r.query_id, r.rank, r.owner_id) for r in ivf.search(file, queries, 5, 30).collect()) == exact
        monkeypatch.setattr(ivf, "BLOCK_ROWS", 90)
        assert 4 < len(ivf.bundles(file)) < 30
        assert sorted((r.query_id, r.rank, r.owner_id) for r in ivf.search(file, queries, 5, 30).collect()) == exact
        near = {r.query_id: set(r.near) for r in ivf.nearest_cells(queries, file.centroids, 6).collect()}
        cell = {r.owner_id: r.cell for r in file.vectors.collect()}
        assert all(cell[r.owner_id] in near[r.query_id] for r in ivf.search(file, queries, 5, 6).collect())
