import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import ivf


def test_best_of_keeps_k_for_each_query():
    rows = [(1, 7, 0.5), (0, 3, np.nan), (1, 2, 0.5 + 1e-13), (0, 9, 0.2), (1, 4, 0.1), (2, 1, 0.0)]
    found = [pd.DataFrame(part, columns=["query_id", "owner_id", "distance"]) for part in (rows[:2], rows[2:], [])]
    got = ivf.best_of(found[:2], 2)
    assert list(zip(got["query_id"], got["owner_id"])) == [(0, 9), (0, 3), (1, 4), (1, 2), (2, 1)]
    assert ivf.best_of([f.astype({"query_id": int, "owner_id": int, "distance": float}) for f in found[2:]], 2).empty


def test_a_bundle_sends_k_rows_for_each_query(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 8)).round(1)
    table = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(np.concatenate([data, data[:40]]))], "owner_id string, embedding array<double>")
    queries = table.select(F.substring("owner_id", 2, 3).cast("int").alias("query_id"), "embedding")
    index = ivf.write(table, str(tmp_path / "f"), cells=20)
    monkeypatch.setattr(ivf, "FOUND_ROWS", 1)  # taken up by the function that is sent to the tasks
    sent = []
    monkeypatch.setattr(ivf, "top_k", lambda df, *a, top=ivf.top_k: sent.append(df) or top(df, *a))
    got = ivf.search(index, queries, 3, 7)
    assert len(ivf.bundles(index)) == 1
    assert sent[0].count() == 440 * 3  # before: 3 for each of the 7 cells
    cells = {r.owner_id: r.cell for r in index.vectors.collect()}
    near = {r.query_id: set(r.near) for r in ivf.nearest_cells(queries, index.centroids, 7).collect()}
    unit = {r.owner_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in table.collect()}
    for q in range(0, 440, 11):
        own = unit[f"v{q:03d}"]
        want = sorted((round(1 - float(own @ v), 10), o) for o, v in unit.items() if cells[o] in near[q])[:3]
        assert [r.owner_id for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == [o for _, o in want]
