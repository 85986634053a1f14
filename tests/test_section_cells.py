import numpy as np
from pyspark.sql import functions as F

from quarry.operators import dense, fusion


def _vectors(spark, n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], i % 12) for i in range(n)]
    return spark.createDataFrame(rows, "owner_id bigint, embedding array<double>, section_id int")


def test_coarse_to_fine_by_cells(spark, monkeypatch):
    chunks = _vectors(spark, 240)
    queries = _vectors(spark, 40, seed=9).select(F.col("owner_id").alias("query_id"), "embedding")
    sections = _vectors(spark, 12, seed=4).select("owner_id", "embedding")
    m = lambda df, c: {r[c]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in df.collect()}
    q, s, v = m(queries, "query_id"), m(sections, "owner_id"), m(chunks, "owner_id")
    want = set()
    for i, x in q.items():
        best = sorted(s, key=lambda j: (round(1 - x @ s[j], 10), j))[:8]
        want |= {(i, o) for o in sorted((o for o in v if o % 12 in best), key=lambda o: (round(1 - x @ v[o], 10), o))[:3]}
    monkeypatch.setattr(dense, "VECTORS_PER_CELL", 7)
    got = fusion.coarse_to_fine(queries, sections, chunks, 3)
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == want
    assert got.count() == 120
