"""Metrics, classification, nearest neighbours and fusion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense as dn
from quarry.operators import fusion as fu
from quarry.operators import hooks
from quarry.operators import metrics as mt
from quarry.scale import running_totals


def test_ranking_metrics(spark):
    run = spark.createDataFrame([("m", 1, f"d{i}", i) for i in range(1, 6)], "method string, query_id int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, d, 1) for d in ("d2", "d4", "d9")], "query_id int, doc_id string, grade int")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = {r.query_id: r for r in mt.per_query(run, qrels, queries, ["m"]).collect()}
    assert rows[1]["P@5"] == 0.4 and rows[1]["P@10"] == 0.2 and rows[1]["R@10"] == pytest.approx(2 / 3)
    assert rows[1]["MRR@10"] == 0.5 and rows[1]["nDCG@10"] == pytest.approx(0.498189, abs=1e-6)
    assert all(rows[2][m] == 0.0 for m in mt.METRICS)
    assert mt.average(mt.per_query(run, qrels, queries, ["m"])).first()["P@5"] == pytest.approx(0.2)


def labeled(spark, *rows):
    return spark.createDataFrame(list(rows), "score double, label boolean")


def test_roc_auc(spark):
    auc = lambda *rows: mt.roc_auc(labeled(spark, *rows)).first()
    assert auc((0.1, False), (0.4, False), (0.35, True), (0.8, True)).auc == 0.75
    assert auc((0.5, True), (0.5, False)).auc == 0.5
    assert auc((0.5, True), (0.5, False), (0.2, False)).auc == 0.75
    one = auc((0.5, True), (0.2, True))
    assert one.auc is None and one.reason


def test_confusion_and_best_threshold(spark):
    c = mt.confusion(labeled(spark, (0.33, True), (0.5, True), (0.4, False), (0.1, True)), 0.33).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (2, 1, 0, 1)
    b = mt.best_f1(labeled(spark, (0.9, True), (0.7, True), (0.6, False), (0.1, False))).first()
    assert (b.threshold, b.best_f1) == (0.7, 1.0)


def test_running_totals_over_many_blocks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"), F.lit(1).alias("one"))
    got = {(r.k, r.x): r.run_one for r in running_totals(df, ["k"], "x", ["one"], blocks=7).collect()}
    assert got == {(x % 3, x): x // 3 + 1 for x in range(500)}


def test_grid_and_broadcast_search_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 8))
    m[7] = m[3]
    m[11] = 0.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    v = spark.createDataFrame(rows, "owner_id bigint, embedding array<float>").repartition(5)
    q = v.withColumnRenamed("owner_id", "query_id")
    a = {(r.query_id, r.rank): r.owner_id for r in dn.knn(q, v, 4).collect()}
    old = dn.VECTORS_PER_CELL, dn.QUERIES_PER_CELL
    dn.VECTORS_PER_CELL, dn.QUERIES_PER_CELL = 17, 13
    try:
        b = {(r.query_id, r.rank): r.owner_id for r in dn.knn(q, v, 4, max_query_rows=0).collect()}
    finally:
        dn.VECTORS_PER_CELL, dn.QUERIES_PER_CELL = old
    f = m.astype(np.float32).astype(np.float64)
    n = np.linalg.norm(f, axis=1, keepdims=True)
    n[n == 0] = 1
    d = np.round(1 - (f / n) @ (f / n).T, 10)
    want = {(i, r + 1): j for i in range(60) for r, j in enumerate(np.lexsort((np.arange(60), d[i]))[:4])}
    assert a == b == want


def test_rrf(spark):
    v = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.2)], "query_id int, chunk_id string, rank int, distance double")
    x = spark.createDataFrame([(1, "a", 1, 9.0), (1, "c", 2, 8.0)], "query_id int, chunk_id string, rank int, score double")
    rows = fu.fuse_rrf(v, x).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["a", "b", "c"] and rows[0].fused_score == pytest.approx(2 / 61)
    assert rows[2].distance is None and rows[0].distance == 0.1


def test_coarse_to_fine_falls_back_per_query(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<double>")
    sections = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(8)] + [(20, [0.0, 1.0])], "owner_id int, embedding array<double>")
    chunks = spark.createDataFrame([(100, 0, [1.0, 0.0])], "owner_id int, section_id int, embedding array<double>")
    flat = spark.createDataFrame([(100, 99, [1.0, 0.0])], "owner_id int, section_id int, embedding array<double>")
    assert {r.strategy for r in fu.coarse_to_fine(q, sections, chunks, 3).filter("query_id = 1").collect()} == {"hierarchical"}
    assert [(r.query_id, r.strategy) for r in fu.coarse_to_fine(q, sections, flat, 3).orderBy("query_id").collect()] == [(1, "flat"), (2, "flat")]


def test_rerank_keeps_order_without_scores(spark):
    hits = spark.createDataFrame([(q, c, r) for q in (1, 2) for r, c in enumerate("abc", 1)], "query_id int, chunk_id string, rank int")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "a", 0.1), (1, "b", 0.5)], "query_id int, chunk_id string, rerank_score double")
    rows = fu.rerank(hits, scores, 2).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in rows] == ["c", "b", "a", "b"]
    gate = fu.weak_evidence(hits.select("query_id").distinct(), fu.assemble_context(fu.rerank(hits, scores, 2)), 0.95)
    assert {r.query_id: r.fires for r in gate.collect()} == {1: True, 2: False}


def test_upsert_and_embed(spark):
    old = spark.createDataFrame([("chunk", 1, "m", [1.0], 1)], "owner_type string, owner_id int, model string, embedding array<double>, v int")
    new = spark.createDataFrame([("chunk", 1, "m", [2.0], 2), ("chunk", 2, "m", [3.0], 1)], old.schema)
    assert sorted(r.embedding[0] for r in dn.upsert(old, new, "v").collect()) == [2.0, 3.0]
    texts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "owner_id int, text string")
    out = {r.owner_id: r.embedding for r in dn.embed(texts, hooks.text_hash_embedder(4), "h", 4).collect()}
    assert out[1] == out[3] != out[2] and np.linalg.norm(out[1]) == pytest.approx(1.0, abs=1e-6)
