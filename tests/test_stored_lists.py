"""Searches over stored lists and the inverted file against the plain scans."""

import random
import tempfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, index as ix, ivf, lists, ranked as rk


@pytest.fixture(scope="module")
def indexes(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words[:10], k=3)), " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(200 + i, "", rows[7][2]) for i in range(8)]  # ties
    zones = ix.zone_rows(spark.createDataFrame(rows, "doc_id int, title string, body string"), {"heading": F.col("title"), "body": F.col("body")})
    plain = ix.held(ix.build(zones, stemmer="none", champion_r=5))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lists.write, "__defaults__", (16,))  # several shards
        stored = ix.held(ix.build(zones, stemmer="none", champion_r=5), lists=True)
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w40 w41 w42 w43 w44 w45 w46 w47"), (3, "w1 w1 w59 nothing"), (4, "nothing"), (5, "")], "query_id int, query string")
    return plain, stored, queries


@pytest.mark.parametrize("options", [{}, {"scheme": "tfidf"}, {"zone_weights": {"heading": 2.0, "body": 1.0}}, {"use_champions": True},
                                     {"use_champions": True, "scheme": "tfidf", "zone_weights": {"heading": 2.0, "none": 3.0}}, {"k1": 0.5, "b": 0.2, "idf_threshold": 0.3}])
def test_early_termination_is_exact(indexes, options):
    plain, stored, queries = indexes
    for k in (2, 200):
        assert sorted(map(tuple, rk.search(stored, queries, k=k, **options).collect())) == sorted(map(tuple, rk.search(plain, queries, k=k, **options).collect()))


def test_champions_come_from_the_stored_cuts(indexes):
    plain, stored, _ = indexes
    assert sorted(map(tuple, ix.champions(stored).collect())) == sorted(map(tuple, ix.champions(plain).collect()))


def test_scan_is_filtered_by_term_and_fewer_postings_are_touched_for_smaller_k(indexes):
    _, stored, queries = indexes
    plan = rk.search(stored, queries, k=3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "dynamicpruning" in plan
    touched = [rk.early(stored, queries, k).groupBy().sum("touched").first()[0] for k in (1, 60)]
    assert touched[0] <= touched[1] * 60
    order = [(9.0, np.arange(50), np.full(50, 9)), *((1.0, np.arange(100), np.full(100, 1)) for _ in range(7))]
    assert lists.best_sums(order, 100, 2)[2] < lists.best_sums(order, 100, 90)[2]


def test_saved_index_has_lists(spark, indexes):
    plain, _, queries = indexes
    with tempfile.TemporaryDirectory() as path:
        ix.save(plain, path)
        loaded = ix.load(spark, path, stemmer="none", champion_r=5)
        assert sorted(map(tuple, rk.search(loaded, queries, k=5).collect())) == sorted(map(tuple, rk.search(replace(plain, lists=None), queries, k=5).collect()))


def test_inverted_file(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))).astype(float)
    rows = [(i, [float(v) for v in x[i]], "m") for i in range(600)] + [(900, [0.0] * 16, "m"), (901, None, "m")]
    vectors = spark.createDataFrame(rows, "owner_id bigint, embedding array<double>, model string")
    queries = vectors.filter("owner_id % 10 = 0").select(F.col("owner_id").alias("query_id"), "embedding")
    with tempfile.TemporaryDirectory() as path:
        file = ivf.write(vectors, path, cells=24, block_rows=20)
        exact = {(r.query_id, r.rank): r.owner_id for r in dense.knn(queries, vectors.filter("embedding is not null"), 10).collect()}
        whole = {(r.query_id, r.rank): r.owner_id for r in ivf.search(file, queries, 10, 24).collect()}
        assert whole == exact
        some = ivf.search(file, queries, 10, 4)
        assert "PartitionFilters: [isnotnull(cell" in some._jdf.queryExecution().toString() or "dynamicpruning" in some._jdf.queryExecution().toString()
        wanted = {(q, o) for (q, _), o in exact.items()}
        recall = len({(r.query_id, r.owner_id) for r in some.collect()} & wanted) / len(wanted)
        share = ivf.rows_read(file, queries, 4).agg(F.avg("share")).first()[0]
        assert recall >= 0.9 and share < 0.25
        assert ivf.search(ivf.read(spark, path), queries, 3, 24).count() == 3 * queries.count()


def test_last_version_replaces_all_zones(spark):
    rows = [(1, "heading", "old title", 1), (1, "body", "old body", 1), (1, "body", "new body", 2), (2, "body", "kept", 1)]
    zones = spark.createDataFrame(rows, "doc_id int, zone string, text string, version int")
    assert sorted(map(tuple, ix.latest_documents(zones, "version").select("doc_id", "zone", "text").collect())) == [(1, "body", "new body"), (2, "body", "kept")]


def test_lists_come_straight_from_the_texts(spark, indexes, monkeypatch):
    """One pass gives the lists, lengths and document frequencies that the stored postings give; searches do not need positions."""
    plain, _, queries = indexes
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefg", k=2)), " ".join(rng.choices("abcdefghi the running runs".split(), k=rng.randint(0, 9)))) for i in range(90)] + [(95, "", "")]
    zones = ix.zone_rows(spark.createDataFrame(rows, "doc_id bigint, title string, body string"), {"heading": F.col("title"), "body": F.col("body")})
    monkeypatch.setattr(lists.build, "__defaults__", ("porter", 16))  # several shards
    monkeypatch.setattr(lists, "BLOCK_SHARDS", 2)
    monkeypatch.setattr(lists, "PART_BYTES", 300)
    made, want = ix.listed(zones, champion_r=5), ix.held(ix.build(zones, champion_r=5))
    show = lambda df: sorted(map(str, df.collect()))
    assert made.lists.shards.select("shard").distinct().count() > 3 and made.lists.parts > 3
    for name in ("dictionary", "zone_stats", "docs"):
        columns = getattr(want, name).columns
        assert show(getattr(made, name).select(columns)) == show(getattr(want, name)), name
    rounded = lambda df: show(df.withColumn("norm", F.round("norm", 12)))
    assert rounded(made.doc_zone.select(want.doc_zone.columns)) == rounded(want.doc_zone)
    columns = ["doc_id", "zone", "term", "tf", "zone_len", "norm"]
    assert rounded(made.postings.select(columns)) == rounded(want.postings.select(columns))
    asked = spark.createDataFrame([(1, "a b running"), (2, "g i h"), (3, "none")], "query_id int, query string")
    for options in ({}, {"scheme": "tfidf"}, {"use_champions": True}):
        assert show(rk.search(made, asked, k=4, **options)) == show(rk.search(want, asked, k=4, **options))
    assert made.lists.cuts is None
    cut = ix.with_cuts(made)
    assert show(ix.champions(cut)) == show(ix.champions(want)) == show(ix.champions(made).select(ix.champions(want).columns))
    assert show(rk.search(cut, asked, k=4, use_champions=True)) == show(rk.search(want, asked, k=4, use_champions=True))
    none = ix.listed(zones.filter("doc_id < 0"))
    assert none.dictionary.count() == 0 and rk.search(none, asked, k=4).count() == 0
