from pyspark.sql import functions as F

from quarry.operators import highlight as hl
from quarry.operators import index as ix
from quarry.operators import ranked as rk


def test_a_text_is_split_once_for_all_its_spans(spark):
    rows = spark.createDataFrame([(1, "Ab cd, ab cd! é ab", [0, 2, 4, 9], 2)], "id int, text string, starts array<int>, n int")
    out = rows.select(hl.phrase_spans("text", F.col("starts"), F.col("n")).alias("s"))
    assert [tuple(s) for s in out.first()["s"]] == [(0, 5), (7, 12), (14, 18)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1  # five times before


def _zones(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("u"), "id")).alias("text"))
    return ix.zone_rows(docs, {"body": F.col("text")})


def test_buckets_follow_the_text(spark, monkeypatch):
    zones = _zones(spark, 400)
    few = ix.buckets_for(zones)
    monkeypatch.setattr(ix, "BUCKET_BYTES", 500)
    many = ix.buckets_for(zones)
    assert many > few and many >= 400 * 10 // 500
    assert ix.buckets_for(zones.filter("doc_id < 0")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = ix.held(ix.build(zones, stemmer="none", buckets=many))
    plain = ix.held(ix.build(zones, stemmer="none"))
    assert few < len(made.postings.inputFiles()) <= many
    show = lambda df: sorted(map(str, df.collect()))
    assert show(made.postings) == show(plain.postings) and show(made.dictionary) == show(plain.dictionary)
    asked = spark.createDataFrame([(1, "common w3"), (2, "u17 w3")], "query_id int, query string")
    want = show(rk.search(plain, asked, k=5))
    assert made.lists is None and want == show(rk.search(made, asked, k=5)) == show(rk.search(ix.with_lists(made), asked, k=5))


def test_a_long_vocabulary_is_not_broadcast(spark, monkeypatch):
    index = ix.held(ix.build(_zones(spark, 60), stemmer="none"))
    pairs = spark.range(60).select(F.col("id").alias("pair_id"), F.concat(F.lit("w1 u"), "id").alias("text_a"), F.concat(F.lit("w1 w2 u"), "id").alias("text_b"))
    show = lambda df: sorted((r.pair_id, round(r.score, 9)) for r in df.collect())
    want = show(rk.pair_cosine(index, pairs))
    monkeypatch.setattr(rk, "VOCABULARY_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = rk.pair_cosine(index, pairs)
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() and show(got) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_hits_are_explained(spark):
    index = ix.held(ix.build(_zones(spark, 60), stemmer="none"))
    asked = spark.createDataFrame([(1, "w1 w2 u8")], "query_id int, query string")
    got = rk.search(index, asked, k=2, explain=True)
    assert got.columns == ["query_id", "doc_id", "score", "explanation", "rank"]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()  # before: every document with a term was explained
    rows, whole = got.collect(), {r.doc_id: r for r in rk.search(index, asked, k=None, explain=True).collect()}
    assert len(rows) == 2 and all(whole[r.doc_id] == r for r in rows)


def test_the_dictionary_is_counted_without_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Runs running", "the run e\u0301"), (2, "", "run"), (3, None, "ﬁne the"), (4, "", ""), (5, "\u00e9 é", "fine")], "doc_id int, title string, body string")
    zones = ix.zone_rows(docs, {"heading": F.col("title"), "body": F.col("body")})
    monkeypatch.setattr(ix, "BUCKET_BYTES", 2)
    want = ix.held(ix.build(zones))
    monkeypatch.setattr(ix, "hold", lambda df, *a, **b: kept.append(df.columns) or df)
    kept = []
    made = ix.counted(zones)
    assert kept == [["term", "df", "idf"]]
    show = lambda df: sorted(map(str, df.collect()))
    assert show(made.dictionary) == show(want.dictionary) and show(ix.statistics(made)) == show(ix.statistics(want))
    assert show(made.postings) == show(want.postings) and show(made.docs) == show(want.docs)
    assert ix.counted(zones.filter("doc_id = 4")).dictionary.count() == 0


def test_stored_postings_are_one_row_for_each_text(spark):
    zones = _zones(spark, 40).unionByName(_zones(spark, 20).withColumn("zone", F.lit("heading"))).unionByName(
        spark.createDataFrame([(99, "body", "")], "doc_id bigint, zone string, text string"))
    made, lazy = ix.held(ix.build(zones)), ix.build(zones)
    show = lambda df: sorted(map(str, df.collect()))
    assert made.grouped.count() == 61 < made.postings.count()
    for name in ("postings", "doc_zone", "docs", "dictionary", "zone_stats"):
        assert show(getattr(made, name)) == show(getattr(lazy, name)), name
    assert show(ix.document_terms(made.grouped)) == show(ix.doc_postings(lazy.postings))
    assert "Exchange" not in ix.document_terms(made.grouped)._jdf.queryExecution().executedPlan().toString()
