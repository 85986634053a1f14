from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import ranked as rk
from quarry.scale import salted_join


def _index(spark, n=60):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("u"), "id")).alias("text"))
    return ix.held(ix.build(ix.zone_rows(docs, {"body": F.col("text")}), stemmer="none"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spark_broadcasts_no_long_vocabulary_on_its_own(spark, monkeypatch):
    monkeypatch.setattr(rk, "VOCABULARY_ROWS", 10)
    monkeypatch.setattr(rk, "HOT_ROWS", 20)
    index = _index(spark)
    pairs = spark.range(60).select(F.col("id").alias("pair_id"), F.concat(F.lit("w1 u"), "id").alias("text_a"), F.concat(F.lit("w1 w2 u"), "id").alias("text_b"))
    got = rk.pair_cosine(index, pairs)
    assert "BroadcastHashJoin" not in _plan(got)  # before: its stored tables are below the threshold
    assert got.count() == 60 and got.filter("score > 0.5").count() == 60


def test_only_hot_keys_are_repeated(spark):
    many = spark.range(100).select(F.when(F.col("id") < 80, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), "id")
    few = many.select("key").distinct().withColumn("v", F.length("key"))
    show = lambda df: sorted(map(tuple, df.select("key", "id", "v").collect()))
    made = salted_join(many, few, ["key"], ["id"], hot=["hot"])
    assert show(made) == show(many.join(few, "key")) == show(salted_join(many, few, ["key"], ["id"], hot=[]))
    assert "SortMergeJoin" in _plan(made) and "BroadcastHashJoin" not in _plan(made)
