"""Ranking and classification metrics as grouped aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.scale import lookup_join, running_totals, small, top_k

METRICS = ["P@1", "P@5", "P@10", "R@10", "R@100", "MRR@10", "nDCG@10"]


def _gain(rank: Column, grade: Column) -> Column:
    return grade / F.log2(rank + 1.0)


def ideal_gains(qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, relevant, idcg``: relevant documents and the best possible DCG at ``k``."""
    positive = qrels.filter("grade > 0")
    counts = positive.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    best = top_k(positive.select("query_id", "doc_id", "grade"), ["query_id"], [F.col("grade").desc(), F.col("doc_id")], k, "r")
    ideal = best.groupBy("query_id").agg(F.sum(_gain(F.col("r"), F.col("grade"))).alias("idcg"))
    return counts.join(ideal, "query_id")


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per (method, query) with the seven report metrics; queries without hits score 0.

    ``run``: method, query_id, doc_id, rank.
    """
    judged = run.filter(F.col("rank") <= 100).join(
        qrels.filter("grade > 0").select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left"
    )
    hit = lambda k: F.count(F.when((F.col("rank") <= k) & F.col("grade").isNotNull(), 1))
    found = judged.groupBy("method", "query_id").agg(
        *[hit(k).alias(f"h{k}") for k in (1, 5, 10, 100)],
        F.min(F.when(F.col("grade").isNotNull() & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, _gain(F.col("rank"), F.col("grade")))).alias("dcg"),
    )
    grid = queries.select("query_id", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    rows = grid.join(found, ["method", "query_id"], "left").join(ideal_gains(qrels), "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda c: F.when(F.col("relevant") > 0, n(c) / F.col("relevant")).otherwise(F.lit(0.0))
    return rows.select(
        "method", "query_id",
        (n("h1") / 1.0).alias("P@1"), (n("h5") / 5.0).alias("P@5"), (n("h10") / 10.0).alias("P@10"),
        share("h10").alias("R@10"), share("h100").alias("R@100"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("MRR@10"),
        F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0)).alias("nDCG@10"),
    )


def reciprocal_rank(run: DataFrame, qrels: DataFrame, queries: DataFrame, cutoff: int | None = None) -> DataFrame:
    rows = run if cutoff is None else run.filter(F.col("rank") <= cutoff)
    first = rows.join(qrels.filter("grade > 0"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    return queries.select("query_id").join(first, "query_id", "left").select(
        "query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("rr"))


def average(rows: DataFrame, by: str = "method") -> DataFrame:
    return rows.groupBy(by).agg(*[F.avg(f"`{m}`").alias(m) for m in METRICS if m in rows.columns])


def comparison(rows: DataFrame, a: str, b: str, margin: float = 0.1) -> DataFrame:
    """``query_id, a_score, b_score, bucket``: who wins on nDCG@10 by more than the margin."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("`nDCG@10`")))
    wide = rows.groupBy("query_id").agg(pick(a).alias("a_score"), pick(b).alias("b_score"))
    gap = F.round(F.col("a_score") - F.col("b_score"), 10)
    return wide.withColumn(
        "bucket", F.when(gap > margin, f"{a}_wins").when(gap < -margin, f"{b}_wins").otherwise("ties")
    )


def term_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """``token, df`` under the report analyzer, one count per document."""
    return docs.select("doc_id", F.explode(F.array_distinct(tx.simple_tokens(text))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df"))


def bucket_profile(buckets: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Per bucket: query length, share of high-idf terms, digits, unseen terms, mean idf."""
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar().cast("double")
    tokens = queries.select("query_id", F.explode_outer(tx.simple_tokens("query")).alias("token"))
    wanted = tokens.select("token").distinct().dropna()
    df = term_idf(docs).join(small(wanted), "token", "left_semi")
    rows = tokens.join(small(df), "token", "left").withColumn("idf", F.ln(n / (1.0 + F.coalesce("df", F.lit(0)))))
    size = F.greatest(F.count("token"), F.lit(1))
    count_if = lambda c: F.count(F.when(c & F.col("token").isNotNull(), 1))
    per = rows.withColumn("_hi", F.col("idf") >= F.ln(n / 101.0)).groupBy("query_id").agg(
        F.count("token").alias("len"),
        (count_if(F.col("_hi")) / size).alias("hi"),
        F.max(F.coalesce(F.col("token").rlike("[0-9]").cast("double"), F.lit(0.0))).alias("dig"),
        (count_if(F.col("df").isNull()) / size).alias("oov"),
        F.coalesce(F.avg(F.when(F.col("token").isNotNull(), F.col("idf"))), F.lit(0.0)).alias("mean_idf"),
    )
    return buckets.join(per, "query_id").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("len").alias("avg_query_len_tokens"), F.avg("hi").alias("frac_high_idf_terms"),
        F.avg("dig").alias("frac_queries_with_digits"), F.avg("oov").alias("frac_terms_unseen_in_corpus"),
        F.avg("mean_idf").alias("mean_term_idf"),
    )


def examples(buckets: DataFrame, k: int = 5) -> DataFrame:
    """The largest-margin queries of each winning bucket."""
    gap = F.round(F.abs(F.col("a_score") - F.col("b_score")), 10)
    return top_k(buckets.filter("bucket <> 'ties'"), ["bucket"], [gap.desc(), F.col("query_id")], k)


# ---- classification --------------------------------------------------------------------


def _by_score(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score; map-side, so ties never travel as rows."""
    return rows.groupBy(*keys, "score").agg(
        F.count(F.when(F.col("label"), 1)).alias("pos"), F.count(F.when(~F.col("label"), 1)).alias("neg"))


def roc_auc(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AUC per key with ties counted half; null and a reason when a class is empty."""
    keys = list(keys)
    ranked = running_totals(_by_score(rows, keys), keys, "score", ["neg"])
    below = F.col("run_neg") - F.col("neg") / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * below).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    defined = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(
        *keys, "n_pos", "n_neg", F.when(defined, F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
        F.when(~defined, F.lit("needs at least one positive and one negative")).alias("reason"),
    )


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1 and accuracy; 0 on an empty denominator."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), div(2.0 * p * r, p + r).alias("f1"), div(tp + tn, tp + fp + tn + fn).alias("accuracy")]


def confusion(rows: DataFrame, threshold: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at a cut-off; a score equal to it is positive."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    n = lambda c: F.count(F.when(c, 1))
    hit = F.col("score") >= t
    counts = rows.groupBy(*keys).agg(
        n(hit & F.col("label")).alias("tp"), n(hit & ~F.col("label")).alias("fp"),
        n(~hit & ~F.col("label")).alias("tn"), n(~hit & F.col("label")).alias("fn"))
    return counts.select("*", *rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def best_f1(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``threshold, best_f1`` over the observed scores; the lowest threshold on a tie."""
    keys = list(keys)
    ranked = running_totals(_by_score(rows, keys), keys, "score", ["pos", "neg"], descending=True)
    total = ranked.groupBy(*keys).agg(F.sum("pos").alias("all_pos"))
    joined = lookup_join(ranked, total, keys, ["score"]) if keys else ranked.withColumn("all_pos", total.select("all_pos").scalar())
    tp, fp = F.col("run_pos"), F.col("run_neg")
    f1 = rates(tp, fp, F.lit(0), F.col("all_pos") - tp)[2]
    scored = joined.select(*keys, "score", f1.alias("f1"))
    return scored.groupBy(*keys).agg(
        F.max_by("score", F.struct(F.round("f1", 10).alias("f"), (-F.col("score")).alias("s"))).alias("threshold"),
        F.max("f1").alias("best_f1"))
