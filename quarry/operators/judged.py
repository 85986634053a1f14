"""Page-level judging and answer provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covered_pages(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """``query_id, rank, doc_id, page``: judged pages inside a hit's page span.

    ``judgments``: query_id, doc_id, page. The equi-join on query and document bounds the range
    test to that document's judged pages.
    """
    return hits.join(judgments, ["query_id", "doc_id"]).filter(F.col("page").between(F.col("page_start"), F.col("page_end"))).select(
        "method", "query_id", "rank", "doc_id", "page")


def page_metrics(hits: DataFrame, judgments: DataFrame, queries: DataFrame, methods: Sequence[str], k: int = 10) -> DataFrame:
    """P@5, P@10, R@10 over distinct pages, Hit@5 and MRR@10 per method and query."""
    found = covered_pages(hits.filter(F.col("rank") <= k), judgments)
    agg = found.groupBy("method", "query_id").agg(
        F.countDistinct(F.when(F.col("rank") <= 5, F.col("rank"))).alias("h5"), F.countDistinct("rank").alias("h10"),
        F.countDistinct("doc_id", "page").alias("pages"), F.min("rank").alias("first"))
    total = judgments.groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"))
    grid = queries.select("query_id", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    rows = grid.join(agg, ["method", "query_id"], "left").join(total, "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "method", "query_id", (n("h5") / 5.0).alias("P@5"), (n("h10") / 10.0).alias("P@10"),
        F.when(F.col("judged") > 0, n("pages") / F.col("judged")).otherwise(F.lit(0.0)).alias("R@10"),
        (n("h5") > 0).cast("double").alias("Hit@5"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("MRR@10"))


def by_kind(rows: DataFrame, queries: DataFrame, methods: Sequence[str], metric: str = "MRR@10") -> DataFrame:
    """Mean metric per query kind, one column per method."""
    joined = rows.join(queries.select("query_id", "kind"), "query_id")
    return joined.groupBy("kind").agg(
        F.countDistinct("query_id").alias("n"), *[F.avg(F.when(F.col("method") == m, F.col(f"`{metric}`"))).alias(m) for m in methods])


def has_evidence(answer: str | Column, keywords: str | Column) -> Column:
    """At least half of the expected keywords (rounded up) occur in the answer."""
    a = F.lower(F.col(answer) if isinstance(answer, str) else answer)
    words = F.col(keywords) if isinstance(keywords, str) else keywords
    hits = F.size(F.filter(words, lambda w: F.contains(a, F.lower(w))))
    return hits >= F.floor((F.size(words) + 1) / 2)


def provenance(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """``query_id, provenance``: every citation's section matches the hint; no citation fails.

    ``questions``: query_id, hint; ``citations``: query_id, heading, path.
    """
    joined = citations.join(questions.select("query_id", "hint"), "query_id")
    where = F.lower(F.concat_ws(" ", "heading", "path"))
    ok = joined.groupBy("query_id").agg(F.bool_and(F.contains(where, F.lower("hint"))).alias("ok"))
    return questions.select("query_id").join(ok, "query_id", "left").select("query_id", F.coalesce("ok", F.lit(False)).alias("provenance"))


def winner(flat: str | Column, hierarchical: str | Column) -> Column:
    f = F.col(flat) if isinstance(flat, str) else flat
    h = F.col(hierarchical) if isinstance(hierarchical, str) else hierarchical
    return F.when(h & ~f, "hierarchical").when(f & ~h, "flat").otherwise("tie")
