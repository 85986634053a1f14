"""Positional phrase retrieval over a table of phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.index import Index
from quarry.operators.ranked import resolve_terms, small_queries
from quarry.scale import lookup_join


def slots(index: Index, queries: DataFrame, checked: bool) -> DataFrame:
    """``query_id, term, lookup, offset, n_slots, n_terms``: offsets count removed stop words."""
    rows = tx.analyze(queries.select("query_id", tx.phrase_text("query").alias("query")), "query", index.stemmer)
    first = F.min("pos").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("offset", (F.col("pos") - first).cast("int"))
    forms = resolve_terms(index, rows.select("term").distinct(), checked).select("term", "lookup")
    rows = rows.select("query_id", "term", "offset").join(forms, "term")
    sizes = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_slots"), F.countDistinct("lookup").alias("n_terms"), F.max("offset").alias("last_offset")
    )
    return rows.join(sizes, "query_id")


def zone_matches(index: Index, queries: DataFrame, zone: str | None = None) -> DataFrame:
    """One row per (query, zone, document) that holds every phrase term in that zone, with the
    sorted start positions (empty when the words never line up)."""
    ok = small_queries(queries)
    wanted = slots(index, queries, ok)
    postings = index.postings.select("doc_id", "zone", F.col("term").alias("lookup"), "positions")
    if zone is not None:
        postings = postings.filter(F.col("zone") == zone)
    rows = lookup_join(postings, wanted, ["lookup"], ["doc_id"], checked=ok).select(
        "query_id", "zone", "doc_id", "lookup", "n_slots", "n_terms",
        F.expr("transform(positions, p -> p - offset)").alias("starts"),
    )
    grouped = rows.groupBy("query_id", "zone", "doc_id").agg(
        F.collect_list("starts").alias("sets"), F.countDistinct("lookup").alias("have"), F.first("n_terms").alias("need"),
    ).filter("have = need")
    common = F.aggregate(
        F.slice("sets", F.lit(2), F.greatest(F.size("sets") - 1, F.lit(0))), F.element_at("sets", 1), lambda a, s: F.array_intersect(a, s)
    )
    return grouped.select("query_id", "zone", "doc_id", F.array_sort(common).alias("starts"))


def search(index: Index, queries: DataFrame, zone: str | None = None) -> DataFrame:
    """Distinct ``query_id, doc_id``; a match in any one zone counts."""
    found = zone_matches(index, queries, zone).filter(F.size("starts") > 0)
    return found.select("query_id", "doc_id").distinct()


def trace(index: Index, queries: DataFrame) -> DataFrame:
    """Per query and zone: candidate documents, matched documents, postings per term."""
    per_doc = zone_matches(index, queries)
    counts = per_doc.groupBy("query_id", "zone").agg(
        F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.size("starts") > 0, 1)).alias("matched")
    )
    ok = small_queries(queries)
    wanted = slots(index, queries, ok).select("query_id", "term", "lookup").distinct()
    sizes = lookup_join(
        index.postings.select("doc_id", "zone", F.col("term").alias("lookup")), wanted, ["lookup"], ["doc_id"], checked=ok
    ).groupBy("query_id", "zone", "term").agg(F.count(F.lit(1)).alias("n"))
    names = index.zone_stats.agg(F.array_sort(F.collect_list("zone")).alias("z")).scalar()  # a handful of zones
    grid = wanted.select("query_id", "term", F.explode(names).alias("zone"))
    listed = grid.join(sizes, ["query_id", "zone", "term"], "left").groupBy("query_id", "zone").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.coalesce("n", F.lit(0)).alias("n"))))).alias("postings")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return listed.join(counts, ["query_id", "zone"], "left").select(
        "query_id", "zone", "postings", zero("candidates"), zero("matched")
    )


def lengths(index: Index, queries: DataFrame) -> DataFrame:
    """Raw-token length of each phrase (last offset plus one)."""
    ok = small_queries(queries)
    return slots(index, queries, ok).groupBy("query_id").agg((F.max("offset") + 1).alias("phrase_len"))
