"""Cross-section synthesis: map prompts per section, reduce prompts per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.scale import first_per_key

MAX_DOCUMENTS = 20
NOT_RELEVANT = "NOT_RELEVANT"
NOTHING_RELEVANT = "(no section extracts were relevant)"


def section_summaries(sections: DataFrame, scope: DataFrame) -> DataFrame:
    """Sections of a scope (``scope_id, doc_id``) that carry a summary."""
    return sections.filter("summary <> ''").join(scope, "doc_id")


def available(scope: DataFrame, summaries: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``scope_id, available``: one to ``max_documents`` documents and at least one summary."""
    sizes = scope.groupBy("scope_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    has = summaries.select("scope_id").distinct().withColumn("_has", F.lit(True))
    ok = (F.col("n_docs") <= max_documents) & F.coalesce("_has", F.lit(False))
    return sizes.join(has, "scope_id", "left").select("scope_id", ok.alias("available"))


def map_prompts(queries: DataFrame, summaries: DataFrame) -> DataFrame:
    """One prompt per query and section of its scope."""
    heading = F.coalesce(F.when(F.col("heading") != "", F.col("heading")), F.lit("(untitled)"))
    joined = queries.select("query_id", "scope_id", "query").join(summaries, "scope_id")
    return joined.select(
        "query_id", "section_id", "doc_id", "heading", "char_start",
        F.concat(F.lit("Section heading: "), heading, F.lit("\nSection summary: "), F.col("summary"), F.lit("\n\n"), F.col("query")).alias("prompt"))


def is_relevant(extract: str | Column) -> Column:
    """Not empty and not the sentinel, whatever its case and trailing punctuation."""
    e = tx.strip(extract)
    return (e != "") & (F.regexp_replace(F.upper(e), "[ .!\"']+\\z", "") != NOT_RELEVANT)


def reduce_blocks(extracts: DataFrame) -> DataFrame:
    """Number the relevant extracts of each query in section order, with their provenance."""
    kept = extracts.filter(is_relevant("extract"))
    order = Window.partitionBy("query_id").orderBy("doc_id", "char_start", "section_id")
    return kept.select(
        "query_id", F.row_number().over(order).alias("index"), tx.strip("extract").alias("content"), F.array("section_id").alias("section_ids"),
        F.array("heading").alias("headings"), F.array("doc_id").alias("document_ids"))


def reduce_prompts(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    part = F.struct("index", F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("content")).alias("t"))
    context = blocks.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "\n\n").alias("c"))
    rows = queries.join(context, "query_id", "left")
    return rows.select("query_id", F.concat(F.coalesce("c", F.lit(NOTHING_RELEVANT)), F.lit("\n\n"), F.col("query")).alias("prompt"))


def is_broad(verdict: str | Column) -> Column:
    """Exactly BROAD; anything else is specific."""
    return F.coalesce(F.upper(tx.strip(verdict)) == "BROAD", F.lit(False))


def route(queries: DataFrame, verdicts: DataFrame, availability: DataFrame) -> DataFrame:
    """Add ``route``: broad when the verdict says so and the scope allows it."""
    rows = queries.join(verdicts, "query_id", "left").join(availability, "scope_id", "left")
    broad = is_broad("verdict") & F.coalesce("available", F.lit(False))
    return rows.withColumn("route", F.when(broad, "broad").otherwise("specific"))


def upsert_overviews(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One overview per notebook; a regenerated one replaces the row and is not stale."""
    rows = stored.unionByName(fresh.withColumn("stale", F.lit(False)).select(stored.columns))
    return first_per_key(rows, ["notebook_id"], ["generated_at"], latest=True)


def mark_stale(overviews: DataFrame, changes: DataFrame) -> DataFrame:
    """Stale when membership changed after the overview was generated."""
    last = changes.groupBy("notebook_id").agg(F.max("changed_at").alias("_last"))
    joined = overviews.join(last, "notebook_id", "left")
    return joined.withColumn("stale", F.col("stale") | F.coalesce(F.col("_last") > F.col("generated_at"), F.lit(False))).drop("_last")
