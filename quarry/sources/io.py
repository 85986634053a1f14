"""Readers, scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scale import hold_dir, small

EVIDENCE = "map<string,array<struct<label:string,sentences:array<int>>>>"


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared folder."""
    return f"{hold_dir(spark)}/quarry_{uuid.uuid4().hex}"


# ---- scans of stored tables ------------------------------------------------------------


def scan_chunks_with_heading(chunks: DataFrame, sections: DataFrame, scope: DataFrame) -> DataFrame:
    """Chunks of a document set with their section heading; a chunk without section stays."""
    wanted = chunks.join(small(scope.select("doc_id").distinct()), "doc_id", "left_semi")
    heads = sections.select("doc_id", "section_id", "heading")
    return wanted.join(heads, ["doc_id", "section_id"], "left").orderBy("doc_id", "ordinal")


def scan_chunks(chunks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Chunks whose ``key`` (doc_id, section_id or chunk_id) is listed."""
    return chunks.join(small(wanted.select(key).distinct()), key, "left_semi")


def scan_sections(sections: DataFrame, scope: DataFrame) -> DataFrame:
    rows = sections.join(small(scope.select("doc_id").distinct()), "doc_id", "left_semi")
    return rows.orderBy("doc_id", "char_start")


def list_documents(docs: DataFrame, folder_id=None, tags: DataFrame | None = None, tag_id=None) -> DataFrame:
    """Documents, optionally of one folder and with one tag."""
    if folder_id is not None:
        docs = docs.filter(F.col("folder_id") == folder_id)
    if tag_id is not None:
        docs = docs.join(tags.filter(F.col("tag_id") == tag_id).select("doc_id"), "doc_id")
    return docs


def scoped(df: DataFrame, org_id) -> DataFrame:
    """Rows of one organisation; partition the stored table by ``org_id`` to prune files."""
    return df.filter(F.col("org_id") == org_id)


# ---- judged collections ----------------------------------------------------------------


def read_judged(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus JSONL, queries JSONL and judgement TSV; positive judgements only, and only the
    queries that have one."""
    docs = spark.read.schema("_id string, title string, text string").json(corpus).withColumnRenamed("_id", "doc_id")
    asked = spark.read.schema("_id string, text string").json(queries).select(
        F.col("_id").alias("query_id"), F.col("text").alias("query"))
    judged = spark.read.option("header", True).option("sep", "\t").schema(
        "`query-id` string, `corpus-id` string, score int").csv(qrels)
    kept = judged.filter("score > 0").select(
        F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("grade"))
    return docs, asked.join(kept.select("query_id").distinct(), "query_id", "left_semi"), kept


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims with their evidence map: claim_id, claim, evidence, cited_doc_ids."""
    schema = f"id bigint, claim string, evidence {EVIDENCE}, cited_doc_ids array<bigint>"
    return spark.read.schema(schema).json(path).withColumnRenamed("id", "claim_id")


# ---- artifacts and results -------------------------------------------------------------


def store_parsed(parsed: DataFrame, path: str) -> None:
    """Append parsed documents that are not stored yet; a repeated run adds nothing."""
    spark = parsed.sparkSession
    try:
        done = spark.read.parquet(path).select("doc_id")
    except Exception as error:  # the first run finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    fresh = parsed if done is None else parsed.join(done, "doc_id", "left_anti")
    fresh.write.mode("append").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Result table as Parquet and JSON."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").json(f"{path}/json")


def to_markdown(summary: DataFrame, limit: int = 1000) -> str:
    """A small summary (one row per method or bucket) as a markdown table."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a markdown report holds at most {limit} rows")
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
