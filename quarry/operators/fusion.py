"""Rank fusion, coarse-to-fine search, rerank merge and context numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.operators import dense
from quarry.scale import exact_sum, hold, small, top_k

RRF_K = 60
POOL = 100
HYBRID_CANDIDATES = 25
TOP_SECTIONS = 8
RERANK_CANDIDATES = 25
RERANK_TOP = 8


def fuse_rrf(vector_hits: DataFrame, lexical_hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse ``query_id, chunk_id, rank`` lists; every input row is kept.

    Ties keep the dense order, then the lexical order.
    """
    v = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), "distance")
    x = lexical_hits.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("sparse_score"))
    both = v.join(x, ["query_id", "chunk_id"], "full")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    fused = both.withColumn("fused_score", part("vector_rank") + part("lexical_rank"))
    order = [F.col("fused_score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank")]
    return top_k(fused, ["query_id"], order, None)


def fuse_runs(runs: list[DataFrame], k: int = RRF_K, depth: int = POOL) -> DataFrame:
    """Fuse any number of ``query_id, doc_id, rank`` runs; ties by document id."""
    rows = reduce(lambda a, b: a.unionByName(b), [r.select("query_id", "doc_id", "rank") for r in runs])
    scores = rows.filter(F.col("rank") <= depth).groupBy("query_id", "doc_id").agg(exact_sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    return top_k(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id")], depth)


def vector_hits(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """kNN over chunk vectors as hit rows."""
    return dense.knn(queries, chunks, k).withColumnRenamed("owner_id", "chunk_id")


def hybrid(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Fuse two lists that were each widened to ``max(k, 25)`` and cut to ``k``."""
    wide = max(k, HYBRID_CANDIDATES)
    fused = fuse_rrf(vector.filter(F.col("rank") <= wide), lexical.filter(F.col("rank") <= wide))
    return fused.filter(F.col("rank") <= k)


def coarse_to_fine(queries: DataFrame, sections: DataFrame, chunks: DataFrame, k: int, wide: int | None = None) -> DataFrame:
    """Chunks inside the best ``max(k, 8)`` sections; a query without such a chunk falls back
    to the flat search. ``chunks`` carries ``section_id``; the result names its strategy.

    The fine pass ranks only chunks of chosen sections: queries and chunks of a section meet in
    cells of bounded size, and each cell gives at most ``k`` rows of a query.
    """
    coarse = hold(dense.knn(queries, sections, max(k, TOP_SECTIONS)).select("query_id", F.col("owner_id").alias("section_id")))
    members = chunks.select(F.col("section_id").cast(coarse.schema["section_id"].dataType).alias("section_id"), F.col("owner_id").alias("v_id"), F.col("embedding").alias("v_vector"))
    n_v = members.groupBy("section_id").agg(F.count("*").alias("n_v"), F.max(F.size("v_vector")).alias("width"))
    sizes = hold(coarse.groupBy("section_id").agg(F.count("*").alias("n_q")).join(n_v, "section_id"))
    width = sizes.agg(F.max("width")).first()[0] or 1
    # every section has cells of its own, so few are needed for tasks to spare
    qb, vb = dense.cuts(F.col("n_q"), F.col("n_v"), width, 1)
    shape = small(sizes.select("section_id", qb.alias("_qb"), vb.alias("_vb")))
    pool = coarse.join(queries.select(F.col("query_id").alias("q_id"), F.col("embedding").alias("q_vector")), F.col("query_id") == F.col("q_id"))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = pool.join(shape, "section_id").select("section_id", part("q_id", "_qb").alias("qb"), parts("_vb").alias("vb"), "q_id", "q_vector")
    right = members.join(shape, "section_id").select("section_id", parts("_qb").alias("qb"), part("v_id", "_vb").alias("vb"), "v_id", "v_vector")
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", members.schema["v_id"].dataType), StructField("distance", DoubleType())])
    scored = dense.grid(left, right, ["section_id", "qb", "vb"], wide or k, schema)
    fine = hold(top_k(scored, ["query_id"], [F.round("distance", 10), F.col("chunk_id")], wide or k).withColumn("strategy", F.lit("hierarchical")))
    missing = queries.join(fine.select("query_id").distinct(), "query_id", "left_anti")
    flat = vector_hits(missing, chunks, wide or k).withColumn("strategy", F.lit("flat"))
    return fine.unionByName(flat.select(fine.columns))


def rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Order the first ``max(k, 25)`` candidates by external score and cut to ``min(k, 8)``; a
    query without any score keeps its order. ``scores``: query_id, chunk_id, rerank_score."""
    pool = hits.filter(F.col("rank") <= max(k, RERANK_CANDIDATES)).withColumnRenamed("rank", "candidate_rank")
    joined = pool.join(scores, ["query_id", "chunk_id"], "left")
    order = [F.round("rerank_score", 10).desc_nulls_last(), F.col("candidate_rank")]
    return top_k(joined, ["query_id"], order, min(k, RERANK_TOP))


def rerank_run(run: DataFrame, scores: DataFrame, depth: int = 50) -> DataFrame:
    """Batch form: the first ``depth`` documents reordered, the rest appended unchanged."""
    joined = run.withColumnRenamed("rank", "base_rank").join(scores, ["query_id", "doc_id"], "left")
    scored = (F.col("base_rank") <= depth) & F.col("rerank_score").isNotNull()
    order = [scored.desc(), F.when(scored, F.round("rerank_score", 10)).desc_nulls_last(), F.col("base_rank")]
    return top_k(joined, ["query_id"], order, None)


def assemble_context(hits: DataFrame) -> DataFrame:
    """Number the hits of each query 1..n as context blocks."""
    return hits.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("rank")


def weak_evidence(queries: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """``query_id, fires``: the top block carries a rerank score below the threshold."""
    low = blocks.filter((F.col("index") == 1) & (F.col("rerank_score") < threshold)).select("query_id", F.lit(True).alias("fires"))
    return queries.select("query_id").join(low, "query_id", "left").withColumn("fires", F.coalesce("fires", F.lit(False)))


def with_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach the page range of each chunk; hits without one stay."""
    return hits.join(pages.select("chunk_id", "page_start", "page_end"), "chunk_id", "left")
