"""Composed plans: the entry points a user calls with whole tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import fusion as fu
from quarry.operators import metrics as mt
from quarry.operators import ranked as rk
from quarry.operators.index import Index


def ablation(runs: Mapping[str, DataFrame], qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Metric table of several retrieval methods over one query set."""
    tagged = [df.select(F.lit(m).alias("method"), "query_id", "doc_id", "rank") for m, df in runs.items()]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    return mt.average(mt.per_query(rows, qrels, queries, list(runs)))


def hybrid_search(index: Index, queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, k: int,
                  scheme: str = "bm25") -> DataFrame:
    """Dense and lexical candidates over one scope, fused and cut to ``k``."""
    wide = max(k, fu.HYBRID_CANDIDATES)
    vector = fu.vector_hits(query_vectors, chunks, wide)
    lexical = rk.lexical_channel(index, queries, wide, scheme).withColumnRenamed("doc_id", "chunk_id")
    return fu.hybrid(vector, lexical, k)


def answer_context(index: Index, queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, contents: DataFrame, k: int) -> DataFrame:
    """Numbered context blocks for every query: hybrid hits with their text."""
    hits = hybrid_search(index, queries, query_vectors, chunks, k)
    return fu.assemble_context(contents.join(hits, "chunk_id"))
