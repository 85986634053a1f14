"""Exact nearest neighbours by cosine distance, and vector tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.operators.hooks import Model, apply_model
from quarry.scale import SCORE_DIGITS, first_per_key, is_small, small, top_k

QUERY_ROWS = 20_000
VECTORS_PER_CELL = 100_000
VALUES_PER_CELL = 6_400_000  # most vector components on either side of a cell
QUERIES_PER_CELL = 20_000
CELL_QUERIES = 1_000  # fewest queries of a cell that is cut for more tasks
TILE = 2_000_000  # products held at once


def active(vectors: DataFrame, model: str | None = None, owner_type: str | None = None,
           org_id: object | None = None) -> DataFrame:
    """Equality filters that reach the scan (partition pruning when stored by model, owner)."""
    for name, value in (("org_id", org_id), ("model", model), ("owner_type", owner_type)):
        if value is not None:
            vectors = vectors.filter(F.col(name) == value)
    return vectors


def in_scope(vectors: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Keep vectors of the given documents or sections."""
    return vectors.join(small(scope.select(key).distinct()), key, "left_semi")


def unit(rows) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0.0] = 1.0
    return m / norms


def nearest(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """Best ``k`` of one block for each query, ties by id at rank precision.

    The product is made ``TILE`` values at a time; a value is rounded only if it can be among the best so far.
    """
    if not len(q_ids) or not len(v_ids):
        return pd.DataFrame({"query_id": q_ids[:0], "owner_id": v_ids[:0], "distance": np.zeros(0)})
    by_id = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[by_id], v[by_id]  # places then order ties
    wide = max(k, min(len(v_ids), 4_096))
    step = max(1, TILE // wide)
    found = []
    for at in range(0, len(q_ids), step):
        part = q[at : at + step]
        n = len(part)
        best = np.full((n, 0), np.inf), np.zeros((n, 0), np.int64)
        for left in range(0, len(v_ids), wide):
            raw = 1.0 - part @ v[left : left + wide].T
            if best[0].shape[1] >= k:
                floor = np.round(best[0].max(axis=1), SCORE_DIGITS)
            elif raw.shape[1] > k:
                floor = np.round(np.partition(raw, k - 1, axis=1)[:, k - 1], SCORE_DIGITS)
            else:
                floor = np.full(n, np.inf)
            hit = (~(raw > np.nan_to_num(floor + 10.0**-SCORE_DIGITS, nan=np.inf)[:, None])).nonzero()  # keeps what is no number
            rows, cols, dist = hit[0], hit[1] + left, raw[hit]
            best = _best(n, np.concatenate([np.repeat(np.arange(n), best[0].shape[1]), rows]), np.concatenate([best[1].ravel(), cols]),
                         np.concatenate([best[0].ravel(), np.round(dist, SCORE_DIGITS + 2)]), k)
        kept = best[0].shape[1]
        found.append((np.repeat(np.arange(at, at + n), kept), best[1].ravel(), best[0].ravel()))
    r, c, d = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query_id": q_ids[r], "owner_id": v_ids[c], "distance": d})


def _best(n: int, rows: np.ndarray, cols: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the best ``k`` of each of ``n`` rows, which all have equally many of them at hand or ``k`` and more."""
    order = np.lexsort((cols, np.round(dist, SCORE_DIGITS), rows))
    counts = np.bincount(rows, minlength=n)
    take = min(k, int(counts.min()))
    pick = order[(np.concatenate([[0], np.cumsum(counts)[:-1]])[:, None] + np.arange(take)).ravel()]
    return dist[pick].reshape(n, take), cols[pick].reshape(n, take)


def _cells(n: Column):
    return F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))


def cuts(n_q: Column, n_v: Column, width: int, tasks: int) -> tuple[Column, Column]:
    """Into how many parts the queries and the vectors of a grid are cut: cells of bounded size, and more while there are fewer than ``tasks``."""
    up = lambda n, per: F.greatest(F.lit(1), F.ceil(n / F.lit(per)))
    per = min(VECTORS_PER_CELL, max(1, VALUES_PER_CELL // max(1, width)))
    vb = up(n_v, per)
    return F.greatest(up(n_q, min(QUERIES_PER_CELL, per)), F.least(up(n_q, CELL_QUERIES), F.ceil(F.lit(tasks) / vb))), vb


def grid(left: DataFrame, right: DataFrame, keys: list[str], k: int, schema: StructType) -> DataFrame:
    """The best ``k`` in every cell: ``left`` has ``keys``, q_id, q_vector and ``right`` has ``keys``, v_id, v_vector."""
    kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        found = nearest(a["q_id"].to_numpy(), unit(a["q_vector"].to_pandas()), b["v_id"].to_numpy(), unit(b["v_vector"].to_pandas()), k)
        return pa.Table.from_pandas(found.set_axis(kinds.names, axis=1), schema=kinds, preserve_index=False)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def knn(queries: DataFrame, vectors: DataFrame, k: int, max_query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, owner_id, distance, rank``: exact top ``k`` per query.

    Every task multiplies its block of vectors with a block of queries, a tile at a time, and emits at most k rows
    per query. A proven small query table is broadcast and the vectors are never shuffled;
    beyond the bound both sides are cut into a grid of cells of limited size.
    """
    q = queries.select("query_id", "embedding")
    v = vectors.select("owner_id", "embedding")
    schema = StructType([q.schema["query_id"], v.schema["owner_id"], StructField("distance", DoubleType())])
    if k <= 0:
        return v.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    if is_small(q, max_query_rows):
        table = q.toPandas()
        if table.empty:
            return v.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
        shared = v.sparkSession.sparkContext.broadcast((table["query_id"].to_numpy(), unit(table["embedding"])))

        def scan(batches):
            q_ids, mat = shared.value
            best = None
            for pdf in batches:
                if pdf.empty:
                    continue
                found = nearest(q_ids, mat, pdf["owner_id"].to_numpy(), unit(pdf["embedding"]), k)
                if best is not None:
                    found = pd.concat([best, found])
                    found["_k"] = found["distance"].round(SCORE_DIGITS)
                    found = found.sort_values(["query_id", "_k", "owner_id"]).groupby("query_id").head(k).drop(columns="_k")
                best = found
            if best is not None:
                yield best

        rows = v.mapInPandas(scan, schema)
    else:
        width = v.agg(F.max(F.size("embedding"))).first()[0] or 1
        n_q, n_v = (F.lit(df.count()) for df in (q, v))
        qb, vb = cuts(n_q, n_v, width, 2 * v.sparkSession.sparkContext.defaultParallelism)
        left = q.select(
            F.pmod(F.xxhash64("query_id"), qb).alias("qb"), F.explode(_cells(vb)).alias("vb"),
            F.col("query_id").alias("q_id"), F.col("embedding").alias("q_vector"))
        right = v.select(
            F.explode(_cells(qb)).alias("qb"), F.pmod(F.xxhash64("owner_id"), vb).alias("vb"),
            F.col("owner_id").alias("v_id"), F.col("embedding").alias("v_vector"))
        rows = grid(left, right, ["qb", "vb"], k, schema)
    return top_k(rows, ["query_id"], [F.round("distance", SCORE_DIGITS), F.col("owner_id")], k)


def upsert(stored: DataFrame, arriving: DataFrame, version: str) -> DataFrame:
    """Latest row wins per ``(owner_type, owner_id, model)``."""
    return first_per_key(stored.unionByName(arriving), ["owner_type", "owner_id", "model"], [version], latest=True)


def embed(texts: DataFrame, model: Model, name: str, dim: int, owner_type: str = "chunk", tasks: int | None = None) -> DataFrame:
    """Vectors for ``owner_id, text`` from a supplied model; each distinct text is embedded once."""
    distinct = texts.select("text").distinct()
    vectors = apply_model(distinct, model, "text string, embedding array<float>", tasks)
    return texts.join(vectors, "text").select(
        F.lit(owner_type).alias("owner_type"), "owner_id", F.lit(name).alias("model"), F.lit(dim).alias("dim"), "embedding"
    )
