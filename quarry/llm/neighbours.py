"""Approximate nearest neighbours with learned partitions.

On a bounded sample (``SAMPLE`` rows) the exact neighbour graph is cut into balanced parts that keep
neighbours together. A small classifier learns from a vector which parts its neighbours lie in. Every
row is then stored under its most probable part, and a query goes to the ``PROBES`` most probable parts,
where all rows are ranked exactly on the original vectors in double precision.

A part with many rows is cut into blocks, as are its queries, so a task holds one bounded cell of
both and a vector that a third of all rows share does not fill one task. Blocks never drop rows.

Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of
another length than most. A query is never its own neighbour; equal scores go by the smaller id; of
repeated ids each row is a candidate. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scale import hold, top_k

SAMPLE = 4096
PARTS = 32
PROBES = 22
GRAPH = 16  # neighbours of a sampled row in the graph
ROWS, QUERIES = 8192, 1024  # most rows and queries of a cell
SLACK = 1.05  # part capacity over the mean
CLOSE = 1e-9  # scores this near the last place are computed again in a fixed order


def usable(vector: Column) -> Column:
    inf = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the rows that are among its ``k`` nearest or have it among theirs."""
    k = min(k, len(x) - 1)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(x), 0), int)
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(x))))


def balanced_parts(x: np.ndarray, graph: list[np.ndarray], parts: int, passes: int = 12) -> np.ndarray:
    """Part of each row: balanced clusters first, then moves to the part with most neighbours,
    while the part has room, or in exchange with a row that gains by the opposite move."""
    n, rng = len(x), np.random.default_rng(1)
    room = int(np.ceil(n / parts * SLACK))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, int)
    for _ in range(10):
        score = x @ centres.T
        best = np.sort(score, axis=1)
        left = np.full(parts, room)
        for i in np.argsort(best[:, -2] - best[:, -1] if parts > 1 else best[:, 0], kind="stable"):
            p = next(p for p in np.argsort(-score[i], kind="stable") if left[p])
            part[i], left[p] = p, left[p] - 1
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    size = np.bincount(part, minlength=parts)
    waiting: dict[tuple[int, int], list[int]] = {}
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[graph[i]], minlength=parts)
            to, here = int(votes.argmax()), int(part[i])
            if votes[to] <= votes[here]:
                continue
            if size[to] < room:
                size[here] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
                continue
            back = waiting.get((to, here), [])
            while back and part[back[-1]] != to:
                back.pop()
            if back:
                part[back.pop()], part[i] = here, to
                moved += 1
            else:
                waiting.setdefault((here, to), []).append(int(i))
        if not moved:
            break
    return part


class Router:
    """A linear softmax classifier of parts; ``weights`` has a last row for the constant."""

    def __init__(self, x: np.ndarray, graph: list[np.ndarray], part: np.ndarray, parts: int, steps: int = 400):
        goal = np.stack([np.bincount(part[[i, *g]], minlength=parts) / (len(g) + 1) for i, g in enumerate(graph)])
        ones = np.c_[x, np.ones(len(x))]
        w = np.zeros((ones.shape[1], parts))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            slope = ones.T @ (self._softmax(ones @ w) - goal) / len(x) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.weights = w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each vector, best first."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.argsort(-(np.c_[unit, np.ones(len(x))] @ self.weights), axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, parts: int = PARTS) -> Router:
    parts = max(1, min(parts, len(sample)))
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    graph = neighbour_graph(unit, GRAPH)
    return Router(unit, graph, balanced_parts(unit, graph, parts), parts)


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, components added in order, so equal vectors score equally."""
    out = np.zeros(len(rows))
    for d in range(len(q)):
        out += q[d] * rows[:, d]
    return out


def nearest(q_ids, q, r_ids, r, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of each query within one cell, ties to smaller ids."""
    found = []
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ r.T
        for i, s in enumerate(scores, at):
            own = r_ids != q_ids[i]
            s = np.where(own, s, -np.inf)
            n = min(k, int(own.sum()))
            if not n:
                continue
            least = np.partition(s, len(s) - n)[len(s) - n] - CLOSE
            near = np.flatnonzero(s >= least)
            score = _exact(q[i], r[near])
            best = np.lexsort((r_ids[near], -score))[:n]
            found.append((np.full(n, q_ids[i]), r_ids[near][best], score[best]))
    if not found:
        return pd.DataFrame({"query_id": np.array([], "int64"), "vec_id": np.array([], "int64"), "score": np.array([], float)})
    a, b, c = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, parts: int = PARTS, probes: int = PROBES) -> DataFrame:
    """query_id, rank (from 1), ``vec_id``, score of the ``k`` nearest found rows of each query."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector))).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == length["d"])
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    router = spark.sparkContext.broadcast(fit(np.array([r["v"] for r in chosen]), parts))

    def route(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(parts=list(router.value.ranked(np.stack(pdf["v"].to_numpy()), probes).astype("int32")))

    routed = hold(rows.mapInPandas(route, "id bigint, v array<double>, asks boolean, parts array<int>"))
    asked = routed.filter("asks").select("id", "v", F.explode("parts").alias("part"))
    stored = routed.select("id", "v", F.get("parts", F.lit(0)).alias("part"))
    # one number of rows and of queries for each part
    counts = stored.groupBy("part").agg(F.count("*").alias("n")).join(asked.groupBy("part").agg(F.count("*").alias("m")), "part").collect()
    if not counts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    grid = spark.createDataFrame([(r["part"], -(-r["n"] // ROWS), -(-r["m"] // QUERIES)) for r in counts], "part int, row_blocks int, query_blocks int")
    grid = F.broadcast(grid)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.col(n)).cast("int")
    r = stored.join(grid, "part").select("id", "v", "part", of("row_blocks").alias("rb"), each("query_blocks").alias("qb"))
    q = asked.join(grid, "part").select(F.col("id").alias("query"), F.col("v").alias("qv"), F.col("part").alias("q_part"), of("query_blocks").alias("q_qb"), each("row_blocks").alias("q_rb"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return nearest([], np.zeros((0, 1)), np.array([], "int64"), np.zeros((0, 1)), k)
        return nearest(left["query"].to_numpy(), np.stack(left["qv"].to_numpy()), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), k)

    near = q.groupBy("q_part", "q_rb", "q_qb").cogroup(r.groupBy("part", "rb", "qb")).applyInPandas(cell, "query_id bigint, vec_id bigint, score double")
    return top_k(near, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
