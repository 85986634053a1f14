"""Approximate nearest neighbours by cosine distance from an inverted file of coarse cells.

Centroids are fitted on a bounded sample; every vector is stored in the folder of its nearest centroid. A query
reads the folders of its nearest ``probes`` cells only (a partition filter of the scan); with all cells probed the answer is
that of the exact scan. A cell with more than ``BLOCK_ROWS`` vectors is dealt into blocks, so one hot cell is
many tasks; small cells are bundled, and a query goes to a bundle once, with one bit for each of its cells.
Queries of a bundle are taken ``QUERIES_PER_GROUP`` at a time.

Vectors with a zero norm have distance 1 to everything, as in the exact scan. Null vectors are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.operators.dense import nearest, unit
from quarry.scale import SCORE_DIGITS, blocks_for, hold, release, small, top_k

SAMPLE = 50_000  # most vectors that the centroids are fitted on
ROUNDS = 15
ROWS_PER_CELL = 8  # of small tables; the number of cells stops at CELLS
CELLS = 4096
BLOCK_ROWS = 20_000
QUERIES_PER_GROUP = 20_000
GROUP_QUERIES = 1_000  # fewest queries of a group that is made for more tasks
TILE_ROWS = 1_000  # vectors held against all centroids at once
FOUND_ROWS = 1_000_000  # hits of a task's cells that are held before each query keeps its best


@dataclass(frozen=True)
class InvertedFile:
    """``vectors``: cell, block, owner_id, embedding and kept columns; ``cells``: cell, blocks, n; ``centroids``: one row for each cell."""

    vectors: DataFrame
    cells: DataFrame
    centroids: np.ndarray


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Spherical k-means on the ``sample`` vectors with the smallest seeded hash (all of them in a smaller table)."""
    drawn = vectors.filter("embedding is not null").select("embedding", F.xxhash64(F.lit(seed), "owner_id").alias("draw")).orderBy("draw").limit(sample)
    rows = unit(drawn.select("embedding").toPandas()["embedding"])
    if not len(rows):
        return np.zeros((1, 1))
    centre = rows[np.random.default_rng(seed).permutation(len(rows))[: min(cells, len(rows))]]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(rows[i : i + TILE_ROWS] @ centre.T, axis=1) for i in range(0, len(rows), TILE_ROWS)])
        sums = np.zeros_like(centre)
        np.add.at(sums, near, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centre)  # an empty cell stays where it was
    return centre


def _closest(rows: np.ndarray, centre: np.ndarray, probes: int) -> np.ndarray:
    if probes >= len(centre):
        return np.broadcast_to(np.arange(len(centre), dtype=np.int32), (len(rows), len(centre)))
    return np.argpartition(-(rows @ centre.T), probes - 1, axis=1)[:, :probes].astype(np.int32)


def _assigned(centre: np.ndarray, probes: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_ROWS):
                batch = whole.slice(at, TILE_ROWS)
                best = _closest(unit(batch.column(column).to_pandas()), centre, probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best), pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return run


def nearest_cells(df: DataFrame, centre: np.ndarray, probes: int = 1) -> DataFrame:
    """``df`` with ``near``: its closest cells by ``embedding``."""
    schema = T.StructType([*df.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_assigned(centre, probes, df.columns.index("embedding")), schema)


def write(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> InvertedFile:
    """Fit and store an inverted file of ``owner_id, embedding`` (other columns are kept)."""
    spark = vectors.sparkSession
    vectors = vectors.filter("embedding is not null")
    count = cells or max(1, min(CELLS, vectors.count() // ROWS_PER_CELL))
    centre = centroids(vectors, count, sample)
    placed = hold(nearest_cells(vectors, centre).withColumn("cell", F.element_at("near", 1)).drop("near"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # one row for each cell
    held = spark.read.parquet(f"{path}/cells")
    dealt = placed.join(F.broadcast(held.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("owner_id"), F.col("blocks")).cast("int")).drop("blocks")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centre)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    release(placed)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> InvertedFile:
    centre = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()["centre"]
    return InvertedFile(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"), np.array(centre.tolist()))


def bundles(index: InvertedFile) -> list[list[tuple[int, int]]]:
    """(cell, block) of each bundle: cells in order until they hold ``BLOCK_ROWS`` vectors; a block of a hot cell alone."""
    made: list[list[tuple[int, int]]] = []
    room = 0
    for r in index.cells.orderBy("cell").collect():
        if r["blocks"] > 1:
            made += [[(r["cell"], block)] for block in range(r["blocks"])]
            room = 0
        elif r["n"] <= room:
            made[-1].append((r["cell"], 0))
            room -= r["n"]
        else:
            made.append([(r["cell"], 0)])
            room = BLOCK_ROWS - r["n"]
    return made


def _asked(centre: np.ndarray, probes: int, groups: list[list[tuple[int, int]]]):
    """A row for each bundle with a probed cell: the query, its bundle and the bits of the bundle's cells (null: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.array([c for c, _ in g]) for g in groups]
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_ROWS):
                batch = whole.slice(at, TILE_ROWS)
                near = _closest(unit(batch.column(1).to_pandas()), centre, probes)
                wants = np.zeros((len(near), len(centre)), bool)
                np.put_along_axis(wants, near, True, axis=1)
                for i, of in enumerate(cells):
                    bits = wants[:, of]
                    rows = np.flatnonzero(bits.any(axis=1))
                    if not len(rows):
                        continue
                    taken = batch.take(pa.array(rows))
                    packed = [None if m.all() else np.packbits(m).tobytes() for m in bits[rows]]
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(0), taken.column(1), pa.array(np.full(len(rows), i, np.int32)), pa.array(packed, pa.binary())],
                        names=["query_id", "q_vector", "bundle", "bits"])

    return run


def _wanted(groups: list[list[tuple[int, int]]]):
    """Distinct (cell, block, bundle) that rows of ``bundle, bits`` ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(groups[i])
                mask = np.ones(n, bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                seen[i] = seen[i] | mask if i in seen else mask
        rows = [(*groups[i][j], i) for i, mask in seen.items() for j in np.flatnonzero(mask)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*rows)], names=["cell", "block", "bundle"])

    return run


def best_of(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The best ``k`` rows of each query in ``found``; equal distances at rank precision by place."""
    query, place, distance = (np.concatenate([f[c].to_numpy() for f in found]) for c in ("query_id", "owner_id", "distance"))
    order = np.lexsort((place, np.round(distance, SCORE_DIGITS), query))
    query, at = query[order], np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], at, 0)) if len(at) else at
    kept = order[at - first < k]
    return pd.DataFrame({"query_id": query[at - first < k], "owner_id": place[kept], "distance": distance[kept]})


def search(index: InvertedFile, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """``query_id, owner_id, distance, rank``: the best ``k`` of the vectors in the query's ``probes`` nearest cells."""
    spark = queries.sparkSession
    v = index.vectors
    schema = T.StructType([queries.schema["query_id"], v.schema["owner_id"], T.StructField("distance", T.DoubleType())])
    if k <= 0:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    groups = bundles(index)
    asked = queries.filter("embedding is not null").select("query_id", F.col("embedding").alias("q_vector"))
    n, tasks = asked.count(), 2 * spark.sparkContext.defaultParallelism
    parts = max(blocks_for(n, QUERIES_PER_GROUP), min(blocks_for(n, GROUP_QUERIES), blocks_for(tasks, max(1, len(groups)))))
    kept = T.StructType([schema["query_id"], asked.schema["q_vector"],
                         T.StructField("bundle", T.IntegerType()), T.StructField("bits", T.BinaryType())])
    left = hold(asked.mapInArrow(_asked(index.centroids, min(probes, len(index.centroids)), groups), kept)
                .withColumn("grp", F.pmod(F.xxhash64("query_id"), F.lit(parts))))
    wanted = left.select("bundle", "bits").mapInArrow(_wanted(groups), "cell int, block int, bundle int").distinct()
    wanted = wanted.select(F.col("cell").alias("_cell"), F.col("block").alias("_block"), "bundle")
    read = v.join(small(wanted), (v["cell"] == F.col("_cell")) & (v["block"] == F.col("_block")))
    right = read.select("bundle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("grp"), "cell", "owner_id", F.col("embedding").alias("v_vector"))
    kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def bundle(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        cells = [c for c, _ in groups[a["bundle"][0].as_py()]]
        q_ids, q, v_ids, x = a["query_id"].to_numpy(), unit(a["q_vector"].to_pandas()), b["owner_id"].to_numpy(), unit(b["v_vector"].to_pandas())
        by_id = np.argsort(v_ids, kind="stable")
        v_ids, x, cell = v_ids[by_id], x[by_id], b["cell"].to_numpy()[by_id]  # places then order ties
        places = np.arange(len(v_ids))
        whole = a["bits"].is_null().to_numpy()
        rows = np.flatnonzero(whole)
        best = best_of([nearest(rows, q[rows], places, x, k)], k)
        if not whole.all():
            some = np.flatnonzero(~whole)
            packed = np.frombuffer(b"".join(a["bits"].drop_null().to_pylist()), np.uint8).reshape(len(some), -1)
            bits = np.unpackbits(packed, axis=1, count=len(cells)).astype(bool)
            found, most = [best], max(FOUND_ROWS, 2 * k * len(q))
            for i, c in enumerate(cells):
                rows, of = some[bits[:, i]], places[cell == c]
                found.append(nearest(rows, q[rows], of, x[of], k))
                if sum(map(len, found)) > most:
                    found = [best_of(found, k)]
            best = best_of(found, k)
        best = best.assign(query_id=q_ids[best["query_id"].to_numpy()], owner_id=v_ids[best["owner_id"].to_numpy()])
        return pa.Table.from_pandas(best, schema=kinds, preserve_index=False)

    rows = left.groupBy("bundle", "grp").cogroup(right.groupBy("bundle", "grp")).applyInArrow(bundle, schema)
    return top_k(rows, ["query_id"], [F.round("distance", SCORE_DIGITS), F.col("owner_id")], k)


def rows_read(index: InvertedFile, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, share: the part of all stored vectors that a query reads."""
    total = index.cells.agg(F.sum("n").alias("n")).scalar()
    near = nearest_cells(queries.select("query_id", "embedding").filter("embedding is not null"), index.centroids, min(probes, len(index.centroids)))
    rows = near.select("query_id", F.explode("near").alias("cell")).join(F.broadcast(index.cells.select("cell", "n")), "cell")
    return rows.groupBy("query_id").agg((F.sum("n") / total).alias("share"))
