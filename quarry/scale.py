"""Helpers that keep plans safe at scale: checked broadcasts, skew-proof joins, held
(materialized) intermediate tables and running totals without a single-task sort."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
SCORE_DIGITS = 10  # distances are compared at this precision
SCORE_UNIT = 1e12


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is proven to stay under both bounds.

    Runs one job that stops after ``rows + 1`` rows, so the check itself is bounded.
    """
    seen = (
        df.select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("b"))
        .limit(rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
        .first()
    )
    return seen["n"] <= rows and seen["b"] <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after a size check; the plain frame (shuffle join, AQE) beyond it."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that stays a merge of shuffled sides. Spark takes a stored table for as large as its compressed
    files and would send many times its broadcast threshold through the driver."""
    return df.hint("merge")


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    hot: Sequence | None = None,
) -> DataFrame:
    """Equi-join whose key may be hot on the ``many`` side.

    Each ``many`` row goes to one of ``salts`` sub-keys (hash of ``spread``); ``few`` is
    repeated once per sub-key, so no task receives a whole hot key. ``hot`` names the values of
    a single key that are salted; the others are then not repeated.
    """
    salt, copies = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        (key,) = on
        salt = F.when(F.col(key).isin(list(hot)), salt).otherwise(F.lit(0))
        copies = F.when(F.col(key).isin(list(hot)), copies).otherwise(F.array(F.lit(0)))
    left = many.withColumn("_salt", salt)
    right = few.withColumn("_salt", F.explode(copies))
    return left.join(right if hot is None else shuffled(right), [*on, "_salt"], how).drop("_salt")


def lookup_join(
    many: DataFrame, few: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner",
    checked: bool | None = None,
) -> DataFrame:
    """Join a large table to a lookup side: broadcast when the lookup is proven small, salted
    otherwise. ``checked`` carries the result of an earlier bound on the lookup's size."""
    ok = is_small(few) if checked is None else checked
    if ok:
        return many.join(F.broadcast(few), list(on), how)
    return salted_join(many, few, on, spread, how)


def hold_dir(spark: SparkSession) -> str:
    """The shared folder for held tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


def hold(
    df: DataFrame,
    bucket_by: str | None = None,
    sort_by: Sequence[str] = (),
    buckets: int | None = None,
    laid_out: bool = False,
) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read it back.

    Lost executors re-read the files instead of recomputing the lineage. With ``bucket_by``
    the table keeps its hash layout, so later grouping on that key needs no exchange;
    ``laid_out`` says the plan already ends in that layout and needs no further shuffle.
    """
    spark = df.sparkSession
    name = f"quarry_{uuid.uuid4().hex}"
    path = f"{hold_dir(spark)}/{name}"
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = (df if laid_out else df.repartition(n, bucket_by)).write.bucketBy(n, bucket_by)
    if sort_by:
        writer = writer.sortBy(*sort_by)
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def release(*held: DataFrame) -> None:
    """Delete the files of tables made by ``hold`` that nothing reads any more."""
    for df in held:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not path.rsplit("/", 1)[-1].startswith("quarry_"):
                raise ValueError(f"{path} is not a held table")
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery (one value; evaluated once per plan)."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], latest=False) -> DataFrame:
    """One row per key by partial aggregation instead of a window, so a key that holds a
    large share of the rows is reduced map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    chosen = pick(F.struct(*rest), by).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    values: Sequence[str],
    descending: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``run_<value>`` per key over ``order`` (unique within a key).

    Range-partitioned blocks are written once, block totals (at most blocks + keys rows) are
    summed before each block, and only rows of one block meet in one task.
    """
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [order] if isinstance(order, str) else list(order)
    by = [F.col(o).desc() if descending else F.col(o).asc() for o in names]
    ranged = hold(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *by).withColumn("_block", F.spark_partition_id())
    )
    totals = ranged.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    within = Window.partitionBy(*keys, "_block").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(small(base), [*keys, "_block"])
    return out.select(
        *df.columns, *[(F.sum(v).over(within) + F.col(f"_b_{v}")).alias(f"run_{v}") for v in values]
    )


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """Rank rows per key and keep the first ``k``; the filter on row_number lets Spark prune
    to k rows per key in every task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def exact_sum(value: str | Column) -> Column:
    """Sum in integer units of 1e-12. Integer addition gives the same total in any order, so
    equal documents get equal scores however their parts were spread over tasks."""
    c = F.col(value) if isinstance(value, str) else value
    return F.sum(F.round(c * SCORE_UNIT).cast("bigint")) / F.lit(SCORE_UNIT)
