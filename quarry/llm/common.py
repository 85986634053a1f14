"""Shared pieces of the corpus operators: table scans, Arrow maps over texts, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ship

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    df: DataFrame, keep: Sequence[str], make: Callable[[], Callable[[bytes], tuple]], fields: Sequence[tuple[str, str]],
    text: str = "text",
) -> DataFrame:
    """Columns ``keep`` and one tuple of ``fields`` (name, Spark type) for each text.

    ``make()`` runs once in each task and returns the function of one text, which receives the
    UTF-8 bytes (null: empty). Arrow batches stream through; one batch is in memory at a time.
    A function with ``close`` lets go of its memory with it when the task ends.
    """
    arrow = [ARROW[kind] for _, kind in fields]
    names = [*keep, *[n for n, _ in fields]]
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(n, T._parse_datatype_string(kind)) for n, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        try:
            for batch in batches:
                texts = batch.column(len(keep))
                rows = [of(t.as_py() or b"") for t in texts]
                made = zip(*rows) if rows else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, a) for c, a in zip(made, arrow)]], names=names)
        finally:
            getattr(of, "close", bool)()

    return df.select(*[F.col(k) for k in keep], F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as literals of the plan."""
    fields = T._parse_datatype_string(schema).fields
    value = lambda v, t: F.array(*map(F.lit, v)) if isinstance(t, T.ArrayType) else F.lit(v).cast(t)
    made = [F.struct(*[value(v, f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*made)))
