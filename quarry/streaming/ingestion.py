"""Continuous ingestion: arriving documents become sections and chunks exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import outline as ol


def _stored(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """Documents finished by other epochs."""
    try:
        return spark.read.parquet(f"{path}/documents").filter(F.col("epoch") != epoch).select("doc_id")
    except Exception as error:  # nothing stored yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def store_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """One micro-batch. Every table is written to its own epoch folder and overwritten on
    replay; the document table comes last and marks the batch as done."""
    spark = batch.sparkSession
    fresh = batch.groupBy("doc_id").agg(F.min_by(F.struct("text", "page_count"), F.sha2("text", 256)).alias("d")).select("doc_id", "d.*")
    done = _stored(spark, path, epoch)
    if done is not None:
        fresh = fresh.join(done, "doc_id", "left_anti")
    sections, chunks = ol.structure(fresh)
    sections.write.mode("overwrite").parquet(f"{path}/sections/epoch={epoch}")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/epoch={epoch}")
    fresh.select("doc_id").write.mode("overwrite").parquet(f"{path}/documents/epoch={epoch}")


def ingest(documents: DataFrame, path: str) -> StreamingQuery:
    """Start ingesting a stream of ``doc_id, text, page_count`` into ``path``."""
    return (
        documents.writeStream.foreachBatch(lambda df, epoch: store_batch(df, epoch, path))
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
