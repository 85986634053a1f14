"""Sliding-window-counter admission per key, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.scale import running_totals


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def admissions(events: DataFrame, key: str, limit: int, window_seconds: int = 60) -> DataFrame:
    """Add ``allowed`` to ``event_id, ts, <key>``: previous window's count, weighted by its
    remaining share, plus the current count. Rejected events still count.

    Counts inside a window come from block-wise running totals, so one busy key is not sorted
    by a single task.
    """
    width = window_seconds * 1_000_000
    rows = events.withColumn("_us", micros(F.col("ts"))).withColumn("_bucket", F.floor(F.col("_us") / width)).withColumn("_one", F.lit(1))
    counted = running_totals(rows, [key, "_bucket"], ["_us", "event_id"], ["_one"])
    totals = rows.groupBy(key, (F.col("_bucket") + 1).alias("_bucket")).agg(F.count(F.lit(1)).alias("_prev"))
    joined = counted.join(totals, [key, "_bucket"], "left")
    elapsed = (F.col("_us") - F.col("_bucket") * width) / F.lit(float(width))
    weighted = F.coalesce("_prev", F.lit(0)) * (1.0 - elapsed) + F.col("run__one")
    return joined.select(*events.columns, (weighted <= limit).alias("allowed"))


def two_limits(events: DataFrame, first: tuple[str, int], second: tuple[str, int], window_seconds: int = 60) -> DataFrame:
    """Admit only what passes both limits; the second is hit only by events the first admits."""
    a = admissions(events, first[0], first[1], window_seconds)
    b = admissions(a.filter("allowed").drop("allowed"), second[0], second[1], window_seconds)
    return b.unionByName(a.filter("not allowed"))


def stream_admissions(events: DataFrame, key: str, limit: int, window_seconds: int = 60) -> DataFrame:
    """The same decision on a stream of ``event_id, ts, <key>`` that arrives in time order.

    State per key is two counters; it expires two windows after the last event.
    """
    width = window_seconds * 1_000_000
    key_type = events.schema[key].dataType.simpleString()
    id_type = events.schema["event_id"].dataType.simpleString()

    def decide(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket, current, previous = state.get if state.exists else (-1, 0, 0)
        # One micro-batch of one key, in event order.
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        allowed = []
        for us in pdf["us"]:
            b = int(us) // width
            if b != bucket:
                previous, current, bucket = (current if b == bucket + 1 else 0), 0, b
            current += 1
            allowed.append(previous * (1.0 - (int(us) - b * width) / width) + current <= limit)
        state.update((bucket, current, previous))
        yield pd.DataFrame({"event_id": pdf["event_id"], key: k[0], "allowed": allowed})

    source = events.select("event_id", key, micros(F.col("ts")).alias("us"))
    return source.groupBy(key).applyInPandasWithState(
        decide, f"event_id {id_type}, {key} {key_type}, allowed boolean", "bucket long, current long, previous long",
        "append", GroupStateTimeout.NoTimeout)
