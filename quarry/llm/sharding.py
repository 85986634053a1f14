"""Sharding by minimax contiguous partition.

Atomic groups (rows with an equal key, such as equal texts) stay in one shard. Groups are ordered by
their key's SHA-256, which mixes the corpus, and laid end to end as running totals. The smallest capacity with
which a greedy pass needs no more than the wanted shards is found by binary search; cutting greedily with that
capacity gives the partition.

A group above the mean shard would force that capacity on all shards. Such groups, fewer than
shards, come first and get a shard each; the search then deals with the rest.

The greedy pass asks for the last group end at or below a point. The driver answers from a sorted
sample of group ends, ``CELLS`` at most at first, each the largest of its cell. Where ends between them decide,
the cells in question are read again at a finer grain, so the result is exact and the driver holds a
bounded summary, never the groups.

Null keys are one group; empty tables give an empty result; sizes must not be negative; equal rows keep
places of their own. With fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import inline
from quarry.scale import hold, running_totals

CELLS = 1 << 14
FINER = 64  # cells that an undecided cell is cut into


class Ends:
    """Known group ends in order, and for each whether unknown ends lie between it and the one
    before."""

    def __init__(self, ends: DataFrame, start: int, total: int):
        self.ends = ends.filter(F.col("end") > start).select("end").distinct().select("end", F.floor((F.col("end") - start - 1) / F.lit(max(1, -(-(total - start) // CELLS)))).alias("c"))
        self.start, self.total = start, total
        rows = self._summary(self.ends.groupBy("c"))
        self.known, self.hidden, self.cell = [[r[i] for r in rows] for i in range(3)]

    @staticmethod
    def _summary(cells) -> list[tuple[int, bool, int]]:
        """The smallest and the largest end of each cell; before the latter others may be hidden."""
        rows = cells.agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count("*").alias("n")).collect()
        return sorted([(r["high"], r["n"] > 2, r["c"]) for r in rows] + [(r["low"], False, r["c"]) for r in rows if r["low"] < r["high"]])

    def at_most(self, point: int) -> tuple[int, int]:
        """Bounds of the last end at or below ``point``; equal if it is known."""
        i = bisect_right(self.known, point)
        below = self.known[i - 1] if i else self.start
        return below, (point if i < len(self.known) and self.hidden[i] else below)

    def passed(self, capacity: int, shards: int, beyond: int) -> tuple[bool | None, list[tuple[int, int]]]:
        """Whether a greedy pass gets through, where shard j may also not end more than
        ``beyond`` after its even share; None: not decided. With bounds of the cuts."""
        mean = (self.total - self.start) / shards
        low = high = self.start
        cuts = []
        for j in range(1, shards + 1):
            most = self.total if j == shards else self.start + int(j * mean) + beyond
            low, high = self.at_most(min(low + capacity, most))[0], self.at_most(min(high + capacity, most))[1]
            cuts.append((low, high))
        return (True if low >= self.total else False if high < self.total else None), cuts

    def refine(self, cuts: list[tuple[int, int]]) -> None:
        """Reads the cells again in which a cut may lie: a few for each shard, in one job."""
        wanted = set()
        for low, high in cuts:
            i = bisect_right(self.known, low)
            while i < len(self.known) and (self.known[i - 1] if i else self.start) < high:
                if self.hidden[i]:
                    wanted.add(i)
                i += 1
        if not wanted:
            return
        cells = [(self.cell[i], self.known[i - 1] if i else self.start, self.known[i]) for i in sorted(wanted)]
        asked = F.broadcast(inline(self.ends.sparkSession, cells, "c bigint, below bigint, above bigint"))
        inside = self.ends.join(asked, "c").filter("end > below and end <= above")
        width = F.ceil((F.col("above") - F.col("below")) / F.lit(FINER))
        rows = self._summary(inside.groupBy("c", "above", F.floor((F.col("end") - F.col("below") - 1) / width)))
        old = {self.known[i] for i in wanted}
        kept = [(k, h, c) for k, h, c in zip(self.known, self.hidden, self.cell) if k not in old]
        rows = sorted(kept + rows)
        self.known, self.hidden, self.cell = [[r[i] for r in rows] for i in range(3)]

    def least(self, low: int, high: int, of) -> int:
        """The smallest x from ``low`` to ``high`` for which the greedy pass ``of(x)`` gets through."""
        while low < high:
            mid = (low + high) // 2
            through, cuts = of(mid)
            if through is None:
                self.refine(cuts)
            else:
                low, high = (low, mid) if through else (mid + 1, high)
        return low

    def partition(self, shards: int, largest: int) -> list[int]:
        """Cuts for the smallest feasible capacity. Of the partitions with this capacity the one
        whose cuts go least beyond the even shares, so that the last shard is not left short."""
        total = self.total - self.start
        low = max(largest, -(-total // shards))
        capacity = self.least(low, max(low, total), lambda c: self.passed(c, shards, total))
        beyond = self.least(0, total, lambda r: self.passed(capacity, shards, r))
        while True:
            _, cuts = self.passed(capacity, shards, beyond)
            if all(a == b for a, b in cuts):
                return [a for a, _ in cuts]
            self.refine(cuts)


def _below(cuts: list[int], x: Column) -> Column:
    """How many of the ascending numbers lie below ``x``; at most as many as shards."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < x)) if cuts else F.lit(0)


def minimax(df: DataFrame, shards: int, size: str, group: Column, order: list[str]) -> DataFrame:
    """``df`` with ``shard`` (from 0), ``slot`` (gapless from 0 in each shard) and the running
    total it was cut by. ``order`` settles the slots within a group."""
    keyed = hold(df.withColumn("_group", F.coalesce(F.sha2(group.cast("binary"), 256), F.lit(""))).withColumn("_one", F.lit(1)))
    groups = hold(keyed.groupBy("_group").agg(F.sum(size).alias("n")))
    total = groups.agg(F.sum("n")).first()[0]
    if total is None:
        return keyed.select(*df.columns, F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    # groups above the mean of what the others leave: fewer than shards, as each takes more than its share
    large, rest = [], total
    for r in groups.orderBy(F.desc("n"), "_group").limit(shards - 1).collect():
        if r["n"] * (shards - len(large)) <= rest:
            break
        large.append(r["_group"])
        rest -= r["n"]
    alone = sum([F.when(F.col("_group") == g, i).otherwise(0) for i, g in enumerate(large)], F.lit(0))
    first = F.when(F.col("_group").isin(large), alone).otherwise(len(large)) if large else F.lit(0)
    laid = hold(running_totals(keyed.withColumn("_first", first), [], ["_first", "_group", *order], [size, "_one"]))
    ends = hold(laid.groupBy("_first", "_group").agg(F.max(f"run_{size}").alias("end"), F.sum(size).alias("n")))
    heads = sorted(r["end"] for r in ends.filter(F.col("_first") < len(large)).select("end").collect())
    tail = ends.filter(F.col("_first") == len(large))
    least = tail.agg(F.max("n")).first()[0] or 0
    cuts = Ends(tail.select("end"), heads[-1] if heads else 0, total).partition(shards - len(large), least)
    # a group's shard: the cuts below its end; groups of size 0 follow the group before them
    shard = _below([*heads, *cuts], F.col(f"run_{size}")).cast("int")
    placed = laid.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("run__one").alias("_start")))  # a row for each shard
    return placed.join(starts, "shard").select(*df.columns, "shard", (F.col("run__one") - F.col("_start")).alias("slot"))
