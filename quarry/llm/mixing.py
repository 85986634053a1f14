"""Mixing sources to target weights by min-cost flow.

Texts may belong to several sources. They are aggregated by membership pattern; a small flow network
routes the words of each pattern, once or repeatedly, to the quotas of its sources, where every
further repetition costs more than the one before. The flow of a pattern is then laid along its texts in seeded
order: a text is taken in a repetition if its middle lies inside the flow. At last one text of each
pattern may be added or taken back if that brings the words closer to the flow.

The driver holds one number for each pattern and source, never anything of a text;
``MAX_PATTERNS`` bounds their count and more raise an error. Seeded running totals are range-partitioned
blocks, so a source with most of the texts is spread over all tasks.

Null and empty texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated rows are
rows of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scale import hold, running_totals

MAX_PATTERNS = 100_000
MAX_REPEATS = 2
SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)
SEED = 17


def words(text: str) -> Column:
    """Number of runs of characters other than space, tab, line breaks; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = SHARE, most: float = MAX_REPEATS) -> list[float]:
    """``share`` of all sizes by weight; what exceeds ``most`` times a source's size is shared
    again by weight among the others until no target is above."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if weights[i] > 0]
    while free:
        unit = total / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > most * sizes[i]]
        for i in over:
            out[i] = float(most * sizes[i])
            total -= out[i]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        free = [i for i in free if i not in set(over)]
    return out


def flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources: largest total, then least cost, where
    repetition r of a pattern's words costs 2r - 1. Successive shortest paths; costs sit on
    the first arcs only, so a path's price is that of the repetition it draws from."""
    sent: list[dict[int, int]] = [defaultdict(int) for _ in capacity]
    used, left = [0] * len(capacity), list(quota)
    of_source = defaultdict(list)
    for p, sources in enumerate(members):
        for s in sources:
            of_source[s].append(p)
    for r in range(1, repeats + 1):
        for start in range(len(capacity)):
            while used[start] < r * capacity[start]:
                # breadth first: pattern -> source -> pattern that can move to another source
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    if kind == "p":
                        steps = [("s", s) for s in members[x]]
                    else:
                        if left[x] > 0:
                            end = (kind, x)
                            break
                        steps = [("p", p) for p in of_source[x] if sent[p][x] > 0]
                    for step in steps:
                        if step not in came:
                            came[step] = (kind, x)
                            queue.append(step)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                moves = list(zip(path, path[1:]))
                amount = min([left[end[1]], r * capacity[start] - used[start], *[sent[b[1]][a[1]] for a, b in moves if a[0] == "s"]])
                for a, b in moves:
                    if a[0] == "p":
                        sent[a[1]][b[1]] += amount
                    else:
                        sent[b[1]][a[1]] -= amount
                used[start] += amount
                left[end[1]] -= amount
    return [dict(s) for s in sent]


def mix(df: DataFrame, members: str, size: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, order: Sequence[str] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """``df`` with ``source_size`` and ``target`` (sums over the row's sources), ``repeats`` and
    ``taken`` (words). ``members`` is an array of source names, sorted and distinct; weights are dealt
    to the sources in code point order, null last, and repeat. ``order`` breaks ties of the seeded draw."""
    spark = df.sparkSession
    plan = df.groupBy(members).agg(F.sum(size).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(plan) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in plan for s in r[0]}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    belongs, capacity = [[at[s] for s in r[0]] for r in plan], [r["n"] for r in plan]
    sizes = [0] * len(names)
    for sources, n in zip(belongs, capacity):
        for s in sources:
            sizes[s] += n
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    routed = flow(capacity, belongs, [round(g) for g in goal], repeats)
    rows = [
        (i, list(r[0]), n, sum(f.values()), sum(sizes[s] for s in b), float(sum(goal[s] for s in b)))
        for i, (r, n, f, b) in enumerate(zip(plan, capacity, routed, belongs))
    ]
    kind = df.schema[members].dataType.simpleString()
    quotas = F.broadcast(spark.createDataFrame(rows, f"_p int, _m {kind}, _n bigint, _flow bigint, source_size bigint, target double"))
    tagged = df.join(quotas, F.col(members).eqNullSafe(F.col("_m"))).drop("_m")
    keyed = tagged.withColumn("_draw", F.xxhash64(F.lit(seed), *order)).withColumn("_one", F.lit(1))
    laid = running_totals(keyed, ["_p"], ["_draw", *order], [size, "_one"])
    middle = F.col(f"run_{size}") - F.col(size) / 2
    inside = [((F.lit(r) * F.col("_n") + middle) < F.col("_flow")).cast("int") for r in range(repeats)]
    laid = hold(laid.withColumn("repeats", F.when(F.col(size) > 0, sum(inside)).otherwise(0)))
    # one text of each pattern closes most of what is left between its words and its flow
    gap = laid.groupBy("_p").agg((F.max("_flow") - F.sum(F.col(size) * F.col("repeats"))).alias("_gap"))
    open_ = laid.join(F.broadcast(gap), "_p")
    step = F.signum("_gap").cast("int")
    base = F.floor(F.col("_flow") / F.greatest(F.col("_n"), F.lit(1)))
    can = (F.col(size) > 0) & (((step > 0) & (F.col("repeats") == base) & (base < repeats)) | ((step < 0) & (F.col("repeats") > base)))
    miss = F.abs(F.abs("_gap") - F.col(size))
    chosen = open_.filter(can & (miss < F.abs("_gap"))).groupBy("_p").agg(F.min_by(F.struct(F.col("run__one").alias("_at"), step.alias("_step")), F.struct(miss, "run__one")).alias("c"))
    out = laid.join(F.broadcast(chosen.select("_p", "c._at", "c._step")), "_p", "left")
    change = F.when(F.col("run__one") == F.col("_at"), F.col("_step")).otherwise(0)
    return out.withColumn("repeats", F.col("repeats") + change).select(*df.columns, "source_size", "target", "repeats", (F.col(size) * F.col("repeats")).cast("bigint").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    sized = hold(df.select(id_col, F.xxhash64(text).alias("sig"), F.array(source).alias("members"), words(text).alias("size")))
    taken = mix(sized, "members", "size", order=(id_col, "sig"))
    often = taken.groupBy(F.col(id_col).alias("_id"), F.col("sig").alias("_sig")).agg(F.sum("repeats").cast("int").alias("_often")).filter("_often > 0")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text).alias("h"))
    kept = rows.join(often, rows["i"].eqNullSafe(often["_id"]) & (rows["h"] == often["_sig"])).dropDuplicates(["i", "h"])
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("_often")))).select(*[F.col("row")[c].alias(c) for c in df.columns])
