"""Near copies by fingerprints of word shingles, completed by an exact set-similarity join.

Two texts are near copies if the sets of their ``SHINGLE``-word shingles have a Jaccard similarity of at
least ``SIMILARITY``. The first links are those of the fingerprint method: the majority fingerprints of the sets that are equal or
meet in a variant signature (``simhash.links``), each verified on the whole sets. Sets that are similar may still differ in more bits,
so the exact join adds the links that are missing.

The shingles of each distinct set are put in one global order, those that are frequent
in a sample last; the sample decides speed only, as any order gives the same pairs. Two similar sets
share one of their first shingles (prefix filter), have similar sizes (length filter), and behind the first
common shingle enough is left on both sides (positional filter). What passes is verified on the whole sets.

Equal sets are one node. Each set is first held against the smallest one that it shares a first shingle with, then against one
of those drawn for its shingles, then, under each shingle, against a drawn one, and only those that are not in one component after that against each other, so a large group
of near copies does not give all its pairs. In that last step a pair is a candidate only if the ``PARITY`` bits of its sets (one for each
group of shingles: odd or even) differ in no more places than the sets may differ in shingles, which loses no similar pair. Components and
their names are those of ``simhash``.

What is stored are the first shingles of each text, not the sets: the sets of candidates are made again from their
texts. Shingles that are frequent in the sample are dealt to ``SALTS`` groups in the first comparison. Stored tables are deleted.

Results for special cases: texts under ``SHINGLE`` words are one shingle; null and empty texts are equal to each
other; bytes that are no UTF-8 are compared as they are; repeated rows and rows without id are rows like any other,
and a component whose rows have no id has a null name; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import map_texts
from quarry.scale import hold, release, small

SHINGLE = 5
SIMILARITY = 0.8
SAMPLE, SEEN, FREQUENT = 16, 3, 100_000  # one text of so many is sampled; least count there; most shingles put last
SALTS = 16  # groups that a frequent shingle is dealt to
PARITY = 1024  # bits that bound the difference of two sets; a power of two
SEED = 42  # fixed value: XXH64 seed of word hashes
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, in ascending order."""
    words = raw.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    w = np.fromiter((digest(x, SEED) for x in words), np.uint64, len(words))
    n = len(words) - shingle + 1
    h = w[:n].copy()
    for j in range(1, shingle):
        h = (h ^ (h >> np.uint64(29))) * FACTOR + w[j : j + n]
    h = (h ^ (h >> np.uint64(30))) * MIX
    return np.unique((h ^ (h >> np.uint64(27))).view(np.int64))


def fingerprint(shingles: np.ndarray) -> int:
    """Majority of the bits of a set's shingles, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), simhash.BLOCK):
        part = shingles[at : at + simhash.BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")[0])


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the set holds an odd number of each of ``PARITY`` groups of shingles. A shingle that only one of two sets
    holds changes one bit, so two sets differ in at least as many shingles as bits."""
    group = (shingles.view(np.uint64) >> np.uint64(65 - PARITY.bit_length())).astype(np.int64)
    odd = (np.bincount(group, minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _sets(df: DataFrame, keep: list[str], text: str, shingle: int) -> DataFrame:
    def make():
        def of(raw: bytes):
            made = shingle_set(raw, shingle)
            return xxhash.xxh64_intdigest(made.tobytes()) - (1 << 63), len(made), made

        return of

    return map_texts(df, keep, make, [("fp", "bigint"), ("n", "int"), ("shingles", "array<bigint>")], text)


def _frequent(df: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts hold, in ascending order, and their counts."""
    some = _sets(df.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0), [], text, shingle).select(F.explode("shingles").alias("s"))
    found = some.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN).orderBy(F.desc("n"), "s").limit(FREQUENT).collect()
    found = sorted((r["s"], r["n"]) for r in found)
    return np.array([s for s, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def _prefixes(df: DataFrame, id_col: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """``id_col``, sig, fp, n, fingerprint (sim), parity bits (odd) and ``first``: the first shingles of each set in the global order, with
    whether they are frequent."""
    names, counts = _frequent(df, text, shingle)

    def make():
        def of(raw: bytes):
            s = shingle_set(raw, shingle)
            fp, n = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s)
            bits = fingerprint(s), parities(s)
            k = n - math.ceil(similarity * n - 1e-9) + 1
            if not len(names):
                return fp, n, *bits, s[:k], k
            at = np.minimum(np.searchsorted(names, s), len(names) - 1)
            often = np.where(names[at] == s, counts[at], 0)
            order = np.lexsort((s, often))[:k]
            return fp, n, *bits, s[order], int((often[order] == 0).sum())

        return of

    fields = [("fp", "bigint"), ("n", "int"), ("sim", "bigint"), ("odd", "array<bigint>"), ("first", "array<bigint>"), ("rare", "int")]
    return map_texts(df.select(id_col, F.xxhash64(text).alias("sig"), text), [id_col, "sig"], make, fields, text)


def _need(n: Column, m: Column, similarity: float) -> Column:
    """Common shingles that sets of these sizes need."""
    return F.ceil((n + m) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def _may(similarity: float) -> Column:
    """Length and positional filter of (n, place) and (m, other_place)."""
    return F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other_place")) >= _need(F.col("n"), F.col("m"), similarity)


def _within(similarity: float) -> Column:
    """Parity filter of (n, odd) and (m, other_odd)."""
    bits = [F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("other_odd")[i])) for i in range(PARITY // 64)]
    return F.col("n") + F.col("m") - functools.reduce(operator.add, bits) >= 2 * _need(F.col("n"), F.col("m"), similarity)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t.as_py() or b"") for t in batch.column(1)], pa.binary())], names=["fp", "packed"])


def _similar(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple[int, np.ndarray] = (0, np.zeros(0, np.int64))  # pairs of one centre follow each other
        for batch in batches:
            kept = []
            for b, s, t in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != b or not len(last[1]):
                    last = b, shingle_set(unpack(t.as_py()), shingle)
                one = shingle_set(unpack(s.as_py()), shingle)
                common = len(np.intersect1d(one, last[1], assume_unique=True))
                kept.append(common >= math.ceil((len(one) + len(last[1])) * similarity / (1 + similarity) - 1e-9))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked."""
    pairs = hold(pairs.select("a", "b").distinct())
    nodes = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).distinct()
    asked = hold(texts(nodes))
    left = pairs.join(asked.withColumnsRenamed({"fp": "a", "packed": "s"}), "a")
    both = left.join(asked.withColumnsRenamed({"fp": "b", "packed": "t"}), "b").select("a", "b", "s", "t")
    found = hold(both.mapInArrow(_similar(shingle, similarity), "a bigint, b bigint"))
    release(pairs, asked)
    return found


def fingerprint_pairs(rows: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of ``fp`` whose fingerprints differ in at most ``simhash.MAX_BITS`` bits: of each pair of fingerprints the
    smallest sets, and each other set with the smallest one of its fingerprint. Held tables are added to ``used``."""
    nodes = rows.select("fp", "sim").distinct()
    sims = hold(nodes.groupBy("sim").agg(F.min("fp").alias("least")))
    near = hold(simhash.links(sims.select(F.col("sim").alias("fp")), used))
    used += [sims, near]
    a, b = (sims.select(F.col("sim").alias(c), F.col("least").alias(f"fp_{c}")) for c in "ab")
    near = near.join(a, "a").join(b, "b").select(F.greatest("fp_a", "fp_b").alias("a"), F.least("fp_a", "fp_b").alias("b"))
    same = nodes.join(sims, "sim").filter(F.col("fp") != F.col("least")).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return near.unionAll(same)


def links(rows: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of ``fp`` that join all similar sets of ``rows`` (fp, n, sim, odd, first, rare): each similar pair is
    among them or in one component by others. ``texts`` gives fp and a packed text of each of some ``fp``."""
    used: list[DataFrame] = []
    marked = _verified(fingerprint_pairs(rows, used), texts, shingle, similarity)
    release(*used)
    each = rows.select("fp", "n", "rare", F.posexplode("first").alias("place", "shingle"))
    salt = F.when(F.col("place") < F.col("rare"), 0).otherwise(1 + F.pmod(F.xxhash64("fp"), F.lit(SALTS))).alias("salt")
    group = Window.partitionBy("shingle", "salt")
    entry = F.struct("fp", "n", "place")
    shared = each.select("fp", "n", "place", "shingle", salt).select("*", F.min(entry).over(group).alias("least"), F.max("fp").over(group).alias("most"))
    shared = hold(shared.filter((F.col("least.fp") < F.col("most")) | (F.col("salt") > 0)).drop("most").distinct())
    stars = shared.select(F.col("fp").alias("a"), "n", "place", F.col("least.fp").alias("b"), F.col("least.n").alias("m"), F.col("least.place").alias("other_place"))
    # one comparison for each set settles most of a large group; then those under each shingle that are still apart
    one = stars.filter((F.col("a") != F.col("b")) & _may(similarity)).groupBy("a").agg(F.min("b").alias("b"))
    more = _verified(_apart(one, marked), texts, shingle, similarity)
    found = hold(marked.unionAll(more))
    second = _labelled(shared.select("fp", "n", "place", "shingle"), found)
    used = [shared, marked, more, found, second]
    for turn in (1, 2):
        draw = F.struct(F.xxhash64("fp", "shingle", F.lit(turn)), "fp")
        drawn = second.groupBy("shingle").agg(F.min_by(F.struct("fp", "n", "place", "label"), draw).alias("least"))
        stars = second.withColumnRenamed("fp", "a").join(drawn, "shingle").filter(F.col("label") != F.col("least.label"))
        stars = stars.select("a", "n", "place", F.col("least.fp").alias("b"), F.col("least.n").alias("m"), F.col("least.place").alias("other_place")).filter(_may(similarity))
        if turn == 1:
            stars = stars.groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64("b"), "b")).alias("b"))
        more = _verified(stars, texts, shingle, similarity)
        found = hold(found.unionAll(more))
        second = _labelled(second.drop("label"), found)
        used += [more, found, second]
    a = hold(second.join(rows.select("fp", "odd").dropDuplicates(["fp"]), "fp"))
    used.append(a)
    b = a.select("shingle", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("label").alias("other"), F.col("odd").alias("other_odd"))
    may = (F.col("a") < F.col("b")) & (F.col("label") != F.col("other")) & _may(similarity) & _within(similarity)
    rest = a.withColumnRenamed("fp", "a").join(b, "shingle").filter(may)
    out = hold(found.unionAll(_verified(rest, texts, shingle, similarity)))
    release(*used)
    return out


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``found`` does not join."""
    labels = hold(simhash.components(found))
    left, right = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    named = pairs.join(left, "a", "left").join(right, "b", "left")
    return named.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _labelled(shared: DataFrame, pairs: DataFrame) -> DataFrame:
    """``shared`` with the component of each set; a shingle with one component has no pair left."""
    named = shared.join(simhash.components(pairs).withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    more = named.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("shingle")
    return hold(named.join(more, "shingle", "left_semi"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``id_col``, ``sig`` (XXH64 of the text), ``fp`` (of the shingle set) and ``component_id`` of every row."""
    rows = hold(_prefixes(df, id_col, text, shingle, similarity))
    one = hold(rows.groupBy("fp").agg(F.min(id_col).alias("first"), F.min("sig").alias("sig")))

    def texts(nodes: DataFrame) -> DataFrame:
        wanted = small(hold(one.select("fp", "sig").join(nodes, "fp", "left_semi")))
        found = df.select(F.xxhash64(text).alias("sig"), F.col(text).cast("binary").alias("t")).join(wanted, "sig").select("fp", "t")
        return found.mapInArrow(_packed, "fp bigint, packed binary").dropDuplicates(["fp"])

    return simhash.named(rows.select(id_col, "sig", "fp"), one.select("fp", "first"), links(rows, texts, shingle, similarity), id_col)
