"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, so two fingerprints that differ in at most two bits have
a half that differs in at most one. Each distinct fingerprint is indexed under its halves with one
bit as a wildcard; equal variants meet in an equality join, one side with the bit 0 and the other with the
bit 1, and are verified. A pair is looked for in one place only: the wildcard variants of the upper half
hold those that differ there in one bit, the whole upper half those that are equal there, the whole lower
half those with both bits above. Variants with more than ``HOT`` fingerprints are cut again, within the
half that may still differ, so a large group of near copies does not give all its pairs.

Equal fingerprints are one node, so copies are never expanded into pairs. Connected components come from
rounds of minimum labels with shortcuts; each round is written to the shared folder.

Null and empty texts have fingerprint 0 and are linked like others; rows without an id belong to
components but do not name them (null if no row has an id); repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_texts
from quarry.scale import hold

SHINGLE = 3
MAX_BITS = 2
HOT = 256  # fingerprints under one variant before it is cut again
BLOCK = 1 << 15  # shingles counted at a time
SEED = 42  # fixed value: XXH64 seed of shingle hashes


def fingerprint(raw: bytes) -> tuple[int]:
    """Majority of the bits of all shingle hashes, as a signed 64-bit integer."""
    words = raw.lower().split()
    if not words:
        return (0,)
    n, counts = 0, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - SHINGLE + 1)
    for at in range(0, last, BLOCK):
        part = words[at : min(at + BLOCK, last) + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    bits = np.packbits(2 * counts > n, bitorder="little").view("<i8")
    return (int(bits[0]),)


def fingerprints(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return map_texts(df, keep, lambda: fingerprint, [("fp", "bigint")], text)


def _bits(c: Column, low: int, n: int) -> Column:
    """``n`` bits of ``c`` from bit ``low`` on."""
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << n) - 1))


def _bit(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, i).bitwiseAND(F.lit(1))


def _variants(c: Column, low: int, n: int) -> list[tuple[int, Column, Column | None]]:
    """(number, value, side) of a segment as it is (no sides) and with one wildcard each."""
    seg = _bits(c, low, n)
    return [(0, seg, None)] + [(i + 1, seg.bitwiseAND(F.lit((1 << n) - 1 - (1 << i))), _bit(c, low + i)) for i in range(n)]


def _rows(df: DataFrame, variants: list[tuple[int, Column, Column | None]]) -> DataFrame:
    """fp, key (variant number above 32 value bits) and side (0: also of whole segments)."""
    entries = [
        F.struct((F.lit(k << 32).bitwiseOR(v)).alias("key"), (F.lit(2) if side is None else side.cast("int")).alias("side")) for k, v, side in variants
    ]
    kept = [c for c in df.columns if c not in ("key", "side")]
    return df.select(*kept, F.explode(F.array(*entries)).alias("e")).select(*kept, "e.key", "e.side")


def _joined(rows: DataFrame, on: list[str]) -> DataFrame:
    """Verified pairs among rows that share ``on``: sides 0 and 1, or any two without sides."""
    a = rows.filter(F.col("side") != 1).select(*on, F.col("fp").alias("a"), F.col("side").alias("_s"))
    b = rows.filter(F.col("side") != 0).select(*on, F.col("fp").alias("b"), F.col("side").alias("_t"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return a.join(b, on).filter(((F.col("_s") < F.col("_t")) & (F.col("_s") == 0) & (F.col("_t") == 1) | (F.col("_s") == 2) & (F.col("_t") == 2) & (F.col("a") < F.col("b"))) & near).select("a", "b")


def links(fps: DataFrame, used: list[DataFrame] | None = None) -> DataFrame:
    """Each pair (a, b) of distinct fingerprints in ``fps`` that differ in 1 or 2 bits. Held tables are added to ``used``."""
    c = F.col("fp")
    upper = _variants(c, 32, 32)
    lower = [(33, _bits(c, 0, 32), None)]
    rows = hold(_rows(fps.select("fp"), [*upper, *lower]))
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key")
    hot = hold(hot)
    if used is not None:
        used += [rows, hot]
    if hot.isEmpty():
        return _joined(rows, ["key"])
    few = rows.join(hot, "key", "left_anti")
    many = rows.join(hot, "key", "left_semi").withColumnsRenamed({"key": "first", "side": "first_side"})
    number = F.shiftrightunsigned(F.col("first"), 32)
    # equal above: one or two bits below, by its halves
    same = many.filter(number == 0)
    # equal below: two bits above, by its halves
    back = many.filter(number == 33)
    # one bit above: none or one below; the sides of both wildcards meet crosswise
    one = many.filter((number > 0) & (number < 33))
    crossed = [(k, v, None if side is None else side.bitwiseXOR(F.col("first_side").cast("bigint"))) for k, v, side in _variants(c, 0, 32)]
    one = _rows(one, crossed).withColumn("key", F.when(F.col("side") == 2, F.col("key")).otherwise(F.shiftleft(F.col("side").cast("bigint"), 40).bitwiseOR(F.col("key"))))
    one = one.withColumn("side", F.col("first_side"))
    halves = lambda low: [*_variants(c, low + 16, 16), (40, _bits(c, low, 16), None)]
    again = [_joined(_rows(same, halves(0)), ["first", "key"]), _joined(_rows(back, halves(32)), ["first", "key"]), _joined(one, ["first", "key"])]
    out = _joined(few, ["key"])
    for more in again:
        out = out.unionAll(more)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node in the pairs (a, b)."""
    edges = hold(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = hold(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("new")))
    while not labels.filter("new").isEmpty():
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.select("node", "label").join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        labels = hold(hooked.join(jump, "best").select("node", F.least("best", "far").alias("to"), "label").select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("new")))
    return labels.select("node", "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``sig`` (XXH64 of the text), ``fp`` and ``component_id`` of every row."""
    rows = hold(fingerprints(df.select(id_col, F.xxhash64(text).alias("sig"), text), [id_col, "sig"], text))
    fps = hold(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
    return named(rows, fps, links(fps), id_col)


def named(rows: DataFrame, fps: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with the ``component_id`` of their ``fp``: the smallest ``first`` of its component."""
    found = components(pairs)
    nodes = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    names = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = hold(nodes.join(hold(names), "label").select("fp", "component_id"))
    return rows.join(of_fp, "fp").select(id_col, "sig", "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", find=near_duplicates) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component in ``find(df, id_col, text)``, one for
    each component (of rows without id the one with the smallest hash)."""
    found = find(df, id_col, text)
    name = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("_id"), F.col("sig").alias("_sig"))
    chosen = found.groupBy(name.alias("name")).agg(F.min(key).alias("k")).select("k._id", "k._sig").distinct()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text).alias("h"))
    kept = rows.join(chosen, rows["i"].eqNullSafe(chosen["_id"]) & (rows["h"] == chosen["_sig"])).dropDuplicates(["i", "h"])
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
