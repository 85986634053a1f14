"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's word shingles, in order.
Sketches of parts merge into the sketch of the whole. Resemblance is estimated from the k smallest
hashes of the union; containment and the number of distinct shingles follow from it. Texts with
at most k distinct shingles are compared exactly. All steps are built-in functions of one row.

Words are runs of characters other than white space, lower-cased in A-Z; a text of fewer words than a shingle is one
shingle, a text without words has an empty sketch. Two empty sketches resemble each other fully,
an empty and a full one not at all. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
K = 128
FOLD_FROM, FOLD_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     "


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """The ``k`` smallest distinct hashes of the text's ``n``-word shingles, ascending."""
    hashes = F.transform(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), FOLD_FROM, FOLD_TO), " "), ""), lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        many = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]))
        return F.when(F.size(h) >= n, many).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(_let(hashes, shingled))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of the texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) / (share of the hash range below the k-th hash)."""
    share = (F.get(s, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(2.0**-64)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two texts' shingles."""
    both = _let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second holds."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def written(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _blocks(df: DataFrame, id_col: str, n: int) -> tuple[Column, Column]:
    """Block number of a row in id order, and the block that also needs the row because it ends
    just before it (null: none; the first row follows the last). Only ids are read here, and the
    driver gets ``n`` numbers."""
    ids = df.select(F.col(id_col).alias("i"))
    cuts = ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    step = max(1, round(len(cuts) ** 0.5))
    coarse = cuts[::step]
    i = F.col(id_col)

    def count(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= i))

    if cuts:
        kind = df.schema[id_col].dataType
        at = count(F.array(*[F.lit(c).cast(kind) for c in coarse]))
        fine = F.slice(F.array(*[F.lit(c).cast(kind) for c in cuts]), (at - 1) * step + 1, step)
        block = F.when(i.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + count(fine))
    else:
        block = F.lit(0)
    firsts = df.select(i.alias("i"), block.alias("b")).groupBy("b").agg(F.min("i").alias("i"), F.max(F.col("i").isNull()).alias("none")).collect()
    firsts = [(r["b"], None if r["none"] else r["i"]) for r in sorted(firsts)]
    lent = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    pairs = [F.lit(v) for first, b in lent.items() if first is not None for v in (first, b)]
    to = F.try_element_at(F.create_map(*pairs), i) if pairs else F.lit(None).cast("int")
    return block, F.when(i.isNull(), F.lit(lent.get(None))).otherwise(to)


def compare_edited(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each text's fingerprint against those of its edited text (the last half replaced by the start of
    the next row's text) and of the next row. Rows are ordered by a numeric id (null first), then
    by text hash; the first row follows the last. Texts are shuffled once, by blocks of ids."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, also = _blocks(df, id_col, 2 * n)
    mine, lent = F.struct(block.alias("b"), F.lit(False).alias("lent")), F.struct(also.alias("b"), F.lit(True).alias("lent"))
    placed = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.explode(F.when(also.isNull(), F.array(mine)).otherwise(F.array(mine, lent))).alias("at"))
    placed = placed.select("id", "text", F.col("at.b").alias("block"), F.col("at.lent").alias("lent")).repartition(n, "block")
    made = placed.withColumn("print", sketch(F.col("text"), k)).withColumn("sig", F.xxhash64("text"))
    w = Window.partitionBy("block").orderBy("lent", F.col("id").asc_nulls_first(), "sig")
    pair = made.select("id", "text", "print", "lent", F.lead("text").over(w).alias("next_text"), F.lead("print").over(w).alias("next_print")).filter("not lent")
    half = F.expr("cast(char_length(text) div 2 as int)")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(char_length(text) div 2 as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    done = pair.select(F.col("id").alias(id_col), F.char_length("text").cast("bigint").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    done = done.withColumn("edited_print", sketch(F.col("edited"), k))
    return done.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print"), k).alias("near_edited"), resemblance(F.col("print"), F.col("next_print"), k).alias("near_next"),
        distinct_shingles(F.col("print"), k).alias("n_shingles"), containment(F.col("print"), F.col("edited_print"), k).alias("in_edited"),
    )
