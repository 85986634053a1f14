"""Positional, zoned inverted index as a set of tables.

Rows are laid out by document: the text is shuffled once on ``doc_id``; term frequencies,
positions, lengths and norms come out of each document's own row, and per-document score sums
group on keys that contain ``doc_id``, so they reuse that layout without another exchange. Only
document frequencies are shuffled by term, after map-side counting.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import lists as ls
from quarry.scale import blocks_for, first_per_key, hold, hold_dir, row_count, top_k

CHAMPION_R = 50
BUCKET_BYTES = 8 << 20  # text of a bucket


@dataclass(frozen=True)
class Index:
    """``postings``: doc_id, zone, term, tf, positions, zone_len, norm;
    ``doc_zone``: doc_id, zone, len, norm; ``docs``: doc_id; ``dictionary``: term, df, idf;
    ``zone_stats``: zone, avg_len, n_docs."""

    postings: DataFrame
    doc_zone: DataFrame
    docs: DataFrame
    dictionary: DataFrame
    zone_stats: DataFrame
    keys: DataFrame  # doc_id, zone of everything indexed, also of empty zones
    stemmer: str = "porter"
    champion_r: int = CHAMPION_R
    buckets: int | None = None  # of the stored tables; None: as many as a shuffle has partitions
    lists: ls.Lists | None = None  # stored lists and champion cuts, for searches that end early
    grouped: DataFrame | None = None  # doc_id, zone, size, norm, terms: the postings as one row for each text


def zone_rows(df: DataFrame, zones: Mapping[str, Column], doc_id: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """``doc_id, zone, text`` from one text column per zone (a single scan)."""
    pairs = [F.struct(F.lit(z).alias("zone"), F.coalesce(c, F.lit("")).alias("text")) for z, c in zones.items()]
    return df.select(F.col(doc_id).alias("doc_id"), *keep, F.inline(F.array(*pairs)))


def latest_documents(zones: DataFrame, order_by: str) -> DataFrame:
    """A repeated document keeps the zones of its last version by ``order_by``; zones that only an older version has are gone."""
    last = zones.groupBy("doc_id").agg(F.max(order_by).alias("_last"))
    rows = zones.join(last, "doc_id").filter(F.col(order_by).eqNullSafe(F.col("_last"))).drop("_last")
    return first_per_key(rows, ["doc_id", "zone"], [order_by], latest=True).drop(order_by)


def buckets_for(zones: DataFrame) -> int:
    """Buckets of at most ``BUCKET_BYTES`` of text on average, so that a task does not grow with the table."""
    size = zones.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks_for(size, BUCKET_BYTES))


def postings_table(zones: DataFrame, stemmer: str = "porter", buckets: int | None = None) -> DataFrame:
    """One row per (document, zone, term) with sorted positions, zone length and lnc norm."""
    return opened(grouped_postings(zones, stemmer, buckets))


def grouped_postings(zones: DataFrame, stemmer: str = "porter", buckets: int | None = None) -> DataFrame:
    """One row per (document, zone) with all its terms, so a stored table has few rows to lay out."""
    dealt = zones.repartition(buckets, "doc_id") if buckets else zones.repartition("doc_id")
    return dealt.select("doc_id", "zone", tx.term_groups("text", stemmer).alias("g")).select("doc_id", "zone", "g.*")


def opened(grouped: DataFrame) -> DataFrame:
    """The postings of grouped rows."""
    rows = grouped.select("doc_id", "zone", "size", "norm", F.inline("terms"))
    return rows.select(
        "doc_id", "zone", "term", F.size("positions").alias("tf"), "positions", F.col("size").alias("zone_len"), "norm"
    )


def log_tf(tf: str | Column) -> Column:
    c = F.col(tf) if isinstance(tf, str) else tf
    return F.when(c > 0, 1.0 + F.log10(c.cast("double"))).otherwise(F.lit(0.0))


def _derive(postings: DataFrame, keys: DataFrame, stemmer: str, champion_r: int) -> Index:
    present = postings.groupBy("doc_id", "zone").agg(F.first("zone_len").alias("len"), F.first("norm").alias("norm"))
    doc_zone = keys.join(present, ["doc_id", "zone"], "left").select(
        "doc_id", "zone", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("norm", F.lit(0.0)).alias("norm")
    )
    return _statistics(postings, doc_zone, keys, stemmer, champion_r)


def _statistics(postings: DataFrame, doc_zone: DataFrame, keys: DataFrame, stemmer: str, champion_r: int, df: DataFrame | None = None) -> Index:
    docs = doc_zone.select("doc_id").distinct()
    n = row_count(docs)
    zone_stats = doc_zone.groupBy("zone").agg(F.sum("len").alias("total")).select(
        "zone", (F.col("total") / n).alias("avg_len"), n.alias("n_docs")
    )
    if df is None:
        df = doc_postings(postings).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    dictionary = df.select("term", "df", F.log10(n / F.col("df")).alias("idf"))
    return Index(postings, doc_zone, docs, dictionary, zone_stats, keys, stemmer, champion_r)


def build(zones: DataFrame, stemmer: str = "porter", champion_r: int = CHAMPION_R,
          order_by: str | None = None, buckets: int | None = None) -> Index:
    """Index over ``doc_id, zone, text`` rows (lazy). With ``order_by`` repeated documents keep
    their last version; otherwise ``(doc_id, zone)`` must be unique."""
    if order_by:
        zones = latest_documents(zones, order_by)
    grouped = grouped_postings(zones, stemmer, buckets)
    made = _derive(opened(grouped), zones.select("doc_id", "zone"), stemmer, champion_r)
    return replace(made, buckets=buckets, grouped=grouped)


def held(index: Index, lists: bool = False) -> Index:
    """Write the index once into bucketed tables of the shared folder; later queries read the
    stored postings and keep the document layout. Postings are stored as one row for each text, and lengths
    and the dictionary are derived from these, so the text is analyzed a single time. With ``lists`` the postings are also stored as
    whole lists with their champion cuts, which ranked searches then use."""
    if index.grouped is None:
        postings, grouped, df = hold(index.postings, "doc_id", buckets=index.buckets, laid_out=True), None, None
        doc_zone = hold(_derive(postings, index.keys, index.stemmer, index.champion_r).doc_zone, "doc_id", buckets=index.buckets)
    else:
        grouped = hold(index.grouped, "doc_id", buckets=index.buckets, laid_out=True)
        postings, df = opened(grouped), document_terms(grouped).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        doc_zone = grouped.select("doc_id", "zone", F.col("size").alias("len"), "norm")
    fresh = _statistics(postings, doc_zone, doc_zone.select("doc_id", "zone"), index.stemmer, index.champion_r, df)
    stored = replace(fresh, dictionary=hold(fresh.dictionary), zone_stats=hold(fresh.zone_stats), buckets=index.buckets, grouped=grouped)
    return with_lists(stored) if lists else stored


def counted(zones: DataFrame, stemmer: str = "porter", champion_r: int = CHAMPION_R) -> Index:
    """An index of which only the dictionary is stored, counted from whole texts without postings; its other tables are made when they are read."""
    n = buckets_for(zones)
    texts = zones.repartition(n, "doc_id").groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    df = tx.document_counts(texts, "text", stemmer)
    made = _derive(postings_table(zones, stemmer, n), zones.select("doc_id", "zone"), stemmer, champion_r)
    fresh = _statistics(made.postings, made.doc_zone, zones.select("doc_id", "zone"), stemmer, champion_r, df)
    docs = zones.select("doc_id").distinct()
    total = row_count(docs)
    dictionary = hold(df.select("term", "df", F.log10(total / F.col("df")).alias("idf")))
    return replace(fresh, docs=docs, dictionary=dictionary, buckets=n)


def listed(zones: DataFrame, stemmer: str = "porter", champion_r: int = CHAMPION_R) -> Index:
    """A stored index for ranked searches in one pass over the text: whole lists of frequencies and the dictionary they give.
    Its postings are the lists as rows, without positions; champion cuts are left to ``with_cuts``."""
    made = ls.build(zones, _lists_dir(zones.sparkSession), champion_r, stemmer)
    doc_zone = hold(ls.doc_zone(made), "doc_id")
    fresh = _statistics(ls.postings(made), doc_zone, doc_zone.select("doc_id", "zone"), stemmer, champion_r, ls.document_frequencies(made))
    return replace(fresh, dictionary=hold(fresh.dictionary), zone_stats=hold(fresh.zone_stats), lists=made)


def with_cuts(index: Index) -> Index:
    """A listed index that also stores its champion cuts."""
    return replace(index, lists=ls.with_cuts(index.lists, _lists_dir(index.docs.sparkSession)))


def _lists_dir(spark: SparkSession) -> str:
    return f"{hold_dir(spark)}/quarry_lists_{uuid.uuid4().hex}"


def with_lists(index: Index) -> Index:
    """A stored index that also holds its postings as whole lists."""
    made = ls.write(index.postings, index.doc_zone, _lists_dir(index.postings.sparkSession), index.champion_r, tasks=index.buckets)
    return replace(index, lists=made)


def save(index: Index, path: str) -> None:
    """Persist the tables; postings are sorted by term so term filters skip row groups."""
    read = index.postings.sparkSession.read.parquet
    index.postings.sortWithinPartitions("term", "zone", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = _derive(read(f"{path}/postings"), index.keys, index.stemmer, index.champion_r)
    stored.doc_zone.write.mode("overwrite").parquet(f"{path}/doc_zone")
    doc_zone = read(f"{path}/doc_zone")
    stored = _statistics(stored.postings, doc_zone, doc_zone.select("doc_id", "zone"), index.stemmer, index.champion_r)
    stored.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    stored.zone_stats.write.mode("overwrite").parquet(f"{path}/zone_stats")
    ls.write(stored.postings, doc_zone, f"{path}/lists", index.champion_r)


def load(spark: SparkSession, path: str, stemmer: str = "porter", champion_r: int = CHAMPION_R) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    doc_zone = read("doc_zone")
    return Index(read("postings"), doc_zone, doc_zone.select("doc_id").distinct(), read("dictionary"),
                 read("zone_stats"), doc_zone.select("doc_id", "zone"), stemmer, champion_r, ls.read(spark, f"{path}/lists"))


def refresh(index: Index, changed_zones: DataFrame, removed: DataFrame | None = None) -> Index:
    """Re-index only changed documents: their old rows leave, new rows enter, statistics follow."""
    gone = changed_zones.select("doc_id").distinct()
    if removed is not None:
        gone = gone.union(removed.select("doc_id")).distinct()
    part = build(changed_zones, index.stemmer, index.champion_r)
    postings = index.postings.join(gone, "doc_id", "left_anti").unionByName(part.postings)
    doc_zone = index.doc_zone.join(gone, "doc_id", "left_anti").unionByName(part.doc_zone)
    return _statistics(postings, doc_zone, doc_zone.select("doc_id", "zone"), index.stemmer, index.champion_r)


# ---- lookups ---------------------------------------------------------------------------


def doc_postings(postings: DataFrame) -> DataFrame:
    """Distinct ``term, doc_id`` over all zones."""
    return postings.select("term", "doc_id").distinct()


def document_terms(grouped: DataFrame) -> DataFrame:
    """Distinct ``term, doc_id`` over all zones from grouped rows: a document's terms are made distinct inside its own row."""
    whole = grouped.groupBy("doc_id").agg(F.collect_list("terms.term").alias("t"))
    return whole.select(F.explode(F.array_distinct(F.flatten("t"))).alias("term"), "doc_id")


def champions(index: Index) -> DataFrame:
    """Top ``champion_r`` postings per (zone, term) by tf, then doc id; from the stored cuts if there are any."""
    if index.lists is not None and index.lists.cuts is not None and index.lists.r == index.champion_r:
        return ls.champions(index.lists)
    return top_k(
        index.postings.select("zone", "term", "doc_id", "tf"), ["zone", "term"],
        [F.col("tf").desc(), F.col("doc_id")], index.champion_r, "champion_rank",
    ).drop("champion_rank")


def terms(index: Index) -> DataFrame:
    """The dictionary in order."""
    return index.dictionary.select("term").orderBy("term")


def term_lookup(index: Index, wanted: DataFrame) -> DataFrame:
    """tf and positions of each wanted ``(term[, zone][, doc_id])``; absent rows get tf 0."""
    on = [c for c in ("term", "zone", "doc_id") if c in wanted.columns]
    rows = index.postings.select("doc_id", "zone", "term", "tf", "positions")
    return wanted.join(rows, on, "left").withColumn("tf", F.coalesce("tf", F.lit(0)))


def statistics(index: Index) -> DataFrame:
    """One row: documents, vocabulary, mean df, total document postings, zones."""
    n = row_count(index.docs)
    return index.dictionary.agg(
        F.count(F.lit(1)).alias("vocabulary_size"),
        F.coalesce(F.avg("df"), F.lit(0.0)).alias("avg_postings_length"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("total_doc_postings"),
    ).select(n.alias("n_docs"), "*")


def zone_postings_means(index: Index) -> DataFrame:
    """Mean postings-list length per zone over the whole dictionary."""
    vocabulary = row_count(index.dictionary)
    return index.postings.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).select(
        "zone", (F.col("n") / vocabulary).alias("mean_postings")
    )


def fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """``n, digest`` of an id set, independent of order and of how tasks split the ids."""
    piece = F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("bigint")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(piece).alias("digest"))
