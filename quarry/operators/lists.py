"""Postings as whole lists of a shard of documents, scored a shard at a time with early termination.

Documents are dealt into shards by a hash; a list holds the ids and frequencies of one term in one zone of one shard,
so the list of a term found in a third of all documents is spread over all shards and never longer than a shard.
Lists are stored in folders by a hash of the term and sorted by term: a search reads the folders of
its terms (a partition filter of the scan), drops other terms in the scan's own task, and shuffles only
the lists it needs, by shard.

In its shard a query opens its lists in the order of the most they can add. Once the lists left cannot lift a document
over the ``k``-th best sum so far, no new document is taken up: the rest is looked up for the documents that can still
be among the best. Every posting that is not touched belongs to a document below them, so the result is exact.

Champion lists (the ``r`` highest frequencies of a term in a zone, ties by id) are stored as cuts: the last champion of each
list that is longer than ``r``. A posting is a champion if it does not come after the cut, so no search ranks lists.

``build`` makes the lists straight from texts: a shard's documents meet in one task, which gives whole lists and the documents'
lengths in one pass, so postings are never stored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as tx
from quarry.scale import SCORE_UNIT, blocks_for

SHARD_DOCS = 2048  # documents of a shard
BLOCK_SHARDS = 256  # shards whose lists share a file of a folder
PART_POSTINGS = 4_000_000  # postings of a folder
PART_BYTES = 32 << 20  # text of a folder, where postings are not counted yet
STEP = 4  # lists opened between two looks at the k-th best sum


@dataclass(frozen=True)
class Lists:
    """``lists``: part, term, zone, shard, ids, tfs; ``shards``: shard, zone, ids, lens, norms of all its documents;
    ``cuts``: term, zone, cut_tf, cut_id of lists with more than ``r`` postings, None if they were not made."""

    lists: DataFrame
    shards: DataFrame
    cuts: DataFrame | None
    parts: int
    r: int


def part_of(term: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def write(postings: DataFrame, doc_zone: DataFrame, path: str, r: int, shard_docs: int = SHARD_DOCS, *, tasks: int | None = None) -> Lists:
    """Lists of an index under ``path``: one shuffle of the postings."""
    spark = postings.sparkSession
    size = doc_zone.agg(F.count_distinct("doc_id").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("terms")).first()
    shards, parts = blocks_for(size["docs"], shard_docs), blocks_for(size["terms"], PART_POSTINGS)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select(part_of("term", parts).alias("part"), shard, "term", "zone", "doc_id", "tf").repartition(n, "part", "shard")
    made = dealt.groupBy("part", "shard", "term", "zone").agg(rows.alias("rows")).select(
        "part", "term", "zone", "shard", F.col("rows.doc_id").alias("ids"), F.col("rows.tf").alias("tfs"))
    made.sortWithinPartitions("part", "term", "zone").write.mode(
        "overwrite").partitionBy("part").parquet(f"{path}/lists")
    docs = F.array_sort(F.collect_list(F.struct("doc_id", "len", "norm")))
    of = doc_zone.groupBy(shard, "zone").agg(docs.alias("docs")).select("shard", "zone", F.col("docs.doc_id").alias("ids"), F.col("docs.len").alias("lens"), F.col("docs.norm").alias("norms"))
    of.write.mode("overwrite").parquet(f"{path}/shards")
    stored = spark.read.parquet(f"{path}/lists")
    _write_cuts(stored, path, r)
    spark.createDataFrame([(parts, r)], "parts int, r int").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    return read(spark, path)


def _write_cuts(stored: DataFrame, path: str, r: int) -> None:
    longer = stored.groupBy("term", "zone").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") > r).select("term", "zone")
    first = F.slice(F.array_sort(F.transform(F.arrays_zip("tfs", "ids"), lambda e: F.struct((-e["tfs"]).alias("o"), e["ids"].alias("id")))), 1, r)
    ends = stored.join(longer, ["term", "zone"], "left_semi").select("term", "zone", F.inline(first))
    place = F.row_number().over(Window.partitionBy("term", "zone").orderBy("o", "id"))
    cuts = ends.withColumn("place", place).filter(F.col("place") <= r).filter(F.col("place") == r)
    cuts.select("term", "zone", (-F.col("o")).alias("cut_tf"), F.col("id").alias("cut_id")).write.mode("overwrite").parquet(f"{path}/cuts")


def with_cuts(found: Lists, path: str) -> Lists:
    """Lists that also hold their champion cuts, stored under ``path``."""
    _write_cuts(found.lists, path, found.r)
    return replace(found, cuts=found.lists.sparkSession.read.parquet(f"{path}/cuts"))


def _shard_lists(docs: pa.Table, of_word, names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """Lists of one shard from its documents' tokens, and one row (no term) for each zone with its documents."""
    docs = docs.combine_chunks().sort_by([("zone", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    column = lambda c: docs[c].combine_chunks() if isinstance(docs[c], pa.ChunkedArray) else docs[c]
    doc_ids, zones, tokens = column("doc_id"), column("zone").dictionary_encode(), column("tokens").cast(pa.list_(pa.string()))
    n, zone = docs.num_rows, zones.indices.to_numpy()
    row, term, _, terms = tx.kept_words(tokens, of_word)
    key, tf = np.unique(term * n + row, return_counts=True)
    term, at = np.divmod(key, n)
    size = np.bincount(row, minlength=n)
    order = np.lexsort((tf, at))  # in one order, so that equal documents have equal norms
    norm = np.sqrt(np.bincount(at[order], weights=(1.0 + np.log10(tf[order])) ** 2, minlength=n))
    doc = doc_ids.dictionary_encode().indices.to_numpy()
    new = np.zeros(len(key), np.int64)
    new[np.unique(term * n + doc[at], return_index=True)[1]] = 1  # a document counts once for a term, in its first zone
    cut = lambda *by: np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in by], axis=0)]) if len(by[0]) else np.zeros(0, np.int64)
    starts, tops = cut(term, zone[at]), cut(zone)
    ends = np.r_[starts, len(key)], np.r_[tops, n]
    of = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    none = lambda k, count: pa.nulls(count, k)
    shard = docs["shard"][0].as_py()
    lists = [terms.take(pa.array(term[starts])), zones.dictionary.take(pa.array(zone[at[starts]])), of(ends[0], doc_ids.take(pa.array(at))), of(ends[0], pa.array(tf, pa.int32())),
             none(kinds[5], len(starts)), none(kinds[6], len(starts)), pa.array(np.add.reduceat(new, starts) if len(starts) else new)]
    rows = [none(kinds[0], len(tops)), zones.dictionary.take(pa.array(zone[tops])), of(ends[1], doc_ids), none(kinds[4], len(tops)),
            of(ends[1], pa.array(size, pa.int32())), of(ends[1], pa.array(norm)), none(kinds[7], len(tops))]
    made = []
    for part in (lists, rows):
        part.insert(2, pa.array(np.full(len(part[0]), shard, np.int32)))
        made.append(pa.table([x.cast(k) for x, k in zip(part, kinds)], names=names))
    return pa.concat_tables(made)


def build(zones: DataFrame, path: str, r: int, stemmer: str = "porter", shard_docs: int = SHARD_DOCS) -> Lists:
    """Lists of ``doc_id, zone, text`` rows under ``path`` without champion cuts: one shuffle of the texts, one of the lists. ``lists`` has ``new``
    as well: its documents that no list of the term in an earlier zone holds, so sums of it are document frequencies."""
    spark = zones.sparkSession
    size = zones.agg(F.count_distinct("doc_id").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards, parts = blocks_for(size["docs"], shard_docs), blocks_for(size["bytes"], PART_BYTES)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = zones.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "zone", "text").repartition(n, "shard")
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(zones.schema["doc_id"].dataType)), T.StructField("tfs", T.ArrayType(T.IntegerType())),
                           T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("norms", T.ArrayType(T.DoubleType())), T.StructField("new", T.LongType())])
    names, kinds, of_word = schema.names, [to_arrow_type(f.dataType) for f in schema.fields], tx.word_terms(stemmer)
    made = dealt.select("shard", "doc_id", "zone", tx.tokenize("text").alias("tokens")).groupBy("shard").applyInArrow(lambda t: _shard_lists(t, of_word, names, kinds), schema)
    part = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(part_of("term", parts))
    blocks = blocks_for(shards, BLOCK_SHARDS)
    spread = made.select(part.alias("part"), "*").withColumn("_block", F.pmod("shard", F.lit(blocks))).repartition(max(n, parts * blocks), "part", "_block").drop("_block")
    spread.sortWithinPartitions("part", "term", "zone").write.partitionBy("part").parquet(f"{path}/lists")
    stored = lambda: spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{path}/lists")
    lists = stored().filter("part >= 0").select("part", "term", "zone", "shard", "ids", "tfs", "new")
    return Lists(lists, stored().filter("part = -1").select("shard", "zone", "ids", "lens", "norms"), None, parts, r)


def document_frequencies(found: Lists) -> DataFrame:
    """``term, df`` of lists made by ``build``."""
    return found.lists.groupBy("term").agg(F.sum("new").alias("df"))


def doc_zone(found: Lists) -> DataFrame:
    """``doc_id, zone, len, norm`` of all documents."""
    rows = found.shards.select("zone", F.inline(F.arrays_zip("ids", "lens", "norms")))
    return rows.select(F.col("ids").alias("doc_id"), "zone", F.col("lens").alias("len"), F.col("norms").alias("norm"))


def postings(found: Lists) -> DataFrame:
    """``doc_id, zone, term, tf, zone_len, norm``: the lists as rows, without positions."""
    rows = found.lists.select("zone", "term", F.inline(F.arrays_zip("ids", "tfs")))
    rows = rows.select(F.col("ids").alias("doc_id"), "zone", "term", F.col("tfs").alias("tf"))
    return rows.join(doc_zone(found).withColumnRenamed("len", "zone_len"), ["doc_id", "zone"])


def read(spark: SparkSession, path: str) -> Lists:
    of = lambda name: spark.read.parquet(f"{path}/{name}")
    shape = of("shape").first()
    return Lists(of("lists"), of("shards"), of("cuts"), shape["parts"], shape["r"])


def champions(found: Lists) -> DataFrame:
    """zone, term, doc_id, tf of the champion postings: the stored cuts, no ranking."""
    rows = found.lists.join(found.cuts, ["term", "zone"], "left").select("term", "zone", "cut_tf", "cut_id", F.explode(F.arrays_zip("ids", "tfs")).alias("e"))
    rows = rows.select("zone", "term", F.col("e.ids").alias("doc_id"), F.col("e.tfs").alias("tf"), "cut_tf", "cut_id")
    within = F.col("cut_tf").isNull() | (F.col("tf") > F.col("cut_tf")) | ((F.col("tf") == F.col("cut_tf")) & (F.col("doc_id") <= F.col("cut_id")))
    return rows.filter(within).select("zone", "term", "doc_id", "tf")


def best_sums(order: list[tuple[float, np.ndarray, np.ndarray]], n: int, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (places below ``n``) with the ``k`` highest sums and ties, their sums, and how many postings were touched.

    ``order``: (most, places, values) of each list, the largest ``most`` first; values are positive integers.
    """
    sums = np.zeros(n, np.int64)
    left = np.cumsum([m for m, _, _ in order][::-1])[::-1] if order else np.zeros(0)
    touched, taken = 0, None
    for i, (_, places, values) in enumerate(order):
        if taken is None and i and i % STEP == 0 and n > k:
            shown = sums if allowed is None else np.where(allowed, sums, 0)
            floor = np.partition(shown, n - k)[n - k]
            if floor > left[i]:
                taken = np.flatnonzero(shown + left[i] >= floor)
        if taken is None:
            sums[places] += values
            touched += len(places)
        else:
            at = np.minimum(np.searchsorted(places, taken), len(places) - 1)
            hit = places[at] == taken
            sums[taken[hit]] += values[at[hit]]
            touched += int(hit.sum())
    if taken is not None:
        keep = np.zeros(n, bool)
        keep[taken] = True
        sums = np.where(keep, sums, 0)
    if allowed is not None:
        sums = np.where(allowed, sums, 0)
    found = np.flatnonzero(sums > 0)
    if len(found) > k:
        floor = np.partition(sums[found], len(found) - k)[len(found) - k]
        found = found[sums[found] >= floor]
    return found, sums[found], touched


def _scorer(queries: dict[object, list[tuple]], scheme: str, weights: dict[str, float], avg: dict[str, float], k: int, k1: float, b: float, use_champions: bool, kinds: list[pa.DataType]):
    """Best documents of each query in one shard, from its lists and its documents."""

    def of(lists: pa.Table, docs: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score", "touched"]
        if not lists.num_rows or not docs.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        zones = {z: i for i, z in enumerate(docs["zone"].to_pylist())}
        ids = docs["ids"].combine_chunks()
        ids = ids[0].values if len(ids) else ids.values
        n = len(ids)
        held = lists.combine_chunks()
        column = lambda c: held[c].combine_chunks() if isinstance(held[c], pa.ChunkedArray) else held[c]
        flat = pc.index_in(column("ids").flatten(), value_set=ids).to_numpy()
        tf = column("tfs").flatten().to_numpy().astype(np.float64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column("ids")).to_numpy())])
        zone = column("zone").to_pylist()
        of_list = np.repeat(np.arange(len(zone)), np.diff(ends))
        code = np.array([zones[z] for z in zone])
        lens = np.stack([np.asarray(x.values.to_numpy(), np.float64) for x in docs["lens"].combine_chunks()])
        norms = np.stack([x.values.to_numpy() for x in docs["norms"].combine_chunks()])
        if scheme == "bm25":
            mean = np.array([avg.get(z) or 0.0 for z in zone])[of_list]
            ratio = np.divide(lens[code[of_list], flat], mean, out=np.zeros(len(flat)), where=mean > 0)
            part = np.where(mean > 0, ((k1 + 1.0) * tf) / (k1 * ((1.0 - b) + b * ratio) + tf), 0.0)
            top = ((k1 + 1.0) * tf), (k1 * ((1.0 - b) + b * ratio) + tf)
        else:
            norm = norms[code[of_list], flat]
            part = np.divide(1.0 + np.log10(tf), norm, out=np.zeros(len(flat)), where=norm > 0)
        most = np.maximum.reduceat(part, ends[:-1])
        where: dict[str, list[int]] = {}
        for i, term in enumerate(column("term").to_pylist()):
            where.setdefault(term, []).append(i)
        if use_champions:
            cut_tf = column("cut_tf").to_numpy(zero_copy_only=False).astype(np.float64)[of_list]
            cut = pc.take(column("cut_id"), pa.array(of_list))
            before = pc.fill_null(pc.less_equal(column("ids").flatten(), cut), True).to_numpy(zero_copy_only=False)
            champion = np.isnan(cut_tf) | (tf > cut_tf) | ((tf == cut_tf) & before)
        out: list[tuple] = []
        for query, terms in queries.items():
            order = []
            allowed = np.zeros(n, bool) if use_champions else None
            for lookup, idf, qweight in terms:
                for i in where.get(lookup, ()):
                    weight = weights.get(zone[i], 0.0)
                    if not weight:
                        continue
                    s = slice(ends[i], ends[i + 1])
                    if scheme == "bm25":
                        values = weight * np.divide(idf * top[0][s], top[1][s], out=np.zeros(s.stop - s.start), where=part[s] > 0)
                    else:
                        values = weight * (qweight * part[s])
                    values = np.floor(values * SCORE_UNIT + 0.5).astype(np.int64)
                    if allowed is not None:
                        allowed[flat[s][champion[s]]] = True
                    order.append((float(values.max()), flat[s], values))
            order.sort(key=lambda x: -x[0])
            found, sums, touched = best_sums(order, n, k, allowed)
            if len(found) > k:  # ids ascend within a shard
                found, sums = (x[np.lexsort((found, -sums))[:k]] for x in (found, sums))
            out.append((query, found, sums, touched))
        counts = [len(f) for _, f, _, _ in out]
        places = np.concatenate([f for _, f, _, _ in out]) if out else np.zeros(0, np.int64)
        sums = np.concatenate([s for _, _, s, _ in out]) if out else np.zeros(0, np.int64)
        touched = np.repeat([t for *_, t in out], counts) if out else np.zeros(0, np.int64)
        asked = pa.array([q for q, *_ in out], kinds[0]).take(pa.array(np.repeat(np.arange(len(out)), counts)))
        return pa.table([asked, ids.take(pa.array(places)), pa.array(sums / SCORE_UNIT), pa.array(touched.astype(np.int64))], names=names)

    return of


def search(found: Lists, wanted: DataFrame, k: int, scheme: str, weights: dict[str, float] | None, zone_stats: DataFrame, k1: float, b: float, use_champions: bool = False) -> DataFrame:
    """query_id, doc_id, score, touched of the best ``k`` documents of each query in each shard.

    ``wanted``: query_id, lookup, idf, qweight of a query table that is proven small.
    """
    spark = wanted.sparkSession
    rows = wanted.select("query_id", "lookup", "idf", "qweight").collect()
    queries: dict[object, list[tuple]] = {}
    for r in rows:
        if scheme == "bm25" or r["qweight"] is not None:
            queries.setdefault(r["query_id"], []).append((r["lookup"], r["idf"], r["qweight"]))
    avg = {r["zone"]: r["avg_len"] for r in zone_stats.select("zone", "avg_len").collect()}
    active = {z: 1.0 for z in avg} if weights is None else {z: float(w) for z, w in weights.items() if w and z in avg}
    terms = wanted.select(F.col("lookup").alias("term"), part_of("lookup", found.parts).alias("part")).distinct()
    lists = found.lists.filter(F.col("zone").isin(list(active))).join(F.broadcast(terms), ["part", "term"]).select("shard", "term", "zone", "ids", "tfs")
    if use_champions:
        cuts = found.cuts.join(F.broadcast(terms.select("term")), "term", "left_semi")  # one for each term of the queries and zone
        lists = lists.join(F.broadcast(cuts), ["term", "zone"], "left")
    schema = T.StructType([T.StructField("query_id", wanted.schema["query_id"].dataType), T.StructField("doc_id", found.lists.schema["ids"].dataType.elementType),
                           T.StructField("score", T.DoubleType()), T.StructField("touched", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    of = _scorer(queries, scheme, active, avg, k, k1, b, use_champions, kinds)
    shape = pa.schema([pa.field(f.name, kind) for f, kind in zip(schema.fields, kinds)])
    return lists.groupBy("shard").cogroup(found.shards.groupBy("shard")).applyInArrow(lambda a, d: of(a, d).cast(shape), schema)
