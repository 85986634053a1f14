"""Collocated phrases from one FM-index of word ids per shard of texts.

Texts are read into shards of about ``SHARD`` words of one language, inside the task that scans them. A
shard holds the Burrows-Wheeler transform of its words, its rows in the order of the first ``DEPTH`` words
(phrases are no longer, so no deeper order is needed), and its dictionary; pieces end with a separator
that no phrase crosses. The interval of a word in this order comes from the counts of the transform; a left
extension groups the rows of an interval by the transform, which gives the intervals one word
deeper; a right extension is found by the interval of the first words. Counts of all shards are summed.

Longer phrases hold only frequent shorter ones, so the lengths are counted one after the other: sums of
words, then of pairs of frequent words, then of triples of two frequent pairs. Each shard gets back the
numbers of its own frequent words and pairs: all tasks get the whole tables while these are proven small
(``LOOKUP_ROWS``, ``LOOKUP_BYTES``), beyond that each shard is joined with its own rows of them.

Results for special cases: null text has no words; null language is ``und``; repeated rows count each time;
an empty table gives no rows; a text is never split, so a shard may exceed ``SHARD`` by one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.scale import hold, is_small, release

SHARD = 1_000_000  # words; below 2**21, so that three word numbers fit one integer
DEPTH = 3
FREQUENT, KEEP, INSIDE = 10, 2000, 50  # least count; phrases of a language; percentage that drops a part
MILLION = 1_000_000
LOOKUP_ROWS, LOOKUP_BYTES = 2_000_000, 64 << 20  # of a broadcast lookup
UPPER = bytes(range(65, 91))
#: Piece ends become line feeds, tabs spaces, A-Z a-z.
FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + UPPER, b"\n" * 10 + b" " + UPPER.lower())
SEPARATOR = 0

SHARDS = "shard bigint, lang string, n bigint, words binary, bwt binary"


class Numbers(dict):
    """Words numbered in order of appearance; 0 is the separator."""

    def __init__(self):
        super().__init__({b"\n": SEPARATOR, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def word_numbers(raw: bytes, numbers: Numbers) -> np.ndarray:
    """The words of a text, each piece followed by a separator."""
    parts = raw.translate(FOLD).replace(b"\n", b" \n ").split(b" ")
    found = np.fromiter(map(numbers.__getitem__, parts), np.int32, len(parts))
    found = found[found >= 0]
    return np.append(found, np.int32(SEPARATOR)) if len(found) else found


def transform(text: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a circular text, rows ordered by their first ``DEPTH`` symbols and then by place."""
    if len(text) and int(text.max()) < 1 << 21:
        key = text.astype(np.int64)
        for d in range(1, DEPTH):
            key <<= 21
            key |= np.roll(text, -d)
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort([np.roll(text, -d) for d in range(DEPTH - 1, -1, -1)])
    return text[order - 1]


class Index:
    """Intervals of the phrases of a shard; a phrase of ``d`` words is a number below the count of its length."""

    def __init__(self, bwt: np.ndarray, size: int):
        self.bwt, self.size = bwt, size
        self.counts = np.bincount(bwt, minlength=size)

    def extended(self, inner: np.ndarray, width: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left extensions of the phrases ``inner`` (one for each row, below ``width``), over rows ``keep``: word before,
        phrase, count; in the order of the rows one word deeper."""
        keys = self.bwt[keep].astype(np.int64)
        keys *= width
        keys += inner[keep]
        keys, counts = np.unique(keys, return_counts=True)
        return keys // width, keys % width, counts

    def words(self) -> np.ndarray:
        """The first word of each row."""
        return np.repeat(np.arange(self.size, dtype=np.int32), self.counts)

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, second word and count of each pair of words that are both ``frequent`` (by number)."""
        after = self.words()
        return self.extended(after, self.size, frequent[self.bwt] & frequent[after])

    def triples(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First pair, second pair (places in ``keys``) and count of each triple of two pairs among ``keys``,
        sorted numbers ``first * size + second``."""
        first, second, counts = self.extended(self.words(), self.size, np.ones(len(self.bwt), bool))
        intervals = first * self.size + second
        place, known = _places(keys, intervals)
        inner = np.repeat(place.astype(np.int32), counts)  # rows of one interval lie together
        keep = np.repeat(known, counts)
        before, pair, counts = self.extended(inner, max(1, len(keys)), keep)
        ahead, known = _places(keys, before * self.size + keys[pair] // self.size)  # the right extension of (before, first)
        return ahead[known], pair[known], counts[known]


def _places(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        task, made = TaskContext.get().partitionId(), 0
        open_: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def shard(lang: str) -> pa.RecordBatch:
            nonlocal made
            numbers, parts = open_.pop(lang)
            del sizes[lang]
            text = np.concatenate(parts)
            words = [w for w, k in numbers.items() if k > 0]
            row = [(task << 32) + made], [lang], [int((text != SEPARATOR).sum())], [pack(b" ".join(words))], [pack(transform(text).tobytes())]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "lang", "n", "words", "bwt"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers, parts = open_.setdefault(lang, (Numbers(), []))
                found = word_numbers(text.as_py() or b"", numbers)
                if len(found):
                    parts.append(found)
                    sizes[lang] = sizes.get(lang, 0) + len(found)
                if sizes.get(lang, 0) >= limit:
                    yield shard(lang)
                elif sum(sizes.values()) >= 1.5 * limit:  # many languages: the largest is closed first
                    yield shard(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield shard(lang)

    return run


def index(df: DataFrame, text: str = "text", lang: str = "lang", shard: int = SHARD) -> DataFrame:
    """The shards (SHARDS) of a table of texts, stored."""
    of = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return hold(df.select(of.alias("lang"), F.col(text).cast("binary").alias("t")).mapInArrow(_shards(shard), SHARDS))


def _opened(batch: pa.RecordBatch, i: int) -> tuple[list[bytes], Index]:
    unpack = zstandard.ZstdDecompressor().decompress
    words = unpack(batch.column("words")[i].as_py()).split(b" ")
    bwt = np.frombuffer(unpack(batch.column("bwt")[i].as_py()), np.int32)
    return words, Index(bwt, len(words) + 1)


def _rows(columns: dict[str, np.ndarray | list], step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    made = pa.table(columns)
    yield from made.to_batches(max_chunksize=step)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words, found = _opened(batch, i)
            n = len(words)
            yield from _rows({"shard": np.full(n, batch.column("shard")[i].as_py()), "lang": pa.array([batch.column("lang")[i].as_py()] * n), "word": pa.array(words, pa.binary()), "number": np.arange(1, n + 1), "c": found.counts[1:]})


def _listed(column: pa.ListArray, i: int) -> list[np.ndarray]:
    values = column[i].values
    return [values.field(k).to_numpy(zero_copy_only=False) for k in range(values.type.num_fields)]


class Known:
    """Frequent words and pairs of all shards, sent to every task while they are proven small."""

    def __init__(self, words: DataFrame):
        held = words.select("lang", "word", "id").toArrow()
        self.ids = {lang: (rows["word"], rows["id"].to_numpy()) for lang in pc.unique(held["lang"]).to_pylist() for rows in [held.filter(pc.equal(held["lang"], lang))]}
        self.size = held.num_rows
        self.pairs = np.zeros(0, np.int64)

    def with_pairs(self, pairs: DataFrame) -> Known:
        held = pairs.select("first", "second").toArrow()
        self.pairs = np.sort(held["first"].to_numpy() * self.size + held["second"].to_numpy())
        return self

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The number in all shards of each local word, -1 of others, the separator first."""
        known, ids = self.ids.get(lang, (pa.array([], pa.binary()), np.zeros(0, np.int64)))
        at = pc.fill_null(pc.index_in(pa.array(words, pa.binary()), value_set=known), -1).to_numpy()
        return np.append(-1, np.where(at >= 0, ids[at] if len(ids) else -1, -1))

    def keys(self, of: np.ndarray, found: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, second, _ = found.pairs(of >= 0)
        _, frequent = _places(self.pairs, of[first] * self.size + of[second])
        first, second = first[frequent], second[frequent]
        return first * found.size + second, of[first], of[second]


def _pairs(known=None):
    """shard, key (local), first, second (numbers in all shards) and count of each pair of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, found = _opened(batch, i)
                if known is None:
                    of = np.full(found.size, -1, np.int64)
                    number, ids = _listed(batch.column("frequent"), i)
                    of[number] = ids
                else:
                    of = known.value.numbers(batch.column("lang")[i].as_py(), words)
                first, second, c = found.pairs(of >= 0)
                yield from _rows({"shard": np.full(len(c), batch.column("shard")[i].as_py()), "key": first * found.size + second, "first": of[first], "second": of[second], "c": c})

    return run


def _triples(known=None):
    """Numbers of the words and count of each triple of two frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, found = _opened(batch, i)
                if known is None:
                    key, first, second = _listed(batch.column("frequent"), i)
                else:
                    key, first, second = known.value.keys(known.value.numbers(batch.column("lang")[i].as_py(), words), found)
                order = np.argsort(key)
                key, first, second = key[order], first[order], second[order]
                head, tail, c = found.triples(key)
                yield from _rows({"first": first[head], "second": second[head], "third": second[tail], "c": c})

    return run


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` stored with ``id``, its rows numbered without a gap."""
    rows = hold(df.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each partition
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    made = hold(rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("id", F.col("start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "_row"))
    release(rows)
    return made


def _sent_back(shards: DataFrame, lists: DataFrame, *columns: str) -> DataFrame:
    """The shards with the list ``frequent`` of their own rows of ``lists``; a list is no longer than its shard."""
    lists = lists.groupBy("shard").agg(F.collect_list(F.struct(*columns)).alias("frequent"))
    return shards.join(lists, "shard")


def counted(df: DataFrame, text: str = "text", lang: str = "lang", least: int = FREQUENT, shard: int = SHARD, lookup_rows: int = LOOKUP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of each language (lang, n), pairs and triples of words that occur ``least`` times or more, stored.

    Pairs: lang, words (array), a, l, r, and the numbers of their words (first, second). Triples: lang, words, a, the
    numbers of their words (first, second, third), and l1, r1, l2, r2 of the cuts after the first and the second word.
    """
    shards = index(df, text, lang, shard)
    context = shards.sparkSession.sparkContext
    totals = hold(shards.groupBy("lang").agg(F.sum("n").alias("n")))
    words = shards.mapInArrow(_words, "shard bigint, lang string, word binary, number bigint, c bigint")
    known = _numbered(words.groupBy("lang", "word").agg(F.sum("c").alias("f")).filter(F.col("f") >= least))
    small = is_small(known, lookup_rows, LOOKUP_BYTES)
    of_pairs = "shard bigint, key bigint, first bigint, second bigint, c bigint"
    if small:
        sent = Known(known)
        local = shards.mapInArrow(_pairs(context.broadcast(sent)), of_pairs)
    else:
        back = words.select("shard", "lang", "word", "number").join(known.select("lang", "word", "id"), ["lang", "word"])
        local = hold(_sent_back(shards, back, "number", "id").mapInArrow(_pairs(), of_pairs))
    often = hold(local.groupBy("first", "second").agg(F.sum("c").alias("a")).filter(F.col("a") >= least))
    of_triples = "first bigint, second bigint, third bigint, c bigint"
    if small and is_small(often, lookup_rows, LOOKUP_BYTES):
        triples = shards.mapInArrow(_triples(context.broadcast(sent.with_pairs(often))), of_triples)
    else:
        back = local.select("shard", "key", "first", "second").join(often.select("first", "second"), ["first", "second"])
        triples = _sent_back(shards, back, "key", "first", "second").mapInArrow(_triples(), of_triples)
    thrice = hold(triples.groupBy("first", "second", "third").agg(F.sum("c").alias("a")).filter(F.col("a") >= least))
    one = known.select(F.col("id").alias("first"), "lang", F.col("word").alias("w1"), F.col("f").alias("l"))
    two = known.select(F.col("id").alias("second"), F.col("word").alias("w2"), F.col("f").alias("r"))
    named = hold(often.join(one, "first").join(two, "second").select("lang", F.array("w1", "w2").alias("words"), "a", "l", "r", "first", "second"))
    head = named.select("first", "second", "lang", F.col("words").alias("h"), F.col("l").alias("l1"), F.col("a").alias("l2"))
    tail = named.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("words").alias("t"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    long = hold(thrice.join(head, ["first", "second"]).join(tail, ["second", "third"]).select("lang", F.concat("h", F.slice("t", 2, 1)).alias("words"), "a", "first", "second", "third", "l1", "r1", "l2", "r2"))
    release(shards, known, often, thrice, *([] if small else [local]))
    return totals, named, long


def _score(a: str, left: str, right: str) -> Column:
    """floor(1 000 000 * a * a / (left * right)), exact up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"cast({wide(a)} * {wide(a)} * {MILLION} as decimal(38,0)) div ({wide(left)} * {wide(right)})").cast("bigint")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = FREQUENT, keep: int = KEEP, inside: int = INSIDE, shard: int = SHARD, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``keep`` best phrases of two or three words of each language.

    The score of a phrase is that of its lowest cut (ties: the first). A pair is left out if a triple around
    it occurs in at least ``inside`` percent of its places.
    """
    totals, pairs, triples = counted(df, text, lang, least, shard, lookup_rows)
    around = triples.select("first", "second", "a").unionAll(triples.select("second", "third", "a"))
    most = around.groupBy("first", "second").agg(F.max("a").alias("most"))
    free = pairs.join(most, ["first", "second"], "left").filter(F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < inside * F.col("a").cast("decimal(20,0)")))
    columns = ["lang", "words", "a", "l", "r", "score"]
    short = free.withColumn("score", _score("a", "l", "r")).select(columns)
    cuts = triples.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    long = cuts.select("lang", "words", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    phrase = F.array_join(F.transform("words", lambda w: w.cast("string")), " ")
    found = short.unionAll(long).withColumn("phrase", phrase)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    return ranked.join(F.broadcast(totals) if is_small(totals) else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
