"""Ranked search over a K2-treap of each shard's term-document grid.

A shard is a range of documents. Its grid has a row for each of its terms (frequent ones first) and a column
for each document; a cell holds the impact of the term in the document. The grid is halved by rows while it is taller
than wide and then quartered; a node keeps which of its parts hold anything (a mask of four bits; where its
children are follows from the rank of that mask) and how far its largest impact lies below that of its parent.

The terms of an item are paths from the root of their rows. All paths of an item descend together: a range of
documents is bounded by the sum of the largest impacts of the nodes that its paths have reached, times the
weights of the terms. Ranges with the highest bounds are halved first, ``TOGETHER`` at a time, until a single
document is left, whose bound is its score. Ranges below the ``k``-th best score that the task knows are dropped.

Impacts need the number and the mean length of documents, which are counted first; weights need the document
frequency of the terms of the items, which are summed over the shards before the search. Items are taken in blocks
of about ``BLOCK`` terms, so what is sent to the tasks is bounded.

Results for special cases: null and empty texts have no terms and are never found; items without a known term
give no rows; rows of one item_id are one item (equal rows count once, further texts are added); repeated documents
are documents of their own; equal scores rank by id, null ids last; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scale import hold, release, top_k

K = 20
POSTINGS, DOCUMENTS = 1_000_000, 1 << 13  # of a shard; it may exceed the first by one document
BLOCK = 100_000  # terms of items searched together
TOGETHER = 512  # ranges halved at a time
#: Fixed values of the score.
SCALE, TF, SATURATION, WHOLE, LENGTH, WEIGHT = 1_000_000_000, 1000, 12, 100, 25, 1000
OTHER = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER = bytes(range(0x41, 0x5B))
FOLD = bytes.maketrans(OTHER + UPPER, b" " * len(OTHER) + UPPER.lower())
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ONES = np.array([bin(m).count("1") for m in range(16)], np.int64)

SHARDS = "ids array<bigint>, words binary, frequencies binary, row_bits int, column_bits int, masks binary, drops binary"


def folded(text: str) -> Column:
    """The text with A-Z (and no other letters) in lower case."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER.decode(), UPPER.lower().decode())


def _counts(df: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, terms of all documents."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TERM))
    row = df.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    length = WHOLE - LENGTH + LENGTH * n.astype(np.int64) * docs // terms
    return SCALE * tf.astype(np.int64) // (TF * tf + SATURATION * length)


class Grid:
    """A K2-treap. Nodes are numbered level by level from the root, 0; ``start`` is the first child of a node."""

    def __init__(self, row_bits: int, column_bits: int, masks: np.ndarray, drops: np.ndarray):
        self.row_bits, self.column_bits, self.masks, self.drops = row_bits, column_bits, masks, drops

    @classmethod
    def built(cls, row: np.ndarray, column: np.ndarray, impact: np.ndarray) -> Grid:
        cb = max(1, int(column.max()).bit_length())
        rb = max(cb, int(row.max()).bit_length())
        code = row.astype(np.int64) >> cb
        for b in range(cb - 1, -1, -1):
            code = code << 2 | (row >> b & 1) << 1 | (column >> b & 1)
        order = np.argsort(code)
        code, high = code[order], impact[order].astype(np.int64)
        levels = [(code, high)]
        masks: list[np.ndarray] = []
        drops: list[np.ndarray] = []
        for depth in range(rb - 1, -1, -1):  # of the parents
            bits = 1 if depth < rb - cb else 2
            parent = code >> bits
            edge = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            top = np.maximum.reduceat(high, edge)
            masks.append(np.add.reduceat(np.int64(1) << (code & ((1 << bits) - 1)), edge).astype(np.uint8))
            drops.append((np.repeat(top, np.diff(np.r_[edge, len(code)])) - high).astype(np.int32))
            code, high = parent[edge], top
            levels.append((code, high))
        drops.append(-high.astype(np.int32))  # the root lies below nothing
        return cls(rb, cb, np.concatenate(masks[::-1]), np.concatenate(drops[::-1]))

    def opened(self) -> Grid:
        """With ``start`` and the largest impact ``high`` of each node."""
        sizes = ONES[self.masks]
        self.start = 1 + np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.high = -self.drops.astype(np.int64)
        begin, end = 0, 1
        for _ in range(self.row_bits):
            children = slice(end, end + int(sizes[begin:end].sum()))
            self.high[children] += np.repeat(self.high[begin:end], sizes[begin:end])
            begin, end = end, children.stop
        return self

    def child(self, node: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The child of each node in a part, and whether it is there."""
        mask = self.masks[node].astype(np.int64)
        return self.start[node] + ONES[mask & ((1 << part) - 1)], (mask >> part & 1).astype(bool)

    def best(self, row: np.ndarray, weight: np.ndarray, k: int, least: float = 0) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of (at least) the ``k`` best documents of a weighted set of rows, all that tie with the
        last, none under ``least``."""
        node = np.zeros(len(row), np.int64)
        for depth in range(self.row_bits - self.column_bits):
            node, there = self.child(node, row >> (self.row_bits - 1 - depth) & 1)
        found_c: list[np.ndarray] = []
        found_s: list[np.ndarray] = []
        top: list[float] = []  # a heap of the k best scores
        bound = (weight * self.high[node]).sum()
        count = 0
        queue = [(-bound, count, 0, np.zeros(1, np.int64), np.array([bound], float), np.array([0, len(row)]), node, np.arange(len(row)))]
        while queue:
            worst, _, level, column, bounds, ends, node, slot = heapq.heappop(queue)
            floor = max(least, top[0] if len(top) == k else 0)
            if -worst < floor:
                break
            order = np.argsort(-bounds, kind="stable")
            order = order[bounds[order] >= floor]
            if len(order) > TOGETHER:
                late = order[TOGETHER:]
                n, s, e = _taken(late, ends, node, slot)
                count += 1
                heapq.heappush(queue, (-bounds[late[0]], count, level, column[late], bounds[late], e, n, s))
                order = order[:TOGETHER]
            node, slot, ends = _taken(order, ends, node, slot)
            column = column[order]
            of = np.repeat(np.arange(len(order)), np.diff(ends))
            side = (row[slot] >> (self.column_bits - 1 - level) & 1) * 2
            kids, where, slots = [], [], []
            for half in (0, 1):
                kid, there = self.child(node, side + half)
                kids.append(kid[there])
                where.append(2 * of[there] + half)
                slots.append(slot[there])
            where = np.concatenate(where)
            order = np.argsort(where, kind="stable")
            where, kid, slot = where[order], np.concatenate(kids)[order], np.concatenate(slots)[order]
            halves, sizes = np.unique(where, return_counts=True)
            bounds = np.bincount(where, weight[slot] * self.high[kid], 2 * len(column) + 1)[halves]
            column = column[halves >> 1] * 2 + (halves & 1)
            if level + 1 == self.column_bits:
                good = bounds >= max(floor, 1)
                found_c.append(column[good])
                found_s.append(bounds[good])
                for s in np.sort(bounds[good])[::-1][:k]:
                    if len(top) < k:
                        heapq.heappush(top, s)
                    elif s > top[0]:
                        heapq.heapreplace(top, s)
            elif len(halves):
                count += 1
                heapq.heappush(queue, (-bounds.max(), count, level + 1, column, bounds, np.concatenate([[0], np.cumsum(sizes)]), kid, slot))
        columns = np.concatenate(found_c) if found_c else np.zeros(0, np.int64)
        scores = np.concatenate(found_s) if found_s else np.zeros(0)
        good = scores >= max(least, top[0] if len(top) == k else 0)
        return columns[good], scores[good].astype(np.int64)


def _taken(ranges: np.ndarray, ends: np.ndarray, node: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths of some ranges."""
    sizes = ends[ranges + 1] - ends[ranges]
    new = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(new[-1]) + np.repeat(ends[ranges] - new[:-1], sizes)
    return node[at], slot[at], new


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _shards(docs: int, terms: int, postings: int, documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        numbers, rows, counts, sizes, ids = _Terms(), [], [], [], []
        held = 0

        def shard() -> pa.RecordBatch:
            row, tf = np.concatenate(rows), np.concatenate(counts)
            distinct = np.array([len(r) for r in rows])
            column = np.repeat(np.arange(len(rows)), distinct)
            df = np.bincount(row, minlength=len(numbers))
            order = np.argsort(-df, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            grid = Grid.built(place[row], column, impacts(tf, np.repeat(np.array(sizes), distinct), docs, terms))
            words = list(numbers)
            made = [ids], [pack(b" ".join(words[i] for i in order))], [pack(df[order].astype(np.int32).tobytes())], [grid.row_bits], [grid.column_bits], [pack(grid.masks.tobytes())], [pack(grid.drops.tobytes())]
            kinds = (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds)], names=["ids", "words", "frequencies", "row_bits", "column_bits", "masks", "drops"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = (text.as_py() or b"").translate(FOLD).split()
                if not parts:
                    continue
                found, tf = np.unique(np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts)), return_counts=True)
                rows.append(found)
                counts.append(tf)
                sizes.append(len(parts))
                ids.append(i)
                held += len(found)
                if held >= postings or len(ids) >= documents:
                    yield shard()
                    numbers, rows, counts, sizes, ids = _Terms(), [], [], [], []
                    held = 0
        if ids:
            yield shard()

    return run


def index(df: DataFrame, id_col: str = "doc_id", text: str = "text", postings: int = POSTINGS, documents: int = DOCUMENTS) -> tuple[DataFrame, int]:
    """The shards (SHARDS) of a table of documents, stored, and its number of documents with a term."""
    docs, terms = _counts(df, text)
    made = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(_shards(docs, terms, postings, documents), SHARDS)
    return hold(made), docs


def _frequencies(wanted: frozenset[bytes]):
    """word, df of the wanted terms in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for words, df in zip(batch.column(0), batch.column(1)):
                found = [(w, n) for w, n in zip(unpack(words.as_py()).split(b" "), np.frombuffer(unpack(df.as_py()), np.int32)) if w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["word", "df"])

    return run


def _searched(items: list[tuple[object, list[bytes], np.ndarray]], k: int):
    """item (its number in ``items``), id, score of the best documents of each shard."""
    wanted = {w for _, words, _ in items for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        known: list[list[float]] = [[] for _ in items]  # best scores of this task so far
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, rb, cb, masks, drops = (batch.column(c)[i] for c in range(6))
                ids, place = ids.values, {w: r for r, w in enumerate(unpack(words.as_py()).split(b" ")) if w in wanted}
                grid = Grid(rb.as_py(), cb.as_py(), np.frombuffer(unpack(masks.as_py()), np.uint8), np.frombuffer(unpack(drops.as_py()), np.int32)).opened()
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for number, (_, terms, weights) in enumerate(items):
                    here = [(place[w], x) for w, x in zip(terms, weights) if w in place and x > 0]
                    if not here:
                        continue
                    row, weight = (np.array(x, np.int64) for x in zip(*here))
                    top = known[number]
                    column, score = grid.best(row, weight, k, top[0] if len(top) == k else 1)
                    if len(column) > k:  # of those that tie with the last, the smallest ids
                        at = pc.fill_null(ids.take(pa.array(column)), (1 << 63) - 1).to_numpy(zero_copy_only=False)
                        first = np.lexsort((at, -score))[:k]
                        column, score = column[first], score[first]
                    for s in score:
                        if len(top) < k:
                            heapq.heappush(top, s)
                        elif s > top[0]:
                            heapq.heapreplace(top, s)
                    out.append((np.full(len(column), number), column, score))
                if out:
                    number, column, score = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), ids.take(pa.array(column)), pa.array(score)], names=["item", "id", "score"])

    return run


def search(shards: DataFrame, docs: int, items: DataFrame, k: int = K, item_col: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_col``, rank, doc_id, score: the ``k`` best documents of each item in an ``index``."""
    spark = items.sparkSession
    given = items.select(item_col, text).distinct().select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0))).alias("word"))
    asked = hold(given.groupBy("item", "word").agg(F.count("*").alias("often")))
    blocks = max(1, -(-asked.count() // block))
    kind = items.schema[item_col].dataType.simpleString()
    schema = f"item {kind}, rank int, id bigint, score bigint"
    out = []
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = mine.select("item", F.col("word").cast("binary").alias("word"), "often").collect()
        words = frozenset(bytes(r["word"]) for r in rows)
        df = {bytes(r["word"]): r["df"] for r in shards.select("words", "frequencies").mapInArrow(_frequencies(words), "word binary, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect()}
        weight = {w: math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * n + 1))) for w, n in df.items()}
        by_item: dict[object, list[tuple[bytes, int]]] = {}
        for r in rows:
            if (w := bytes(r["word"])) in weight:
                by_item.setdefault(r["item"], []).append((w, weight[w] * r["often"]))
        listed = [(i, [w for w, _ in terms], np.array([x for _, x in terms])) for i, terms in by_item.items()]
        hits = shards.select("ids", "words", "row_bits", "column_bits", "masks", "drops").mapInArrow(_searched(listed, k), "item int, id bigint, score bigint")
        best = hold(top_k(hits, ["item"], [F.desc("score"), F.asc_nulls_last("id")], k))
        names = spark.createDataFrame([(n, i) for n, (i, _, _) in enumerate(listed)], f"item int, name {kind}")
        out.append(best.join(F.broadcast(names), "item").select(F.col("name").alias("item"), F.col("rank").cast("int").alias("rank"), "id", "score"))
    release(asked)
    found = spark.createDataFrame([], schema)
    for part in out:
        found = part if part is out[0] else found.unionAll(part)
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias("doc_id"), "score")
