"""Repeated word windows by relative Lempel-Ziv factors against indexed reference blocks.

A window is ``LENGTH`` words in a row; a word is repeated if one of its windows also starts anywhere else. Parsing
every document against every block of the corpus would grow with its square, so blocks are made by content: each
window chooses its smallest hashed ``GRAM``-word anchor, equal windows choose equal anchors, and all pieces (an anchor
with the windows through it) of one anchor go to one block. A document meets every block that can hold one
of its windows, and no other.

1. Anchors are counted. Those found once are left. Pieces that equal another one of their anchor as a whole
   (hashes of 128 bits) are repeated throughout; one of each kind and all that have no equal go on.
2. A block is some ``BLOCK`` pieces; pieces of one document that overlap are one segment, so a place is in it once.
   Its index is the suffix order of its words with the common prefixes of neighbours.
   Each segment is parsed greedily: the factor at a word is the longest string there that the block also holds
   elsewhere. Factors of ``LENGTH`` words or more are repeated spans. A shorter repeat crosses one factor boundary
   at most, as the factor at the boundary reaches its end; so at each boundary between two factors that
   have ``LENGTH`` words together, the windows across are looked up in the index.
3. Anchors with more than ``HOT`` places are not gathered: the kinds of their pieces are counted by partial
   sums, and the windows of the remaining pieces are grouped by digest (128 bits), a row for each.
4. The spans of each document are joined, and its words outside them kept.

Results for special cases: null and empty texts have no words; texts under ``LENGTH`` words keep all; repeated rows
are places of their own; rows without id are told apart by their text; an empty table gives no rows. Memory: the
words of one document, or one block, at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.repeats import mixed, powers, sliding
from quarry.scale import hold, lookup_join, release

LENGTH, GRAM = 35, 8
SIDE = LENGTH - GRAM  # words of a piece on each side of its anchor
PART = 1 << 20  # windows of a text hashed at a time
CACHED = 1 << 20  # words with their hashes kept by a task
BLOCK, HOT = 20_000, 20_000  # pieces of a block; places of an anchor that is split
NO_ID = -(1 << 63)
STEPS = (32, 16, 8, 4, 2, 1)  # their sum is the longest common prefix that is told apart

PLACE = "h bigint, c bigint, e bigint, id bigint, sig bigint, pos bigint"  # anchor, hash of its piece, place
SPAN = "id bigint, sig bigint, a bigint, b bigint"


class Hashes(dict):
    """Two hashes of each word, by its number."""

    def __init__(self):
        super().__init__()
        self.one, self.two = (np.zeros(1 << 16, np.uint64) for _ in range(2))

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        if number == len(self.one):
            self.one, self.two = (np.concatenate([x, np.zeros_like(x)]) for x in (self.one, self.two))
        self.one[number], self.two[number] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)
        return number

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHED:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.one[numbers], self.two[numbers]


def anchors(one: np.ndarray, two: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and two hashes of the piece of each anchor of a text, from the hashes of its words."""
    n, parts, before = len(one), [], np.zeros(0, np.int64)
    for begin in range(0, n - LENGTH + 1, part):
        low, high = max(0, begin - SIDE), min(n, begin + part + 2 * LENGTH)
        windows = min(part, n - LENGTH + 1 - begin)
        found = _anchors(one[low:high], two[low:high], begin - low, windows)
        new = ~np.isin(found[0] + low, before)
        before = found[0] + low
        parts.append((before[new], *(x[new] for x in found[1:])))
    if not parts:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(one: np.ndarray, two: np.ndarray, first: int, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(one)
    power, inverse = powers(n + 1)
    sums, more = (np.concatenate([np.zeros(1, np.uint64), np.cumsum((x | np.uint64(1)) * power[:n])]) for x in (one, two))
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1], 1)
    order = (grams >> np.uint64(32)).astype(np.uint32)
    low = sliding(order, SIDE + 1, True)[first : first + windows]  # of each window
    padded = np.zeros(len(order) + SIDE, np.uint32)
    padded[SIDE + first : SIDE + first + len(low)] = low
    at = np.flatnonzero((sliding(padded, SIDE + 1, False) == order) & _inside(len(order), first, len(low)))
    start, end = np.maximum(at - SIDE, 0), np.minimum(at + LENGTH, n)
    shape = ((at - start) * (2 * LENGTH) + end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    c, e = (mixed((s[end] - s[start]) * inverse[start] + shape, salt) for s, salt in ((sums, 2), (more, 3)))
    return at, grams[at].view(np.int64), c.view(np.int64), e.view(np.int64)


def _inside(n: int, first: int, windows: int) -> np.ndarray:
    """Which of ``n`` grams lie in a window."""
    inside = np.zeros(n, bool)
    inside[first : first + windows + SIDE] = True
    return inside


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        out, held = [], 0
        for i, sig, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
            words = (text.as_py() or b"").split()
            if len(words) < LENGTH:
                continue
            at, h, c, e = anchors(*hashes.of(words))
            out.append((h, c, e, np.full(len(at), i), np.full(len(at), sig), at))
            held += len(at)
            if held > 200_000:
                yield _batch(out, ("h", "c", "e", "id", "sig", "pos"))
                out, held = [], 0
        if out:
            yield _batch(out, ("h", "c", "e", "id", "sig", "pos"))


def _batch(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=list(names))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places sorted by anchor and piece: those that equal another (whole), and those to be parsed."""
    held = [np.zeros(0, np.int64)] * 6

    def told(h, c, e, i, sig, pos) -> pa.RecordBatch:
        group = np.r_[True, h[1:] != h[:-1]]
        kind = group | np.r_[True, (c[1:] != c[:-1]) | (e[1:] != e[:-1])]
        of_group, of_kind = np.cumsum(group) - 1, np.cumsum(kind) - 1
        copies = np.bincount(of_kind)[of_kind]
        kinds = np.bincount(of_group[kind])[of_group]
        alone = np.bincount(of_group, copies == 1)[of_group] > 0  # some piece of the anchor has no equal
        whole, open_ = copies > 1, kind & (kinds > 1) & alone
        rows = [(i[m], sig[m], pos[m], h[m], np.full(int(m.sum()), w)) for m, w in ((whole, True), (open_, False))]
        return _batch(rows, ("id", "sig", "pos", "h", "whole"))

    for batch in batches:
        held = [np.concatenate([a, b.to_numpy()]) for a, b in zip(held, batch.columns)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on
        if cut:
            yield told(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield told(*held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, id, sig, start, words of each piece to be parsed, from packed texts and places."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for i, sig, packed, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            words = unpack(packed.as_py()).split()
            for place in places.as_py():
                start = max(0, place["pos"] - SIDE)
                for col, v in zip(cols, (place["h"], i, sig, start, b" ".join(words[start : place["pos"] + LENGTH]))):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.binary(),))], names=["k", "id", "sig", "start", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and place of each window of some pieces."""
    for batch in batches:
        digests, rows = [], []
        for i, sig, start, words in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            parts = words.split(b" ")
            for s in range(len(parts) - LENGTH + 1):
                digests.append(hashlib.md5(b" ".join(parts[s : s + LENGTH])).digest())
                rows.append((i, sig, start + s))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["digest", "id", "sig", "a"])


class Block:
    """The suffix order of some word sequences, with what each suffix shares with others."""

    def __init__(self, segments: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        flat: list[int] = []
        self.begin = np.zeros(len(segments) + 1, np.int64)
        for s, words in enumerate(segments):
            flat.extend(numbers.setdefault(w, len(numbers)) for w in words)
            flat.append(-1 - s)  # an end of its own, so no match crosses it
            self.begin[s + 1] = len(flat)
        ranks = [np.unique(np.array(flat, np.int64), return_inverse=True)[1].astype(np.int64)]
        n = len(flat)
        for step in STEPS[:0:-1]:  # 1, 2, ... to 16: ranks of strings twice as long
            ranks.append(np.unique(self._joined(ranks[-1], step), return_inverse=True)[1].astype(np.int64))
        order = np.argsort(self._joined(ranks[-1], STEPS[0]), kind="stable")
        common = np.zeros(n + 1, np.int64)
        for step, rank in zip(STEPS, ranks[::-1]):
            a, b = order[:-1] + common[1:-1], order[1:] + common[1:-1]
            inside = np.maximum(a, b) < n
            same = np.zeros(n - 1, bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            common[1:-1] += np.where(same, step, 0)
        #: The longest string at each place that also starts elsewhere.
        self.shared = np.zeros(n, np.int64)
        self.shared[order] = np.maximum(common[:-1], common[1:])

    @staticmethod
    def _joined(rank: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - step)] = rank[step:] + 1
        return rank * (len(rank) + 1) + after

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, start and length of each factor, in the order of the text."""
        at, end = self.begin[:-1].copy(), self.begin[1:] - 1
        segment = np.flatnonzero(at < end)
        made = []
        while len(segment):
            length = np.maximum(self.shared[at[segment]], 1)
            made.append((segment, at[segment].copy(), length))
            at[segment] += length
            segment = segment[at[segment] < end[segment]]
        if not made:
            return (np.zeros(0, np.int64),) * 3
        found = [np.concatenate(x) for x in zip(*made)]
        order = np.argsort(found[1])
        return tuple(x[order] for x in found)

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, first word and end of repeated spans: long factors, and windows across factor boundaries."""
        segment, at, length = self.factors()
        long = length >= LENGTH
        spans = [(segment[long], at[long], at[long] + length[long])]
        edge = np.flatnonzero((segment[1:] == segment[:-1]) & (length[1:] + length[:-1] >= LENGTH)) if len(at) else np.zeros(0, np.int64)
        if len(edge):
            start = at[edge + 1][:, None] - np.arange(1, LENGTH)[None, :]
            inside = start >= at[edge][:, None]
            hit = inside & (self.shared[np.where(inside, start, 0)] >= LENGTH)
            start, of = start[hit], np.broadcast_to(segment[edge][:, None], hit.shape)[hit]
            spans.append((of, start, start + LENGTH))
        of, a, b = (np.concatenate(x) for x in zip(*spans))
        return of, a - self.begin[of], b - self.begin[of]


def _factored(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def spans() -> pa.RecordBatch:
            held.sort(key=lambda r: r[1:4])
            where: list[tuple[int, int, int]] = []
            segments: list[list[bytes]] = []
            for _, i, sig, start, words in held:
                parts = words.split(b" ")
                if where and where[-1][:2] == (i, sig) and start <= (end := where[-1][2] + len(segments[-1])):
                    segments[-1].extend(parts[end - start :])
                else:
                    where.append((i, sig, start))
                    segments.append(parts)
            of, a, b = Block(segments).repeated()
            place = np.array(where, np.int64)
            return _batch([(place[of, 0], place[of, 1], place[of, 2] + a, place[of, 2] + b)], ("id", "sig", "a", "b"))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= block and row[0] != held[-1][0]:
                    yield spans()
                    held = []
                held.append(row)
        if held:
            yield spans()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([pack(t.as_py() or b"") for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["id", "sig", "packed"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        cols: list[list] = [[] for _ in range(4)]
        for i, packed, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            words, kept, at = unpack(packed.as_py()).split(), [], 0
            for span in sorted((s["a"], s["b"]) for s in spans.as_py() or ()):
                a, b = max(0, span[0]), min(len(words), span[1])
                kept.extend(words[at : max(at, a)])
                at = max(at, b)
            kept.extend(words[at:])
            for col, v in zip(cols, (None if i == NO_ID else i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),))], names=["doc", "n_words", "n_removed", "kept_sha256"])


def spans(texts: DataFrame, packed: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Repeated spans (SPAN, in words) of texts (id, sig, t)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = hold(texts.mapInArrow(_places, PLACE))
    large = hold(places.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("h"))
    some = not large.isEmpty()
    around = [(F.col("pos") - SIDE).alias("a"), (F.col("pos") + LENGTH).alias("b")]

    def fetched(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("id", "sig").agg(F.collect_list(F.struct("h", "pos")).alias("places"))
        return packed.join(listed, ["id", "sig"]).select("id", "sig", "packed", "places").mapInArrow(_pieces, "k bigint, id bigint, sig bigint, start bigint, words binary")

    cold = lookup_join(places, large, ["h"], ["id", "pos"], "left_anti") if some else places
    again = hold(cold.select("h", "c", "e", "id", "sig", "pos").repartition(n, "h").sortWithinPartitions("h", "c", "e", "id", "sig", "pos").mapInArrow(_kinds, "id bigint, sig bigint, pos bigint, h bigint, whole boolean"))
    frequent = hold(lookup_join(places, large, ["h"], ["id", "pos"], "left_semi")) if some else None
    release(places)  # before the pieces are fetched, so both are not stored at a time
    out = again.filter("whole").select("id", "sig", *around)
    pieces = fetched(again.filter("not whole")).repartition(n, "k").sortWithinPartitions("k")
    out = out.unionAll(pieces.mapInArrow(_factored(block), SPAN))
    if some:
        kinds = hold(frequent.groupBy("h", "c", "e").agg(F.count("*").alias("n"), F.min(F.struct("id", "sig", "pos")).alias("first")))
        equal = lookup_join(frequent, kinds.filter("n > 1").select("h", "c", "e"), ["h", "c", "e"], ["id", "pos"])
        out = out.unionAll(equal.select("id", "sig", *around))
        windows = hold(fetched(kinds.select("h", "first.*")).mapInArrow(_windows, "digest binary, id bigint, sig bigint, a bigint").distinct())
        twice = windows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
        out = out.unionAll(windows.join(twice, "digest").select("id", "sig", "a", (F.col("a") + LENGTH).alias("b")))
    out = hold(out)
    release(large, again)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and the digest of the kept words."""
    texts = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("sig"), F.col(text).cast("binary").alias("t"))
    packed = texts.mapInArrow(_packed, "id bigint, sig bigint, packed binary")
    found = spans(texts, packed.dropDuplicates(["id", "sig"]), hot, block).groupBy("id", "sig").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    made = packed.join(found, ["id", "sig"], "left").select("id", "packed", "spans").mapInArrow(_kept, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return made.withColumnRenamed("doc", id_col)
