"""Repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts earlier.

Sorting the suffixes of whole documents column by column takes as many rounds as the longest document has
bytes. Strings of a fixed length need no more than their own columns, so the collection is cut
into short pieces first, without losing a match: each window of ``LENGTH`` bytes chooses its smallest
hashed ``GRAM`` as an anchor, equal windows choose equal anchors at equal offsets, and only anchors that
occur again are followed up. A piece is an anchor with all windows through it.

1. Anchors with a hash of their piece are shuffled and sorted by anchor. Pieces equal to an
   earlier piece are repeated as a whole.
2. If an anchor has several pieces, the first of each kind is fetched from its text. These pieces form the
   collection: its suffix order is built one column per round from the right, every round inserts one symbol of each
   piece (a stable sort by that symbol), and neighbours in the order with a common prefix of
   ``LENGTH`` form the classes of equal windows. All but the earliest of a class are repeated.
   Anchors with more than ``TOGETHER`` pieces are split first: the windows of a piece are halved by their start, and
   a half is grouped by the bytes that all its windows hold. Groups still too large are split again; those of one
   window hold equal windows only and need no more than their earliest place.
3. The spans of each document are joined, and its bytes outside them kept.

Earlier means a smaller id (null first), in one document a smaller start. Texts that share an id are
told apart by their XXH64 and compared in its order at equal starts; identical rows count once and each gets the same result. Null and short texts
keep all. Hashes have 64 bits for the anchor and 64 for the piece. The places of one anchor pass through
one task in step 1, as a sorted stream that is never held; the spans of one document meet in one task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scale import hold

LENGTH = 100
GRAM = 30
SIDE = LENGTH - GRAM  # bytes of a piece on each side of its anchor
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NO_ID = -(1 << 63)
TOGETHER = 20_000  # pieces of a group sorted at a time; larger groups are split

PIECE = "k bigint, lo int, hi int, id bigint, p bigint, sig bigint, left int, piece binary"  # key, first and last window, place, bytes left of the anchor
PLACE = ("id", "p", "sig")  # id, byte in the text, XXH64 of the text: texts that share an id differ in it

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for i, b in enumerate((BASE, INVERSE)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``w`` neighbours, from running ones in blocks of ``w``."""
    op, pad = (np.minimum, np.iinfo(x.dtype).max) if least else (np.maximum, 0)
    n = len(x)
    blocks = np.full(-(-n // w) * w, pad, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash and hash of the piece of each anchor of a text."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1], 1)
    order = (grams >> np.uint64(32)).astype(np.uint32)
    low = sliding(order, SIDE + 1, True)  # of each window
    padded = np.zeros(len(low) + 2 * SIDE, np.uint32)
    padded[SIDE : SIDE + len(low)] = low
    at = np.flatnonzero(sliding(padded, SIDE + 1, False) == order)  # the least of one of its windows
    start, end = np.maximum(at - SIDE, 0), np.minimum(at + LENGTH, n)
    piece = (sums[end] - sums[start]) * inverse[start] + (at - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return at, grams[at], mixed(piece + (end - start).astype(np.uint64), 2)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """whole, h, c, id, p, sig of each anchor. Pieces that an earlier piece of the same task equals
    are already known to be repeated; they are dealt by id, so that a frequent anchor leaves a task
    once."""
    for batch in batches:
        ids, sigs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for i, text in enumerate(batch.column(2)):
            at, h, c = anchors(text.as_py() or b"")
            out.append((h.view(np.int64), c.view(np.int64), np.full(len(at), ids[i]), at, np.full(len(at), sigs[i])))
            held += len(at)
            if held > 500_000:
                yield _combined(out)
                out, held = [], 0
        if held:
            yield _combined(out)


def _combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    h, c, *place = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((*place[::-1], c, h))
    h, c, *place = (x[order] for x in (h, c, *place))
    new = np.ones(len(h), bool)  # a repeated row is no earlier place
    new[1:] = (h[1:] != h[:-1]) | ~_equal(place)
    h, c, *place = (x[new] for x in (h, c, *place))
    whole = np.zeros(len(h), bool)
    whole[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    dealt = place[0] ^ (place[1] << 24) ^ place[2]
    h[whole] = mixed(dealt[whole].view(np.uint64), 3).view(np.int64)
    return _batch([(whole, h, c, *place)], ("whole", "h", "c", *PLACE))


def _equal(place: list[np.ndarray]) -> np.ndarray:
    """Whether each place but the first is the one before it."""
    return np.logical_and.reduce([x[1:] == x[:-1] for x in place])


def _batch(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=list(names))


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, piece and place: pieces equal to an earlier one (whole), and
    the first of each kind if its anchor has several kinds. One row waits for its successor.
    Rows known to be whole pass."""
    names = (*PLACE, "h", "whole")
    wait: tuple[int, int, tuple[int, ...], bool] | None = None  # h, c, place, other kinds before
    one = lambda: tuple(np.array([v]) for v in (*wait[2], wait[0], False))
    for batch in batches:
        known = batch.column(0).to_numpy(zero_copy_only=False)
        h, c, *place = [batch.column(k).to_numpy() for k in range(1, 6)]
        if known.any():
            yield _batch([(*[x[known] for x in place], h[known], known[known])], names)
            h, c, *place = (x[~known] for x in (h, c, *place))
        if not len(h):
            continue
        ph, pc = (wait[0], wait[1]) if wait else (None, None)
        new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        new_h[0] = ph is None or h[0] != ph
        new_c[0] = new_h[0] or c[0] != pc
        same = np.zeros(len(h), bool)
        same[1:] = _equal(place)
        same[0] = wait is not None and tuple(x[0] for x in place) == wait[2]
        repeat = ~new_c & ~same
        first = np.flatnonzero(new_c)
        several = ~new_h[first]
        rows = [(*[x[repeat] for x in place], h[repeat], np.ones(int(repeat.sum()), bool))]
        if len(first):
            if wait and (wait[3] or several[0]):
                rows.append(one())
            several[:-1] |= several[1:].copy()
            keep = first[:-1][several[:-1]]
            rows.append((*[x[keep] for x in place], h[keep], np.zeros(len(keep), bool)))
            k = first[-1]
            wait = (int(h[k]), int(c[k]), tuple(int(x[k]) for x in place), bool(several[-1]))
        yield _batch(rows, names)
    if wait and wait[3]:
        yield _batch([one()], names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (PIECE) of all windows, from packed texts and their places."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for i, sig, packed, places in zip(*batch.columns):
            raw, i, sig = unpack(packed.as_py()), i.as_py(), sig.as_py()
            for place in places.as_py():
                at = place["p"]
                start = max(0, at - SIDE)
                for col, v in zip(cols, (place["h"], 0, SIDE, i, at, sig, at - start, raw[start : at + LENGTH])):
                    col.append(v)
        yield _piece_batch(cols)


def _piece_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["k", "lo", "hi", *PLACE, "left", "piece"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece under one key for each half of its windows ``lo`` to ``hi``: a hash of the old key
    and of the bytes that all windows of the half hold. Halves without a window are left out."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for k, lo, hi, i, p, sig, left, piece in zip(*[c.to_pylist() for c in batch.columns]):
            begin = SIDE - left
            mid = (lo + hi) // 2
            for a, b in ((lo, mid), (mid + 1, hi)):
                if max(a, begin) > min(b, begin + len(piece) - LENGTH):
                    continue
                common = piece[b - begin : a + LENGTH - begin]
                key = hashlib.blake2b(common, digest_size=8, key=struct.pack("<qBB", k, a, b)).digest()
                for col, v in zip(cols, (int.from_bytes(key, "little", signed=True), a, b, i, p, sig, left, piece)):
                    col.append(v)
        yield _piece_batch(cols)


def repeated_windows(left: np.ndarray, pieces: list[bytes], place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the first and the last of its windows ``lo`` to ``hi`` that an earlier piece
    also has (-1: none). ``place`` ranks the pieces by where they start."""
    n, width = len(pieces), 2 * SIDE + GRAM
    grid = np.zeros((n, width), np.uint8)
    for i, p in enumerate(pieces):
        at = SIDE - left[i]
        grid[i, at : at + len(p)] = np.frombuffer(p, np.uint8)
    begin = SIDE - left
    end = begin + np.array([len(p) for p in pieces])
    lo, hi = np.maximum(lo, begin), np.minimum(hi, end - LENGTH)
    columns = np.ascontiguousarray(grid.T)
    first, last = np.full(n, -1), np.full(n, -1)
    order = np.arange(n)
    for s in range(width - 1, -1, -1):
        order = order[np.argsort(columns[s][order], kind="stable")]
        if s > SIDE:
            continue
        rows = order[(lo[order] <= s) & (s <= hi[order])]
        if len(rows) < 2:
            continue
        windows = grid[rows, s : s + LENGTH]
        edge = np.flatnonzero(np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)])
        earliest = np.minimum.reduceat(place[rows], edge)
        late = rows[place[rows] > np.repeat(earliest, np.diff(np.r_[edge, len(rows)]))]
        first[late] = s
        last[late] = np.where(last[late] < 0, s, last[late])
    return first, last


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (id, sig, from, to) out of pieces sorted by key, whole groups at a time."""
    held: list[tuple] = []

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        _, lo, hi, ids, at, sigs, left, pieces = zip(*rows)
        ids, at, sigs, left, lo, hi = [np.array(x, np.int64) for x in (ids, at, sigs, left, lo, hi)]
        place = np.empty(len(rows), np.int64)
        place[np.lexsort((sigs, at, ids))] = np.arange(len(rows))
        first, last = repeated_windows(left, list(pieces), place, lo, hi)
        hit = first >= 0
        origin = at[hit] - SIDE
        return _batch([(ids[hit], sigs[hit], origin + first[hit], origin + last[hit] + LENGTH)], ("id", "sig", "a", "b"))

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if len(held) >= TOGETHER and row[0] != held[-1][0]:
                yield spans(held)
                held = []
            held.append(row)
    if held:
        yield spans(held)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([pack(t.as_py() or b"") for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["id", "sig", "packed"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for i, packed, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
            raw = unpack(packed.as_py())
            digest, at, runs, removed = hashlib.sha256(), 0, 0, 0
            end = -1
            for a, b in sorted((max(0, s["a"]), min(len(raw), s["b"])) for s in spans.as_py() or ()):
                if a > end:
                    digest.update(raw[at:a])
                    runs += 1
                removed += max(0, b - max(a, at))
                at = end = max(at, b)
            digest.update(raw[at:])
            for col, v in zip(cols, (None if i.as_py() == NO_ID else i.as_py(), len(raw), removed, runs, digest.hexdigest())):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(texts: DataFrame, packed: DataFrame) -> DataFrame:
    """Repeated spans (id, sig, a, b) of texts (id, sig, t)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = texts.mapInArrow(_anchor_rows, "whole boolean, h bigint, c bigint, id bigint, p bigint, sig bigint")
    again = hold(found.repartition(n, "h").sortWithinPartitions("whole", "h", "c", *PLACE).mapInArrow(_again, "id bigint, p bigint, sig bigint, h bigint, whole boolean"))
    whole = again.filter("whole").select("id", "sig", (F.col("p") - SIDE).alias("a"), (F.col("p") + LENGTH).alias("b"))
    several = again.filter("not whole").select(*PLACE, "h")

    def fetched(rows: DataFrame) -> DataFrame:
        places = rows.groupBy("id", "sig").agg(F.collect_list(F.struct("h", "p")).alias("places"))
        return packed.join(places, ["id", "sig"]).select("id", "sig", "packed", "places").mapInArrow(_pieces, PIECE)

    def resolved(pieces: DataFrame) -> DataFrame:
        return pieces.repartition(n, "k").sortWithinPartitions("k").mapInArrow(_resolved, "id bigint, sig bigint, a bigint, b bigint")

    large = hold(several.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select("h"))
    if large.isEmpty():
        return whole.unionAll(resolved(fetched(several)))
    out = whole.unionAll(resolved(fetched(several.join(large, "h", "left_anti"))))
    open_ = hold(fetched(several.join(large, "h", "left_semi")).mapInArrow(_halves, PIECE))
    for _ in range(SIDE.bit_length()):
        one = F.col("lo") == F.col("hi")
        sizes = open_.groupBy("k").agg(F.count("*").alias("n"))
        large = hold(sizes.filter(F.col("n") > TOGETHER).select("k"))
        if large.isEmpty():
            break
        out = out.unionAll(resolved(open_.join(large, "k", "left_anti")))
        rest = open_.join(large, "k", "left_semi")
        out = out.unionAll(_late(rest.filter(one)))
        open_ = hold(rest.filter(~one).mapInArrow(_halves, PIECE))
    return out.unionAll(resolved(open_))


def _late(pieces: DataFrame) -> DataFrame:
    """Spans of pieces with one window each: of equal windows all but the earliest."""
    start = F.col("p") + F.col("lo") - SIDE
    window = F.expr(f"substring(piece, lo - {SIDE} + left + 1, {LENGTH})")
    rows = pieces.select("id", start.alias("a"), "sig", window.alias("w"))
    place = F.struct("id", "a", "sig")  # the same for each anchor of a window
    first = rows.groupBy("w").agg(F.min(place).alias("first"))
    late = rows.join(first, "w").filter(place != F.col("first"))
    return late.select("id", "sig", "a", (F.col("a") + LENGTH).alias("b"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and the digest of the kept bytes."""
    sig = F.xxhash64(text).alias("sig")
    texts = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), sig, F.col(text).cast("binary").alias("t"))
    packed = texts.mapInArrow(_packed, "id bigint, sig bigint, packed binary")
    merged = spans(texts, packed.dropDuplicates(["id", "sig"])).groupBy("id", "sig").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    out = packed.join(merged, ["id", "sig"], "left").select("id", "packed", "spans")
    made = out.mapInArrow(_kept, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return made.withColumnRenamed("doc", id_col)
