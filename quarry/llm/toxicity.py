"""Toxic passages by maximum-scoring segment search.

Each token's log-odds between toxic and other labelled texts, with an informative Dirichlet
prior from the pooled counts, is its score if its z-value is significant; every other token
costs a small drift. A linear scan finds all maximal scoring segments (Ruzzo and Tompa). The
scores of chance segments follow an extreme-value law whose scale solves
``sum p(w) exp(lambda s(w)) = 1`` over the tokens of clean texts, so a segment in a text of n
tokens has E-value ``K n exp(-lambda S)``. The evidence of the significant segments is turned into a
probability by a logistic fit on labelled texts that had no part in the token counts.

Bounds, all parameters: at most ``MAX_LABELLED`` labelled rows for the token counts,
``MAX_CALIBRATION`` for the fit and ``MAX_TERMS`` tokens in the model. Every row is scored over its whole text.
Without labels of both kinds the score is the share of toxic labels (none: 0). Null and empty
texts score as texts without toxic passages. Null ids are never labelled, of repeated labels the highest holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_texts

MAX_LABELLED = 200_000
MAX_CALIBRATION = 20_000
MAX_TERMS = 20_000
MIN_Z = 3.0
DRIFT = 0.02  # what a token without significant log-odds costs
PRIOR = 0.1  # pseudo-counts of the prior, as a share of the pooled counts
E_MAX = 0.05  # segments with a smaller E-value are significant
THRESHOLD = 0.3
HELD_OUT = 2  # remainder of crc32(id) mod 4 that is never learned from

TOKEN = re.compile(rb"[a-z\x80-\xff]+")


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def tokens(raw: bytes) -> list[bytes]:
    """ASCII-lowered runs of ASCII letters and non-ASCII characters."""
    return TOKEN.findall(raw.lower())


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    rate: float = 1.0  # K
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.0

    def segments(self, raw: bytes) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens; (score, first token, token after the last) of all maximal segments."""
        found = tokens(raw)
        known = self.scores
        hits = [(i, known[t]) for i, t in enumerate(found) if t in known] if not known.keys().isdisjoint(found) else []
        return len(found), maximal_segments(hits, DRIFT)

    def features(self, n: int, scores: Iterable[float]) -> tuple[float, float]:
        """Of the significant segments: the surprise -ln E of the best, and of all together."""
        limit = math.log(self.rate * max(n, 1) / E_MAX)
        over = [self.scale * s - limit for s in scores if self.scale * s > limit]
        return (math.log1p(max(over)), math.log1p(sum(over))) if over else (0.0, 0.0)

    def probability(self, raw: bytes) -> float:
        if not self.scores:
            return self.base
        n, found = self.segments(raw)
        best, total = self.features(n, [s for s, _, _ in found])
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * best + b * total + c))))


def maximal_segments(hits: Iterable[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments in linear time, given (position, score) of the tokens that
    have one; all others cost ``drift``. Candidates hold the cumulative score before and
    after them, the pointer of each goes to the nearest earlier one that starts lower."""
    cands: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, end, pointer
    total, at = 0.0, 0
    for pos, score in hits:
        total -= drift * (pos - at)
        left, total, at = total, total + score, pos + 1
        if score <= 0:
            continue
        cand = [left, total, pos, pos + 1]
        while True:
            j = len(cands) - 1
            while j >= 0 and cands[j][0] >= cand[0]:
                j = cands[j][4]
            if j < 0 or cands[j][1] >= cand[1]:
                cands.append((*cand, j))
                break
            cand[0], cand[2] = cands[j][0], cands[j][2]
            del cands[j:]
    return [(right - left, first, end) for left, right, first, end, _ in cands]


def token_counts(labelled: DataFrame, text: str) -> DataFrame:
    """token, number of toxic and clean texts that hold it in folds for terms (0, 1) and for the fit (3).

    Each task counts its own rows; counts, not texts, are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {k: Counter() for k in range(4)}
        names = ["token", *[f"n{k}" for k in range(4)]]

        def emitted() -> pa.RecordBatch:
            words = list(set().union(*counts.values()))
            cols = [pa.array([counts[k][w] for w in words], pa.int64()) for k in range(4)]
            for c in counts.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *cols], names=names)

        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[kind].update(set(tokens(raw.as_py() or b"")))  # texts that hold the token
                if sum(map(len, counts.values())) > 150_000:  # keeps the task's memory bounded
                    yield emitted()
        yield emitted()

    rows = labelled.select((2 * (F.col("_fold") == 3).cast("int") + F.col("_toxic")).alias("k"), F.col(text).cast("binary").alias("t"))
    parts = rows.mapInArrow(run, "token binary, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    return parts.groupBy("token").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]).filter("n0 + n1 + n2 + n3 > 1")


def log_odds(counts: DataFrame, clean: list[str], toxic: list[str]) -> list[tuple[bytes, float, float, float]]:
    """(token, log-odds, share in clean texts) of the most significant tokens."""
    y0, y1 = [sum(F.col(c) for c in cols) for cols in (clean, toxic)]
    sums = counts.select(F.sum(y0).alias("a"), F.sum(y1).alias("b")).first()
    n0, n1 = float(sums["a"] or 0), float(sums["b"] or 0)
    if not n0 or not n1:
        return []
    prior, whole = PRIOR * (y0 + y1) + 1e-9, PRIOR * (n0 + n1)
    odds = F.log((y1 + prior) / (n1 + whole - y1 - prior)) - F.log((y0 + prior) / (n0 + whole - y0 - prior))
    z = odds / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    rows = counts.select("token", odds.alias("s"), z.alias("z"), (y0 / n0).alias("p")).filter(F.abs("z") >= MIN_Z)
    return [tuple(r) for r in rows.orderBy(F.abs("z").desc(), "token").limit(MAX_TERMS).select("token", "s", "p").collect()]


def scale_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1; other tokens score -DRIFT."""
    rest = max(0.0, 1 - shares.sum())
    value = lambda x: float(np.sum(shares * np.exp(np.minimum(x * scores, 700))) + rest * math.exp(-DRIFT * x)) - 1
    lo, hi = 0.0, 1.0
    while value(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 2
    if value(1e-6) >= 0:  # no negative drift: scores as they are
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _model(terms: list[tuple[bytes, float, float]], base: float) -> Model:
    if not terms:
        return Model(base=base)
    s, p = np.array([t[1] for t in terms]), np.array([t[2] for t in terms])
    return Model({bytes(t[0]): float(t[1]) for t in terms}, scale_of(s, p), base=base)


def _fitted(rows: list[tuple[int, float, float]]) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.array([[a, b, 1.0] for _, a, b in rows])
    y = np.array([t for t, _, _ in rows], dtype=float)
    w, ridge = np.zeros(3), np.diag([0.1, 0.1, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows outside the held-out fold."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(id_col) != HELD_OUT))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("_toxic"))
    )
    n = known.count()
    if not n:
        return Model()
    share = lambda most: F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.98 * most / n)) if n > most else F.lit(True)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    # at most MAX_LABELLED rows of 12 bytes are broadcast
    labelled = rows.join(F.broadcast(known.filter(share(MAX_LABELLED))), "_id").withColumn("_fold", fold("_id"))
    counts = token_counts(labelled, "_text").persist()
    try:
        terms, final = log_odds(counts, ["n0"], ["n1"]), log_odds(counts, ["n0", "n2"], ["n1", "n3"])
    finally:
        counts.unpersist()
    total = known.agg(F.avg("_toxic")).first()[0]
    first, model = _model(terms, total), _model(final, total)
    fitting = rows.join(F.broadcast(known.filter((fold("_id") == 3) & share(MAX_CALIBRATION))), "_id")
    if not terms:
        return Model(base=total)

    def make():
        def of(raw: bytes) -> tuple[int, bytes]:
            n, found = first.segments(raw)
            return n, np.array([s for s, _, _ in found], dtype=float).tobytes()

        return of

    seen = map_texts(fitting.select("_toxic", "_text"), ["_toxic"], make, [("n", "bigint"), ("s", "binary")], "_text").collect()
    seen = [(r["_toxic"], r["n"], np.frombuffer(r["s"])) for r in seen]
    if len({t for t, _, _ in seen}) < 2:
        return Model(base=total)
    # K from the chance segments of clean texts: how many reach the scale, against n exp(-1) each
    chance = sum(int((s * first.scale >= 1).sum()) for t, _, s in seen if not t)
    first.rate = model.rate = max(1.0, chance) / max(1.0, sum(n for t, n, _ in seen if not t) * math.exp(-1))
    model.weights = _fitted([(t, *first.features(n, s)) for t, n, s in seen])
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(raw: bytes) -> tuple[float, int]:
            p = sent.value.probability(raw)
            return p, int(p >= THRESHOLD)

        return of

    return map_texts(docs, keep, make, [("score", "double"), ("predicted", "int")], text)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return score(whole, model, ["_row"], "_text").filter("predicted = 0").select("_row.*")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and, for each significant passage, ``first_token``, ``end_token``, ``evalue``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(raw: bytes) -> tuple[str]:
            m = sent.value
            n, found = m.segments(raw)
            return (";".join([f"{a},{b},{m.rate * n * math.exp(-m.scale * s)!r}" for s, a, b in found if m.rate * n * math.exp(-m.scale * s) <= E_MAX]),)

        return of

    part = F.split(F.col("_passage"), ",")
    listed = map_texts(docs, [id_col], make, [("_found", "string")], text).filter(F.col("_found") != "")
    return listed.select(id_col, F.explode(F.split("_found", ";")).alias("_passage")).select(
        id_col, part[0].cast("bigint").alias("first_token"), part[1].cast("bigint").alias("end_token"), part[2].cast("double").alias("evalue")
    )
