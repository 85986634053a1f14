import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_shuffled_joins import _index, _plan

from quarry.functions import text as tx
from quarry.operators import claims as cc
from quarry.operators import ranked as rk


def test_runs_are_bounded_and_whole():
    assert list(tx.runs(np.array([3, 3, 9, 0, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(tx.runs(np.array([], np.int64), 6)) == []


def test_pieces_are_grouped_as_one_by_one():
    rows = [[["x", "b", "x"], ["the"], []], None, [], [["c", "x"], ["c"]]]
    kind = pa.list_(pa.list_(pa.string()))
    terms, sizes, places, counts = (x.to_pylist() for x in tx._group_pieces(pa.array([None, *rows], kind).slice(1), tx.word_terms("none")))
    for row, t, s, p, c in zip(rows, terms, sizes, places, counts):
        got, at = [], 0
        for n in s:
            got.append({t[i]: k for i, k in zip(p[at : at + n], c[at : at + n])})
            at += n
        assert got == [dict(Counter(w for w in piece if w != "the")) for piece in row or []] and at == len(p)


CONTENTS = {1: "Common w1 words are here now. Then u5 and w2 follow common U5! Bare words stand alone there\nÉtude w3 ﬁne w3 u7 text", 2: "w1 u9 u9", 3: "", 4: None}
SAID = {0: "common w1 u5 [1]", 1: "u5 u5 w3 w9", 2: "unknown words", 3: "u9 w1"}


@pytest.mark.parametrize("rows", [20_000, 3])
def test_window_scores_keep_windows_in_their_block(spark, monkeypatch, rows):
    monkeypatch.setattr(rk, "VOCABULARY_ROWS", rows)
    index = _index(spark)
    claims = spark.createDataFrame([("x", i, s, [1, 2, 3, 4, 9]) for i, s in SAID.items()], "answer_id string, claim_no int, sentence string, citations array<int>")
    blocks = spark.createDataFrame([("x", i, c) for i, c in CONTENTS.items()], "answer_id string, index int, content string")
    stored = []
    monkeypatch.setattr(cc, "hold", lambda df, keep=cc.hold: stored.append(keep(df)) or stored[-1])
    out = cc.window_scores(index, claims, blocks)
    assert rows > 3 or "BroadcastHashJoin" not in _plan(out)
    assert max(t.count() for t in stored if "index" in t.columns) == len(CONTENTS)  # before: a row for each term of each window
    idf = {r.term: r.idf for r in index.dictionary.collect() if r.idf > 0}

    def vectors(df, keys):
        found: dict = {}
        for r in tx.term_rows(df, "text", "none").collect():
            if r.term in idf:
                found.setdefault(tuple(r[k] for k in keys), {})[r.term] = (1 + math.log10(len(r.positions))) * idf[r.term]
        return found

    a = vectors(claims.select("claim_no", cc.strip_markers("sentence").alias("text")), ["claim_no"])
    b = vectors(blocks.select("index", F.posexplode(cc.passage_windows("content")).alias("window_no", "text")), ["index", "window_no"])
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {(*i, *j): sum(x * v[t] for t, x in u.items() if t in v) / (norm(u) * norm(v)) for i, u in a.items() for j, v in b.items() if u.keys() & v.keys()}
    got = {(r.claim_no, r["index"], r.window_no): r.score for r in out.collect()}
    assert got.keys() == want.keys() and len(want) > 6 and all(got[k] == pytest.approx(want[k]) for k in want)
    assert out.columns == ["answer_id", "claim_no", "index", "window_no", "score"]
