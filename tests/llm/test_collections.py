"""Phrases, word-window repeats and ranked search against brute force, on nulls, empty and long texts, ties, repeated rows,
empty tables, clashing names, and on both sides of every size switch."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from quarry.llm import factors, phrases, queries, treap

SCHEMA = "doc_id bigint, text string, lang string, shard bigint, words string, id bigint, sig string, rank int, score double, h bigint"


def frame(spark, texts, langs=None, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, l, 1, "w", 2, "s", 3, 0.5, 4) for i, t, l in zip(ids, texts, langs or ["en"] * len(texts))], SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    pool = ["the", "of", "Thing", "erand", "ré", "héan", "ing"]
    made = [" ".join(rng.choice(pool) + rng.choice(["", "", "x", ".", ", of"]) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    made += [None, "", "  ", "new york city " * 30, "one\ttwo\vthree", "the of " * 900, "A B C. a b c! A b c\n" * 15, made[3], made[3]]
    return made


def slow_phrases(texts, langs, least, keep):
    out = []
    for lang in {x or "und" for x in langs}:
        f, n = collections.Counter(), 0
        for t, l in zip(texts, langs):
            if (l or "und") != lang:
                continue
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
                n += len(w)
                for k in (1, 2, 3):
                    f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) == 3 and b >= least and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard": 150, "lookup_rows": 2}, {"shard": 400, "lookup_rows": 40, "keep": 5}])
def test_phrases_equal_brute_force(spark, prose, options):
    langs = [["en", "de", None][i % 3] for i in range(len(prose))]
    got = sorted(map(tuple, phrases.collocations(frame(spark, prose, langs), **options).collect()))
    assert got == slow_phrases(prose, langs, 10, options.get("keep", 2000)) and got


def test_phrase_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(10**12, 10**13, 10**12 + 1)], "a bigint, l bigint, r bigint")
    assert row.select(phrases._score("a", "l", "r").alias("s")).first().s == 10**6 * 10**24 // (10**13 * (10**12 + 1))


def test_transform_of_many_words_takes_the_long_way():
    text = np.array([3, 1, 2, 3, 1, 2, 0, 1 << 22], np.int32)
    low = np.where(text == 1 << 22, 9, text).astype(np.int32)
    assert [9 if x == 1 << 22 else x for x in phrases.transform(text)] == list(phrases.transform(low))


def slow_repeats(texts):
    words = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[s : s + 35]) for w in words for s in range(len(w) - 34))
    out = []
    for w in words:
        gone = {j for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block": 5}, {"block": 1}])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, options):
    if options.get("block") == 1:
        monkeypatch.setattr(factors.anchors, "__defaults__", (7,))  # long texts are hashed in parts
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    base = [word() for _ in range(60)]
    made = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(15)]
    made += [" ".join([word() for _ in range(rng.randint(0, 30))] + base[rng.randint(0, 20) : rng.randint(30, 60)] + [word() for _ in range(20)]) for _ in range(12)]
    made += [None, "", "a " * 200, "a " * 34, "a " * 35, " ".join(base + ["x"] + base), " ".join(base[:35]), " ".join(base[1:36]), " ".join(base[:34]), " ".join(base)]
    edited = list(base * 3)
    edited[70] = "changed"
    made += [" ".join(base * 3), " ".join(edited), made[0], made[0]]
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in factors.remove_repeats(frame(spark, made), **options).collect()}
    assert [rows[i] for i in range(len(made))] == slow_repeats(made)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_places_are_deleted_before_pieces_are_fetched(spark, monkeypatch, hot):
    left, hold, release = [], factors.hold, factors.release
    stored = lambda df: [c for c in df.columns] == ["h", "c", "e", "id", "sig", "pos"]
    alive: list = []

    def held(df, *more, **options):
        left.append(len(alive))
        made = hold(df, *more, **options)
        alive.extend([made] * stored(made))
        return made

    def gone(*frames):
        alive[:] = [x for x in alive if not any(x is f for f in frames)]
        release(*frames)

    monkeypatch.setattr(factors, "hold", held)
    monkeypatch.setattr(factors, "release", gone)
    made = [" ".join(f"w{(i + k) % 90}" for i in range(80)) for k in range(5)]
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in factors.remove_repeats(frame(spark, made), hot=hot).collect()}
    assert [rows[i] for i in range(len(made))] == slow_repeats(made)
    assert left[-1] == (hot == 2)  # only the frequent places, if any, are stored when the spans are made


def test_repeated_rows_and_null_ids_are_places(spark):
    text = " ".join(f"u{i}" for i in range(50))
    rows = factors.remove_repeats(frame(spark, [text, text, "lone " + text[:40]], ids=[None, None, 5])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 50), (0, 50), (5, 0)]


def test_greedy_factors_find_windows_across_boundaries():
    base = [b"%d" % i for i in range(100)]
    block = factors.Block([base[:60], base[20:80], [b"z", *base[30:70], b"y"]])
    of, a, b = block.repeated()
    covered = {(s, j) for s, x, y in zip(of, a, b) for j in range(x, y)}
    assert covered == {(0, j) for j in range(20, 60)} | {(1, j) for j in range(0, 50)} | {(2, j) for j in range(1, 41)}


def slow_ranking(texts, items, k, ids=None):
    fold = lambda t: [w.lower() if w.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [collections.Counter(fold(t)) for t in texts]
    sizes = [sum(d.values()) for d in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(w for d in docs for w in d)
    out = []
    for item, t in items:
        found = []
        for i, d in enumerate(docs):
            score = 0
            for w, often in collections.Counter(fold(t)).items():
                if d[w]:
                    m = 75 + (25 * sizes[i] * n) // total
                    score += often * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * d[w] // (1000 * d[w] + 12 * m))
            if score > 0:
                found.append((-score, (ids or range(len(texts)))[i]))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [({}, {}), ({"postings": 40, "documents": 6}, {"block": 3}), ({"postings": 1}, {})])
def test_ranking_equals_brute_force(spark, prose, monkeypatch, options):
    monkeypatch.setattr(treap, "TOGETHER", 4)
    given = [*prose, "Éa café_bar 12 x", "tie one", "tie one", "tie one", "only\x00here"]
    items = [(1, "the erand thing HÉAN of of"), (2, "tie"), (3, None), (4, "unknown words"), (5, "café x 12 here new york"), (6, ""), (1, "the erand thing HÉAN of of")]
    shards, docs = treap.index(frame(spark, given), **options[0])
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, treap.search(shards, docs, asked, k=4, **options[1]).collect()))
    assert got == slow_ranking(given, items[:-1], 4)


def test_grid_keeps_every_impact():
    rng = np.random.default_rng(0)
    for rows, columns in ((1, 1), (3, 50), (300, 5), (64, 64)):
        cells = np.unique(rng.integers(0, rows * columns, 80))
        row, column, impact = cells // columns, cells % columns, rng.integers(1, 1000, len(cells))
        grid = treap.Grid.built(row, column, impact).opened()
        for r in range(rows):
            if r in row:
                found, score = grid.best(np.array([r]), np.array([2]), 10**6)
                assert dict(zip(found.tolist(), score.tolist())) == dict(zip(column[row == r].tolist(), (2 * impact[row == r]).tolist()))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert phrases.collocations(none).count() == 0 and factors.remove_repeats(none).count() == 0
    shards, docs = treap.index(none)
    assert treap.search(shards, docs, spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_phrases", "op12_factors", "op13_ranked_search"])
def test_registered_queries_equal_their_sql(spark, name):
    from check_queries import compare, connect

    sf = "/root/testdata/sf0.001"
    problem, rows = compare(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLE[name])
    assert problem is None and rows, problem
