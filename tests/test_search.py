"""Hand-computed values for analysis, index, ranked, Boolean and phrase retrieval."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.porter import stem
from quarry.operators import boolean as bo
from quarry.operators import highlight as hl
from quarry.operators import index as ix
from quarry.operators import phrase as ph
from quarry.operators import ranked as rk

TINY = {"d1": {"body": "ionic bond ionic"}, "d2": {"body": "covalent bond"}, "d3": {"body": "metal lattice"}}
TWO = {
    "d1": {"heading": "Ionic bonds", "body": "An ionic bond forms between a metal and a nonmetal."},
    "d2": {"heading": "Covalent bonds", "body": "The covalent bond shares electrons."},
    "d3": {"heading": "Covalent", "body": "A bond that is not covalent, and a covalent bond."},
    "d4": {"heading": "", "body": "Bond energy of covalent molecules"},
}


def build(spark, docs, **kw):
    rows = [(d, z, t) for d, zones in docs.items() for z, t in zones.items()]
    return ix.build(spark.createDataFrame(rows, "doc_id string, zone string, text string"), **kw)


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def ids(df):
    return [r.doc_id for r in df.orderBy("query_id", *(["rank"] if "rank" in df.columns else ["doc_id"])).collect()]


def test_porter_published_examples():
    words = (
        "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing "
        "conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file "
        "happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam operator oper "
        "feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formalize formal "
        "electrical electr goodness good revival reviv allowance allow replacement replac adjustment adjust adoption adopt "
        "communism commun effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll saying sai toy toi"
    ).split()
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_tokenize_folds_and_drops_underscores(spark):
    df = spark.createDataFrame([("Hello, WORLD! re-use x_y Straße ﬁne ２",)], "t string")
    assert df.select(tx.tokenize("t")).first()[0] == ["hello", "world", "re", "use", "x", "y", "strasse", "fine", "2"]


def test_analyze(spark):
    df = spark.createDataFrame([("The bonding of ionic bonds",), ("connected connection connecting",), ("the of and",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.terms_of("t")).collect()]
    assert got[:4] == [["bond", "ionic", "bond"], ["connect"] * 3, [], []]


def test_term_groups_equal_plain_python(spark):
    texts = ["a bond, the Bonds of bonding", "", "x y x y x", "the", "Ünïcode ünïcode"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    got = {(r.i, r.term): (r.positions, r.size, round(r.norm, 9)) for r in tx.term_rows(df).collect()}
    want = {}
    for i, t in enumerate(texts):
        toks = [w.strip(",").casefold() for w in t.split()]
        kept = [(stem(w), p) for p, w in enumerate(toks) if w not in tx.STOP_WORDS]
        groups = {}
        for term, p in kept:
            groups.setdefault(term, []).append(p)
        norm = math.sqrt(sum((1 + math.log10(len(p))) ** 2 for p in groups.values()))
        for term, p in groups.items():
            want[i, term] = (p, len(kept), round(norm, 9))
    assert got == want


def test_index_statistics(spark):
    index = build(spark, TINY)
    idf = {r.term: r.idf for r in index.dictionary.collect()}
    assert idf["ionic"] == pytest.approx(math.log10(3)) and idf["bond"] == pytest.approx(math.log10(1.5))
    assert index.zone_stats.first().avg_len == pytest.approx(7 / 3)
    row = index.postings.filter("term = 'ionic'").first()
    assert (row.doc_id, row.positions, row.tf) == ("d1", [0, 2], 2)
    assert ix.statistics(index).first().vocabulary_size == 5


def test_positions_keep_stop_word_gaps(spark):
    index = build(spark, {"a": {"body": "rules of thumb"}})
    assert index.postings.filter("term = 'thumb'").first().positions == [2]


def test_duplicate_document_keeps_last(spark):
    rows = [("d", "body", "old words", 1), ("d", "body", "new", 2)]
    zones = spark.createDataFrame(rows, "doc_id string, zone string, text string, v int")
    assert [r.term for r in ix.build(zones, order_by="v").postings.collect()] == ["new"]


def test_tfidf_and_bm25_values(spark):
    index = build(spark, TINY)
    t = {r.doc_id: r.score for r in rk.search(index, ask(spark, "ionic bonds"), scheme="tfidf").collect()}
    assert t["d1"] == pytest.approx(0.954818, abs=1e-6) and t["d2"] == pytest.approx(0.244830, abs=1e-6)
    b = {r.doc_id: r.score for r in rk.search(index, ask(spark, "ionic bond")).collect()}
    assert b["d1"] == pytest.approx(0.764908, abs=1e-6) and b["d2"] == pytest.approx(0.187021, abs=1e-6)


def test_ties_and_cutoffs(spark):
    index = build(spark, {d: {"body": "apple"} for d in "zyx"} | {"w": {"body": "pear"}})
    assert ids(rk.search(index, ask(spark, "apple"), k=2)) == ["x", "y"]
    assert ids(rk.search(index, ask(spark, "apple"), k=10)) == ["x", "y", "z"]
    assert ids(rk.search(index, ask(spark, "apple"), k=0)) == []


def test_champions_restrict_documents(spark):
    docs = {"a": {"body": "cat cat cat"}, "b": {"body": "cat dog mouse bird"}, "c": {"body": "cat dog"}, "d": {"body": "fish"}}
    index = build(spark, docs, champion_r=1)
    assert ids(rk.search(index, ask(spark, "cat"), use_champions=True)) == ["a"]
    assert ids(rk.search(index, ask(spark, "cat"))) == ["a", "c", "b"]


def test_index_elimination(spark):
    index = build(spark, TINY)
    rows = rk.search(index, ask(spark, "ionic bond"), idf_threshold=0.3, explain=True).collect()
    assert {e.term for r in rows for e in r.explanation} == {"ionic"}
    everywhere = build(spark, {"a": {"body": "salt"}, "b": {"body": "salt"}})
    assert rk.search(everywhere, ask(spark, "salt")).count() == 0


def test_zone_weights_and_explanation(spark):
    docs = {"h": {"heading": "bond", "body": "filler"}, "b": {"heading": "filler", "body": "bond"}, "x": {"heading": "other", "body": "other"}}
    index = build(spark, docs)
    rows = rk.search(index, ask(spark, "bond"), zone_weights={"heading": 2.0, "body": 1.0}, explain=True).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["h", "b"] and rows[0].score == pytest.approx(2 * rows[1].score)
    assert all(r.score == pytest.approx(sum(e.weight for e in r.explanation)) for r in rows)
    assert ids(rk.search(index, ask(spark, "bond"), zone_weights={"heading": 1.0, "body": 2.0})) == ["b", "h"]
    assert ids(rk.search(index, ask(spark, "bond"), zone_weights={"heading": 1.0, "body": 0.0})) == ["h"]


def test_salted_join_gives_the_broadcast_result(spark, monkeypatch):
    index = build(spark, TWO)
    want = sorted(map(tuple, rk.search(index, ask(spark, "covalent bond", "ionic"), k=5).collect()))
    monkeypatch.setattr(rk, "is_small", lambda *a, **k: False)
    got = sorted(map(tuple, rk.search(index, ask(spark, "covalent bond", "ionic"), k=5).collect()))
    assert got == want


def test_stored_index_and_refresh_equal_a_rebuild(spark, tmp_path):
    index = build(spark, TWO)
    ix.save(index, str(tmp_path / "i"))
    stored = ix.load(spark, str(tmp_path / "i"))
    q = ask(spark, "covalent bond", "metal")
    show = lambda i: sorted(map(tuple, rk.search(i, q).collect()))
    assert show(stored) == show(index) == show(ix.held(index))
    changed = spark.createDataFrame([("d4", "heading", ""), ("d4", "body", "metal metal")], "doc_id string, zone string, text string")
    fresh = build(spark, {**TWO, "d4": {"heading": "", "body": "metal metal"}})
    assert show(ix.refresh(index, changed)) == show(fresh)


def test_pair_cosine(spark):
    index = build(spark, TINY)
    pairs = spark.createDataFrame([(1, "ionic bond", "ionic bonds"), (2, "ionic", "covalent"), (3, "the of", "ionic")], "pair_id int, text_a string, text_b string")
    got = {r.pair_id: r.score for r in rk.pair_cosine(index, pairs).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 0.0


BOOL_DOCS = {"1": {"body": "ionic bond salt"}, "2": {"body": "covalent bond"}, "3": {"body": "metal lattice"}, "4": {"body": "gas"}}


@pytest.mark.parametrize("query, want", [
    ("ionic AND bond", "1"), ("covalent OR lattice", "23"), ("bond AND NOT salt", "2"), ("NOT bond", "34"),
    ("ionic AND bond OR gas", "14"), ("unseen AND bond", ""), ("ionic bond", "1"), ("NOT NOT bond", "12"), ("the", ""),
])
def test_boolean(spark, query, want):
    assert ids(bo.search(build(spark, BOOL_DOCS), ask(spark, query))) == list(want)


@pytest.mark.parametrize("query, ok", [
    ("AND NOT", False), ("AND bond", False), ("bond OR", False), ("bond NOT", False), ("hydrogen AND (bond", False),
    ("a OR AND b", False), ("NOT AND x", False), ("", False), ("bond", True), ("a AND NOT b", True), ("NOT x", True), ("a OR NOT b c", True),
])
def test_boolean_validation(spark, query, ok):
    good, bad = bo.split_valid(ask(spark, query))
    assert (good.count(), bad.count()) == ((1, 0) if ok else (0, 1))


def test_boolean_trace_reports_the_result(spark):
    index, q = build(spark, BOOL_DOCS), ask(spark, "ionic bond OR covalent NOT salt")
    steps = bo.trace(index, q).orderBy("clause", "step").collect()
    assert [s.op for s in steps] == ["START", "AND", "OR", "START", "AND NOT", "OR"]
    assert steps[-1].result_size == bo.search(index, q).count() == 2


def test_phrase(spark):
    index = build(spark, {"p": {"body": "salt water is wet"}, "q": {"body": "water with salt"}})
    assert ids(ph.search(index, ask(spark, "salt water"))) == ["p"]
    assert ids(ph.search(index, ask(spark, "water salt"))) == []
    gaps = build(spark, {"a": {"body": "rules of thumb"}, "b": {"body": "rules thumb"}})
    assert ids(ph.search(gaps, ask(spark, "rules of thumb"))) == ["a"]
    assert ids(ph.search(gaps, ask(spark, "rules thumb"))) == ["b"]


def test_phrase_trace(spark):
    rows = {r.zone: r for r in ph.trace(build(spark, TWO), ask(spark, '"covalent bond"')).collect()}
    assert (rows["body"].candidates, rows["body"].matched) == (3, 2)
    assert (rows["heading"].candidates, rows["heading"].matched) == (1, 1)


def test_highlights_and_snippet(spark):
    text = "filler " * 80 + "Ionic Bonds here " + "tail " * 80
    df = spark.createDataFrame([(text, ["bond", "ionic"])], "text string, matched_terms array<string>")
    row = hl.surface_forms(df).select("highlights", hl.snippet("text", F.col("highlights")).alias("s")).first()
    assert row.highlights == ["Ionic", "Bonds"]
    start = text.index("Ionic") - 106
    assert row.s == "…" + text[start:start + 320].strip() + "…"
    spans = spark.createDataFrame([("one, two  three", [1])], "text string, p array<int>").select(
        hl.phrase_spans("text", F.col("p"), F.lit(2))).first()[0]
    assert [(s.start, s.end) for s in spans] == [(5, 15)]


def test_web_search_negated_phrase_alternatives_and_plain_not(spark):
    from quarry.operators import fulltext as ft

    texts = ["apple pear", "apple grape melon", "apple melon grape", "kiwi plum", "plum kiwi", "fig"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    index = ix.held(ix.build(ix.zone_rows(docs, {"body": F.col("text")})))
    queries = ['apple -"grape melon"', '"kiwi plum" or fig', "apple NOT melon", "apple -melon", '"plum kiwi" or "kiwi plum" -fig', "pear or"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    got = {}
    for r in ft.search(index, asked, 10).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {0: {1, 3}, 1: {4, 6}, 2: {2, 3}, 3: {1}, 4: {4, 5}, 5: {1}}
