"""Folder trees, access, history, limits and continuous ingestion."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import conversations as cv
from quarry.operators import outline as ol
from quarry.operators import scope as ac
from quarry.operators import synthesis as sy
from quarry.streaming import ingestion as si
from quarry.streaming import limits as st


def folders(spark, rows):
    return spark.createDataFrame(rows, "folder_id string, parent_id string, name string")


def test_cycle_is_found_within_a_few_rounds(spark):
    with pytest.raises(ValueError, match="cycle"):
        ac.closure(folders(spark, [("a", "c", "a"), ("b", "a", "b"), ("c", "b", "c"), ("d", None, "d")]))


def test_deep_closure_and_cycle(spark, monkeypatch):
    f = folders(spark, [(f"f{i}", f"f{i - 1}" if i else None, f"n{i}") for i in range(11)])
    tree = ac.closure(f)
    assert tree.count() == 66 and tree.filter("folder_id = 'f10' AND ancestor_id = 'f0'").first().distance == 10
    assert ac.paths(f, tree).filter("folder_id = 'f2'").first().path == "n0/n1/n2"
    monkeypatch.setattr(ac, "MAX_DOUBLINGS", 3)
    with pytest.raises(ValueError):
        ac.closure(folders(spark, [("a", "b", "a"), ("b", "a", "b")]))


def test_edit_checks(spark):
    f = folders(spark, [("hr", None, "HR"), ("ha", None, "HR-Archive"), ("c", "hr", "C"), ("d", "c", "D")])
    e = spark.createDataFrame([("hr", "d", "HR"), ("ha", None, "HR"), ("c", "ha", "C"), ("d", None, "Free")], "folder_id string, new_parent_id string, new_name string")
    got = {r.folder_id: r.reason for r in ac.check_edits(f, ac.closure(f), e).collect()}
    assert got["hr"].startswith("Cannot move") and got["ha"].startswith("A folder") and got["c"] is None and got["d"] is None
    moved = ac.apply_edits(f, e.filter("folder_id = 'c'"))
    assert {r.folder_id: r.path for r in moved.collect()} == {"hr": "HR", "ha": "HR-Archive", "c": "HR-Archive/C", "d": "HR-Archive/C/D"}


def test_gating(spark):
    f = folders(spark, [("p", None, "p"), ("c", "p", "c"), ("o", None, "o")])
    eff = ac.effective_folder_tags(ac.closure(f), spark.createDataFrame([("p", "t1"), ("o", "free")], "folder_id string, tag_id string"))
    roles = spark.createDataFrame([("r1", "t1"), ("r2", "t2")], "role_id string, tag_id string")
    docs = spark.createDataFrame([(1, "c"), (2, "o"), (3, None), (4, None)], "doc_id int, folder_id string")
    gates = ac.document_gates(docs, eff, spark.createDataFrame([(4, "t2")], "doc_id int, tag_id string"), ac.controlling_tags(roles))
    granted = ac.granted_tags(spark.createDataFrame([("u1", "r1")], "user_id string, role_id string"), roles)
    users = spark.createDataFrame([("u1", False), ("u2", False), ("boss", True)], "user_id string, is_admin boolean")
    asks = spark.createDataFrame([(u, d) for u in ("u1", "u2", "boss") for d in (1, 2, 3, 4)], "user_id string, doc_id int")
    seen = {(r.user_id, r.doc_id) for r in ac.can_access(asks, users, gates, granted).filter("allowed").collect()}
    assert seen == {("u1", 1), ("u1", 2), ("u1", 3), ("u2", 2), ("u2", 3)} | {("boss", d) for d in (1, 2, 3, 4)}
    assert {r.doc_id for r in ac.allowed_items(docs, gates, granted, "u1").collect()} == {1, 2, 3}


def test_delete_modes(spark):
    f = folders(spark, [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", None, "X"), ("y", "x", "A"), ("e", None, "E")])
    docs = spark.createDataFrame([(1, "c"), (2, "b"), (3, "a")], "doc_id int, folder_id string")
    run = lambda *e: ac.delete_folders(f, docs, ac.closure(f), spark.createDataFrame(list(e), "folder_id string, mode string"))
    kept, moved, bad = run(("b", "reflow"), ("x", "reflow"), ("e", "block"))
    assert {r.folder_id: r.parent_id for r in kept.collect()} == {"a": None, "c": "a", "x": None, "y": "x"}
    assert {r.doc_id: r.folder_id for r in moved.collect()} == {1: "c", 2: "a", 3: "a"}
    assert {r.folder_id for r in bad.collect()} == {"x"}
    assert {r.folder_id for r in run(("a", "block"), ("c", "cascade"))[2].collect()} == {"a", "c"}


def test_history_order(spark):
    m = spark.createDataFrame([(2, 1, "assistant", "A", 5), (1, 1, "user", "Q", 5), (3, 1, "user", "Q2", 6)], "message_id int, conversation_id int, role string, content string, created_at int")
    assert [r.message_id for r in cv.history(m).collect()] == [1, 2, 3]
    assert cv.answered_questions(m).first().question == "Q"


def test_relevance_and_verdicts(spark):
    df = spark.createDataFrame([("NOT_RELEVANT.",), (' not_relevant!"',), ("",), ("fact",), ("NOT_RELEVANT but",)], "e string")
    assert [r[0] for r in df.select(sy.is_relevant("e")).collect()] == [False, False, False, True, True]
    v = spark.createDataFrame([(" broad\n",), ("BROAD.",), (None,)], "v string")
    assert [r[0] for r in v.select(sy.is_broad("v")).collect()] == [True, False, False]


def events(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(seconds=s), k) for i, (s, k) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, key string")


def test_boundary_burst_is_rejected(spark):
    rows = [(59.999, "a")] * 5 + [(60.001, "a")] * 5 + [(119.9, "b")] * 4 + [(60.5, "c")] * 2
    got = [r.allowed for r in st.admissions(events(spark, rows), "key", 5, 60).orderBy("event_id").collect()]
    assert got == [True] * 5 + [False] * 5 + [True] * 4 + [True] * 2
    late = [(59.999, "a")] * 5 + [(119.9, "a")] * 5
    assert sum(r.allowed for r in st.admissions(events(spark, late), "key", 5, 60).collect()) >= 9


def test_second_limit_counts_only_survivors(spark):
    e = events(spark, [(1, "a")] * 4).withColumn("ip", F.lit("i"))
    got = [r.allowed for r in st.two_limits(e, ("key", 3), ("ip", 2), 60).orderBy("event_id").collect()]
    assert got == [True, True, False, False]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id")
    for i, cut in enumerate(["< '2024-01-11'", ">= '2024-01-11'"]):
        e.filter(f"ts {cut}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    source = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in" / "part=*"))
    out = st.stream_admissions(source, "user_id", 2, 86_400)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.event_id: r.allowed for r in st.admissions(e, "user_id", 2, 86_400).collect()}


def test_replayed_batches_change_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "# A\none two", 1), (2, "plain", 1), (1, "# A\none two", 1)], "doc_id int, text string, page_count int")
    path = str(tmp_path / "store")
    for epoch in (0, 0, 1):
        si.store_batch(d, epoch, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    want = ol.structure(d.dropDuplicates(["doc_id"]))[1]
    assert sorted(r.chunk_id for r in chunks.collect()) == sorted(r.chunk_id for r in want.collect())
