"""Batches of folder edits against the same edits applied one after the other."""

import random

import pytest

from quarry.operators import folder_edits as fe

FOLDERS, EDITS = "folder_id string, parent_id string, name string", "seq int, folder_id string, op string, new_parent_id string, new_name string"


def one_by_one(folders, docs, edits):
    at, home, out = {f: (p, n) for f, p, n in folders}, dict(docs), {}

    def above(f):
        while f is not None:
            yield f
            f = at[f][0]

    def taken(parent, name, but):
        return any(f != but and v == (parent, name) for f, v in at.items())

    for seq, f, op, parent, name in sorted(edits, key=lambda e: (e[0], e[1])):
        reason = None
        if f not in at:
            reason = fe.MISSING
        elif op == "move":
            if parent is not None and parent not in at:
                reason = fe.NO_PARENT
            elif f in set(above(parent)):
                reason = fe.CYCLE
            elif taken(parent, name, f):
                reason = fe.CLASH
            else:
                at[f] = (parent, name)
        else:
            children = [c for c, v in at.items() if v[0] == f]
            if op == "block" and (children or f in home.values()):
                reason = fe.FULL
            elif op == "reflow" and any(taken(at[f][0], at[c][1], c) for c in children):
                reason = fe.TAKEN
            elif op == "reflow":
                up = at[f][0]
                for c in children:
                    at[c] = (up, at[c][1])
                home = {d: up if h == f else h for d, h in home.items()}
                del at[f]
            else:
                gone = [c for c in at if f in set(above(c))]
                home = {d: None if h in gone else h for d, h in home.items()}
                for c in gone:
                    del at[c]
        out[seq] = reason
    return at, home, out


def both(spark, folders, docs, edits):
    got = fe.settle(spark.createDataFrame(folders, FOLDERS), spark.createDataFrame(docs, "doc_id int, folder_id string"), spark.createDataFrame(edits, EDITS))
    at = {r.folder_id: (r.parent_id, r.name) for r in got[0].collect()}
    return (at, {r.doc_id: r.folder_id for r in got[1].collect()}, {r.seq: r.reason for r in got[2].collect()}), one_by_one(folders, docs, edits)


TREE = [("root", None, "root"), ("a", "root", "a"), ("b", "root", "b"), ("a1", "a", "x"), ("b1", "b", "x"), ("a2", "a1", "deep")]
DOCS = [(1, "a"), (2, "a2"), (3, "b1"), (4, None)]


@pytest.mark.parametrize("edits", [
    [(1, "a", "move", "b", "a"), (2, "b", "move", "a", "b")],  # each below the other
    [(1, "a", "move", "root", "new"), (2, "b", "move", "root", "new"), (3, "a", "move", "root", "a"), (4, "b", "move", "root", "new")],
    [(1, "a", "reflow", None, None), (2, "b", "reflow", None, None)],  # both lift a child named x
    [(1, "a1", "reflow", None, None), (2, "a", "cascade", None, None), (3, "a2", "block", None, None), (4, "b1", "move", "a", "y"), (5, "b", "block", None, None)],
])
def test_dependent_edits(spark, edits):
    got, want = both(spark, TREE, DOCS, edits)
    assert got == want


def test_random_batch(spark):
    rng = random.Random(1)
    folders = [("f0", None, "n0")] + [(f"f{i}", f"f{rng.randrange(i)}", f"n{i}") for i in range(1, 12)]
    docs = [(d, rng.choice([*[f for f, _, _ in folders], None])) for d in range(10)]
    ids = [f for f, _, _ in folders] + ["gone"]
    edits = []
    for seq in range(9):
        op = rng.choice(["move", "move", "move", "block", "cascade", "reflow"])
        edits.append((seq, rng.choice(ids[5:]), op, rng.choice([*ids[:8], None]) if op == "move" else None, f"n{rng.randrange(6)}" if op == "move" else None))
    got, want = both(spark, folders, docs, edits)
    assert got == want
