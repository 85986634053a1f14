"""A batch of folder edits with the result of applying them one after the other.

Edits are ordered by ``seq``. Each reads and writes parts of the folder tree, named by keys: a folder, a name under a
parent, the content of a folder. An edit is ready when no earlier open edit touches one of its keys in a way that
matters (readers may share a key, and so may edits that only add to or take from a folder). All ready edits are
checked against the state and applied together, then the rest is looked at again on the new state, so there are as many
rounds as the longest chain of edits that depend on each other, and one edit at least is settled in each.

``op`` is ``move`` (to ``new_parent_id`` under ``new_name``; a rename keeps the parent), ``block`` (delete if empty), ``cascade`` (delete
with all folders below; documents go to the root) or ``reflow`` (delete; children and documents move up one level).
Unknown folders, parents and ops are refused; equal ``seq`` values are settled by folder id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.scope import closure, paths
from quarry.scale import hold, release

#: The reasons of refused edits.
MISSING, NO_PARENT = "Folder not found", "Target parent folder not found"
CYCLE, CLASH = "Cannot move a folder into itself or one of its descendants", "A folder with that name already exists here"
FULL, TAKEN, UNKNOWN = "folder is not empty", "name already exists in the parent folder", "unknown edit"


def _key(kind: str, *parts: Column) -> Column:
    """A text that names a part of the tree; null (the root) and empty names stay apart."""
    return F.concat(F.lit(kind), F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}))


def _keys(edits: DataFrame, folders: DataFrame, tree: DataFrame) -> DataFrame:
    """n (place of the edit), key, how (r: reads, w: writes, a: adds or takes)."""
    now = folders.select("folder_id", F.col("parent_id").alias("up"), F.col("name").alias("old_name"), F.lit(True).alias("there"))
    e = edits.join(now, "folder_id", "left")
    move, reflow, deletes = F.col("op") == "move", F.col("op") == "reflow", F.col("op").isin("block", "cascade", "reflow")
    known = F.coalesce("there", F.lit(False))

    def rows(df: DataFrame, *keys: tuple[str, Column, Column | None]) -> DataFrame:
        made = [F.when(cond if cond is not None else F.lit(True), F.struct(key.alias("key"), F.lit(how).alias("how"))) for how, key, cond in keys]
        return df.select("n", F.explode(F.array_compact(F.array(*made))).alias("k")).select("n", "k.key", "k.how")

    self_, up, target = F.col("folder_id"), F.col("up"), F.col("new_parent_id")
    own = rows(
        e, ("r", _key("f", self_), None), ("w", _key("f", self_), known),
        ("w", _key("n", up, F.col("old_name")), known), ("a", _key("c", up), known & up.isNotNull()),
        ("w", _key("n", target, F.col("new_name")), move), ("r", _key("n", target, F.col("new_name")), move),
        ("a", _key("c", target), move & target.isNotNull()), ("r", _key("f", target), move & target.isNotNull()),
        ("r", _key("c", self_), deletes), ("a", _key("c", self_), reflow),
    )
    # what stands above the folder (a cascade there removes it) or above the target (a move there may close a cycle)
    above = tree.filter("distance > 0").select(F.col("folder_id").alias("of"), "ancestor_id")
    from_ = e.select("n", F.explode(F.array_compact(F.array(F.col("folder_id"), F.when(move, target)))).alias("of"))
    higher = from_.join(above, "of").select("n", _key("f", F.col("ancestor_id")).alias("key"), F.lit("r").alias("how"))
    # a cascade takes all below, with what has been added there
    below = tree.filter("distance > 0").select(F.col("ancestor_id").alias("folder_id"), F.col("folder_id").alias("lower"))
    lost = e.filter(F.col("op") == "cascade").select("n", "folder_id").join(below, "folder_id")
    lost = rows(lost, ("w", _key("f", F.col("lower")), None), ("r", _key("c", F.col("lower")), None))
    # a reflow lifts the children
    children = folders.select(F.col("parent_id").alias("folder_id"), F.col("folder_id").alias("child"), F.col("name").alias("child_name"))
    lifted = e.filter(reflow).select("n", "folder_id", "up").join(children, "folder_id")
    lifted = rows(lifted, ("w", _key("f", F.col("child")), None), ("w", _key("n", up, F.col("child_name")), None), ("w", _key("n", self_, F.col("child_name")), None))
    return own.unionAll(higher).unionAll(lost).unionAll(lifted).distinct()


def ready(edits: DataFrame, folders: DataFrame, tree: DataFrame) -> DataFrame:
    """The edits that no earlier one of ``edits`` touches: first uses of each key are compared, never pairs of edits."""
    keys = hold(_keys(edits, folders, tree))
    first = lambda how: F.min(F.when(F.col("how") == how, F.col("n"))).alias(f"first_{how}")
    uses = keys.groupBy("key").agg(first("r"), first("w"), first("a"))
    seen = keys.join(uses, "key")
    before = lambda how: F.coalesce(F.col(f"first_{how}") < F.col("n"), F.lit(False))
    late = (F.col("how") == "r") & (before("w") | before("a")) | (F.col("how") == "w") & (before("r") | before("w") | before("a")) | (F.col("how") == "a") & (before("r") | before("w"))
    return edits.join(seen.filter(late).select("n").distinct(), "n", "left_anti")


def checked(edits: DataFrame, folders: DataFrame, docs: DataFrame, tree: DataFrame) -> DataFrame:
    """``edits`` (that do not touch each other) with ``reason``, null where an edit is fine."""
    there = folders.select("folder_id", F.col("parent_id").alias("up"), F.lit(True).alias("there"))
    parents = folders.select(F.col("folder_id").alias("new_parent_id"), F.lit(True).alias("parent_there"))
    inside = tree.select(F.col("ancestor_id").alias("folder_id"), F.col("folder_id").alias("new_parent_id"), F.lit(True).alias("cycle"))
    names = folders.select(F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("p"), F.col("parent_id").isNull().alias("top"), F.col("name").alias("m"), F.col("folder_id").alias("other"))
    used = folders.select(F.col("parent_id").alias("folder_id")).unionAll(docs.select("folder_id")).dropna().distinct().withColumn("used", F.lit(True))
    e = edits.join(there, "folder_id", "left").join(parents, "new_parent_id", "left").join(inside, ["folder_id", "new_parent_id"], "left").join(used, "folder_id", "left")
    of = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("p"), F.col(c).isNull().alias("top")]
    moved = e.filter(F.col("op") == "move").select("n", "folder_id", *of("new_parent_id"), F.col("new_name").alias("m"))
    clash = moved.join(names, ["p", "top", "m"]).filter(F.col("folder_id") != F.col("other")).select("n").distinct().withColumn("clash", F.lit(True))
    children = folders.select(F.col("parent_id").alias("folder_id"), F.col("folder_id").alias("child"), F.col("name").alias("m"))
    lifted = e.filter(F.col("op") == "reflow").select("n", "folder_id", *of("up")).join(children, "folder_id")
    taken = lifted.join(names, ["p", "top", "m"]).filter(F.col("child") != F.col("other")).select("n").distinct().withColumn("taken", F.lit(True))
    e = e.join(clash, "n", "left").join(taken, "n", "left")
    move = F.col("op") == "move"
    reason = (
        F.when(~F.col("op").isin("move", "block", "cascade", "reflow") | F.col("op").isNull(), UNKNOWN).when(F.col("there").isNull(), MISSING)
        .when(move & F.col("new_parent_id").isNotNull() & F.col("parent_there").isNull(), NO_PARENT).when(move & F.col("cycle"), CYCLE)
        .when(move & F.col("clash"), CLASH).when((F.col("op") == "block") & F.col("used"), FULL).when((F.col("op") == "reflow") & F.col("taken"), TAKEN)
    )
    return e.select(*edits.columns, reason.alias("reason"))


def applied(accepted: DataFrame, folders: DataFrame, docs: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders (without paths) and documents after edits that do not touch each other."""
    kind = folders.schema["folder_id"].dataType
    moves = accepted.filter(F.col("op") == "move").select("folder_id", "new_parent_id", "new_name", F.lit(True).alias("moved"))
    below = tree.join(accepted.filter(F.col("op") == "cascade").select(F.col("folder_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("folder_id").distinct()
    gone = hold(accepted.filter(F.col("op").isin("block", "reflow")).select("folder_id").unionAll(below).distinct())
    own = folders.select("folder_id", F.col("parent_id").alias("lift_to"))
    lifted = accepted.filter(F.col("op") == "reflow").select("folder_id").join(own, "folder_id").withColumn("lift", F.lit(True))
    kept = folders.join(gone, "folder_id", "left_anti").join(moves, "folder_id", "left")
    kept = kept.join(lifted.withColumnRenamed("folder_id", "parent_id"), "parent_id", "left")
    parent = F.when(F.col("moved"), F.col("new_parent_id")).when(F.col("lift"), F.col("lift_to")).otherwise(F.col("parent_id"))
    new_folders = kept.select("folder_id", parent.alias("parent_id"), F.when(F.col("moved"), F.col("new_name")).otherwise(F.col("name")).alias("name"))
    homes = below.select("folder_id", F.lit(None).cast(kind).alias("lift_to"), F.lit(True).alias("lift")).unionAll(lifted.select("folder_id", "lift_to", "lift"))
    new_docs = docs.join(homes, "folder_id", "left").select("doc_id", F.when(F.col("lift"), F.col("lift_to")).otherwise(F.col("folder_id")).alias("folder_id"))
    return new_folders, new_docs


def settle(folders: DataFrame, docs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply ``seq, folder_id, op, new_parent_id, new_name`` in the order of ``seq`` to ``folder_id, parent_id, name`` and ``doc_id, folder_id``.

    Returns the folders with rebuilt paths, the documents, and ``seq, folder_id, reason`` of every edit (null: done).
    """
    columns = ["seq", "folder_id", "op", "new_parent_id", "new_name"]
    # a place for each edit without one window over all: places compare like (seq, folder_id)
    open_ = hold(edits.select(*columns).withColumn("n", F.struct("seq", F.col("folder_id").cast("string"))))
    state, homes = hold(folders.select("folder_id", "parent_id", "name")), hold(docs.select("doc_id", "folder_id"))
    outcomes = []
    while not open_.isEmpty():
        tree = hold(closure(state))
        found = hold(checked(ready(open_, state, tree), state, homes, tree))
        outcomes.append(found.select("seq", "folder_id", "reason"))
        new_state, new_homes = applied(found.filter("reason is null"), state, homes, tree)
        before = (state, homes, open_, tree)
        state, homes = hold(new_state), hold(new_homes)
        open_ = hold(open_.join(found.select("n"), "n", "left_anti"))
        release(*before)
    if not outcomes:
        outcomes.append(open_.select("seq", "folder_id", F.lit(None).cast("string").alias("reason")))
    done = outcomes[0]
    for more in outcomes[1:]:
        done = done.unionAll(more)
    return state.join(paths(state, closure(state)), "folder_id"), homes, done
