"""Who may see what: tags, roles and folder trees as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scale import hold, lookup_join

MAX_DOUBLINGS = 40


# ---- folder trees ----------------------------------------------------------------------


def closure(folders: DataFrame) -> DataFrame:
    """``folder_id, ancestor_id, distance`` of every folder, itself included.

    Distances double each round, so a tree of depth d needs log2(d) joins; each round is held
    in the shared folder. One look at a round tells both whether it reached further and whether it met a cycle.
    """
    known = folders.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    jump = folders.filter("parent_id is not null").select("folder_id", F.col("parent_id").alias("via"))
    span = 1
    for _ in range(MAX_DOUBLINGS):
        above = known.select(F.col("folder_id").alias("via"), "ancestor_id", "distance")
        further = jump.join(above, "via").select("folder_id", "ancestor_id", (F.col("distance") + span).alias("distance"))
        known = hold(known.unionByName(further))
        seen = known.agg(F.max("distance").alias("far"), F.bool_or((F.col("folder_id") == F.col("ancestor_id")) & (F.col("distance") > 0)).alias("cycle")).first()
        if seen["cycle"]:
            break  # a folder above itself: the rows would double every round
        if seen["far"] is None or seen["far"] < span:
            return known
        next_hop = jump.select(F.col("folder_id").alias("via"), F.col("via").alias("far"))
        jump = hold(jump.join(next_hop, "via").select("folder_id", F.col("far").alias("via")))
        span *= 2
    raise ValueError("the folder table contains a cycle")


def subtree(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """``root_id, folder_id, level`` of each root's descendants, parents before children."""
    below = tree.select(F.col("ancestor_id").alias("root_id"), "folder_id", F.col("distance").alias("level"))
    return below.join(roots.select(F.col("folder_id").alias("root_id")).distinct(), "root_id", "left_semi").orderBy("root_id", "level", "folder_id")


def paths(folders: DataFrame, tree: DataFrame) -> DataFrame:
    """``folder_id, path`` from current parents and names, never from an older path."""
    names = folders.select(F.col("folder_id").alias("ancestor_id"), "name")
    chain = tree.join(names, "ancestor_id")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    return chain.groupBy("folder_id").agg(F.array_join(F.transform(steps, lambda s: s["name"]), "/").alias("path"))


def check_edits(folders: DataFrame, tree: DataFrame, edits: DataFrame) -> DataFrame:
    """Add ``reason`` to ``folder_id, new_parent_id, new_name``: a move below itself, or a
    sibling with the same name; null when the edit is fine."""
    inside = tree.select(F.col("ancestor_id").alias("folder_id"), F.col("folder_id").alias("new_parent_id"), F.lit(True).alias("cycle"))
    taken = folders.select(F.col("folder_id").alias("other"), F.col("parent_id").alias("_p"), F.col("name").alias("_n"))
    same = edits["new_parent_id"].eqNullSafe(taken["_p"]) & (edits["new_name"] == taken["_n"]) & (edits["folder_id"] != taken["other"])
    clash = edits.join(taken, same, "left_semi").select("folder_id", F.lit(True).alias("clash"))
    checked = edits.join(inside, ["folder_id", "new_parent_id"], "left").join(clash, "folder_id", "left")
    reason = F.when(F.col("cycle"), "Cannot move a folder into itself or one of its descendants").when(
        F.col("clash"), "A folder with that name already exists here")
    return checked.select(*edits.columns, reason.alias("reason"))


def apply_edits(folders: DataFrame, accepted: DataFrame) -> DataFrame:
    """Folders after moves and renames, with rebuilt paths."""
    new = accepted.select("folder_id", "new_parent_id", "new_name", F.lit(True).alias("_e"))
    moved = folders.join(new, "folder_id", "left").select(
        "folder_id", F.when(F.col("_e"), F.col("new_parent_id")).otherwise(F.col("parent_id")).alias("parent_id"),
        F.when(F.col("_e"), F.col("new_name")).otherwise(F.col("name")).alias("name"))
    return moved.join(paths(moved, closure(moved)), "folder_id")


def delete_folders(folders: DataFrame, docs: DataFrame, tree: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply ``folder_id, mode`` deletions; returns folders, documents and rejected edits.

    block: only an empty folder goes. cascade: the subtree goes and its documents move to the
    root. reflow: children and documents move up one level unless a name is taken there. An
    edit inside another edit's subtree is rejected and can be sent in a later batch.
    """
    target = edits.select("folder_id", "mode")
    above = tree.filter("distance > 0").join(target.select(F.col("folder_id").alias("ancestor_id")), "ancestor_id", "left_semi")
    nested = target.join(above.select("folder_id").distinct(), "folder_id", "left_semi").select("folder_id", F.lit("nested edit").alias("reason"))
    used = folders.select(F.col("parent_id").alias("folder_id")).union(docs.select("folder_id")).dropna().distinct()
    full = target.filter("mode = 'block'").join(used, "folder_id", "left_semi").select("folder_id", F.lit("folder is not empty").alias("reason"))
    reflow = target.filter("mode = 'reflow'").select("folder_id")
    own = folders.select("folder_id", F.col("parent_id").alias("up"))
    children = folders.select(F.col("folder_id").alias("child"), F.col("parent_id").alias("folder_id"), "name").join(reflow, "folder_id", "left_semi").join(own, "folder_id")
    there = folders.select(F.col("folder_id").alias("other"), F.col("parent_id").alias("_p"), F.col("name").alias("_n"))
    taken = children.join(there, children["up"].eqNullSafe(there["_p"]) & (children["name"] == there["_n"]) & (children["child"] != there["other"]), "left_semi")
    clash = taken.select("folder_id").distinct().withColumn("reason", F.lit("name already exists in the parent folder"))
    rejected = hold(target.join(nested.union(full).union(clash).groupBy("folder_id").agg(F.min("reason").alias("reason")), "folder_id"))
    accepted = hold(target.join(rejected.select("folder_id"), "folder_id", "left_anti"))

    cascade = tree.join(accepted.filter("mode = 'cascade'").select(F.col("folder_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("folder_id")
    gone = accepted.filter("mode <> 'cascade'").select("folder_id").union(cascade).distinct()
    lifted = accepted.filter("mode = 'reflow'").join(own, "folder_id").select("folder_id", "up", F.lit(True).alias("_lift"))
    kept = folders.join(gone, "folder_id", "left_anti").join(lifted.withColumnRenamed("folder_id", "parent_id"), "parent_id", "left")
    new_folders = kept.select("folder_id", F.when(F.col("_lift"), F.col("up")).otherwise(F.col("parent_id")).alias("parent_id"), "name")
    moves = cascade.select("folder_id", F.lit(None).cast(folders.schema["folder_id"].dataType).alias("up"), F.lit(True).alias("_lift")).union(lifted)
    new_docs = lookup_join(docs, moves, ["folder_id"], ["doc_id"], "left").select(
        "doc_id", F.when(F.col("_lift"), F.col("up")).otherwise(F.col("folder_id")).alias("folder_id"))
    return new_folders, new_docs, rejected


# ---- gating ----------------------------------------------------------------------------


def controlling_tags(role_tags: DataFrame) -> DataFrame:
    """Tags granted to any role: only these gate anything."""
    return role_tags.select("tag_id").distinct()


def granted_tags(user_roles: DataFrame, role_tags: DataFrame) -> DataFrame:
    """``user_id, tag_id`` through the user's roles."""
    return user_roles.join(role_tags, "role_id").select("user_id", "tag_id").distinct()


def effective_folder_tags(tree: DataFrame, folder_tags: DataFrame) -> DataFrame:
    """Own tags and those of every ancestor."""
    tags = folder_tags.withColumnRenamed("folder_id", "ancestor_id")
    return tree.join(tags, "ancestor_id").select("folder_id", "tag_id").distinct()


def document_gates(docs: DataFrame, folder_effective: DataFrame, doc_tags: DataFrame, controlling: DataFrame) -> DataFrame:
    """``doc_id, tag_id``: the controlling tags of each document, inherited or its own."""
    inherited = lookup_join(docs.select("doc_id", "folder_id"), folder_effective, ["folder_id"], ["doc_id"]).select("doc_id", "tag_id")
    return inherited.union(doc_tags.select("doc_id", "tag_id")).distinct().join(controlling, "tag_id", "left_semi").select("doc_id", "tag_id")


def can_access(requests: DataFrame, users: DataFrame, gates: DataFrame, granted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decide a table of ``user_id, <key>`` requests: add ``allowed``.

    Administrators see everything; an ungated item is open; a gated one needs one granted tag.
    The answer stays in this factored form because user x document would list every open item
    once per user.
    """
    asked = requests.select("user_id", key).distinct()
    paired = asked.join(gates, key)
    opened = paired.join(granted, ["user_id", "tag_id"], "left_semi").select("user_id", key).distinct().withColumn("_ok", F.lit(True))
    gated = gates.select(key).distinct().withColumn("_gated", F.lit(True))
    rows = asked.join(gated, key, "left").join(opened, ["user_id", key], "left")
    rows = rows.join(users.select("user_id", "is_admin"), "user_id", "left")
    allowed = F.coalesce("is_admin", F.lit(False)) | F.col("_gated").isNull() | F.col("_ok").isNotNull()
    return rows.select("user_id", key, allowed.alias("allowed"))


def allowed_items(items: DataFrame, gates: DataFrame, granted: DataFrame, user_id, is_admin: bool = False, key: str = "doc_id") -> DataFrame:
    """Items one user may see."""
    if is_admin:
        return items.select(key)
    mine = granted.filter(F.col("user_id") == user_id).select("tag_id")
    opened = gates.join(mine, "tag_id", "left_semi").select(key)
    closed = gates.select(key).join(opened, key, "left_anti").distinct()
    return items.select(key).join(closed, key, "left_anti")


# ---- notebooks and small rules -----------------------------------------------------------


def notebook_scope(notebook_docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Notebook documents that the asking user may see: notebook_id, user_id, doc_id."""
    return notebook_docs.join(decisions.filter("allowed"), ["user_id", "doc_id"], "left_semi")


def visible_notebooks(notebooks: DataFrame, shares: DataFrame) -> DataFrame:
    """``user_id, notebook_id``: created by or shared with the user; no administrator bypass."""
    own = notebooks.select(F.col("created_by").alias("user_id"), "notebook_id")
    return own.union(shares.select("user_id", "notebook_id")).distinct()


def with_uploader(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Attach the uploader's email."""
    return docs.join(users.select(F.col("user_id").alias("uploaded_by"), F.col("email").alias("uploader_email")), "uploaded_by", "left")


def attach(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert bridge rows that are not stored yet."""
    return stored.unionByName(new).dropDuplicates(keys)
