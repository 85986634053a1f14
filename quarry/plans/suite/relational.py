"""Registered queries: scope (AC), conversations (CV), synthesis (MR), judging (EV18-EV22), streams (ST)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.operators import conversations as cv
from quarry.operators import folder_edits as fe
from quarry.operators import judged as jd
from quarry.operators import scope as ac
from quarry.operators import synthesis as sy
from quarry.plans.suite.common import query, r6, table
from quarry.plans.suite.ingestion import CHUNKS, PAGES, TREE, parts
from quarry.operators import ingest as ig
from quarry.sources import io
from quarry.streaming import ingestion as si
from quarry.streaming import limits as st

# Folder tree: root, regions, nations, market segments per nation; customers are the documents.
FOLDERS = """folders AS (SELECT 'root' AS folder_id, CAST(NULL AS VARCHAR) AS parent_id, 'root' AS name
UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT DISTINCT 's' || c_nationkey || '-' || c_mktsegment, 'n' || c_nationkey, c_mktsegment FROM customer),
ftags AS (SELECT 'r' || r_regionkey AS folder_id, 'reg' || r_regionkey AS tag_id FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT 'n' || n_nationkey, 'nat' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0),
docs AS (SELECT c_custkey AS doc_id, 's' || c_nationkey || '-' || c_mktsegment AS folder_id FROM customer),
dtags AS (SELECT c_custkey AS doc_id, 'vip' AS tag_id FROM customer WHERE c_acctbal > 9000),
rtags AS (SELECT 'role' || n_nationkey AS role_id, 'nat' || n_nationkey AS tag_id FROM nation UNION ALL SELECT 'boss', 'vip' UNION ALL SELECT 'region0', 'reg0'),
uroles AS (SELECT s_suppkey AS user_id, 'role' || s_nationkey AS role_id FROM supplier UNION ALL SELECT s_suppkey, 'boss' FROM supplier WHERE s_acctbal > 5000
UNION ALL SELECT s_suppkey, 'region0' FROM supplier WHERE s_suppkey % 7 = 0),
users AS (SELECT s_suppkey AS user_id, s_suppkey % 10 = 0 AS is_admin, lower(s_name) AS email FROM supplier)"""
GATES = "WITH RECURSIVE " + FOLDERS + """, tree AS (SELECT folder_id, folder_id AS ancestor_id, 0 AS distance FROM folders
UNION ALL SELECT t.folder_id, f.parent_id, t.distance + 1 FROM tree t JOIN folders f ON f.folder_id = t.ancestor_id WHERE f.parent_id IS NOT NULL),
eff AS (SELECT DISTINCT t.folder_id, g.tag_id FROM tree t JOIN ftags g ON g.folder_id = t.ancestor_id),
ctl AS (SELECT DISTINCT tag_id FROM rtags), granted AS (SELECT DISTINCT user_id, tag_id FROM uroles JOIN rtags USING (role_id)),
gates AS (SELECT DISTINCT doc_id, tag_id FROM (SELECT d.doc_id, e.tag_id FROM docs d JOIN eff e USING (folder_id) UNION SELECT doc_id, tag_id FROM dtags) SEMI JOIN ctl USING (tag_id)),
req AS (SELECT DISTINCT l_suppkey AS user_id, o_custkey AS doc_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
dec AS (SELECT r.user_id, r.doc_id, u.is_admin OR NOT EXISTS (SELECT 1 FROM gates g WHERE g.doc_id = r.doc_id)
  OR EXISTS (SELECT 1 FROM gates g JOIN granted x USING (tag_id) WHERE g.doc_id = r.doc_id AND x.user_id = r.user_id) AS allowed FROM req r JOIN users u USING (user_id))"""


def _union(*parts_):
    return reduce(lambda a, b: a.unionByName(b), parts_)


def _key(prefix, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _segment():
    return F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment"))


def folders(spark, sf):
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    root = region.limit(1).select(F.lit("root").alias("folder_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("name"))
    return _union(
        root, region.select(_key("r", "r_regionkey").alias("folder_id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name")),
        nation.select(_key("n", "n_nationkey").alias("folder_id"), _key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")),
        customer.select(_segment().alias("folder_id"), _key("n", "c_nationkey").alias("parent_id"), F.col("c_mktsegment").alias("name")).distinct())


def folder_tags(spark, sf):
    return _union(
        table(spark, sf, "region").filter("r_regionkey % 2 = 0").select(_key("r", "r_regionkey").alias("folder_id"), _key("reg", "r_regionkey").alias("tag_id")),
        table(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(_key("n", "n_nationkey").alias("folder_id"), _key("nat", "n_nationkey").alias("tag_id")))


def documents(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), _segment().alias("folder_id"))


def doc_tags(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("doc_id"), F.lit("vip").alias("tag_id"))


def role_tags(spark, sf):
    nation = table(spark, sf, "nation")
    fixed = F.inline(F.array(F.struct(F.lit("boss").alias("role_id"), F.lit("vip").alias("tag_id")), F.struct(F.lit("region0").alias("role_id"), F.lit("reg0").alias("tag_id"))))
    return nation.select(_key("role", "n_nationkey").alias("role_id"), _key("nat", "n_nationkey").alias("tag_id")).unionByName(
        nation.filter("n_nationkey = 0").select(fixed))


def user_roles(spark, sf):
    s = table(spark, sf, "supplier")
    u = F.col("s_suppkey").alias("user_id")
    return _union(s.select(u, _key("role", "s_nationkey").alias("role_id")), s.filter("s_acctbal > 5000").select(u, F.lit("boss").alias("role_id")),
                  s.filter("s_suppkey % 7 = 0").select(u, F.lit("region0").alias("role_id")))


def users(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 10 == 0).alias("is_admin"), F.lower("s_name").alias("email"))


def requests(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_suppkey").alias("user_id"), F.col("o_custkey").alias("doc_id")).distinct()


def effective(spark, sf):
    return ac.effective_folder_tags(ac.closure(folders(spark, sf)), folder_tags(spark, sf))


def gates(spark, sf):
    return ac.document_gates(documents(spark, sf), effective(spark, sf), doc_tags(spark, sf), ac.controlling_tags(role_tags(spark, sf)))


def granted(spark, sf):
    return ac.granted_tags(user_roles(spark, sf), role_tags(spark, sf))


@query("ac1_tenant_filter", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def ac1(spark, sf):
    return io.scoped(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "org_id"), 3).select("c_custkey")


@query("ac2_controlling_tags", GATES + " SELECT tag_id FROM ctl")
def ac2(spark, sf):
    return ac.controlling_tags(role_tags(spark, sf))


@query("ac3_granted_tags", GATES + " SELECT user_id, tag_id FROM granted")
def ac3(spark, sf):
    return granted(spark, sf)


@query("ac4_effective_folder_tags", GATES + " SELECT folder_id, tag_id FROM eff")
def ac4(spark, sf):
    return effective(spark, sf)


@query("ac5_access_decisions", GATES + " SELECT user_id, doc_id, allowed FROM dec")
def ac5(spark, sf):
    return ac.can_access(requests(spark, sf), users(spark, sf), gates(spark, sf), granted(spark, sf))


@query("ac5_allowed_documents", GATES + """ SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM gates) OR doc_id IN
(SELECT doc_id FROM gates JOIN granted USING (tag_id) WHERE user_id = 5)""")
def ac5_user(spark, sf):
    return ac.allowed_items(documents(spark, sf), gates(spark, sf), granted(spark, sf), 5)


FREQ = GATES + """, fg AS (SELECT folder_id, tag_id FROM eff SEMI JOIN ctl USING (tag_id)),
fr AS (SELECT DISTINCT r.user_id, d.folder_id FROM req r JOIN docs d USING (doc_id))
SELECT r.user_id, r.folder_id, u.is_admin OR NOT EXISTS (SELECT 1 FROM fg WHERE fg.folder_id = r.folder_id)
OR EXISTS (SELECT 1 FROM fg JOIN granted x USING (tag_id) WHERE fg.folder_id = r.folder_id AND x.user_id = r.user_id) AS allowed FROM fr r JOIN users u USING (user_id)"""


@query("ac6_accessible_folders", FREQ)
def ac6(spark, sf):
    fg = effective(spark, sf).join(ac.controlling_tags(role_tags(spark, sf)), "tag_id", "left_semi")
    asked = requests(spark, sf).join(documents(spark, sf), "doc_id").select("user_id", "folder_id")
    return ac.can_access(asked, users(spark, sf), fg, granted(spark, sf), "folder_id")


@query("ac7_notebook_scope", GATES + """ SELECT n.notebook_id, n.user_id, n.doc_id FROM (SELECT DISTINCT l_partkey % 20 AS notebook_id, l_suppkey AS user_id, o_custkey AS doc_id
FROM lineitem JOIN orders ON o_orderkey = l_orderkey) n JOIN dec USING (user_id, doc_id) WHERE allowed""")
def ac7(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    books = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        (F.col("l_partkey") % 20).alias("notebook_id"), F.col("l_suppkey").alias("user_id"), F.col("o_custkey").alias("doc_id")).distinct()
    decisions = ac.can_access(books, users(spark, sf), gates(spark, sf), granted(spark, sf))
    return ac.notebook_scope(books, decisions).select("notebook_id", "user_id", "doc_id")


@query("ac8_visible_notebooks", "SELECT o_custkey AS user_id, o_orderkey AS notebook_id FROM orders UNION SELECT l_suppkey, l_orderkey FROM lineitem")
def ac8(spark, sf):
    books = table(spark, sf, "orders").select(F.col("o_orderkey").alias("notebook_id"), F.col("o_custkey").alias("created_by"))
    shares = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("notebook_id"))
    return ac.visible_notebooks(books, shares)


@query("ac9_subtree", GATES + " SELECT ancestor_id AS root_id, folder_id, distance AS level FROM tree WHERE ancestor_id LIKE 'r_'")
def ac9(spark, sf):
    f = folders(spark, sf)
    return ac.subtree(ac.closure(f), f.filter("folder_id LIKE 'r_'"))


EDITED = FOLDERS.replace("folders AS (", "before AS (", 1) + """, folders AS (SELECT b.folder_id, CASE WHEN b.folder_id IN ('n3', 'n8') THEN 'n7' ELSE parent_id END AS parent_id,
CASE WHEN b.folder_id = 'r1' THEN 'RENAMED' ELSE name END AS name FROM before b)"""


@query("ac10_rebuild_paths", "WITH RECURSIVE " + EDITED + """, p AS (SELECT folder_id, name AS path FROM folders WHERE parent_id IS NULL
UNION ALL SELECT f.folder_id, p.path || '/' || f.name FROM p JOIN folders f ON f.parent_id = p.folder_id) SELECT folder_id, path FROM p""")
def ac10(spark, sf):
    f = folders(spark, sf)
    edits = f.filter("folder_id IN ('n3', 'n8', 'r1')").select(
        "folder_id", F.when(F.col("folder_id") == "r1", F.col("parent_id")).otherwise("n7").alias("new_parent_id"),
        F.when(F.col("folder_id") == "r1", "RENAMED").otherwise(F.col("name")).alias("new_name"))
    return ac.apply_edits(f, edits).select("folder_id", "path")


EDITS = """edits AS (SELECT 'n' || n_nationkey AS folder_id, CASE n_nationkey % 3 WHEN 0 THEN 's' || n_nationkey || '-BUILDING' WHEN 1 THEN 'r' || n_regionkey ELSE 'root' END AS new_parent_id,
CASE n_nationkey % 3 WHEN 1 THEN (SELECT min(m.n_name) FROM nation m WHERE m.n_regionkey = nation.n_regionkey) ELSE n_name END AS new_name FROM nation)"""


@query("ac11_edit_checks", GATES + ", " + EDITS + """ SELECT e.folder_id, CASE WHEN EXISTS (SELECT 1 FROM tree t WHERE t.ancestor_id = e.folder_id AND t.folder_id = e.new_parent_id)
THEN 'Cannot move a folder into itself or one of its descendants' WHEN EXISTS (SELECT 1 FROM folders f WHERE f.parent_id = e.new_parent_id AND f.name = e.new_name AND f.folder_id <> e.folder_id)
THEN 'A folder with that name already exists here' END AS reason FROM edits e""")
def ac11(spark, sf):
    f, nation = folders(spark, sf), table(spark, sf, "nation")
    case = F.col("n_nationkey") % 3
    first = nation.groupBy("n_regionkey").agg(F.min("n_name").alias("first"))
    edits = nation.join(first, "n_regionkey").select(
        _key("n", "n_nationkey").alias("folder_id"),
        F.when(case == 0, F.concat(_key("s", "n_nationkey"), F.lit("-BUILDING"))).when(case == 1, _key("r", "n_regionkey")).otherwise("root").alias("new_parent_id"),
        F.when(case == 1, F.col("first")).otherwise(F.col("n_name")).alias("new_name"))
    return ac.check_edits(f, ac.closure(f), edits).select("folder_id", "reason")


DELETES = GATES + """, ed AS (SELECT 'n' || n_nationkey AS folder_id, ['block', 'cascade', 'reflow'][n_nationkey % 3 + 1] AS mode FROM nation),
bad AS (SELECT e.folder_id FROM ed e WHERE (mode = 'block' AND EXISTS (SELECT 1 FROM folders f WHERE f.parent_id = e.folder_id))
  OR (mode = 'reflow' AND EXISTS (SELECT 1 FROM folders c JOIN folders o ON o.folder_id = e.folder_id JOIN folders x ON x.parent_id = o.parent_id AND x.name = c.name AND x.folder_id <> c.folder_id WHERE c.parent_id = e.folder_id))),
ok AS (SELECT * FROM ed ANTI JOIN bad USING (folder_id)), casc AS (SELECT t.folder_id FROM tree t JOIN ok ON ok.folder_id = t.ancestor_id WHERE mode = 'cascade')"""


def _deleted(spark, sf):
    f = folders(spark, sf)
    mode = F.element_at(F.array(F.lit("block"), F.lit("cascade"), F.lit("reflow")), F.col("n_nationkey") % 3 + 1)
    edits = table(spark, sf, "nation").select(_key("n", "n_nationkey").alias("folder_id"), mode.alias("mode"))
    return ac.delete_folders(f, documents(spark, sf), ac.closure(f), edits)


@query("ac12_delete_folders", DELETES + """ SELECT f.folder_id, CASE WHEN p.folder_id IS NOT NULL THEN o.parent_id ELSE f.parent_id END AS parent_id FROM folders f
LEFT JOIN (SELECT folder_id FROM ok WHERE mode = 'reflow') p ON p.folder_id = f.parent_id LEFT JOIN folders o ON o.folder_id = p.folder_id
WHERE f.folder_id NOT IN (SELECT folder_id FROM ok UNION SELECT folder_id FROM casc)""")
def ac12(spark, sf):
    return _deleted(spark, sf)[0].select("folder_id", "parent_id")


@query("ac12_moved_documents", DELETES + """ SELECT d.doc_id, CASE WHEN d.folder_id IN (SELECT folder_id FROM casc) THEN NULL ELSE d.folder_id END AS folder_id FROM docs d""")
def ac12_docs(spark, sf):
    return _deleted(spark, sf)[1]


@query("ac12_rejected", DELETES + " SELECT folder_id FROM bad")
def ac12_rejected(spark, sf):
    return _deleted(spark, sf)[2].select("folder_id")


@query("ac12_settled_batch", """WITH named AS (SELECT n_nationkey, n_regionkey % 3 AS m, row_number() OVER (PARTITION BY n_regionkey % 3 = 0, left(n_name, 2) ORDER BY n_nationkey) AS k FROM nation)
SELECT r_regionkey AS seq, 'r' || r_regionkey AS folder_id, CASE r_regionkey % 3 WHEN 2 THEN 'folder is not empty' END AS reason FROM region
UNION ALL SELECT 100 + n_nationkey, 'n' || n_nationkey, CASE WHEN m = 0 THEN 'Folder not found' WHEN k > 1 THEN 'A folder with that name already exists here' END FROM named""")
def ac12_settled(spark, sf):
    """Regions go (cascade, reflow, or refused as not empty), then every nation moves to the root under its first two letters."""
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    none = F.lit(None).cast("string")
    op = F.element_at(F.array(F.lit("cascade"), F.lit("reflow"), F.lit("block")), (F.col("r_regionkey") % 3 + 1).cast("int"))
    edits = region.select(F.col("r_regionkey").alias("seq"), _key("r", "r_regionkey").alias("folder_id"), op.alias("op"), none.alias("new_parent_id"), none.alias("new_name")).unionAll(
        nation.select(F.col("n_nationkey") + 100, _key("n", "n_nationkey"), F.lit("move"), F.lit("root"), F.left("n_name", F.lit(2))))
    return fe.settle(folders(spark, sf), documents(spark, sf), edits)[2]


@query("ac13_uploader_email", "SELECT o_orderkey AS doc_id, lower(s_name) AS uploader_email FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def ac13(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("uploaded_by"))
    return ac.with_uploader(d, users(spark, sf)).select("doc_id", "uploader_email")


@query("ac14_attach", "SELECT l_partkey AS doc_id, l_suppkey AS tag_id FROM lineitem UNION SELECT p_partkey, p_size FROM part")
def ac14(spark, sf):
    stored = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("bigint").alias("tag_id"))
    new = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("tag_id"))
    return ac.attach(stored, new, ["doc_id", "tag_id"])


# ---- conversations ---------------------------------------------------------------------

MSG = "msg AS (SELECT conv_id * 100 + turn AS message_id, conv_id AS conversation_id, role, text AS content, turn // 2 AS created_at FROM conversations)"


def messages(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("conversation_id"), "role",
                    F.col("text").alias("content"), F.floor(F.col("turn") / 2).alias("created_at"))


@query("cv1_history", "WITH " + MSG + " SELECT created_at, conversation_id, message_id, role FROM msg")
def cv1(spark, sf):
    return cv.history(messages(spark, sf)).select("created_at", "conversation_id", "message_id", "role")


@query("cv2_questions", "WITH " + MSG + """ SELECT a.message_id, q.question FROM msg a LEFT JOIN
(SELECT conversation_id, min_by(content, created_at * 100000 + message_id) AS question FROM msg WHERE role = 'user' GROUP BY 1) q USING (conversation_id) WHERE a.role = 'assistant'""".replace("created_at * 100000", "created_at * 10000000000"))
def cv2(spark, sf):
    return cv.answered_questions(messages(spark, sf)).select("message_id", "question")


FB = MSG + """, fb AS (SELECT (user_id % 120) * 100 + event_id % 8 AS message_id, event_type AS user_id, value AS rating, ts, event_id AS feedback_id FROM events),
good AS (SELECT f.* FROM fb f JOIN msg m USING (message_id) WHERE m.role = 'assistant'),
latest AS (SELECT message_id, user_id, max_by(rating, (ts, feedback_id)) AS rating FROM good GROUP BY ALL)"""


def arriving(spark, sf):
    return table(spark, sf, "events").select(((F.col("user_id") % 120) * 100 + F.col("event_id") % 8).alias("message_id"), F.col("event_type").alias("user_id"),
                                             F.col("value").alias("rating"), "ts", F.col("event_id").alias("feedback_id"))


@query("cv3_feedback", "WITH " + FB + " SELECT message_id, user_id, rating FROM latest")
def cv3(spark, sf):
    return cv.feedback(None, arriving(spark, sf), messages(spark, sf))[0].select("message_id", "user_id", "rating")


@query("cv3_rejects", "WITH " + FB + """ SELECT f.feedback_id, CASE WHEN m.message_id IS NULL THEN 'message not found' ELSE 'only answers can be rated' END AS reason
FROM fb f LEFT JOIN msg m USING (message_id) WHERE m.role IS DISTINCT FROM 'assistant'""")
def cv3_rejects(spark, sf):
    return cv.feedback(None, arriving(spark, sf), messages(spark, sf))[1].select("feedback_id", "reason")


@query("cv4_own_rating", "WITH " + FB + " SELECT m.message_id, l.rating AS my_rating FROM msg m LEFT JOIN latest l ON l.message_id = m.message_id AND l.user_id = 'click'")
def cv4(spark, sf):
    ratings, _ = cv.feedback(None, arriving(spark, sf), messages(spark, sf))
    return cv.with_own_rating(messages(spark, sf), ratings, "click").select("message_id", "my_rating")


GOLD = MSG + """, golden AS (SELECT a.message_id, a.conversation_id, a.created_at, q.question, md5(a.content) AS answer, split_part(d.text, chr(10), 1) || '|' || d.lang AS contexts
FROM msg a JOIN (SELECT conversation_id, min_by(content, created_at * 10000000000 + message_id) AS question FROM msg WHERE role = 'user' GROUP BY 1) q USING (conversation_id)
JOIN documents d ON d.doc_id = a.conversation_id WHERE a.role = 'assistant')"""


def golden(spark, sf):
    m = messages(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("conversation_id"), F.array(
        F.struct(F.lit(2).alias("index"), F.col("lang").alias("content")), F.struct(F.lit(1).alias("index"), F.substring_index("text", "\n", 1).alias("content"))).alias("hits"))
    traces = m.join(docs, "conversation_id").select("message_id", "hits")
    return cv.golden_questions(m, traces, m.select("message_id"))


@query("cv5_golden_questions", "WITH " + GOLD + " SELECT message_id, question, answer, contexts FROM golden WHERE question IS NOT NULL")
def cv5(spark, sf):
    return golden(spark, sf).filter("question is not null").select("message_id", "question", F.md5("reference_answer").alias("answer"), F.array_join("reference_contexts", "|").alias("contexts"))


@query("cv6_active_golden", "WITH " + MSG + " SELECT message_id AS question_id, created_at FROM msg WHERE conversation_id % 5 = 2 AND role = 'assistant'")
def cv6(spark, sf):
    q = messages(spark, sf).select(F.col("message_id").alias("question_id"), (F.col("conversation_id") % 5).alias("notebook_id"), "created_at", (F.col("role") == "assistant").alias("active"))
    return cv.active_golden(q, 2).select("question_id", "created_at")


# ---- synthesis -------------------------------------------------------------------------

SUMS = TREE + """, sc AS (SELECT doc_id, doc_id // 15 AS scope_id FROM labels), sums AS (SELECT s.section_id, s.doc_id, c.scope_id, s.heading, s.char_start,
CASE WHEN s.ordinal % 2 = 0 THEN 'about ' || s.path ELSE '' END AS summary FROM sections s JOIN sc c USING (doc_id) WHERE s.ordinal % 2 = 0),
qs AS (SELECT item_id AS query_id, item_id % 30 AS scope_id, text AS query FROM benchmark)"""


def scope_docs(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.floor(F.col("doc_id") / 15).alias("scope_id"))


def summaries(spark, sf):
    s = parts(spark, sf)[1]
    summary = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("about "), "path")).otherwise(F.lit(""))
    return sy.section_summaries(s.withColumn("summary", summary), scope_docs(spark, sf))


def broad_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 30).alias("scope_id"), F.col("text").alias("query"))


@query("mr1_section_summaries", "WITH " + SUMS + " SELECT section_id, scope_id, summary FROM sums")
def mr1(spark, sf):
    return summaries(spark, sf).select("section_id", "scope_id", "summary")


AVAIL = "av AS (SELECT scope_id, count(DISTINCT doc_id) <= 9 AND scope_id IN (SELECT scope_id FROM sums) AS available FROM sc GROUP BY scope_id)"


@query("mr2_available", "WITH " + SUMS + ", " + AVAIL + " SELECT scope_id, available FROM av")
def mr2(spark, sf):
    return sy.available(scope_docs(spark, sf), summaries(spark, sf), 9)


@query("mr3_map_prompts", "WITH " + SUMS + """ SELECT q.query_id, s.section_id, md5('Section heading: ' || CASE WHEN heading = '' THEN '(untitled)' ELSE heading END || chr(10) || 'Section summary: ' || summary || chr(10) || chr(10) || q.query) AS digest
FROM qs q JOIN sums s USING (scope_id)""")
def mr3(spark, sf):
    return sy.map_prompts(broad_queries(spark, sf), summaries(spark, sf)).select("query_id", "section_id", F.md5("prompt").alias("digest"))


EXTRACTS = """ex AS (SELECT q.query_id, s.section_id, s.doc_id, s.heading, s.char_start, CASE ascii(right(s.section_id, 1)) % 4 WHEN 0 THEN ' Not_Relevant. ' WHEN 1 THEN ' ' ELSE ' fact ' || s.section_id || ' ' END AS extract
FROM qs q JOIN sums s USING (scope_id)), rel AS (SELECT *, trim(extract) AS content FROM ex WHERE trim(extract) <> '' AND upper(trim(extract)) <> 'NOT_RELEVANT.'),
rb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, char_start, section_id) AS i FROM rel)"""


def extracts(spark, sf):
    p = sy.map_prompts(broad_queries(spark, sf), summaries(spark, sf))
    case = F.ascii(F.right("section_id", F.lit(1))) % 4
    answer = F.when(case == 0, " Not_Relevant. ").when(case == 1, " ").otherwise(F.concat(F.lit(" fact "), "section_id", F.lit(" ")))
    return p.select("query_id", "section_id", "doc_id", "heading", "char_start", answer.alias("extract"))


@query("mr4_relevant_extracts", "WITH " + SUMS + ", " + EXTRACTS + " SELECT query_id, section_id FROM rel")
def mr4(spark, sf):
    return extracts(spark, sf).filter(sy.is_relevant("extract")).select("query_id", "section_id")


@query("mr5_reduce_blocks", "WITH " + SUMS + ", " + EXTRACTS + ' SELECT query_id, CAST(i AS INTEGER) AS "index", content, section_id, doc_id FROM rb')
def mr5(spark, sf):
    b = sy.reduce_blocks(extracts(spark, sf))
    return b.select("query_id", "index", "content", F.get("section_ids", F.lit(0)).alias("section_id"), F.get("document_ids", F.lit(0)).alias("doc_id"))


@query("mr5_reduce_prompts", "WITH " + SUMS + ", " + EXTRACTS + """ SELECT q.query_id, md5(coalesce(c.t, '(no section extracts were relevant)') || chr(10) || chr(10) || q.query) AS digest
FROM qs q LEFT JOIN (SELECT query_id, string_agg('[' || i || '] ' || content, chr(10) || chr(10) ORDER BY i) AS t FROM rb GROUP BY 1) c USING (query_id)""")
def mr5_prompts(spark, sf):
    return sy.reduce_prompts(broad_queries(spark, sf), sy.reduce_blocks(extracts(spark, sf))).select("query_id", F.md5("prompt").alias("digest"))


@query("mr6_route", "WITH " + SUMS + ", " + AVAIL + """ SELECT q.query_id, CASE WHEN q.query_id % 3 = 0 AND coalesce(a.available, false) THEN 'broad' ELSE 'specific' END AS route FROM qs q LEFT JOIN av a USING (scope_id)""")
def mr6(spark, sf):
    q = broad_queries(spark, sf)
    case = F.col("query_id") % 3
    verdicts = q.select("query_id", F.when(case == 0, " Broad\n").when(case == 1, "BROAD.").otherwise("specific").alias("verdict"))
    return sy.route(q, verdicts, sy.available(scope_docs(spark, sf), summaries(spark, sf), 9)).select("query_id", "route")


OVERVIEW = """ov AS (SELECT o_custkey AS notebook_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS content, max(o_orderdate) AS generated_at FROM orders GROUP BY 1),
chg AS (SELECT o_custkey AS notebook_id, max(l_shipdate) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"""


@query("mr7_overviews", "WITH " + OVERVIEW + " SELECT o.notebook_id, o.content, coalesce(c.t > o.generated_at, false) AS stale FROM ov o LEFT JOIN chg c USING (notebook_id)")
def mr7(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("notebook_id"), F.col("o_orderkey").alias("content"), F.struct("o_orderdate", "o_orderkey").alias("generated_at"), F.lit(True).alias("stale"))
    stored, fresh = rows.filter("content % 2 = 0"), rows.filter("content % 2 = 1")
    latest = sy.upsert_overviews(stored.withColumn("stale", F.lit(False)), fresh).withColumn("generated_at", F.col("generated_at.o_orderdate"))
    lines = table(spark, sf, "lineitem")
    changes = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("notebook_id"), F.col("l_shipdate").alias("changed_at"))
    return sy.mark_stale(latest, changes).select("notebook_id", "content", "stale")


# ---- judging ---------------------------------------------------------------------------

JUDGE = PAGES + """, hits AS (SELECT CASE WHEN c.ordinal % 2 = 0 THEN 'even' ELSE 'odd' END AS method, c.doc_id % 40 AS query_id, c.doc_id, p.page_start, p.page_end,
  row_number() OVER (PARTITION BY c.ordinal % 2, c.doc_id % 40 ORDER BY length(c.content) DESC, c.chunk_id) AS rank FROM ck c JOIN chunk_pages p USING (chunk_id)),
jg AS (SELECT doc_id % 40 AS query_id, doc_id, page FROM pg WHERE page % 2 = 0),
cov AS (SELECT h.method, h.query_id, h.rank, h.doc_id, j.page FROM hits h JOIN jg j USING (query_id, doc_id) WHERE h.rank <= 10 AND j.page BETWEEN h.page_start AND h.page_end),
ja AS (SELECT method, query_id, count(DISTINCT rank) FILTER (WHERE rank <= 5) AS h5, count(DISTINCT rank) AS h10, count(DISTINCT (doc_id, page)) AS pages, min(rank) AS first FROM cov GROUP BY ALL),
pm AS (SELECT m.method, b.item_id AS query_id, coalesce(h5, 0) / 5.0 AS p5, coalesce(h10, 0) / 10.0 AS p10, coalesce(coalesce(pages, 0) / t.n, 0) AS r10, CASE WHEN coalesce(h5, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit5, coalesce(1.0 / first, 0) AS mrr
  FROM benchmark b CROSS JOIN (VALUES ('even'), ('odd')) m(method) LEFT JOIN ja a ON a.method = m.method AND a.query_id = b.item_id LEFT JOIN (SELECT query_id, count(*) AS n FROM jg GROUP BY 1) t ON t.query_id = b.item_id)"""


def page_hits(spark, sf):
    from pyspark.sql import Window

    _, sections, chunks = parts(spark, sf)
    c = chunks.join(ig.chunk_pages(chunks, sections).drop("doc_id"), "chunk_id").withColumn("query_id", F.col("doc_id") % 40)
    c = c.withColumn("method", F.when(F.col("ordinal") % 2 == 0, "even").otherwise("odd"))
    rank = F.row_number().over(Window.partitionBy("method", "query_id").orderBy(F.length("content").desc(), "chunk_id"))
    return c.select("method", "query_id", "doc_id", "page_start", "page_end", rank.alias("rank")).filter("rank <= 10")


def judgments(spark, sf):
    n = F.ceil(F.size(F.split("text", "\n")) / 3).cast("int")
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), n)).alias("page")).filter("page % 2 = 0")
    return d.select((F.col("doc_id") % 40).alias("query_id"), "doc_id", "page")


def judged_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "lookup").otherwise("concept").alias("kind"))


@query("ev18_covered_pages", "WITH " + JUDGE + " SELECT method, query_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(page AS INTEGER) AS page FROM cov")
def ev18(spark, sf):
    return jd.covered_pages(page_hits(spark, sf), judgments(spark, sf))


def page_table(spark, sf):
    return jd.page_metrics(page_hits(spark, sf), judgments(spark, sf), judged_queries(spark, sf), ["even", "odd"])


@query("ev19_page_metrics", "WITH " + JUDGE + ' SELECT method, query_id, round(CAST(p5 AS DOUBLE), 6) AS "P@5", round(CAST(p10 AS DOUBLE), 6) AS "P@10", round(r10, 6) AS "R@10", CAST(hit5 AS DOUBLE) AS "Hit@5", round(mrr, 6) AS "MRR@10" FROM pm')
def ev19(spark, sf):
    t = page_table(spark, sf)
    return t.select("method", "query_id", *[r6(f"`{c}`").alias(c) for c in t.columns[2:]])


@query("ev20_by_kind", "WITH " + JUDGE + """ SELECT CASE WHEN query_id % 2 = 0 THEN 'lookup' ELSE 'concept' END AS kind, count(DISTINCT query_id) AS n,
round(avg(mrr) FILTER (WHERE method = 'even'), 6) AS even, round(avg(mrr) FILTER (WHERE method = 'odd'), 6) AS odd FROM pm GROUP BY 1""")
def ev20(spark, sf):
    out = jd.by_kind(page_table(spark, sf), judged_queries(spark, sf), ["even", "odd"])
    return out.select("kind", "n", r6("even").alias("even"), r6("odd").alias("odd"))


@query("ev21_answer_evidence", r"""SELECT conv_id, turn, len([k for k in ks if contains(lower(text), lower(k))]) >= (len(ks) + 1) // 2 AS evidence FROM
(SELECT conv_id, turn, text, ['the', 'THE', 'and', 'que', 'zu'] AS ks FROM conversations WHERE role = 'assistant')""")
def ev21(spark, sf):
    a = table(spark, sf, "conversations").filter("role = 'assistant'")
    words = F.array(*[F.lit(w) for w in ("the", "THE", "and", "que", "zu")])
    return a.select("conv_id", "turn", jd.has_evidence("text", words).alias("evidence"))


PROV = TREE + """, cit AS (SELECT b.item_id AS query_id, s.heading, s.path FROM benchmark b JOIN sections s ON s.doc_id = b.item_id),
qh AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'E' ELSE 'page' END AS hint FROM benchmark),
pv AS (SELECT q.query_id, coalesce((SELECT bool_and(contains(lower(c.heading || ' ' || c.path), lower(q.hint))) FROM cit c WHERE c.query_id = q.query_id), false) AS provenance FROM qh q)"""


def provenance_flags(spark, sf):
    sections = parts(spark, sf)[1]
    b = table(spark, sf, "benchmark").withColumn("query_id", F.col("item_id"))
    cit = sections.join(b.select("query_id"), F.col("doc_id") == F.col("query_id")).select("query_id", "heading", "path")
    q = b.select("query_id", F.when(F.col("item_id") % 2 == 0, "E").otherwise("page").alias("hint"))
    return jd.provenance(q, cit)


@query("ev22_provenance", "WITH " + PROV + " SELECT query_id, provenance FROM pv")
def ev22(spark, sf):
    return provenance_flags(spark, sf)


@query("ev22_winners", "WITH " + PROV + """ SELECT CASE WHEN provenance AND query_id % 3 <> 0 THEN 'hierarchical' WHEN query_id % 3 = 0 AND NOT provenance THEN 'flat' ELSE 'tie' END AS winner, count(*) AS n FROM pv GROUP BY 1""")
def ev22_winners(spark, sf):
    f = provenance_flags(spark, sf).withColumn("flat", F.col("query_id") % 3 == 0)
    return f.groupBy(jd.winner("flat", "provenance").alias("winner")).agg(F.count(F.lit(1)).alias("n"))


# ---- rate limits and streams -----------------------------------------------------------


def limit_sql(name, source, key, limit, width):
    return f"""{name}a AS (SELECT *, epoch_us(ts) // {width} AS bucket FROM {source}),
{name}b AS (SELECT *, count(*) OVER (PARTITION BY {key}, bucket ORDER BY ts, event_id) AS cur FROM {name}a),
{name}t AS (SELECT {key}, bucket + 1 AS bucket, count(*) AS prev FROM {name}a GROUP BY ALL),
{name} AS (SELECT b.event_id, b.ts, b.user_id, b.event_type, coalesce(t.prev, 0) * (1 - (epoch_us(b.ts) - b.bucket * {width}) / CAST({width} AS DOUBLE)) + b.cur <= {limit} AS allowed
  FROM {name}b b LEFT JOIN {name}t t ON t.{key} = b.{key} AND t.bucket = b.bucket)"""


DAY = 86_400_000_000


@query("st1_admissions", "WITH " + limit_sql("l", "events", "user_id", 3, DAY) + " SELECT event_id, user_id, allowed FROM l")
def st1(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return st.admissions(e, "user_id", 3, 86_400).select("event_id", "user_id", "allowed")


@query("st2_two_limits", "WITH " + limit_sql("l", "events", "event_type", 60, DAY) + ", s AS (SELECT * FROM l WHERE allowed), " + limit_sql("m", "s", "user_id", 2, DAY)
       + " SELECT event_id, allowed FROM m UNION ALL SELECT event_id, allowed FROM l WHERE NOT allowed")
def st2(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return st.two_limits(e, ("event_type", 60), ("user_id", 2), 86_400).select("event_id", "allowed")


@query("st1_stream_admissions", "WITH " + limit_sql("l", "events", "user_id", 3, DAY) + " SELECT event_id, user_id, allowed FROM l")
def st1_stream(spark, sf):
    """The events as a stream into a held table; the stateful decision equals the batch one."""
    base = io.scratch(spark)
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    e.write.parquet(f"{base}/events")
    source = spark.readStream.schema(e.schema).parquet(f"{base}/events")
    out = st.stream_admissions(source, "user_id", 3, 86_400)
    job = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "allowed")


@query("st3_staged_ingestion", r"""WITH leaf AS (SELECT doc_id, text AS seg FROM documents),
win AS (WITH RECURSIVE w AS (SELECT doc_id, seg, 0 AS s, 0 AS e FROM leaf UNION ALL SELECT doc_id, seg, e, e + CASE WHEN e + 1000 < length(seg)
  AND strpos(reverse(substr(seg, e + 1, 1000)), ' ') BETWEEN 1 AND 999 THEN 1001 - strpos(reverse(substr(seg, e + 1, 1000)), ' ')
  ELSE least(1000, length(seg) - e) END FROM w WHERE e < length(seg)) SELECT * FROM w WHERE e > s)
SELECT doc_id, count(*) AS chunks FROM win WHERE regexp_replace(substr(seg, s + 1, e - s), '\s+', '', 'g') <> '' GROUP BY doc_id""")
def st3(spark, sf):
    base = io.scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("page_count"))
    docs.repartition(3, "doc_id").write.parquet(f"{base}/in")
    docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id").write.mode("append").parquet(f"{base}/in")  # delivered twice
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    si.ingest(source, f"{base}/store").awaitTermination()
    return spark.read.parquet(f"{base}/store/chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
