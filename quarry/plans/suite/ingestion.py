"""Registered queries: sources (IO) and ingestion (IN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import dense as dn
from quarry.operators import hooks
from quarry.operators import index as ix
from quarry.operators import ingest as ig
from quarry.operators import outline as ol
from quarry.plans.suite.common import query, table
from quarry.scale import hold
from quarry.sources import io

# Marked text of every document: every fifth line is a heading, three lines make a page.
PAGED = r"""ln AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 5 = 0
THEN repeat('#', CAST((doc_id + i - 1) % 3 + 1 AS INTEGER)) || ' ' || l ELSE l END) AS ls FROM documents),
pg AS (SELECT doc_id, p AS page, regexp_replace(array_to_string(ls[3 * p - 2:3 * p], chr(10)), '^\s+|\s+$', '', 'g') AS body FROM
  (SELECT doc_id, ls, unnest(range(1, (len(ls) + 2) // 3 + 1)) AS p FROM ln)),
pieces AS (SELECT *, '### Page ' || page || chr(10) || body || chr(10) || chr(10) AS piece FROM pg),
doc AS (SELECT doc_id, string_agg(piece, '' ORDER BY page) AS text, max(page) AS page_count, sum(length(body)) AS body_chars FROM pieces GROUP BY doc_id)"""
OUTLINE = PAGED + r""", cut AS (SELECT doc_id, page_count, length(text) AS text_len,
  string_split(regexp_replace(text, '(?m)^(#{1,6})\s+(.+?)\s*$', chr(1) || '\0', 'g'), chr(1)) AS s FROM doc),
seg AS (SELECT doc_id, page_count, text_len, unnest(s) AS seg, unnest(range(len(s))) AS idx FROM cut),
placed AS (SELECT *, CAST(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY idx) - length(seg) AS BIGINT) AS char_start FROM seg),
heads AS (SELECT doc_id, idx, page_count, text_len, char_start, length(regexp_extract(seg, '(?m)^(#{1,6})\s+(.+?)\s*$', 1)) AS level,
  trim(regexp_extract(seg, '(?m)^(#{1,6})\s+(.+?)\s*$', 2)) AS heading FROM placed WHERE idx > 0),
outl AS (SELECT h.*, coalesce((SELECT min(x.char_start) FROM heads x WHERE x.doc_id = h.doc_id AND x.idx > h.idx AND x.level <= h.level), text_len) AS char_end FROM heads h)"""
TREE = OUTLINE + """, par AS (SELECT h.*, (SELECT max(x.idx) FROM outl x WHERE x.doc_id = h.doc_id AND x.idx < h.idx AND x.level < h.level) AS parent_idx FROM outl h),
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_idx ORDER BY idx) - 1 AS ordinal FROM par),
paths AS (WITH RECURSIVE t AS (SELECT doc_id, idx, CAST(ordinal + 1 AS VARCHAR) AS path, 1 AS depth FROM ord WHERE parent_idx IS NULL
  UNION ALL SELECT o.doc_id, o.idx, t.path || '.' || (o.ordinal + 1), t.depth + 1 FROM t JOIN ord o ON o.doc_id = t.doc_id AND o.parent_idx = t.idx) SELECT * FROM t),
sections AS (SELECT o.doc_id, o.idx, o.doc_id || '/' || p.path AS section_id, CASE WHEN o.parent_idx IS NULL THEN NULL ELSE o.doc_id || '/' || q.path END AS parent_section_id,
  o.ordinal, p.depth, p.path, o.heading, 1 AS page_start, o.page_count AS page_end, o.char_start, o.char_end,
  NOT EXISTS (SELECT 1 FROM ord c WHERE c.doc_id = o.doc_id AND c.parent_idx = o.idx) AS is_leaf
  FROM ord o JOIN paths p USING (doc_id, idx) LEFT JOIN paths q ON q.doc_id = o.doc_id AND q.idx = o.parent_idx)"""
CHUNKS = TREE + r""", leaf AS (SELECT s.doc_id, s.section_id, s.idx, s.char_start AS base, substr(d.text, s.char_start + 1, s.char_end - s.char_start) AS seg
  FROM sections s JOIN doc d USING (doc_id) WHERE s.is_leaf),
win AS (WITH RECURSIVE w AS (SELECT doc_id, section_id, idx, base, seg, 0 AS s, 0 AS e FROM leaf
  UNION ALL SELECT doc_id, section_id, idx, base, seg, e, e + CASE WHEN e + 1000 < length(seg) AND strpos(reverse(substr(seg, e + 1, 1000)), ' ') > 0
    AND 1000 - strpos(reverse(substr(seg, e + 1, 1000)), ' ') + 1 >= 2 THEN 1000 - strpos(reverse(substr(seg, e + 1, 1000)), ' ') + 1
    ELSE least(1000, length(seg) - e) END FROM w WHERE e < length(seg)) SELECT * FROM w WHERE e > s),
ch0 AS (SELECT doc_id, section_id, idx, base + s AS char_start, base + e AS char_end, substr(seg, s + 1, e - s) AS content FROM win),
chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, char_start) - 1 AS ordinal FROM ch0 WHERE regexp_replace(content, '\s+', '', 'g') <> ''),
chk AS (SELECT *, sha256(doc_id || '|' || ordinal || '|' || content) AS h FROM chunks),
ck AS (SELECT *, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS chunk_id FROM chk)"""


def pages(spark, sf):
    mark = F.expr(
        "transform(split(text, '\\n'), (l, i) -> CASE WHEN i % 5 = 0 THEN concat(repeat('#', cast((doc_id + i) % 3 + 1 AS int)), ' ', l) ELSE l END)")
    lines = table(spark, sf, "documents").select("doc_id", mark.alias("ls"))
    cells = lines.select("doc_id", "ls", F.explode(F.sequence(F.lit(1), F.ceil(F.size("ls") / 3).cast("int"))).alias("page"))
    return cells.select("doc_id", "page", F.array_join(F.slice("ls", F.col("page") * 3 - 2, F.lit(3)), "\n").alias("body"))


_HELD: dict = {}


def parts(spark, sf):
    """Marked text, sections and chunks of every document, stored once per application."""
    key = (spark.sparkContext.applicationId, id(spark), sf)
    if key not in _HELD:
        docs = hold(ol.assemble_pages(pages(spark, sf))[0], "doc_id")
        sections, chunks = ol.structure(docs)
        sections = hold(sections, "doc_id")
        _HELD[key] = docs, sections, hold(ol.chunks(docs, sections), "doc_id")
    return _HELD[key]


def full(spark, sf):
    docs, sections, chunks = parts(spark, sf)
    extra = sections.withColumns({"summary": F.lit(None).cast("string"), "topics": F.lit(None).cast("array<string>")})
    return docs, extra, chunks


# ---- sources ---------------------------------------------------------------------------


@query("io1_scan_with_heading", "WITH " + CHUNKS + """ SELECT c.doc_id, CAST(c.ordinal AS INTEGER) AS ordinal, s.heading, CAST(length(c.content) AS INTEGER) AS n
FROM ck c JOIN sections s USING (section_id) WHERE c.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def io1(spark, sf):
    _, sections, chunks = parts(spark, sf)
    scope = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    rows = io.scan_chunks_with_heading(chunks, sections, scope)
    return rows.select("doc_id", "ordinal", "heading", F.length("content").alias("n"))


@query("io2_scan_by_section", "WITH " + CHUNKS + " SELECT chunk_id, section_id FROM ck WHERE section_id IN (SELECT section_id FROM sections WHERE depth = 1)")
def io2(spark, sf):
    _, sections, chunks = parts(spark, sf)
    wanted = sections.filter("depth = 1").select("section_id")
    return io.scan_chunks(chunks, wanted, "section_id").select("chunk_id", "section_id")


@query("io3_scan_sections", "WITH " + TREE + " SELECT section_id, CAST(char_start AS INTEGER) AS char_start FROM sections WHERE doc_id IN (SELECT doc_id FROM labels)")
def io3(spark, sf):
    _, sections, _ = parts(spark, sf)
    return io.scan_sections(sections, table(spark, sf, "labels").select("doc_id")).select("section_id", "char_start")


@query("io4_list_documents", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.toxic = 1")
def io4(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "folder_id")
    tags = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("tag_id"))
    return io.list_documents(docs, folder_id="en", tags=tags, tag_id=1).select("doc_id")


@query("io5_judged_collection", """SELECT b.item_id AS query_id, count(*) AS judged FROM benchmark b JOIN labels l ON l.doc_id % 7 = b.item_id % 7
WHERE l.quality > 0 GROUP BY 1""")
def io5(spark, sf):
    base = f"{io.scratch(spark)}/judged"
    table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("_id"), F.substring_index("text", "\n", 1).alias("title"), "text").write.json(f"{base}/corpus.jsonl")
    bench = table(spark, sf, "benchmark")
    bench.select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{base}/queries.jsonl")
    labels = table(spark, sf, "labels").select("doc_id", "quality").withColumn("m", F.col("doc_id") % 7)
    judged = bench.withColumn("m", F.col("item_id") % 7).join(labels, "m").select(
        F.col("item_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("quality").alias("score"))
    judged.write.option("sep", "\t").option("header", True).csv(f"{base}/qrels.tsv")
    corpus, queries, qrels = io.read_judged(spark, f"{base}/corpus.jsonl", f"{base}/queries.jsonl", f"{base}/qrels.tsv")
    kept = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").join(queries.select("query_id"), "query_id", "left_semi")
    return kept.groupBy(F.col("query_id").cast("bigint").alias("query_id")).agg(F.count(F.lit(1)).alias("judged"))


@query("io6_claim_release", """SELECT item_id AS claim_id, text AS claim, 2 AS n_evidence, CASE WHEN item_id % 2 = 0 THEN 'SUPPORT' ELSE 'CONTRADICT' END AS label FROM benchmark""")
def io6(spark, sf):
    path = f"{io.scratch(spark)}/claims.jsonl"
    label = F.when(F.col("item_id") % 2 == 0, "SUPPORT").otherwise("CONTRADICT")
    entry = F.array(F.struct(label.alias("label"), F.array(F.lit(0), F.lit(1)).alias("sentences")))
    table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("claim"),
        F.create_map(F.col("item_id").cast("string"), entry, (F.col("item_id") + 1).cast("string"), entry).alias("evidence"),
        F.array(F.col("item_id")).alias("cited_doc_ids")).write.json(path)
    claims = io.read_claims(spark, path)
    first = F.element_at(F.element_at(F.map_values("evidence"), 1), 1)["label"]
    return claims.select("claim_id", "claim", F.size("evidence").alias("n_evidence"), first.alias("label"))


@query("io7_parsed_artifacts", "WITH " + PAGED + " SELECT doc_id, md5(text) AS digest, CAST(page_count AS INTEGER) AS page_count FROM doc")
def io7(spark, sf):
    path = f"{io.scratch(spark)}/parsed"
    text, _ = ol.assemble_pages(pages(spark, sf))
    io.store_parsed(text.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), path)
    io.store_parsed(text, path)  # a second run only adds what is missing
    return spark.read.parquet(path).select("doc_id", F.md5("text").alias("digest"), "page_count")


@query("io8_result_sinks", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY lang")
def io8(spark, sf):
    path = f"{io.scratch(spark)}/summary"
    out = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    io.write_results(out, path)
    return spark.read.json(f"{path}/json").select("lang", "n", "mean_chars")


@query("io9_fingerprint", "SELECT count(*) AS n, bit_xor(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT) AS digest FROM documents")
def io9(spark, sf):
    return ix.fingerprint(table(spark, sf, "documents"), "doc_id")


# ---- uploads and stages ----------------------------------------------------------------

UPLOADS = """up AS (SELECT item_id, doc_id, 'file' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.PDF' END AS filename,
CASE doc_id % 4 WHEN 0 THEN 'application/pdf; charset=x' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN ' ' ELSE 'text/plain' END AS mime FROM (SELECT doc_id, doc_id AS item_id FROM documents))"""


@query("in1_upload_filter", "WITH " + UPLOADS + """ SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR (doc_id % 4 IN (1, 2) AND doc_id % 5 <> 0) THEN NULL
ELSE 'Only PDF files can be uploaded. Please choose a .pdf file.' END AS reason FROM up""")
def in1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".PDF"))
    kind = F.col("doc_id") % 4
    mime = F.when(kind == 0, "application/pdf; charset=x").when(kind == 1, "application/octet-stream").when(kind == 2, " ").otherwise("text/plain")
    good, bad = ig.split_uploads(d.withColumns({"filename": name, "mime_type": mime}))
    return bad.select("doc_id", "reason").unionByName(good.select("doc_id", F.lit(None).cast("string").alias("reason")))


@query("in2_dedupe", """WITH f AS (SELECT lang, sha256(text) AS checksum, min(doc_id) AS first_id FROM documents GROUP BY ALL),
e AS (SELECT lang, sha256(text) AS checksum, min(d.doc_id) + 1000000 AS stored FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 GROUP BY ALL)
SELECT d.lang AS org_id, d.doc_id AS upload_id, f.checksum, coalesce(e.stored, f.first_id) AS document_id, e.stored IS NULL AND d.doc_id = f.first_id AS created
FROM documents d JOIN f ON f.lang = d.lang AND f.checksum = sha256(d.text) LEFT JOIN e ON e.lang = f.lang AND e.checksum = f.checksum""")
def in2(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("org_id"), F.col("doc_id").alias("upload_id"), F.col("text").alias("content"))
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("upload_id"))
    stored = docs.join(toxic, "upload_id").groupBy("org_id", F.sha2("content", 256).alias("checksum")).agg((F.min("upload_id") + 1000000).alias("document_id"))
    return ig.dedupe(docs, stored)


STATE = """st AS (SELECT o_orderkey AS doc_id, ['uploaded', 'parsing', 'structuring', 'embedding', 'ready', 'failed'][o_orderkey % 6 + 1] AS status,
CASE WHEN o_orderkey % 6 = 5 THEN ['parsing', 'structuring', 'embedding'][o_custkey % 3 + 1] END AS failed_stage FROM orders)"""


def states(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    o = table(spark, sf, "orders")
    status = pick(["uploaded", "parsing", "structuring", "embedding", "ready", "failed"], F.col("o_orderkey") % 6 + 1)
    return o.select(
        F.col("o_orderkey").alias("doc_id"), status.alias("status"),
        F.when(F.col("o_orderkey") % 6 == 5, pick(["parsing", "structuring", "embedding"], F.col("o_custkey") % 3 + 1)).alias("failed_stage"),
        F.lit("boom").alias("error_detail"))


@query("in3_stage_eligibility", "WITH " + STATE + """, s AS (SELECT *, unnest(['parsing', 'structuring', 'embedding']) AS stage FROM st)
SELECT doc_id, stage, coalesce((stage = 'parsing' AND status IN ('uploaded', 'parsing')) OR (stage <> 'parsing' AND status = stage) OR (status = 'failed' AND failed_stage = stage), false) AS eligible,
CASE WHEN (stage = 'parsing' AND status IN ('uploaded', 'parsing')) OR (stage <> 'parsing' AND status = stage) OR (status = 'failed' AND failed_stage = stage) THEN stage ELSE status END AS status FROM s""")
def in3(spark, sf):
    out = None
    for stage in ig.STAGES:
        rows = ig.begin_stage(states(spark, sf), stage).select("doc_id", F.lit(stage).alias("stage"), "eligible", "status")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("in4_failure_messages", """SELECT event_id AS doc_id, 'failed' AS status, CASE WHEN user_id % 3 = 0 THEN 'parsing' WHEN user_id % 3 = 1 THEN 'structuring' ELSE 'embedding' END AS failed_stage,
CASE WHEN event_type = 'error' THEN 'The document processing service is temporarily unavailable. Please try again later.'
WHEN user_id % 3 = 1 THEN 'We couldn''t process this document''s contents. Please try again later.' WHEN user_id % 3 = 2 THEN 'We couldn''t index this document for search. Please try again later.'
WHEN event_type = 'click' THEN 'This file type isn''t supported. Please upload a PDF.' WHEN event_type = 'view' THEN 'This PDF is password-protected. Remove the password and upload it again.'
WHEN event_type = 'signup' THEN 'No readable text was found in this PDF (it may be empty or a low-quality scan).'
ELSE 'This file couldn''t be read as a PDF (it may be corrupted or password-protected).' END AS error_detail FROM events""")
def in4(spark, sf):
    kind, who = F.col("event_type"), F.col("user_id") % 3
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), F.when(who == 0, "parsing").when(who == 1, "structuring").otherwise("embedding").alias("stage"),
        F.when(kind == "error", "TimeoutError").otherwise("ValueError").alias("error_type"),
        F.when(kind == "click", "Unsupported MIME type").when(kind == "view", "file is Encrypted").when(kind == "signup", "Negligible text").otherwise("broken").alias("error"))
    return ig.mark_failed(rows)


# ---- pages, outline, sections, chunks --------------------------------------------------


@query("in5_assemble_pages", "WITH " + PAGED + " SELECT doc_id, md5(text) AS digest, CAST(page_count AS INTEGER) AS page_count, CAST(body_chars AS BIGINT) AS body_chars FROM doc")
def in5(spark, sf):
    return ol.assemble_pages(pages(spark, sf))[0].select("doc_id", F.md5("text").alias("digest"), "page_count", "body_chars")


@query("in5_page_outline", "WITH " + PAGED + """ SELECT doc_id, 'Page ' || page AS heading, CAST(e - length(piece) AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end, CAST(page AS INTEGER) AS page_start
FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY page) AS e FROM pieces)""")
def in5_outline(spark, sf):
    return ol.assemble_pages(pages(spark, sf))[1].select("doc_id", "heading", "char_start", "char_end", "page_start")


@query("in6_negligible", "WITH " + PAGED + r" SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) / greatest(page_count, 1) < 200 AS negligible FROM doc")
def in6(spark, sf):
    docs = ol.assemble_pages(pages(spark, sf))[0]
    return docs.select("doc_id", ol.negligible_text("text", "page_count", 200).alias("negligible"))


@query("in7_markdown_outline", "WITH " + OUTLINE + """ SELECT doc_id, CAST(idx AS INTEGER) AS idx, heading, CAST(level AS INTEGER) AS level,
CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM outl""")
def in7(spark, sf):
    docs = ol.assemble_pages(pages(spark, sf))[0]
    return ol.markdown_outline(docs).select("doc_id", "idx", "heading", "level", "char_start", "char_end")


@query("in8_degenerate_outline", r"""SELECT doc_id, bool_and(h = '' OR regexp_matches(lower(h), '^page\s+\d+$') OR lower(h) IN ('metadata', 'contents') OR regexp_matches(h, '\.\w{2,5}$')) AS degenerate
FROM (SELECT doc_id, regexp_replace(h, '^\s+|\s+$', '', 'g') AS h FROM (SELECT doc_id, unnest(['Page ' || doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Contents' ELSE split_part(text, chr(10), 1) || CASE WHEN doc_id % 3 = 1 THEN 'x.pdf' ELSE ' ' END END]) AS h FROM documents)) GROUP BY doc_id""")
def in8(spark, sf):
    d = table(spark, sf, "documents")
    case = F.col("doc_id") % 3
    second = F.when(case == 0, "Contents").otherwise(F.concat(F.substring_index("text", "\n", 1), F.when(case == 1, "x.pdf").otherwise(" ")))
    nodes = d.select("doc_id", F.explode(F.array(F.concat(F.lit("Page "), F.col("doc_id").cast("string")), second)).alias("heading"))
    return ol.degenerate(d, nodes)


SECTION_COLS = """ SELECT section_id, parent_section_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(depth AS INTEGER) AS depth, path, heading,
CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, is_leaf FROM sections"""


@query("in9_section_tree", "WITH " + TREE + SECTION_COLS)
def in9(spark, sf):
    docs = ol.assemble_pages(pages(spark, sf))[0].repartition("doc_id")
    tree = ol.section_tree(docs, ol.markdown_outline(docs))
    return tree.select("section_id", "parent_section_id", "ordinal", "depth", "path", "heading", "char_start", "char_end", "is_leaf")


@query("in9_empty_outline", "SELECT doc_id || '/1' AS section_id, 0 AS depth, CAST(length(text) AS INTEGER) AS char_end FROM documents")
def in9_empty(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("page_count"))
    none = ol.markdown_outline(docs.filter(F.lit(False)))
    return ol.section_tree(docs, none).select("section_id", "depth", "char_end")


@query("in10_leaves", "WITH " + TREE + " SELECT section_id, CAST(idx AS INTEGER) AS idx FROM sections WHERE is_leaf")
def in10(spark, sf):
    return ol.leaves(parts(spark, sf)[1]).select("section_id", "idx")


@query("in11_chunk_windows", "WITH " + CHUNKS + " SELECT doc_id, section_id, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM ck")
def in11(spark, sf):
    docs = ol.assemble_pages(pages(spark, sf))[0]
    return ol.structure(docs)[1].select("doc_id", "section_id", "char_start", "char_end")


@query("in11_whole_documents", r"""WITH leaf AS (SELECT doc_id, text AS seg FROM documents),
win AS (WITH RECURSIVE w AS (SELECT doc_id, seg, 0 AS s, 0 AS e FROM leaf UNION ALL SELECT doc_id, seg, e, e + CASE WHEN e + 1000 < length(seg)
  AND strpos(reverse(substr(seg, e + 1, 1000)), ' ') BETWEEN 1 AND 999 THEN 1001 - strpos(reverse(substr(seg, e + 1, 1000)), ' ')
  ELSE least(1000, length(seg) - e) END FROM w WHERE e < length(seg)) SELECT * FROM w WHERE e > s)
SELECT doc_id, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end FROM win WHERE regexp_replace(substr(seg, s + 1, e - s), '\s+', '', 'g') <> ''""")
def in11_whole(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("page_count"))
    return ol.structure(docs, ol.markdown_outline(docs.filter(F.lit(False))))[1].select("doc_id", "char_start", "char_end")


@query("in12_chunk_ids", "WITH " + CHUNKS + " SELECT chunk_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(greatest(length(content) // 4, 1) AS INTEGER) AS token_count, md5(content) AS digest FROM ck")
def in12(spark, sf):
    return parts(spark, sf)[2].select("chunk_id", "doc_id", "ordinal", "token_count", F.md5("content").alias("digest"))


@query("in13_replace", "WITH " + CHUNKS + """ SELECT doc_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM (SELECT doc_id, content FROM ck WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT doc_id, 'replaced' FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)) GROUP BY doc_id""")
def in13(spark, sf):
    chunks = parts(spark, sf)[2].select("doc_id", "content")
    touched = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    out = ol.replace_documents(chunks, touched.select("doc_id", F.lit("replaced").alias("content")), touched)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


PAGES = CHUNKS + r""", mk AS (SELECT *, regexp_extract_all(content, '(?m)^#{1,6}[ \t]*Page[ \t]+(\d+)[ \t]*$', 1) AS m,
  regexp_matches(content, '(^|\n)#{1,6} *Page +[0-9]+ *(\n|$)') AS has, regexp_matches(ltrim(content, chr(10) || ' '), '^#{1,6}[ \t]*Page[ \t]+\d+[ \t]*(\n|$)') AS at_start FROM ck),
pr AS (SELECT *, CAST(m[1] AS INTEGER) AS first, CAST(m[-1] AS INTEGER) AS last, last_value(CASE WHEN has THEN CAST(m[-1] AS INTEGER) END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY char_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding FROM mk),
stt AS (SELECT p.*, d.page_count, CASE WHEN at_start THEN first ELSE coalesce(preceding, CASE WHEN first IS NOT NULL THEN greatest(first - 1, 1) END) END AS st FROM pr p JOIN doc d USING (doc_id)),
chunk_pages AS (SELECT chunk_id, doc_id, CASE WHEN st IS NOT NULL THEN st WHEN page_count > 1 THEN NULL ELSE 1 END AS page_start,
  CASE WHEN st IS NOT NULL THEN greatest(coalesce(last, st), st) WHEN page_count > 1 THEN NULL ELSE page_count END AS page_end FROM stt)"""


@query("in14_page_ranges", "WITH " + PAGES + " SELECT chunk_id, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end FROM chunk_pages")
def in14(spark, sf):
    _, sections, chunks = parts(spark, sf)
    return ig.chunk_pages(chunks, sections).select("chunk_id", "page_start", "page_end")


@query("in15_tiling", "WITH " + CHUNKS + """, l AS (SELECT section_id, char_start AS f, char_end AS t FROM sections WHERE is_leaf),
w AS (SELECT c.section_id, c.char_start, c.char_end, lag(c.char_end) OVER w AS prev, lead(c.char_start) OVER w AS nxt, l.f, l.t FROM ck c JOIN l USING (section_id) WINDOW w AS (PARTITION BY c.section_id ORDER BY c.char_start))
SELECT section_id, CASE WHEN prev IS NULL AND char_start <> f THEN 'bad_start' WHEN char_start > prev THEN 'gap' WHEN char_start < prev THEN 'overlap' END AS issue, CAST(char_start AS INTEGER) AS at FROM w
WHERE (prev IS NULL AND char_start <> f) OR char_start <> prev UNION ALL SELECT section_id, 'bad_end', CAST(char_end AS INTEGER) FROM w WHERE nxt IS NULL AND char_end <> t
UNION ALL SELECT section_id, 'empty', CAST(f AS INTEGER) FROM l WHERE t > f AND section_id NOT IN (SELECT section_id FROM ck)""")
def in15(spark, sf):
    _, sections, chunks = parts(spark, sf)
    return ol.tiling_report(sections, chunks)


@query("in16_extractor_windows", """SELECT doc_id, CAST(w AS INTEGER) AS "window", md5(substr(text, w * 1600 + 1, 2000)) AS digest FROM
(SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 400) / 1600.0)) AS INTEGER))) AS w FROM documents WHERE length(text) > 0)""".replace("1600", "1500").replace("400", "500"))
def in16(spark, sf):
    return ol.extractor_windows(table(spark, sf, "documents"), 2000).select("doc_id", "window", F.md5("segment").alias("digest"))


def responses(spark, sf):
    """Model answers derived from each document: its line starts as headings, some broken."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(3).alias("page_count"))
    lines = F.filter(F.split("text", "\n"), lambda x: tx.strip(x) != "")
    items = F.transform(F.transform(lines, lambda x, i: F.struct(F.substring(tx.strip(x), 1, 40).alias("heading"), (i % 9).alias("level"))), lambda s: s)
    body = F.to_json(items)
    answer = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Sure! "), body)).otherwise(body))
    return docs, docs.select("doc_id", F.lit(0).alias("window"), answer.alias("response"))


HEADS = r"""ls AS (SELECT doc_id, text, [left(regexp_replace(x, '^\s+|\s+$', '', 'g'), 40) for x in string_split(text, chr(10)) if regexp_replace(x, '\s+', '', 'g') <> ''] AS l FROM documents WHERE doc_id % 5 <> 1),
h AS (SELECT doc_id, text, unnest(range(len(l))) AS i, regexp_replace(unnest(l), '\s+$', '') AS heading FROM ls),
hl AS (SELECT doc_id, text, i, heading, greatest(1, least(6, i % 9)) AS level FROM h)"""


@query("in17_parse_headings", "WITH " + HEADS + " SELECT doc_id, heading, CAST(level AS INTEGER) AS level, CAST(i AS INTEGER) AS pos FROM hl")
def in17(spark, sf):
    _, r = responses(spark, sf)
    rows = r.select("doc_id", F.posexplode(ol.parse_headings("response")).alias("pos", "h"))
    return rows.select("doc_id", "h.heading", "h.level", "pos")


@query("in18_locate_headings", "WITH " + HEADS + r""", k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM hl
  WHERE NOT (regexp_matches(lower(heading), '^page\s+\d+$') OR lower(heading) IN ('metadata', 'contents') OR regexp_matches(heading, '\.\w{2,5}$'))),
loc AS (WITH RECURSIVE t AS (SELECT doc_id, 0 AS n, 0 AS cur, CAST(NULL AS INTEGER) AS spot, 0 AS level, '' AS heading FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL SELECT k.doc_id, CAST(k.n AS INTEGER), CASE WHEN strpos(substr(k.text, t.cur + 1), k.heading) > 0 THEN t.cur + strpos(substr(k.text, t.cur + 1), k.heading) - 1 + length(k.heading) ELSE t.cur END,
    CASE WHEN strpos(substr(k.text, t.cur + 1), k.heading) > 0 THEN t.cur + strpos(substr(k.text, t.cur + 1), k.heading) - 1 END, k.level, k.heading
  FROM t JOIN k ON k.doc_id = t.doc_id AND k.n = t.n + 1) SELECT * FROM t WHERE spot IS NOT NULL)
SELECT l.doc_id, l.heading, CAST(l.level AS INTEGER) AS level, CAST(l.spot AS INTEGER) AS char_start, CAST(coalesce((SELECT min(x.spot) FROM loc x WHERE x.doc_id = l.doc_id AND x.n > l.n AND x.level <= l.level), length(d.text)) AS INTEGER) AS char_end
FROM loc l JOIN documents d USING (doc_id)""")
def in18(spark, sf):
    docs, r = responses(spark, sf)
    return ol.locate_headings(docs, r).select("doc_id", "heading", "level", "char_start", "char_end")


PROMPT = r"""pr AS (SELECT s.doc_id, s.section_id, left(regexp_replace(substr(d.text, s.char_start + 1, s.char_end - s.char_start), '^\s+|\s+$', '', 'g'), 6000) AS seg, s.heading FROM sections s JOIN doc d USING (doc_id))"""


@query("in19_enrichment_prompts", "WITH " + TREE + ", " + PROMPT + " SELECT section_id, md5('Section heading: ' || CASE WHEN heading = '' THEN '(untitled)' ELSE heading END || chr(10) || chr(10) || 'Section text:' || chr(10) || seg) AS digest FROM pr WHERE seg <> ''")
def in19(spark, sf):
    docs, sections, _ = parts(spark, sf)
    return ig.enrichment_prompts(docs, sections).select("section_id", F.md5("prompt").alias("digest"))


def enrichment_responses(spark, sf):
    """Model answers per section: heading as summary, some fenced, empty or broken."""
    s = parts(spark, sf)[1]
    topics = F.array(F.col("path"), F.lit(""), F.repeat(F.lit("t"), 100), F.lit("c"), F.lit("d"), F.lit("e"))
    body = F.to_json(F.struct(F.when(F.col("ordinal") % 4 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("heading"), F.lit(" sum "))).alias("summary"), topics.alias("topics")))
    answer = (F.when(F.col("ordinal") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(F.col("ordinal") % 4 == 2, F.concat(body, F.lit(" extra {"))).otherwise(body))
    return s.select("section_id", answer.alias("response"))


ENRICHED = r"""en AS (SELECT section_id, doc_id, left(trim(heading || ' sum'), 2000) AS summary, path || '|' || repeat('t', 80) || '|c|d' AS topics FROM sections WHERE ordinal % 4 < 2)"""


@query("in20_parse_enrichment", "WITH " + TREE + ", " + ENRICHED + " SELECT section_id, summary, topics FROM en")
def in20(spark, sf):
    good, _ = ig.split_responses(enrichment_responses(spark, sf))
    return good.select("section_id", "summary", F.array_join("topics", "|").alias("topics"))


@query("in20_rejects", "WITH " + TREE + " SELECT section_id, CASE WHEN ordinal % 4 = 2 THEN 'unparsable' ELSE 'empty_summary' END AS reason FROM sections WHERE ordinal % 4 >= 2")
def in20_rejects(spark, sf):
    return ig.split_responses(enrichment_responses(spark, sf))[1].select("section_id", "reason")


@query("in21_apply_enrichment", "WITH " + TREE + ", " + ENRICHED + " SELECT s.section_id, e.summary AS summary FROM sections s LEFT JOIN en e USING (section_id)")
def in21(spark, sf):
    good, _ = ig.split_responses(enrichment_responses(spark, sf))
    return ig.apply_enrichment(full(spark, sf)[1], good).select("section_id", "summary")


@query("in22_contextual_texts", "WITH " + CHUNKS + ", " + ENRICHED + " SELECT c.chunk_id AS owner_id, md5(e.summary || chr(10) || chr(10) || c.content) AS digest FROM ck c JOIN en e USING (section_id)")
def in22(spark, sf):
    good, _ = ig.split_responses(enrichment_responses(spark, sf))
    return ig.contextual_texts(parts(spark, sf)[2], good).select("owner_id", F.md5("text").alias("digest"))


@query("in22_reembedded")
def in22_vectors(spark, sf):
    good, _ = ig.split_responses(enrichment_responses(spark, sf))
    texts = ig.contextual_texts(parts(spark, sf)[2], good)
    return dn.embed(texts, hooks.text_hash_embedder(8), "hash-8", 8).select("owner_type", "owner_id", "model", "dim")


@query("in23_backfill_counts", "WITH " + STATE + """ SELECT count(*) FILTER (WHERE status = 'ready' AND doc_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS enriched,
count(*) FILTER (WHERE status <> 'ready') AS skipped, count(*) FILTER (WHERE status = 'ready' AND doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS failed FROM st""")
def in23(spark, sf):
    failed = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    return ig.backfill_counts(states(spark, sf), failed)


@query("in24_delete_documents", "WITH " + CHUNKS + """ SELECT 'chunks' AS "table", count(*) AS n FROM ck WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'sections', count(*) FROM sections WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def in24(spark, sf):
    docs, sections, chunks = parts(spark, sf)
    doomed = table(spark, sf, "labels").filter("quality = 0")
    left = ig.delete_documents({"documents": docs, "sections": sections, "chunks": chunks}, doomed)
    out = None
    for name, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out
