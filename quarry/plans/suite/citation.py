"""Registered queries: citation checking (CC) and its evaluation (EV11-EV17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import claims as cc
from quarry.operators import pairs as pr
from quarry.operators import ranked as rk
from quarry.plans.suite.common import STOP_SQL, doc_index, exploded_sql, index_sql, listed_index, query, r6, scores_sql, stems_sql, table
from quarry.scale import hold, shuffled

# Answers: assistant turns with citation marks by conversation number; blocks: three documents.
ANSWERS = r"""ans AS (SELECT conv_id || '-' || turn AS answer_id, conv_id, CASE conv_id % 3 WHEN 0 THEN replace(text, '. ', ' [2]. ')
WHEN 1 THEN replace(text, '.' || chr(10), '. [1][3]' || chr(10)) ELSE text || ' [9]' END AS answer FROM conversations WHERE role = 'assistant'),
blk AS (SELECT a.answer_id, i AS "index", d.doc_id AS chunk_id, d.text AS content FROM (SELECT answer_id, conv_id, unnest([1, 2, 3]) AS i FROM ans) a JOIN documents d ON d.doc_id = a.conv_id * 3 + a.i)"""
LINES = r"""lns AS (SELECT answer_id, conv_id, unnest(string_split(answer, chr(10))) AS line, unnest(range(len(string_split(answer, chr(10))))) AS line_no FROM ans),
sp AS (SELECT answer_id, line_no, [trim(x) for x in string_split(regexp_replace(trim(line), '([.!?]+(?:\s*\[\d+\])*)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) if trim(x) <> ''] AS p FROM lns WHERE trim(line) <> ''),
sj AS (SELECT answer_id, line_no, CASE WHEN len(p) > 1 AND trim(regexp_replace(p[-1], '\[\d+\]', '', 'g')) = '' THEN list_concat(p[1:len(p) - 2], [p[len(p) - 1] || ' ' || p[-1]]) ELSE p END AS p FROM sp),
sent AS (SELECT answer_id, line_no, unnest(p) AS sentence, unnest(range(len(p))) AS sent_no FROM sj),
mk AS (SELECT *, list_distinct(regexp_extract_all(sentence, '\[(\d+)\]', 1)) AS m, trim(regexp_replace(regexp_replace(sentence, '\[\d+\]', '', 'g'), '\s+', ' ', 'g')) AS bare FROM sent),
nx AS (SELECT *, CASE WHEN len(m) > 0 THEN regexp_extract_all(sentence, '\[(\d+)\]', 1) END AS mm FROM mk),
inh AS (SELECT *, coalesce(first_value(mm IGNORE NULLS) OVER (PARTITION BY answer_id, line_no ORDER BY sent_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  last_value(mm IGNORE NULLS) OVER (PARTITION BY answer_id, line_no ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS borrowed FROM nx),
cl0 AS (SELECT answer_id, line_no, sent_no, sentence, bare, coalesce(mm, borrowed, []) AS raw, mm IS NULL AND borrowed IS NOT NULL AS inherited FROM inh
  WHERE length(bare) >= 12 AND len(string_split(bare, ' ')) >= 3 AND NOT regexp_replace(bare, '[*_ ]+$', '') LIKE '%:' AND NOT bare LIKE '#%'),
claims AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY line_no, sent_no) - 1 AS claim_no,
  array_to_string([x for x, i in raw if list_position(raw, x) = i], ',') AS citations FROM cl0)""".replace("[x for x, i in raw if list_position(raw, x) = i]", "list_filter(raw, lambda x, i: list_position(raw, x) = i)")
CLAIMS = ANSWERS + ", " + LINES


def answers(spark, sf):
    a = table(spark, sf, "conversations").filter("role = 'assistant'")
    kind = F.col("conv_id") % 3
    text = (
        F.when(kind == 0, F.replace("text", F.lit(". "), F.lit(" [2]. ")))
        .when(kind == 1, F.replace("text", F.lit(".\n"), F.lit(". [1][3]\n"))).otherwise(F.concat("text", F.lit(" [9]"))))
    return a.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "conv_id", text.alias("answer"))


def blocks(spark, sf):
    a = answers(spark, sf).select("answer_id", "conv_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("index"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return a.withColumn("chunk_id", F.col("conv_id") * 3 + F.col("index")).join(shuffled(docs), "chunk_id").select("answer_id", "index", "chunk_id", "content")


def claims(spark, sf):
    return cc.assign_citations(answers(spark, sf))


def marks(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query("cc1_sentences", "WITH " + ANSWERS + ", " + LINES + " SELECT answer_id, count(*) AS n, md5(string_agg(sentence, '|' ORDER BY line_no, sent_no)) AS digest FROM sent GROUP BY answer_id")
def cc1(spark, sf):
    s = answers(spark, sf).select("answer_id", cc.split_sentences("answer").alias("s"))
    return s.select("answer_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("cc2_markers", "WITH " + ANSWERS + r""" SELECT answer_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS markers FROM
(SELECT answer_id, regexp_extract_all(answer, '\[(\d+)\]', 1) AS r FROM ans)""")
def cc2(spark, sf):
    return answers(spark, sf).select("answer_id", cc.markers("answer").alias("markers")).select("answer_id", marks("markers"))


@query("cc3_strip_markers", "WITH " + ANSWERS + r""" SELECT answer_id, md5(trim(regexp_replace(regexp_replace(answer, '\[\d+\]', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM ans""")
def cc3(spark, sf):
    return answers(spark, sf).select("answer_id", F.md5(cc.strip_markers("answer")).alias("digest"))


@query("cc4_checkable", "WITH " + CLAIMS + """ SELECT answer_id, count(*) FILTER (WHERE length(bare) >= 12 AND len(string_split(bare, ' ')) >= 3) AS checkable FROM mk GROUP BY answer_id""")
def cc4(spark, sf):
    s = answers(spark, sf).select("answer_id", F.explode(cc.split_sentences("answer")).alias("sentence"))
    return s.groupBy("answer_id").agg(F.count(F.when(cc.is_checkable("sentence"), 1)).alias("checkable"))


@query("cc5_lead_in", r"""SELECT conv_id, turn, conv_id % 2 = 0 OR turn % 2 = 0 OR regexp_matches(text, '^\s*#') OR regexp_matches(text, ':[\s*_]*$') AS lead_in FROM conversations""")
def cc5(spark, sf):
    s = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("## "), "text")).when(F.col("turn") % 2 == 0, F.concat("text", F.lit(":** [3] "))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", cc.is_lead_in(s).alias("lead_in"))


@query("cc6_assign_citations", "WITH " + CLAIMS + " SELECT answer_id, CAST(claim_no AS INTEGER) AS claim_no, sentence, citations, inherited FROM claims")
def cc6(spark, sf):
    return claims(spark, sf).select("answer_id", "claim_no", "sentence", marks("citations"), "inherited")


WINDOWS = r"""wp AS (SELECT answer_id, "index", content, [trim(x) for x in string_split(regexp_replace(regexp_replace(content, '([.!?])[ \t]*\n+|\n+', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if trim(x) <> ''] AS p FROM blk),
wf AS (SELECT answer_id, "index", content, [x for x in p if len([y for y in regexp_split_to_array(x, '\s+') if y <> '']) >= 4] AS p FROM wp),
wl AS (SELECT answer_id, "index", CASE WHEN len(p) = 0 THEN [content] ELSE list_concat(p, [p[i] || ' ' || p[i + 1] for i in range(1, len(p))]) END AS w FROM wf),
win AS (SELECT answer_id, "index", unnest(w) AS text, unnest(range(len(w))) AS window_no FROM wl)"""


@query("cc7_passage_windows", "WITH " + ANSWERS + ", " + WINDOWS + """ SELECT answer_id, CAST("index" AS INTEGER) AS "index", CAST(window_no AS INTEGER) AS window_no, md5(text) AS digest FROM win""")
def cc7(spark, sf):
    b = blocks(spark, sf).select("answer_id", "index", F.posexplode(cc.passage_windows("content")).alias("window_no", "w"))
    return b.select("answer_id", "index", "window_no", F.md5("w").alias("digest"))


SCORED = index_sql("SELECT answer_id AS query_id, answer AS query FROM ans", zones=CLAIMS + ", " + WINDOWS + r""", zones AS (
SELECT doc_id, 'heading' AS zone, split_part(text, chr(10), 1) AS text FROM documents
UNION ALL SELECT doc_id, 'body', substr(text, length(split_part(text, chr(10), 1)) + 2) FROM documents)""") + f""",
ctok AS ({exploded_sql('claims', 'answer_id, claim_no', 'bare')}), wtok AS ({exploded_sql('win', 'answer_id, "index", window_no', 'text')}),
vocab1 AS (SELECT token FROM ctok UNION SELECT token FROM wtok), {stems_sql('vocab1', 'stems1', 's1_')},
vocab2 AS (SELECT DISTINCT term AS token FROM stems1 WHERE term NOT IN {STOP_SQL} AND term NOT IN (SELECT term FROM dictionary)), {stems_sql('vocab2', 'stems2', 's2_')},
tidf AS (SELECT s.token, s.term, coalesce(d.idf, d2.idf) AS idf FROM stems1 s LEFT JOIN dictionary d USING (term) LEFT JOIN stems2 s2 ON s2.token = s.term LEFT JOIN dictionary d2 ON d2.term = s2.term
  WHERE s.token NOT IN {STOP_SQL} AND coalesce(d.idf, d2.idf) > 0),
cw AS (SELECT answer_id, claim_no, term, (1 + log10(count(*))) * any_value(idf) AS w FROM ctok JOIN tidf USING (token) GROUP BY ALL),
ww AS (SELECT answer_id, "index", window_no, term, (1 + log10(count(*))) * any_value(idf) AS w FROM wtok JOIN tidf USING (token) GROUP BY ALL),
cn AS (SELECT answer_id, claim_no, sqrt(sum(w * w)) AS n FROM cw GROUP BY ALL), wn AS (SELECT answer_id, "index", window_no, sqrt(sum(w * w)) AS n FROM ww GROUP BY ALL),
cited AS (SELECT DISTINCT answer_id, claim_no, CAST(unnest(raw) AS INTEGER) AS "index" FROM claims),
ws AS (SELECT c.answer_id, c.claim_no, c."index", w.window_no, sum(a.w * w.w) / (any_value(cn.n) * any_value(wn.n)) AS score FROM cited c JOIN cw a USING (answer_id, claim_no)
  JOIN ww w ON w.answer_id = c.answer_id AND w."index" = c."index" AND w.term = a.term JOIN cn ON cn.answer_id = c.answer_id AND cn.claim_no = c.claim_no
  JOIN wn ON wn.answer_id = w.answer_id AND wn."index" = w."index" AND wn.window_no = w.window_no GROUP BY ALL),
lex AS (SELECT c.answer_id, c.claim_no, max(coalesce(s.score, 0)) AS lexical FROM cited c JOIN blk b ON b.answer_id = c.answer_id AND b."index" = c."index"
  LEFT JOIN (SELECT answer_id, claim_no, "index", max(score) AS score FROM ws GROUP BY ALL) s ON s.answer_id = c.answer_id AND s.claim_no = c.claim_no AND s."index" = c."index" GROUP BY ALL),
sem AS (SELECT c.answer_id, c.claim_no, max(list_cosine_similarity(CAST(e1.embedding AS DOUBLE[]), CAST(e2.embedding AS DOUBLE[]))) AS semantic FROM cited c
  JOIN claims k USING (answer_id, claim_no) JOIN blk b ON b.answer_id = c.answer_id AND b."index" = c."index" JOIN embeddings e1 ON e1.vec_id = length(k.bare) % 500
  JOIN embeddings e2 ON e2.vec_id = length(b.content) % 500 GROUP BY ALL),
checked AS (SELECT k.answer_id, k.claim_no, k.citations, k.inherited, l.lexical, s.semantic, (l.lexical + s.semantic) / 2 AS score,
  CASE WHEN k.citations = '' THEN 'uncited' WHEN (l.lexical + s.semantic) / 2 >= 0.2 THEN 'supported' ELSE 'weak' END AS status
  FROM claims k LEFT JOIN lex l USING (answer_id, claim_no) LEFT JOIN sem s USING (answer_id, claim_no))"""


def text_vectors(spark, sf, texts):
    e = table(spark, sf, "embeddings")
    keyed = texts.withColumn("vec_id", (F.length("text") % 500).cast("bigint"))
    return keyed.join(shuffled(e.select("vec_id", "embedding")), "vec_id").select("text", "embedding")


def checked(spark, sf):
    c, b = claims(spark, sf), blocks(spark, sf)
    vectors = text_vectors(spark, sf, cc.texts_to_embed(c, b))
    return cc.score_claims(doc_index(spark, sf), c, b, vectors, threshold=0.2)


@query("cc8_lexical_scores", SCORED + " SELECT answer_id, CAST(claim_no AS INTEGER) AS claim_no, round(lexical, 4) AS lexical FROM lex")
def cc8(spark, sf):
    out = cc.score_claims(doc_index(spark, sf), claims(spark, sf), blocks(spark, sf))
    return out.filter("lexical is not null").select("answer_id", "claim_no", "lexical")


@query("cc9_semantic_scores", "WITH " + CLAIMS + """, cited AS (SELECT DISTINCT answer_id, claim_no, CAST(unnest(raw) AS INTEGER) AS "index" FROM claims)
SELECT c.answer_id, CAST(c.claim_no AS INTEGER) AS claim_no, round(max(list_cosine_similarity(CAST(e1.embedding AS DOUBLE[]), CAST(e2.embedding AS DOUBLE[]))), 4) AS semantic FROM cited c
JOIN claims k USING (answer_id, claim_no) JOIN blk b ON b.answer_id = c.answer_id AND b."index" = c."index" JOIN embeddings e1 ON e1.vec_id = length(k.bare) % 500
JOIN embeddings e2 ON e2.vec_id = length(b.content) % 500 GROUP BY c.answer_id, c.claim_no""")
def cc9(spark, sf):
    c, b = claims(spark, sf), blocks(spark, sf)
    out = cc.score_claims(None, c, b, text_vectors(spark, sf, cc.texts_to_embed(c, b)))
    return out.filter("semantic is not null").select("answer_id", "claim_no", "semantic")


@query("cc10_claim_status", SCORED + """ SELECT answer_id, CAST(claim_no AS INTEGER) AS claim_no, citations, inherited, round(lexical, 4) AS lexical,
round(semantic, 4) AS semantic, round(score, 4) AS score, status FROM checked""")
def cc10(spark, sf):
    return checked(spark, sf).select("answer_id", "claim_no", marks("citations"), "inherited", "lexical", "semantic", "score", "status")


@query("cc11_texts_to_embed", "WITH " + CLAIMS + """ SELECT md5(text) AS digest FROM (SELECT bare AS text FROM claims UNION SELECT b.content FROM blk b JOIN
(SELECT DISTINCT answer_id, CAST(unnest(raw) AS INTEGER) AS "index" FROM claims) c ON c.answer_id = b.answer_id AND c."index" = b."index")""")
def cc11(spark, sf):
    return cc.texts_to_embed(claims(spark, sf), blocks(spark, sf)).select(F.md5("text").alias("digest"))


@query("cc12_status_counts", SCORED + """ SELECT answer_id, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'weak') AS weak,
count(*) FILTER (WHERE status = 'uncited') AS uncited FROM checked GROUP BY answer_id""")
def cc12(spark, sf):
    return cc.status_counts(checked(spark, sf))


FRESH = "fresh AS (SELECT d.doc_id AS chunk_id, d.n_chars FROM documents d JOIN labels l USING (doc_id))"


def fresh_chunks(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("chunk_id"), "n_chars")


MARKED = r"""am AS (SELECT DISTINCT answer_id, CAST(unnest(regexp_extract_all(answer, '\[(\d+)\]', 1)) AS INTEGER) AS marker FROM ans)"""


@query("cc13_resolve_citations", "WITH " + ANSWERS + ", " + FRESH + ", " + MARKED + """ SELECT m.answer_id, m.marker, b.chunk_id, f.n_chars FROM am m
JOIN blk b ON b.answer_id = m.answer_id AND b."index" = m.marker JOIN fresh f USING (chunk_id)""")
def cc13(spark, sf):
    return cc.resolve_citations(answers(spark, sf), blocks(spark, sf), fresh_chunks(spark, sf)).select("answer_id", "marker", "chunk_id", "n_chars")


@query("cc13_resolution_counts", "WITH " + ANSWERS + ", " + FRESH + ", " + MARKED + """ SELECT a.answer_id, count(m.marker) AS parsed, count(f.chunk_id) AS resolved,
count(*) FILTER (WHERE m.marker IS NOT NULL AND b.chunk_id IS NULL) AS out_of_range, count(*) FILTER (WHERE b.chunk_id IS NOT NULL AND f.chunk_id IS NULL) AS missing_chunk
FROM ans a LEFT JOIN am m USING (answer_id) LEFT JOIN blk b ON b.answer_id = m.answer_id AND b."index" = m.marker LEFT JOIN fresh f USING (chunk_id) GROUP BY a.answer_id""")
def cc13_counts(spark, sf):
    return cc.resolution_counts(answers(spark, sf), blocks(spark, sf), fresh_chunks(spark, sf))


@query("cc14_section_citations", "WITH " + ANSWERS + ", " + MARKED + """ SELECT m.answer_id, m.marker, b.chunk_id AS section_id, split_part(b.content, chr(10), 1) AS heading FROM am m
JOIN blk b ON b.answer_id = m.answer_id AND b."index" = m.marker""")
def cc14(spark, sf):
    b = blocks(spark, sf).withColumns({"section_ids": F.array("chunk_id"), "headings": F.array(F.substring_index("content", "\n", 1))})
    return cc.resolve_section_citations(answers(spark, sf), b).select("answer_id", "marker", "section_id", "heading")


@query("cc15_prompts", "WITH " + ANSWERS + """ SELECT a.answer_id AS query_id, md5(coalesce(c.ctx, '(no context was retrieved for this notebook)') || chr(10) || chr(10) || 'Question: ' || a.answer) AS digest
FROM ans a LEFT JOIN (SELECT answer_id, string_agg('[' || "index" || '] ' || content, chr(10) || chr(10) ORDER BY "index") AS ctx FROM blk GROUP BY 1) c USING (answer_id)""")
def cc15(spark, sf):
    b = blocks(spark, sf).withColumnRenamed("answer_id", "query_id")
    q = answers(spark, sf).select(F.col("answer_id").alias("query_id"), F.col("answer").alias("query"))
    return cc.prompts(q, b).select("query_id", F.md5("prompt").alias("digest"))


# ---- evaluation pairs ------------------------------------------------------------------

CASE = "CASE item_id % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'contradict' END"
EVID = f"""ev AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'train' END AS split, {CASE} AS kind, item_id AS claim_id, text AS claim, item_id AS doc_id, '0,1,2' AS gold FROM benchmark WHERE item_id % 3 < 2
UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'train' END, 'support', item_id, text, item_id + 1, '1' FROM benchmark)"""


def claim_release(spark, sf):
    one = lambda label, *gold: F.struct(F.lit(label).alias("label"), F.array(*[F.lit(g) for g in gold]).alias("sentences"))
    case = F.col("item_id") % 3
    own = (F.when(case == 0, F.array(one("SUPPORT", 2, 0), one("SUPPORT", 1, 0)))
           .when(case == 1, F.array(one("CONTRADICT", 0, 1), one("CONTRADICT", 2))).otherwise(F.array(one("SUPPORT", 0), one("CONTRADICT", 1))))
    evidence = F.create_map(F.col("item_id").cast("string"), own, (F.col("item_id") + 1).cast("string"), F.array(one("SUPPORT", 1)))
    return table(spark, sf, "benchmark").select(
        F.when(F.col("item_id") % 2 == 0, "dev").otherwise("train").alias("split"), F.col("item_id").alias("claim_id"), F.col("text").alias("claim"),
        evidence.alias("evidence"), F.array(F.col("item_id") + 2).alias("cited_doc_ids"))


@query("ev11_evidence_pairs", f"WITH {EVID} SELECT split, kind, claim_id, doc_id, gold FROM ev")
def ev11(spark, sf):
    p = pr.evidence_pairs(claim_release(spark, sf))
    return p.select("split", "kind", "claim_id", F.col("doc_id").cast("bigint").alias("doc_id"), F.array_join(F.col("gold").cast("array<string>"), ",").alias("gold"))


HARD = """hard AS (SELECT query_id AS claim_id, min_by(doc_id, rank) AS doc_id FROM ranked WHERE doc_id NOT IN (query_id, query_id + 1, query_id + 2) GROUP BY 1)"""


@query("ev12_hard_negatives", index_sql() + scores_sql() + ", " + HARD + " SELECT claim_id, doc_id FROM hard")
def ev12(spark, sf):
    return pr.hard_negatives(listed_index(spark, sf), claim_release(spark, sf)).select("claim_id", "doc_id")


EASY = """num AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS number FROM documents),
st AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'train' END AS split, item_id AS claim_id,
  ('0x' || substr(md5('7:' || CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'train' END || ':' || item_id), 1, 15))::BIGINT AS h FROM benchmark),
easy AS (SELECT split, claim_id, min_by(doc_id, probe) AS doc_id FROM (SELECT *, unnest(range(4)) AS probe FROM st) JOIN num ON number = (h + probe) % (SELECT count(*) FROM documents) + 1
  WHERE doc_id NOT IN (claim_id, claim_id + 1, claim_id + 2) GROUP BY ALL)"""


@query("ev13_easy_negatives", "WITH " + EASY + " SELECT split, claim_id, doc_id FROM easy")
def ev13(spark, sf):
    return pr.easy_negatives(table(spark, sf, "documents"), claim_release(spark, sf), 7).select("split", "claim_id", "doc_id")


SCORED_PAIRS = index_sql() + scores_sql() + ", " + HARD + ", " + EASY + ", " + EVID + """,
allp AS (SELECT split, kind, claim_id, doc_id FROM ev UNION ALL SELECT s.split, 'hard_neg', claim_id, h.doc_id FROM hard h JOIN st s USING (claim_id) UNION ALL SELECT split, 'easy_neg', claim_id, doc_id FROM easy),
sp AS (SELECT *, ((claim_id * 13 + doc_id * 7) % 100) / CAST(100 AS DOUBLE) AS lexical, ((claim_id * 29 + doc_id * 3) % 90) / CAST(90 AS DOUBLE) AS semantic FROM allp),
scp AS (SELECT *, (lexical + semantic) / 2 AS combined FROM sp)"""
LONG = SCORED_PAIRS + """, lg AS (SELECT split, kind, signal, score FROM (SELECT split, kind, lexical, semantic, combined FROM scp) UNPIVOT (score FOR signal IN (lexical, semantic, combined))),
nb AS (SELECT *, unnest(CASE kind WHEN 'hard_neg' THEN ['hard', 'all'] WHEN 'easy_neg' THEN ['easy', 'all'] ELSE ['hard', 'easy', 'all'] END) AS negatives, kind = 'support' AS label FROM lg WHERE kind <> 'contradict')"""


def scored_pairs(spark, sf):
    release = claim_release(spark, sf)
    keys = ["split", "kind", "claim_id", "doc_id"]
    rows = pr.evidence_pairs(release).withColumn("doc_id", F.col("doc_id").cast("bigint")).select(keys)
    rows = rows.unionByName(pr.hard_negatives(listed_index(spark, sf), release).select(keys))
    rows = rows.unionByName(pr.easy_negatives(table(spark, sf, "documents"), release, 7).select(keys))
    lexical, semantic = ((F.col("claim_id") * 13 + F.col("doc_id") * 7) % 100) / 100.0, ((F.col("claim_id") * 29 + F.col("doc_id") * 3) % 90) / 90.0
    return rows.withColumns({"lexical": lexical, "semantic": semantic}).withColumn("combined", (F.col("lexical") + F.col("semantic")) / 2)


@query("ev14_score_table", SCORED_PAIRS + """ SELECT kind, count(*) AS n, round(avg(lexical), 6) AS lexical, round(avg(semantic), 6) AS semantic, round(avg(combined), 6) AS combined,
round(avg(CASE WHEN combined >= 0.33 THEN 1.0 ELSE 0.0 END), 6) AS supported_share FROM scp GROUP BY kind""")
def ev14(spark, sf):
    out = pr.score_table(scored_pairs(spark, sf))
    return out.select("kind", "n", *[r6(c).alias(c) for c in out.columns[2:]])


@query("ev15_tuned_thresholds", LONG + """, auc AS (SELECT negatives, signal, (sum(rk) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2)
  / (count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY negatives, signal ORDER BY score) + (count(*) OVER (PARTITION BY negatives, signal, score) - 1) / 2 AS rk
  FROM nb WHERE split = 'dev') GROUP BY ALL),
cuts AS (SELECT DISTINCT split, negatives, signal, score AS cut FROM nb),
f AS (SELECT c.split, c.negatives, c.signal, c.cut, 2.0 * count(*) FILTER (WHERE score >= cut AND label) / (2 * count(*) FILTER (WHERE score >= cut AND label) + count(*) FILTER (WHERE score >= cut AND NOT label)
  + count(*) FILTER (WHERE score < cut AND label)) AS f1 FROM cuts c JOIN nb USING (split, negatives, signal) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY split, negatives, signal ORDER BY round(f1, 10) DESC, cut) AS r FROM f),
fx AS (SELECT negatives, signal, count(*) FILTER (WHERE score >= 0.33 AND label) / count(*) FILTER (WHERE score >= 0.33) AS precision_fixed,
  count(*) FILTER (WHERE score >= 0.33 AND label) / count(*) FILTER (WHERE label) AS recall_fixed FROM nb WHERE split = 'dev' GROUP BY ALL),
tn AS (SELECT n.negatives, n.signal, any_value(b.cut) AS cut, count(*) FILTER (WHERE score >= b.cut AND label) AS tp, count(*) FILTER (WHERE score >= b.cut) AS pp, count(*) FILTER (WHERE label) AS p
  FROM nb n JOIN b ON b.split = 'train' AND b.r = 1 AND b.negatives = n.negatives AND b.signal = n.signal WHERE n.split = 'dev' GROUP BY ALL)
SELECT a.negatives, a.signal, round(auc, 6) AS auc, round(precision_fixed, 6) AS precision_fixed, round(recall_fixed, 6) AS recall_fixed, round(t.cut, 6) AS train_threshold,
round(t.tp / t.pp, 6) AS precision_tuned, round(t.tp / t.p, 6) AS recall_tuned, round(d.f1, 6) AS dev_f1 FROM auc a JOIN fx USING (negatives, signal) JOIN tn t USING (negatives, signal)
JOIN (SELECT * FROM b WHERE split = 'dev' AND r = 1) d ON d.negatives = a.negatives AND d.signal = a.signal""")
def ev15(spark, sf):
    out = pr.tuned_table(scored_pairs(spark, sf))
    shown = ["auc", "precision_fixed", "recall_fixed", "train_threshold", "precision_tuned", "recall_tuned", "dev_f1"]
    return out.select("negatives", "signal", *[r6(c).alias(c) for c in shown])


@query("ev16_contradictions", LONG + """, c AS (SELECT * FROM lg WHERE split = 'dev' AND kind IN ('support', 'contradict'))
SELECT signal, round((sum(rk) FILTER (WHERE kind = 'support') - count(*) FILTER (WHERE kind = 'support') * (count(*) FILTER (WHERE kind = 'support') + 1) / 2)
/ (count(*) FILTER (WHERE kind = 'support') * count(*) FILTER (WHERE kind = 'contradict')), 6) AS auc,
round(avg(CASE WHEN score >= 0.33 THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind = 'contradict'), 6) AS false_supported_rate
FROM (SELECT *, rank() OVER (PARTITION BY signal ORDER BY score) + (count(*) OVER (PARTITION BY signal, score) - 1) / 2 AS rk FROM c) GROUP BY signal""")
def ev16(spark, sf):
    out = pr.contradiction_table(scored_pairs(spark, sf))
    return out.select("signal", r6("auc").alias("auc"), r6("false_supported_rate").alias("false_supported_rate"))


@query("ev17_localization")
def ev17(spark, sf):
    """Every document is searched for the passage behind its own second sentence."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), F.col("text").alias("content"))

    def cut(rows):
        n = lambda w: ((F.size(w) + 1) / 2).cast("int")
        whole = F.filter(F.array(cc.passage_windows("content")), lambda w: n(w) >= 2)
        rows = rows.select("*", F.explode(whole).alias("windows"))  # the sentence rules run once for a text
        return rows.withColumn("sentences", F.slice("windows", F.lit(1), n("windows")))

    claim = hold(cut(docs).select("answer_id", F.lit(0).alias("claim_no"), F.get("sentences", F.lit(1)).alias("sentence"), F.array(F.lit(1)).alias("citations")))
    scored = cc.window_scores(doc_index(spark, sf), claim, docs.select("answer_id", F.lit(1).alias("index"), "content"))
    lists = scored.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("window_no", "score"))).alias("m"))
    scores = F.transform("windows", lambda w, i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    ready = cut(docs.join(shuffled(lists), "answer_id", "left")).select(
        F.lit("dev").alias("split"), "answer_id", "content", "sentences", F.array(F.lit(1)).alias("gold"), "windows", scores.alias("scores"))
    rates = pr.localization_rates(pr.localize(ready))
    return rates.select("split", "n", *[r6(c).alias(c) for c in rates.columns[2:]])
