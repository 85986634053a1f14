"""Registered queries: dense retrieval (DN), fusion (FU) and ranking metrics (EV1-EV10, EV23)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.vectors import cosine
from quarry.operators import dense as dn
from quarry.operators import fusion as fu
from quarry.operators import hooks, ivf
from quarry.operators import metrics as mt
from quarry.operators import ranked as rk
from quarry.plans.suite.common import bench_queries, index_sql, listed_index, query, r6, scores_sql, table
from quarry.scale import hold_dir

D = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
DIST = f"(1 - {D.format('q.embedding', 'v.embedding')})"


def distance(c="distance"):
    return (F.round(c, 6) + F.lit(0.0)).alias("distance")


def vectors(spark, sf):
    """Chunk vectors with the keys the reference stores: owner, model, section, organisation."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("owner_id"), "embedding", F.when(F.col("label") < 8, "active").otherwise("old").alias("model"),
        F.lit("chunk").alias("owner_type"), (F.col("vec_id") % 50).alias("section_id"), (F.col("label") % 2).alias("org_id"), "label",
    )


def vector_queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def section_vectors(spark, sf):
    cells = vectors(spark, sf).select("section_id", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("section_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(
        F.col("section_id").alias("owner_id"), F.col("c.m").alias("embedding"))


VEC = "v AS (SELECT vec_id, embedding, label, vec_id % 50 AS section_id FROM embeddings)"
SEC = """secs AS (SELECT section_id, list(m ORDER BY i) AS embedding FROM (SELECT section_id, i, avg(CAST(x AS DOUBLE)) AS m FROM
(SELECT section_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM v) GROUP BY ALL) GROUP BY ALL)"""
NEAR = "row_number() OVER (PARTITION BY q.vec_id ORDER BY round({d}, 10), v.vec_id)"
KNN = f"SELECT q.vec_id AS query_id, v.vec_id AS owner_id, {DIST} AS d, {NEAR.format(d=DIST)} AS rank FROM embeddings q, "
SHOW = "SELECT query_id, owner_id, round(d, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM x"


@query("dn1_knn", f"WITH x AS ({KNN} embeddings v WHERE v.label < 8 AND v.label % 2 = 1 QUALIFY rank <= 10) {SHOW}")
def dn1(spark, sf):
    hits = dn.knn(vector_queries(spark, sf), dn.active(vectors(spark, sf), "active", "chunk", 1), 10)
    return hits.select("query_id", "owner_id", distance(), "rank")


@query("dn2_section_knn", f"WITH {VEC}, {SEC}, x AS (SELECT q.vec_id AS query_id, v.section_id AS owner_id, {DIST} AS d, "
       f"row_number() OVER (PARTITION BY q.vec_id ORDER BY round({DIST}, 10), v.section_id) AS rank FROM embeddings q, secs v QUALIFY rank <= 8) {SHOW}")
def dn2(spark, sf):
    return dn.knn(vector_queries(spark, sf), section_vectors(spark, sf), 8).select("query_id", "owner_id", distance(), "rank")


@query("dn3_sections_only", f"WITH x AS ({KNN} embeddings v WHERE v.vec_id % 50 IN (SELECT s_nationkey FROM supplier) QUALIFY rank <= 10) {SHOW}")
def dn3(spark, sf):
    scope = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("section_id"))
    hits = dn.knn(vector_queries(spark, sf), dn.in_scope(vectors(spark, sf), scope, "section_id"), 10)
    return hits.select("query_id", "owner_id", distance(), "rank")


@query("dn4_batch_knn", f"WITH x AS ({KNN} embeddings v QUALIFY rank <= 100) {SHOW}")
def dn4(spark, sf):
    return dn.knn(vector_queries(spark, sf), vectors(spark, sf), 100).select("query_id", "owner_id", distance(), "rank")


@query("dn4_grid_knn", f"WITH x AS ({KNN} embeddings v QUALIFY rank <= 10) {SHOW}")
def dn4_grid(spark, sf):
    hits = dn.knn(vector_queries(spark, sf), vectors(spark, sf), 10, max_query_rows=0)
    return hits.select("query_id", "owner_id", distance(), "rank")


@query("dn5_cosine", f"WITH {VEC}, {SEC} SELECT v.vec_id, round({D.format('v.embedding', 's.embedding')}, 6) AS cosine FROM v JOIN secs s USING (section_id)")
def dn5(spark, sf):
    s = section_vectors(spark, sf).select(F.col("owner_id").alias("section_id"), F.col("embedding").alias("mean"))
    v = vectors(spark, sf).join(s, "section_id")
    return v.select(F.col("owner_id").alias("vec_id"), r6(cosine("embedding", "mean")).alias("cosine"))


@query("dn6_upsert", """SELECT p_partkey AS owner_id, CASE WHEN l.v IS NULL THEN p_retailprice ELSE l.v END AS value FROM part
LEFT JOIN (SELECT l_partkey, max_by(l_extendedprice, (l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey""")
def dn6(spark, sf):
    shape = lambda df, key, value, order: df.select(
        F.lit("chunk").alias("owner_type"), F.col(key).alias("owner_id"), F.lit("m").alias("model"),
        F.array(F.col(value)).alias("embedding"), order.alias("version"))
    old = shape(table(spark, sf, "part"), "p_partkey", "p_retailprice", F.lit(-1).cast("bigint"))
    arriving = table(spark, sf, "lineitem")
    new = shape(arriving, "l_partkey", "l_extendedprice", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    return dn.upsert(old, new, "version").select("owner_id", F.element_at("embedding", 1).alias("value"))


@query("dn7_embed")
def dn7(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("owner_id"), "text")
    out = dn.embed(texts, hooks.text_hash_embedder(16), "hash-16", 16)
    return out.select("owner_type", "owner_id", "model", "dim", r6(F.element_at("embedding", 1).cast("double")).alias("first"))


DN8 = f"""WITH x AS ({KNN} embeddings v WHERE v.label < 8 QUALIFY rank <= 10) SELECT query_id, owner_id, round(d, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM x"""
_FILES: dict[tuple, ivf.InvertedFile] = {}


def inverted_file(spark, sf):
    """The inverted file of the active vectors, built once per application and data folder."""
    key = (spark.sparkContext.applicationId, id(spark), sf)
    if key not in _FILES:
        _FILES[key] = ivf.write(dn.active(vectors(spark, sf), "active"), f"{hold_dir(spark)}/quarry_ivf_{uuid.uuid4().hex}")
    return _FILES[key]


@query("dn8_indexed_search", DN8)
def dn8(spark, sf):
    """All cells probed: the answer of the exact scan, through the inverted file."""
    file = inverted_file(spark, sf)
    return ivf.search(file, vector_queries(spark, sf), 10, len(file.centroids)).select("query_id", "owner_id", distance(), "rank")


@query("dn8_probed_search")
def dn8_probed(spark, sf):
    """A third of the cells, as on vectors without clusters; fewer do where vectors cluster. No SQL: the cells are learned."""
    file = inverted_file(spark, sf)
    return ivf.search(file, vector_queries(spark, sf), 10, -(-len(file.centroids) // 3)).select("query_id", "owner_id", distance(), "rank")


# ---- runs shared by fusion and metrics -------------------------------------------------

BASE = index_sql() + scores_sql() + f""", dq AS (SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
dense AS (SELECT q.query_id, v.vec_id AS doc_id, {DIST} AS d, row_number() OVER (PARTITION BY q.query_id ORDER BY round({DIST}, 10), v.vec_id) AS rank
  FROM dq q, embeddings v QUALIFY rank <= 100),
bm25 AS (SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 100),
qrels AS (SELECT b.item_id AS query_id, d.doc_id, CASE WHEN d.lang = 'en' THEN 2 ELSE 1 END AS grade
  FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))"""
FUSED = """, fused AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.doc_id, x.doc_id) AS chunk_id, v.rank AS vector_rank, x.rank AS lexical_rank,
v.d, x.score, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + x.rank), 0) AS fused_score
FROM (SELECT * FROM dense WHERE rank <= 25) v FULL JOIN (SELECT * FROM bm25 WHERE rank <= 25) x ON v.query_id = x.query_id AND v.doc_id = x.doc_id),
hyb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, vector_rank NULLS LAST, lexical_rank) AS rank FROM fused)"""


def dense_queries(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "query_id")
    return bench_queries(spark, sf).join(e.select("query_id", "embedding"), "query_id").select("query_id", "embedding")


def dense_run(spark, sf, k=100):
    return dn.knn(dense_queries(spark, sf), vectors(spark, sf), k)


def bm25_run(spark, sf, k=100):
    return rk.search(listed_index(spark, sf), bench_queries(spark, sf), k=k)


def qrels(spark, sf):
    """Documents that contain a benchmark passage, found through the passage's rarest inner term
    (every inner token of a contained passage is a token of the document), then verified."""
    idx, q = listed_index(spark, sf), bench_queries(spark, sf)
    from quarry.functions import text as tx
    from quarry.scale import lookup_join

    rows = tx.analyze(q.select("query_id", F.size(tx.tokenize("query")).alias("n"), F.col("query").alias("text")))
    inner = rows.filter((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)).select("query_id", "term").distinct()
    df = lookup_join(idx.dictionary.select("term", "df"), inner, ["term"], ["term"])
    rare = df.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    lists = idx.lists.lists.select("term", "shard", "ids")
    found = lookup_join(lists, rare, ["term"], ["shard"]).select("query_id", F.explode("ids").alias("doc_id")).distinct()
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    checked = docs.join(found, "doc_id").join(q.select("query_id", "query"), "query_id")
    return checked.filter(F.contains(F.lower("text"), F.lower("query"))).select(
        "query_id", "doc_id", F.when(F.col("lang") == "en", 2).otherwise(1).alias("grade"))


def _fused(spark, sf, k):
    d = dense_run(spark, sf, 25).withColumnRenamed("owner_id", "chunk_id")
    x = bm25_run(spark, sf, 25).withColumnRenamed("doc_id", "chunk_id")
    return fu.fuse_rrf(d, x) if k is None else fu.hybrid(d, x, k)


@query("fu1_rrf", BASE + FUSED + """ SELECT query_id, chunk_id, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank,
round(d, 6) + 0.0 AS distance, round(score, 6) AS sparse_score, round(fused_score, 6) AS fused_score, CAST(rank AS INTEGER) AS rank FROM hyb""")
def fu1(spark, sf):
    out = _fused(spark, sf, None)
    return out.select("query_id", "chunk_id", "vector_rank", "lexical_rank", distance(), r6("sparse_score").alias("sparse_score"),
                      r6("fused_score").alias("fused_score"), "rank")


RRF = """, rr AS (SELECT query_id, doc_id, sum(CAST(round((1.0 / (60 + rank)) * 1e12) AS BIGINT)) / 1e12 AS score FROM (SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM bm25) GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rr QUALIFY rank <= 100)"""


@query("fu2_rrf_runs", BASE + RRF + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rrf")
def fu2(spark, sf):
    return _rrf(spark, sf).select("query_id", "doc_id", r6("score").alias("score"), "rank")


def _rrf(spark, sf):
    return fu.fuse_runs([dense_run(spark, sf).withColumnRenamed("owner_id", "doc_id"), bm25_run(spark, sf)])


@query("fu3_hybrid", BASE + FUSED + " SELECT query_id, chunk_id, round(fused_score, 6) AS fused_score, CAST(rank AS INTEGER) AS rank FROM hyb WHERE rank <= 10")
def fu3(spark, sf):
    return _fused(spark, sf, 10).select("query_id", "chunk_id", r6("fused_score").alias("fused_score"), "rank")


@query("fu4_coarse_to_fine", f"""WITH {VEC}, {SEC}, c AS (SELECT q.vec_id AS query_id, v.section_id, row_number() OVER (PARTITION BY q.vec_id
ORDER BY round({DIST}, 10), v.section_id) AS r FROM embeddings q, secs v QUALIFY r <= 8),
fine AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DIST} AS d, 'hierarchical' AS strategy FROM c JOIN embeddings q ON q.vec_id = c.query_id
  JOIN v ON v.section_id = c.section_id),
flat AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DIST} AS d, 'flat' AS strategy FROM embeddings q, v
  WHERE q.vec_id NOT IN (SELECT query_id FROM fine))
SELECT query_id, chunk_id, round(d, 6) + 0.0 AS distance, strategy, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 10), chunk_id) AS INTEGER) AS rank
FROM (SELECT * FROM fine UNION ALL SELECT * FROM flat) QUALIFY rank <= 5""")
def fu4(spark, sf):
    out = fu.coarse_to_fine(vector_queries(spark, sf), section_vectors(spark, sf), vectors(spark, sf), 5)
    return out.select("query_id", "chunk_id", distance(), "strategy", "rank")


RERANKED = """, sc AS (SELECT query_id, chunk_id, ((query_id * 31 + chunk_id * 17) % 101) / 100.0 AS rerank_score FROM hyb WHERE query_id % 4 <> 0),
rer0 AS (SELECT h.query_id, h.chunk_id, h.rank AS candidate_rank, s.rerank_score, row_number() OVER (PARTITION BY h.query_id
ORDER BY round(s.rerank_score, 10) DESC NULLS LAST, h.rank) AS new_rank FROM hyb h LEFT JOIN sc s USING (query_id, chunk_id) WHERE h.rank <= 25),
rer AS (SELECT query_id, chunk_id, candidate_rank, rerank_score, new_rank AS rank FROM rer0 WHERE new_rank <= 8)"""


def rerank_scores(hits):
    """A stand-in for an external scorer; every fourth query has no scores (a failed call)."""
    value = ((F.col("query_id") * 31 + F.col("chunk_id") * 17) % 101) / 100.0
    return hits.filter("query_id % 4 <> 0").select("query_id", "chunk_id", value.alias("rerank_score"))


def _reranked(spark, sf):
    hits = _fused(spark, sf, None).select("query_id", "chunk_id", "rank")
    return fu.rerank(hits, rerank_scores(hits), 10)


@query("fu5_rerank", BASE + FUSED + RERANKED + " SELECT query_id, chunk_id, CAST(candidate_rank AS INTEGER) AS candidate_rank, CAST(rerank_score AS DOUBLE) AS rerank_score, CAST(rank AS INTEGER) AS rank FROM rer")
def fu5(spark, sf):
    return _reranked(spark, sf).select("query_id", "chunk_id", "candidate_rank", "rerank_score", "rank")


@query("fu5_rerank_run", BASE + """, s AS (SELECT *, CASE WHEN rank <= 50 THEN ((query_id * 31 + doc_id * 17) % 101) / 100.0 END AS rs FROM bm25)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS base_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (rs IS NOT NULL) DESC, rs DESC NULLS LAST, rank) AS INTEGER) AS rank FROM s""")
def fu5_run(spark, sf):
    run = bm25_run(spark, sf).select("query_id", "doc_id", "rank")
    value = ((F.col("query_id") * 31 + F.col("doc_id") * 17) % 101) / 100.0
    return fu.rerank_run(run, run.select("query_id", "doc_id", value.alias("rerank_score"))).select("query_id", "doc_id", "base_rank", "rank")


@query("fu6_context_blocks", BASE + FUSED + RERANKED + ' SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS "index" FROM rer')
def fu6(spark, sf):
    return fu.assemble_context(_reranked(spark, sf)).select("query_id", "chunk_id", "index")


@query("fu7_weak_evidence", BASE + FUSED + RERANKED + """ SELECT b.item_id AS query_id, coalesce(r.rerank_score < 0.9, false) AS fires FROM benchmark b
LEFT JOIN rer r ON r.query_id = b.item_id AND r.rank = 1""")
def fu7(spark, sf):
    return fu.weak_evidence(bench_queries(spark, sf), fu.assemble_context(_reranked(spark, sf)), 0.9)


@query("fu8_pages", BASE + FUSED + """ SELECT h.query_id, h.chunk_id, CAST(h.rank AS INTEGER) AS rank, l.quality AS page_start, l.quality + l.toxic AS page_end
FROM hyb h LEFT JOIN labels l ON l.doc_id = h.chunk_id WHERE h.rank <= 10""")
def fu8(spark, sf):
    pages = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("page_start"),
                                              (F.col("quality") + F.col("toxic")).alias("page_end"))
    return fu.with_pages(_fused(spark, sf, 10), pages).select("query_id", "chunk_id", "rank", "page_start", "page_end")


# ---- metrics ---------------------------------------------------------------------------

METHODS = ["bm25", "dense", "hybrid"]


def runs(spark, sf):
    d = dense_run(spark, sf).withColumnRenamed("owner_id", "doc_id")
    parts = {"bm25": bm25_run(spark, sf), "dense": d, "hybrid": _rrf(spark, sf)}
    rows = [df.select(F.lit(m).alias("method"), "query_id", "doc_id", "rank") for m, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


PER = BASE + RRF + """, runs AS (SELECT 'bm25' AS method, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense
UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM rrf),
j AS (SELECT r.*, g.grade FROM runs r LEFT JOIN qrels g USING (query_id, doc_id)),
ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) END) AS idcg FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM qrels) GROUP BY 1),
agg AS (SELECT method, query_id, count(*) FILTER (WHERE rank <= 1 AND grade IS NOT NULL) AS h1, count(*) FILTER (WHERE rank <= 5 AND grade IS NOT NULL) AS h5,
  count(*) FILTER (WHERE rank <= 10 AND grade IS NOT NULL) AS h10, count(*) FILTER (WHERE grade IS NOT NULL) AS h100,
  min(rank) FILTER (WHERE grade IS NOT NULL AND rank <= 10) AS first, min(rank) FILTER (WHERE grade IS NOT NULL) AS any_first,
  sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) END) AS dcg FROM j GROUP BY ALL),
per AS (SELECT m.method, q.query_id, coalesce(h1, 0) / 1.0 AS p1, coalesce(h5, 0) / 5.0 AS p5, coalesce(h10, 0) / 10.0 AS p10,
  coalesce(coalesce(h10, 0) / i.relevant, 0) AS r10, coalesce(coalesce(h100, 0) / i.relevant, 0) AS r100, coalesce(1.0 / first, 0) AS mrr,
  coalesce(coalesce(dcg, 0) / i.idcg, 0) AS ndcg, any_first
  FROM (VALUES ('bm25'), ('dense'), ('hybrid')) m(method) CROSS JOIN queries q LEFT JOIN agg a ON a.method = m.method AND a.query_id = q.query_id
  LEFT JOIN ideal i ON i.query_id = q.query_id)"""


def per_query(spark, sf):
    return mt.per_query(runs(spark, sf), qrels(spark, sf), bench_queries(spark, sf), METHODS)


def _rounded(df, *keys):
    return df.select(*keys, *[r6(f"`{m}`").alias(m) for m in mt.METRICS if m in df.columns])


@query("ev_qrels", BASE + " SELECT query_id, doc_id, CAST(grade AS INTEGER) AS grade FROM qrels")
def ev_qrels(spark, sf):
    return qrels(spark, sf)


@query("ev1_precision_recall", PER + ' SELECT method, query_id, round(p1, 6) AS "P@1", round(p5, 6) AS "P@5", round(p10, 6) AS "P@10", round(r10, 6) AS "R@10", round(r100, 6) AS "R@100" FROM per')
def ev1(spark, sf):
    return _rounded(per_query(spark, sf).drop("MRR@10", "nDCG@10"), "method", "query_id")


@query("ev2_reciprocal_rank", PER + " SELECT query_id, round(coalesce(1.0 / any_first, 0), 6) AS rr FROM per WHERE method = 'hybrid'")
def ev2(spark, sf):
    out = mt.reciprocal_rank(_rrf(spark, sf), qrels(spark, sf), bench_queries(spark, sf))
    return out.select("query_id", r6("rr").alias("rr"))


@query("ev3_ndcg", PER + ' SELECT method, query_id, round(ndcg, 6) AS "nDCG@10" FROM per')
def ev3(spark, sf):
    return _rounded(per_query(spark, sf).select("method", "query_id", "`nDCG@10`"), "method", "query_id")


MEANS = """ SELECT method, round(avg(p1), 6) AS "P@1", round(avg(p5), 6) AS "P@5", round(avg(p10), 6) AS "P@10", round(avg(r10), 6) AS "R@10",
round(avg(r100), 6) AS "R@100", round(avg(mrr), 6) AS "MRR@10", round(avg(ndcg), 6) AS "nDCG@10" FROM per GROUP BY method"""


@query("ev4_metric_table", PER + MEANS)
def ev4(spark, sf):
    return _rounded(mt.average(per_query(spark, sf)), "method")


@query("ev23_ablation", PER + MEANS)
def ev23(spark, sf):
    from quarry.plans.pipelines import ablation

    methods = {
        "bm25": bm25_run(spark, sf),
        "dense": dense_run(spark, sf).withColumnRenamed("owner_id", "doc_id"),
        "hybrid": _rrf(spark, sf),
    }
    return _rounded(ablation(methods, qrels(spark, sf), bench_queries(spark, sf)), "method")


BUCKETS = PER + """, wide AS (SELECT query_id, max(ndcg) FILTER (WHERE method = 'bm25') AS a_score, max(ndcg) FILTER (WHERE method = 'dense') AS b_score FROM per GROUP BY 1),
buckets AS (SELECT *, CASE WHEN round(a_score - b_score, 10) > 0.1 THEN 'bm25_wins' WHEN round(a_score - b_score, 10) < -0.1 THEN 'dense_wins' ELSE 'ties' END AS bucket FROM wide)"""


@query("ev8_method_buckets", BUCKETS + " SELECT bucket, count(*) AS n FROM buckets GROUP BY bucket")
def ev8(spark, sf):
    return mt.comparison(per_query(spark, sf), "bm25", "dense").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("ev9_bucket_profile", BUCKETS + r""", st AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents),
sdf AS (SELECT token, count(*) AS df FROM st GROUP BY 1),
sq AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
si AS (SELECT query_id, token, coalesce(df, 0) AS df, ln((SELECT n FROM n) / (1 + coalesce(df, 0))) AS idf FROM sq LEFT JOIN sdf USING (token)),
sp AS (SELECT query_id, count(*) AS len, count(*) FILTER (WHERE idf >= ln((SELECT n FROM n) / 101)) / count(*) AS hi,
  max(CASE WHEN regexp_matches(token, '[0-9]') THEN 1.0 ELSE 0.0 END) AS dig, count(*) FILTER (WHERE df = 0) / count(*) AS oov, avg(idf) AS mi FROM si GROUP BY 1)
SELECT bucket, count(*) AS n_queries, round(avg(len), 6) AS avg_query_len_tokens, round(avg(hi), 6) AS frac_high_idf_terms,
round(CAST(avg(dig) AS DOUBLE), 6) AS frac_queries_with_digits, round(avg(oov), 6) AS frac_terms_unseen_in_corpus, round(avg(mi), 6) AS mean_term_idf
FROM buckets JOIN sp USING (query_id) GROUP BY bucket""")
def ev9(spark, sf):
    b = mt.comparison(per_query(spark, sf), "bm25", "dense")
    out = mt.bucket_profile(b, bench_queries(spark, sf), table(spark, sf, "documents"))
    return out.select("bucket", "n_queries", *[r6(c).alias(c) for c in out.columns[2:]])


@query("ev10_examples", BUCKETS + """ SELECT bucket, query_id, round(a_score, 6) AS a_score, round(b_score, 6) AS b_score,
CAST(row_number() OVER (PARTITION BY bucket ORDER BY round(abs(a_score - b_score), 10) DESC, query_id) AS INTEGER) AS rank FROM buckets WHERE bucket <> 'ties' QUALIFY rank <= 5""")
def ev10(spark, sf):
    out = mt.examples(mt.comparison(per_query(spark, sf), "bm25", "dense"))
    return out.select("bucket", "query_id", r6("a_score").alias("a_score"), r6("b_score").alias("b_score"), "rank")


# ---- classification --------------------------------------------------------------------

LABELED = """lab AS (SELECT 'length' AS signal, d.n_chars / 1000.0 AS score, l.quality = 1 AS label FROM documents d JOIN labels l USING (doc_id)
UNION ALL SELECT 'lines', CAST(len(string_split(d.text, chr(10))) AS DOUBLE), l.quality = 1 FROM documents d JOIN labels l USING (doc_id)
UNION ALL SELECT 'toxic_length', d.n_chars / 1000.0, l.toxic = 1 FROM documents d JOIN labels l USING (doc_id))"""


def labeled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = F.array(
        F.struct(F.lit("length").alias("signal"), (F.col("n_chars") / 1000.0).alias("score"), (F.col("quality") == 1).alias("label")),
        F.struct(F.lit("lines").alias("signal"), F.size(F.split("text", "\n")).cast("double").alias("score"), (F.col("quality") == 1).alias("label")),
        F.struct(F.lit("toxic_length").alias("signal"), (F.col("n_chars") / 1000.0).alias("score"), (F.col("toxic") == 1).alias("label")),
    )
    return d.select(F.inline(rows))


AUC = """auc AS (SELECT signal, (sum(rk) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2)
/ (count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label)) AS auc, count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg
FROM (SELECT *, rank() OVER (PARTITION BY signal ORDER BY score) + (count(*) OVER (PARTITION BY signal, score) - 1) / 2 AS rk FROM lab) GROUP BY signal)"""


@query("ev5_roc_auc", f"WITH {LABELED}, {AUC} SELECT signal, n_pos, n_neg, round(auc, 6) AS auc FROM auc")
def ev5(spark, sf):
    return mt.roc_auc(labeled(spark, sf), ["signal"]).select("signal", "n_pos", "n_neg", r6("auc").alias("auc"))


CONF = """SELECT signal, count(*) FILTER (WHERE score >= {t} AND label) AS tp, count(*) FILTER (WHERE score >= {t} AND NOT label) AS fp,
count(*) FILTER (WHERE score < {t} AND NOT label) AS tn, count(*) FILTER (WHERE score < {t} AND label) AS fn"""


@query("ev6_confusion", f"""WITH {LABELED}, c AS ({CONF.format(t='1.5')} FROM lab GROUP BY signal),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, (tp + tn) / (tp + fp + tn + fn) AS accuracy FROM c)
SELECT signal, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(accuracy, 6) AS accuracy FROM p""")
def ev6(spark, sf):
    out = mt.confusion(labeled(spark, sf), 1.5, ["signal"])
    return out.select("signal", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("ev7_best_f1", f"""WITH {LABELED}, t AS (SELECT DISTINCT signal, score AS cut FROM lab),
c AS (SELECT t.signal, t.cut, count(*) FILTER (WHERE score >= cut AND label) AS tp, count(*) FILTER (WHERE score >= cut AND NOT label) AS fp,
  count(*) FILTER (WHERE score < cut AND label) AS fn FROM t JOIN lab USING (signal) GROUP BY ALL),
f AS (SELECT signal, cut, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT signal, round(cut, 6) AS threshold, round(f1, 6) AS best_f1 FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY round(f1, 10) DESC, cut) AS r FROM f) WHERE r = 1""")
def ev7(spark, sf):
    out = mt.best_f1(labeled(spark, sf), ["signal"])
    return out.select("signal", r6("threshold").alias("threshold"), r6("best_f1").alias("best_f1"))
