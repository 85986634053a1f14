"""Shared inputs of the registered queries and the SQL fragments of their checks.

Inputs are derived from the test tables by the same expression on the Spark and SQL side:
zones are the first line and the rest of a document, queries are the benchmark passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import porter
from quarry.functions.text import STOP_WORDS
from quarry.operators import index as ix
from quarry.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when given, the SQL that must produce the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- Spark inputs ----------------------------------------------------------------------


def first_line(c: str = "text"):
    return F.substring_index(F.col(c), "\n", 1)


def other_lines(c: str = "text"):
    return F.expr(f"substring({c}, length(substring_index({c}, '\\n', 1)) + 2)")


def doc_zones(spark: SparkSession, sf: str) -> DataFrame:
    return ix.zone_rows(table(spark, sf, "documents"), {"heading": first_line(), "body": other_lines()})


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict[tuple, ix.Index] = {}


def doc_index(spark: SparkSession, sf: str) -> ix.Index:
    """The document index, built and stored once per application and data folder."""
    key = (spark.sparkContext.applicationId, id(spark), sf, "docs")
    if key not in _INDEXES:
        zones = doc_zones(spark, sf)
        _INDEXES[key] = ix.held(ix.build(zones, buckets=ix.buckets_for(zones)))
    return _INDEXES[key]


def counted_index(spark: SparkSession, sf: str) -> ix.Index:
    """The dictionary of the documents, for queries that read no postings."""
    key = (spark.sparkContext.applicationId, id(spark), sf, "counts")
    if key not in _INDEXES:
        _INDEXES[key] = ix.counted(doc_zones(spark, sf))
    return _INDEXES[key]


def listed_index(spark: SparkSession, sf: str) -> ix.Index:
    """The stored lists of the documents, which ranked searches read."""
    key = (spark.sparkContext.applicationId, id(spark), sf, "lists")
    if key not in _INDEXES:
        _INDEXES[key] = ix.listed(doc_zones(spark, sf))
    return _INDEXES[key]


def champion_index(spark: SparkSession, sf: str) -> ix.Index:
    """The stored lists with their champion cuts, which only champion searches read."""
    key = (spark.sparkContext.applicationId, id(spark), sf, "cuts")
    if key not in _INDEXES:
        _INDEXES[key] = ix.with_cuts(listed_index(spark, sf))
    return _INDEXES[key]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- SQL fragments ---------------------------------------------------------------------

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
TOKENS_SQL = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


def tokens_sql(expr: str) -> str:
    return TOKENS_SQL.format(expr)


def exploded_sql(source: str, keys: str, text: str) -> str:
    """Token rows of a CTE: keys, token, pos (zero based)."""
    return (
        f"SELECT {keys}, unnest(toks) AS token, unnest(range(len(toks))) AS pos "
        f"FROM (SELECT {keys}, {tokens_sql(text)} AS toks FROM {source})"
    )


def _suffix_sql(src: str, name: str, suffixes: dict[str, str], condition: str | None) -> str:
    test = f" AND regexp_matches(base, '{condition}')" if condition else ""
    swap = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in suffixes.items())
    return (
        f"{name}a AS (SELECT token, w, regexp_extract(w, '{porter.ends_with_any(suffixes)}', 0) AS suf FROM {src}), "
        f"{name}b AS (SELECT token, w, suf, left(w, length(w) - length(suf)) AS base FROM {name}a), "
        f"{name} AS (SELECT token, CASE WHEN suf <> ''{test} THEN base || CASE suf {swap} END ELSE w END AS w FROM {name}b), "
    )


def stems_sql(vocab: str, out: str = "stems", p: str = "st") -> str:
    """CTEs from ``vocab(token)`` to ``out(token, term)`` following the same published rules."""
    v, m0, m1, is1, cvc = porter.ANY_VOWEL, porter.M_OVER_0, porter.M_OVER_1, porter.M_IS_1, porter.CVC
    sql = f"{p}0 AS (SELECT DISTINCT token, regexp_replace(token, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM {vocab}), "
    sql += _suffix_sql(f"{p}0", f"{p}1", porter.STEP_1A, None)
    sql += (
        f"{p}2a AS (SELECT token, w, regexp_extract(w, '(?:eed|ed|ing)$', 0) AS suf FROM {p}1), "
        f"{p}2b AS (SELECT token, w, suf, left(w, length(w) - length(suf)) AS base FROM {p}2a), "
        f"{p}2 AS (SELECT token, CASE WHEN suf = '' THEN w "
        f"WHEN suf = 'eed' THEN CASE WHEN regexp_matches(base, '{m0}') THEN base || 'ee' ELSE w END "
        f"WHEN NOT regexp_matches(base, '{v}') THEN w "
        f"WHEN regexp_matches(base, '(?:at|bl|iz)$') THEN base || 'e' "
        f"WHEN length(base) > 1 AND right(base, 1) = substr(base, length(base) - 1, 1) "
        f"AND regexp_matches(base, '[^aeiouy]$') THEN CASE WHEN right(base, 1) IN ('l', 's', 'z') THEN base "
        f"ELSE left(base, length(base) - 1) END "
        f"WHEN regexp_matches(base, '{is1}') AND regexp_matches(base, '{cvc}') THEN base || 'e' ELSE base END AS w FROM {p}2b), "
        f"{p}3 AS (SELECT token, CASE WHEN regexp_matches(w, '[aeiouy].*[yY]$') "
        f"THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM {p}2), "
    )
    sql += _suffix_sql(f"{p}3", f"{p}4", porter.STEP_2, m0) + _suffix_sql(f"{p}4", f"{p}5", porter.STEP_3, m0)
    sql += (
        f"{p}6a AS (SELECT token, w, regexp_extract(w, '{porter.ends_with_any(porter.STEP_4)}', 0) AS suf FROM {p}5), "
        f"{p}6b AS (SELECT token, w, suf, left(w, length(w) - length(suf)) AS base FROM {p}6a), "
        f"{p}6 AS (SELECT token, CASE WHEN suf <> '' AND regexp_matches(base, '{m1}') "
        f"AND (suf <> 'ion' OR regexp_matches(base, '[st]$')) THEN base ELSE w END AS w FROM {p}6b), "
        f"{p}7b AS (SELECT token, w, regexp_replace(w, 'e$', '') AS base FROM {p}6), "
        f"{p}7 AS (SELECT token, CASE WHEN w LIKE '%e' AND (regexp_matches(base, '{m1}') "
        f"OR (regexp_matches(base, '{is1}') AND NOT regexp_matches(base, '{cvc}'))) THEN base ELSE w END AS w FROM {p}7b), "
        f"{out} AS (SELECT token, replace(CASE WHEN w LIKE '%ll' AND regexp_matches(left(w, length(w) - 1), '{m1}') "
        f"THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y') AS term FROM {p}7)"
    )
    return sql


ZONES_SQL = """zones AS (
SELECT doc_id, 'heading' AS zone, split_part(text, chr(10), 1) AS text FROM documents
UNION ALL SELECT doc_id, 'body', substr(text, length(split_part(text, chr(10), 1)) + 2) FROM documents)"""


def index_sql(queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark", zones: str = ZONES_SQL) -> str:
    """CTEs: zones, tok, queries, qtok, stems, terms, postings, doc_zone, docs, dictionary,
    zone_stats, qterms (query_id, term, qtf, first_pos, df, idf)."""
    return (
        f"WITH {zones}, tok AS ({exploded_sql('zones', 'doc_id, zone', 'text')}), "
        f"queries AS ({queries}), qtok AS ({exploded_sql('queries', 'query_id', 'query')}), "
        "vocab AS (SELECT token FROM tok UNION SELECT token FROM qtok), "
        + stems_sql("vocab")
        + f""", terms AS (SELECT doc_id, zone, pos, token, term FROM tok JOIN stems USING (token) WHERE token NOT IN {STOP_SQL}),
counted AS (SELECT doc_id, zone, term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM terms GROUP BY ALL),
lens AS (SELECT doc_id, zone, sum(tf) AS zone_len, sqrt(sum((1 + log10(tf)) ** 2)) AS norm FROM counted GROUP BY ALL),
postings AS (SELECT c.*, l.zone_len, l.norm FROM counted c JOIN lens l USING (doc_id, zone)),
doc_zone AS (SELECT z.doc_id, z.zone, coalesce(l.zone_len, 0) AS len, coalesce(l.norm, 0) AS norm
  FROM zones z LEFT JOIN lens l USING (doc_id, zone)),
docs AS (SELECT DISTINCT doc_id FROM zones), n AS (SELECT count(*) AS n FROM docs),
zone_stats AS (SELECT zone, sum(len) / (SELECT n FROM n) AS avg_len FROM doc_zone GROUP BY zone),
dictionary AS (SELECT term, count(DISTINCT doc_id) AS df, log10((SELECT n FROM n) / count(DISTINCT doc_id)) AS idf
  FROM postings GROUP BY term),
qkept AS (SELECT query_id, pos, token, term FROM qtok JOIN stems USING (token) WHERE token NOT IN {STOP_SQL}),
qmiss AS (SELECT DISTINCT term AS token FROM qkept WHERE term NOT IN {STOP_SQL} AND term NOT IN (SELECT term FROM dictionary)),
{stems_sql('qmiss', 'stemsq', 'sq_')},
qterms AS (SELECT q.*, CASE WHEN d.df IS NULL AND d2.df IS NOT NULL THEN d2.term ELSE q.term END AS lookup,
  coalesce(d.df, d2.df, 0) AS df, coalesce(d.idf, d2.idf, 0) AS idf FROM
  (SELECT query_id, term, count(*) AS qtf, min(pos) AS first_pos FROM qkept GROUP BY ALL) q LEFT JOIN dictionary d USING (term)
  LEFT JOIN stemsq s2 ON s2.token = q.term LEFT JOIN dictionary d2 ON d2.term = s2.term)"""
    )


def scores_sql(scheme: str = "bm25", zones: str = "(VALUES ('heading', 1.0), ('body', 1.0))", threshold: float = 0.0,
               champions: bool = False, champion_r: int = 50) -> str:
    """CTEs after ``index_sql``: active, contrib (one row per query, doc, zone, term), scores."""
    champ = pool = ""
    if champions:
        champ = f""", champs AS (SELECT zone, term, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY zone, term
  ORDER BY tf DESC, doc_id) AS r FROM postings) WHERE r <= {champion_r}),
cand AS (SELECT DISTINCT a.query_id, c.doc_id FROM champs c JOIN active a ON a.lookup = c.term JOIN zw USING (zone))"""
        pool = "JOIN cand USING (query_id, doc_id)"
    if scheme == "bm25":
        value = "a.idf * (2.2 * p.tf) / (1.2 * (0.25 + 0.75 * p.zone_len / s.avg_len) + p.tf)"
    else:
        value = "((1 + log10(a.qtf)) * a.idf / a.qnorm) * ((1 + log10(p.tf)) / p.norm)"
    return f""", zw AS (SELECT * FROM {zones} w(zone, zw)),
kept AS (SELECT * FROM qterms WHERE idf > {threshold}),
active AS (SELECT *, sqrt(sum(((1 + log10(qtf)) * idf) ** 2) OVER (PARTITION BY query_id)) AS qnorm FROM kept){champ},
contrib AS (SELECT a.query_id, p.doc_id, p.zone, a.term, p.tf, a.idf, zw.zw * {value} AS weight
  FROM active a JOIN postings p ON p.term = a.lookup JOIN zw USING (zone) JOIN zone_stats s USING (zone) {pool}),
scores AS (SELECT query_id, doc_id, sum(CAST(round(weight * 1e12) AS BIGINT)) / 1e12 AS score FROM contrib GROUP BY ALL HAVING sum(weight) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
"""
