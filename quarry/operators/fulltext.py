"""Web-style lexical search: quoted phrases, ``or`` and ``-word`` over analyzed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import phrase, ranked
from quarry.operators.index import Index
from quarry.scale import exact_sum, small


def items(queries: DataFrame) -> DataFrame:
    """``query_id, part, n, negated, query``: the words and quoted phrases of each query. ``part``
    numbers the alternatives that an unquoted ``or`` separates; NOT is an ordinary word."""
    found = F.regexp_extract_all("query", F.lit(r'(-?"[^"]*"|[^\s"]+)'), F.lit(1))
    rows = queries.select("query_id", found.alias("found")).select("query_id", "found", F.posexplode("found").alias("n", "item"))
    is_or = lambda c: F.lower(c) == "or"
    part = F.size(F.filter(F.slice("found", F.lit(1), F.col("n")), is_or))
    body = F.regexp_replace(F.regexp_replace("item", "^-", ""), '"', " ")
    return rows.filter(~is_or(F.col("item"))).select("query_id", part.alias("part"), "n", F.col("item").startswith("-").alias("negated"), body.alias("query"))


def search(index: Index, queries: DataFrame, k: int, zone: str = "body",
           doc_sections: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Top ``k`` matches per query, ranked by lnc.ltc over one zone; ``distance`` is null.

    A document matches an alternative if it holds each of its words and quoted phrases in the
    zone and none of the negated ones in any zone. Items of stop words alone ask for nothing, an
    alternative of negations alone matches nothing. Matches whose terms have no weight score 0.
    """
    keyed = items(queries).select(F.struct("query_id", "part", "n", "negated").alias("query_id"), "query")
    asks = tx.analyze(keyed, "query", index.stemmer).select("query_id").distinct()
    keyed = keyed.join(asks, "query_id", "left_semi")
    wanted = keyed.filter("not query_id.negated")
    key = [F.col(f"query_id.{c}").alias(c) for c in ("query_id", "part")]
    need = wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("need"))
    have = phrase.search(index, wanted, zone).groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("have"))
    banned = phrase.search(index, keyed.filter("query_id.negated")).select(*key, "doc_id").distinct()
    matched = have.join(need, ["query_id", "part"]).filter("have = need").join(banned, ["query_id", "part", "doc_id"], "left_anti").select("query_id", "doc_id").distinct()
    words = F.array_sort(F.collect_list(F.struct(F.col("query_id.n").alias("n"), "query")))
    bare = wanted.groupBy(F.col("query_id.query_id").alias("query_id")).agg(F.array_join(F.transform(words, lambda w: w["query"]), " ").alias("query"))
    rows = ranked.contributions(index, bare, scheme="tfidf", zone_weights={zone: 1.0})
    scores = rows.groupBy("query_id", "doc_id").agg(exact_sum("weight").alias("score"))
    scores = matched.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    if sections is not None:
        scores = scores.join(doc_sections.select("doc_id", "section_id"), "doc_id").join(
            small(sections.select("query_id", "section_id").distinct()), ["query_id", "section_id"], "left_semi").drop("section_id")
    return ranked.rank_scores(scores, k).withColumn("distance", F.lit(None).cast("double"))
