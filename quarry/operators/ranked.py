"""Ranked retrieval for whole query tables: BM25 and lnc.ltc cosine per zone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import lists
from quarry.operators.index import Index, champions, log_tf
from quarry.scale import exact_sum, hold, is_small, lookup_join, salted_join, shuffled, small, top_k

BM25_K1 = 1.2
BM25_B = 0.75
QUERY_TEXT_BYTES = 8 << 20
VOCABULARY_ROWS = 20_000  # most terms of a text table that are broadcast
VOCABULARY_BYTES = 2 << 20
HOT_TERMS = 200  # most terms of a text table whose rows are dealt over several tasks of a join
HOT_ROWS = 10_000  # fewest rows of such a term
HEADING_WEIGHTS = {"heading": 2.0, "body": 1.0}  # lexical channel default


def query_term_counts(queries: DataFrame, stemmer: str = "porter", text: str = "query") -> DataFrame:
    """``query_id, term, qtf, first_pos`` of every analyzed query term."""
    rows = tx.term_rows(queries.select("query_id", text), text, stemmer)
    return rows.select("query_id", "term", F.size("positions").alias("qtf"), F.get("positions", F.lit(0)).alias("first_pos"))


def small_queries(queries: DataFrame) -> bool:
    """Bound on the raw query text that also bounds every term table derived from it."""
    return is_small(queries.select("query_id", "query"), size=QUERY_TEXT_BYTES)


def resolve_terms(index: Index, wanted: DataFrame, checked: bool | None = None) -> DataFrame:
    """Add ``lookup, df, idf``. A term missing from the dictionary is analyzed once more and
    used under its new form when that form exists (stemming twice can reach a known stem)."""
    forms = wanted.withColumn("_again", F.element_at(tx.stems(F.array("term"), index.stemmer), 1))
    forms = hold(forms.withColumn("_again", F.when(~tx.is_stop("term"), F.col("_again"))))
    ok = is_small(forms, VOCABULARY_ROWS, VOCABULARY_BYTES) if checked is None else checked
    keys = forms.select(F.explode(F.array("term", "_again")).alias("term")).distinct().dropna()
    hint = F.broadcast if ok else shuffled
    known = index.dictionary.join(hint(keys), "term", "left_semi")
    direct = hint(known.select("term", F.col("df").alias("_df"), F.col("idf").alias("_idf")))
    again = hint(known.select(F.col("term").alias("_again"), F.col("df").alias("_df2"), F.col("idf").alias("_idf2")))
    out = forms.join(direct, "term", "left").join(again, "_again", "left")
    return out.select(
        *wanted.columns,
        F.when(F.col("_df").isNull() & F.col("_df2").isNotNull(), F.col("_again")).otherwise(F.col("term")).alias("lookup"),
        F.coalesce("_df", "_df2", F.lit(0)).alias("df"),
        F.coalesce("_idf", "_idf2", F.lit(0.0)).alias("idf"),
    )


def query_terms(index: Index, counts: DataFrame, idf_threshold: float = 0.0, checked: bool | None = None) -> DataFrame:
    """Index elimination: keep terms whose idf exceeds the threshold; add the ltc weight."""
    kept = resolve_terms(index, counts, checked).filter(F.col("idf") > idf_threshold)
    kept = kept.withColumn("_w", log_tf("qtf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("query_id")))
    return kept.withColumn("qweight", F.when(norm > 0, F.col("_w") / norm)).drop("_w")


def zone_weight(zone: Column, weights: Mapping[str, float] | None) -> Column:
    """Weight of a zone; null when the zone is inactive."""
    if weights is None:
        return F.lit(1.0)
    out = F.lit(None).cast("double")
    for name, w in weights.items():
        if w:
            out = F.when(zone == name, F.lit(float(w))).otherwise(out)
    return out


def contributions(
    index: Index,
    queries: DataFrame,
    scheme: str = "bm25",
    zone_weights: Mapping[str, float] | None = None,
    use_champions: bool = False,
    idf_threshold: float = 0.0,
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """One row per (query, document, zone, term) that adds to a score.

    The query terms are the small side: they are broadcast after a size check (salted join
    beyond it), so postings are read in place and never shuffled by term.
    """
    if scheme not in ("bm25", "tfidf"):
        raise ValueError(f"unknown scheme {scheme!r}")
    counts = query_term_counts(queries, index.stemmer)
    ok = small_queries(queries)
    wanted = query_terms(index, counts, idf_threshold, ok).select(
        "query_id", "term", F.col("lookup"), "qtf", "idf", "qweight", "first_pos"
    )
    postings = index.postings.select("doc_id", "zone", F.col("term").alias("lookup"), "tf", "zone_len", "norm")
    postings = postings.withColumn("zweight", zone_weight(F.col("zone"), zone_weights)).filter("zweight is not null")
    rows = lookup_join(postings, wanted, ["lookup"], ["doc_id"], checked=ok)
    if use_champions:
        listed = champions(index).select("zone", F.col("term").alias("lookup"), "doc_id")
        listed = listed.withColumn("_w", zone_weight(F.col("zone"), zone_weights)).filter("_w is not null")
        pool = lookup_join(listed, wanted.select("query_id", "lookup").distinct(), ["lookup"], ["doc_id"], checked=ok)
        rows = rows.join(pool.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    if scheme == "tfidf":
        score = F.when(F.col("norm") > 0, F.col("qweight") * (log_tf("tf") / F.col("norm")))
    else:
        rows = rows.join(F.broadcast(index.zone_stats.select("zone", "avg_len")), "zone")  # one row per zone name given to the index
        ratio = F.col("zone_len") / F.col("avg_len")
        tf = F.col("tf").cast("double")
        score = F.when(
            F.col("avg_len") > 0, F.col("idf") * ((k1 + 1.0) * tf) / (k1 * ((1.0 - b) + b * ratio) + tf)
        )
    return rows.withColumn("weight", F.col("zweight") * score).filter("weight is not null").select(
        "query_id", "doc_id", "zone", "term", "tf", "idf", "weight"
    )


def early(
    index: Index, queries: DataFrame, k: int, scheme: str = "bm25", zone_weights: Mapping[str, float] | None = None,
    use_champions: bool = False, idf_threshold: float = 0.0, k1: float = BM25_K1, b: float = BM25_B,
) -> DataFrame:
    """``query_id, doc_id, score, touched``: the best ``k`` documents of each query in each shard of the
    stored lists, and how many postings of the shard were touched for the query."""
    if scheme not in ("bm25", "tfidf"):
        raise ValueError(f"unknown scheme {scheme!r}")
    wanted = query_terms(index, query_term_counts(queries, index.stemmer), idf_threshold, True)
    return lists.search(index.lists, wanted, k, scheme, zone_weights, index.zone_stats, k1, b, use_champions)


def rank_scores(scores: DataFrame, k: int | None) -> DataFrame:
    """Positive scores only; ties by ascending document id."""
    return top_k(scores.filter(F.col("score") > 0), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def search(index: Index, queries: DataFrame, k: int | None = 10, explain: bool = False, **options) -> DataFrame:
    """``query_id, doc_id, score, rank`` (plus ``explanation`` sorted by weight) per query."""
    if k is not None and k <= 0:
        queries = queries.filter(F.lit(False))
    elif k is not None and not explain and index.lists is not None and (index.lists.cuts is not None or not options.get("use_champions")) and small_queries(queries):
        return rank_scores(early(index, queries, k, **options).drop("touched"), k)
    rows = contributions(index, queries, **options)
    by = ["query_id", "doc_id"]
    hits = rank_scores(rows.groupBy(*by).agg(exact_sum("weight").alias("score")), k)
    if explain:
        if k is not None:  # only hits are explained: at most k for each query
            hits = hold(hits)
            rows = rows.join(small(hits.select(*by)), by, "left_semi")
        order = F.struct((-F.col("weight")).alias("o"), "zone", "term", "tf", "idf", "weight")
        parts = rows.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("explanation"))
        shown = F.transform("explanation", lambda e: F.struct(e["term"].alias("term"), e["zone"].alias("zone"), e["tf"].alias("tf"),
                                                              e["idf"].alias("idf"), e["weight"].alias("weight")))
        hits = hits.join(parts, by).select(*by, "score", shown.alias("explanation"), "rank")
    return hits


def lexical_channel(
    index: Index, queries: DataFrame, k: int, scheme: str = "tfidf", sections: DataFrame | None = None,
    doc_sections: DataFrame | None = None, heading_weight: float = 2.0,
) -> DataFrame:
    """Lexical candidates. A section filter applies after scoring the whole scope, so idf and
    lengths stay global; ``sections`` has ``query_id, section_id``."""
    weights = {"heading": heading_weight, "body": 1.0}
    rows = contributions(index, queries, scheme=scheme, zone_weights=weights)
    scores = rows.groupBy("query_id", "doc_id").agg(exact_sum("weight").alias("score"))
    if sections is not None:
        scores = scores.join(doc_sections.select("doc_id", "section_id"), "doc_id").join(
            small(sections.select("query_id", "section_id").distinct()), ["query_id", "section_id"], "left_semi"
        ).drop("section_id")
    return rank_scores(scores, k)


def term_stats(index: Index, queries: DataFrame, idf_threshold: float | None = None) -> DataFrame:
    """Per query term: surface words, counts, df, idf, postings and champions per zone."""
    stages = tx.query_stages(queries, index.stemmer)
    words = stages.select(
        "query_id", F.posexplode(F.arrays_zip("kept_tokens", "stems")).alias("pos", "w")
    ).select("query_id", "pos", F.col("w.kept_tokens").alias("token"), F.col("w.stems").alias("term"))
    per_form = words.groupBy("query_id", "term", "token").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = per_form.groupBy("query_id", "term").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("surface"),
        F.sum("n").cast("int").alias("query_tf"),
        F.min("pos").alias("first_pos"),
    )
    ok = small_queries(queries)
    resolved = resolve_terms(index, counts, ok)
    keys = resolved.select("lookup").distinct()
    matched = lookup_join(
        index.postings.select("zone", F.col("term").alias("lookup"), "doc_id"), keys, ["lookup"], ["doc_id"], checked=ok
    )
    sizes = matched.groupBy("lookup", "zone").agg(F.count(F.lit(1)).alias("n"))
    per_zone = sizes.groupBy("lookup").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", "n")))).alias("postings")
    )
    out = resolved.join(per_zone, "lookup", "left")
    eliminated = F.lit(False) if idf_threshold is None else F.col("idf") <= idf_threshold
    return out.select(
        "query_id", "term", "surface", "query_tf", "df", "idf", "first_pos",
        F.coalesce("postings", F.create_map().cast("map<string,bigint>")).alias("postings"),
        F.transform_values(
            F.coalesce("postings", F.create_map().cast("map<string,bigint>")),
            lambda z, n: F.least(n, F.lit(index.champion_r).cast("bigint")),
        ).alias("champions"),
        eliminated.alias("eliminated"),
    )


def ranked_trace(
    index: Index, queries: DataFrame, zone_weights: Mapping[str, float] | None = None,
    use_champions: bool = False, idf_threshold: float = 0.0,
) -> DataFrame:
    """Candidate pool sizes per query: documents with postings, champions, documents scored."""
    ok = small_queries(queries)
    resolved = resolve_terms(index, query_term_counts(queries, index.stemmer), ok)
    active = F.col("idf") > idf_threshold
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("first_pos", "term")))), lambda s: s["term"])
    named = resolved.groupBy("query_id").agg(ordered(active).alias("active_terms"), ordered(~active).alias("eliminated_terms"))
    wanted = resolved.filter(active).select("query_id", "lookup").distinct()

    def pool(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_w", zone_weight(F.col("zone"), zone_weights)).filter("_w is not null")
        rows = rows.select(F.col("term").alias("lookup"), "doc_id")
        return lookup_join(rows, wanted, ["lookup"], ["doc_id"], checked=ok).select("query_id", "doc_id").distinct()

    scored = pool(index.postings).withColumn("in_pool", F.lit(1))
    if use_champions:
        scored = scored.join(pool(champions(index)).withColumn("in_champions", F.lit(1)), ["query_id", "doc_id"], "full")
    else:
        scored = scored.withColumn("in_champions", F.lit(None).cast("int"))
    sizes = scored.groupBy("query_id").agg(
        F.count("in_pool").alias("docs_with_postings"),
        F.count("in_champions").alias("champion_candidates"),
        F.count(F.when(F.col("in_pool").isNotNull() & F.col("in_champions").isNotNull(), 1)).alias("both"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return queries.select("query_id").join(named, "query_id", "left").join(sizes, "query_id", "left").select(
        "query_id",
        F.coalesce("active_terms", F.array().cast("array<string>")).alias("active_terms"),
        F.coalesce("eliminated_terms", F.array().cast("array<string>")).alias("eliminated_terms"),
        zero("docs_with_postings").alias("docs_with_postings"),
        (zero("champion_candidates") if use_champions else F.lit(None).cast("bigint")).alias("champion_candidates"),
        (zero("both") if use_champions else zero("docs_with_postings")).alias("docs_scored"),
    )


def pair_cosine(index: Index, pairs: DataFrame) -> DataFrame:
    """tf-idf cosine of two texts per row of ``pair_id, text_a, text_b`` (0 when either side
    has no weighted term). Each distinct text is analyzed once."""
    sides = pairs.select(
        "pair_id",
        F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"text_{s}").alias("text")) for s in "ab"])),
    )
    n = F.size("positions")
    terms = hold(tx.term_rows(sides, "text", index.stemmer).groupBy("pair_id", "term").agg(
        F.sum(F.when(F.col("side") == "a", n).otherwise(0)).alias("tf_a"),
        F.sum(F.when(F.col("side") == "b", n).otherwise(0)).alias("tf_b"),
    ))
    weighed = with_weights(index, terms, ["pair_id"])
    a, b = log_tf("tf_a") * F.col("idf"), log_tf("tf_b") * F.col("idf")
    sums = weighed.groupBy("pair_id").agg(
        F.sum(a * b).alias("dot"), F.sqrt(F.sum(a * a)).alias("na"), F.sqrt(F.sum(b * b)).alias("nb")
    )
    score = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0)
    return pairs.select("pair_id").join(shuffled(sums.select("pair_id", score.alias("s"))), "pair_id", "left").select(
        "pair_id", F.coalesce("s", F.lit(0.0)).alias("score")
    )


def text_weights(index: Index, terms: DataFrame) -> DataFrame:
    """``term, n, idf`` for the distinct terms of a token table and their rows in it, stored so that its
    size can be checked before it is joined."""
    return hold(resolve_terms(index, terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))).select("term", "n", "idf"))


def with_weights(index: Index, terms: DataFrame, spread: list[str]) -> DataFrame:
    """``terms`` of positive ``idf``. The vocabulary of texts grows with them, so only a short one goes through the driver;
    a longer one is joined by shuffles, with the most frequent terms dealt over several tasks."""
    held = text_weights(index, terms)
    found = held.filter("idf > 0").select("term", "idf")
    if is_small(found, VOCABULARY_ROWS, VOCABULARY_BYTES):
        return terms.join(F.broadcast(found), "term")
    hot = held.filter(F.col("n") >= HOT_ROWS).orderBy(F.col("n").desc(), "term").limit(HOT_TERMS).select("term").collect()
    return salted_join(terms, found, ["term"], spread, hot=[r["term"] for r in hot])


def hits_total(index: Index, queries: DataFrame, **options) -> DataFrame:
    """Search response rows: rank, matched terms in explanation order, total documents scored."""
    k = options.pop("k", 10)
    scheme = options.pop("scheme", "bm25")
    hits = search(index, queries, k=k, explain=True, scheme=scheme, **options)
    totals = ranked_trace(index, queries, **options).select("query_id", F.col("docs_scored").alias("total_matches"))
    return hits.join(totals, "query_id").withColumn(
        "matched_terms", F.array_distinct(F.transform("explanation", lambda e: e["term"]))
    )
