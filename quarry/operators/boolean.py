"""Boolean retrieval over a table of queries, as relational division and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.index import Index, doc_postings
from quarry.operators.ranked import resolve_terms, small_queries
from quarry.scale import SALTS, hold, is_small, lookup_join, row_count, top_k

OPERATORS = ("AND", "OR", "NOT")


def rejection(query: str | Column) -> Column:
    """Null for a well-formed query, else why it cannot be read unambiguously."""
    q = F.col(query) if isinstance(query, str) else query
    w = tx.words(q)
    first, last = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(-1))
    follows = F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
        F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.when(a.isin(*OPERATORS) & b.isin("AND", "OR"), F.concat(a, F.lit(" "), b)),
    )
    clash = F.try_element_at(F.filter(follows, lambda x: x.isNotNull()), F.lit(1))
    return (
        F.when(q.contains("(") | q.contains(")"), F.lit("Grouping with ( ) isn't available."))
        .when(~F.exists(w, lambda x: ~x.isin(*OPERATORS)), F.lit("The Boolean query has no search terms."))
        .when(first.isin("AND", "OR"), F.concat(F.lit("The query can't start with "), first, F.lit(".")))
        .when(last.isin(*OPERATORS), F.concat(F.lit("The query can't end with "), last, F.lit(".")))
        .when(clash.isNotNull(), F.concat(F.lit("'"), clash, F.lit("' needs a term between the operators.")))
    )


def split_valid(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed queries, and the rejected ones with a reason."""
    checked = queries.withColumn("reason", rejection("query"))
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def parse(queries: DataFrame, stemmer: str = "porter") -> DataFrame:
    """One row per operand term: query_id, clause, operand, word, negated, term, part.

    OR starts a clause, NOT toggles (an even count cancels), stop-word operands vanish but
    still end a pending NOT, and a word may analyze to several terms.
    """
    w = queries.select("query_id", F.posexplode(tx.words("query")).alias("operand", "word"))
    kinds = w.withColumn("is_or", (F.col("word") == "OR").cast("int")).withColumn(
        "is_not", (F.col("word") == "NOT").cast("int")
    ).withColumn("resets", F.when(F.col("word").isin("AND", "NOT"), 0).otherwise(1))
    order = Window.partitionBy("query_id").orderBy("operand")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("clause", F.sum("is_or").over(order).cast("int")).withColumn(
        "_span", F.coalesce(F.sum("resets").over(before), F.lit(0))
    )
    nots = F.sum("is_not").over(Window.partitionBy("query_id", "_span"))
    operands = placed.withColumn("negated", nots % 2 == 1).filter(~F.col("word").isin(*OPERATORS))
    terms = operands.select(
        "query_id", "clause", "operand", "word", "negated", F.posexplode(tx.terms_of("word", stemmer)).alias("part", "term")
    )
    return terms


def _wanted_docs(index: Index, wanted: DataFrame, checked: bool) -> DataFrame:
    """Distinct ``lookup, doc_id`` of the terms that are asked for; the others are left out before rows are made distinct."""
    rows = index.postings.select(F.col("term").alias("lookup"), "doc_id")
    return lookup_join(rows, wanted.select("lookup").distinct(), ["lookup"], ["doc_id"], "left_semi", checked=checked).distinct()


def _operand_docs(index: Index, wanted: DataFrame, keys: list[str], checked: bool) -> DataFrame:
    """Documents that hold every distinct term of a key group (relational division)."""
    need = wanted.groupBy(*keys).agg(F.countDistinct("lookup").alias("_need"))
    terms = wanted.select(*keys, "lookup").distinct().join(need, keys)
    found = lookup_join(_wanted_docs(index, terms, checked), terms, ["lookup"], ["doc_id"], checked=checked)
    return (
        found.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("_have"), F.first("_need").alias("_need"))
        .filter("_have = _need").select(*keys, "doc_id")
    )


def _resolved(index: Index, queries: DataFrame) -> tuple[DataFrame, bool]:
    ok = small_queries(queries)
    parsed = parse(queries, index.stemmer)
    forms = resolve_terms(index, parsed.select("term").distinct(), ok).select("term", "lookup", "df")
    return parsed.join(forms, "term"), ok


def _clause_docs(index: Index, terms: DataFrame, checked: bool) -> DataFrame:
    """Documents of each clause's positive part; all documents when it has none."""
    positives = _operand_docs(index, terms.filter("not negated"), ["query_id", "clause"], checked)
    open_clauses = terms.groupBy("query_id", "clause").agg(F.bool_and("negated").alias("only_not")).filter("only_not")
    # Such a clause starts from every document, so the rows below are its answer; documents are
    # dealt to buckets and each bucket meets the few open clauses.
    dealt = index.docs.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spread = open_clauses.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    everything = dealt.join(spread, "_b").select("query_id", "clause", "doc_id")
    return positives.unionByName(everything)


def clause_matches(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, clause, doc_id`` after the negated operands are taken away."""
    terms, ok = _resolved(index, queries)
    matched = _clause_docs(index, terms, ok)
    banned = _operand_docs(index, terms.filter("negated"), ["query_id", "clause", "operand"], ok)
    return matched.join(banned, ["query_id", "clause", "doc_id"], "left_anti")


def search(index: Index, queries: DataFrame) -> DataFrame:
    """Distinct ``query_id, doc_id`` over all clauses."""
    return clause_matches(index, queries).select("query_id", "doc_id").distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti").distinct()


def intersect_many(postings: DataFrame, wanted: DataFrame, checked: bool | None = None) -> DataFrame:
    """Documents holding all terms of each ``query_id`` in one grouped count."""
    ok = is_small(wanted) if checked is None else checked
    need = wanted.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("_need"))
    found = lookup_join(doc_postings(postings), wanted.distinct().join(need, "query_id"), ["term"], ["doc_id"], checked=ok)
    return found.groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("_have"), F.first("_need").alias("_need")
    ).filter("_have = _need").select("query_id", "doc_id")


def trace(index: Index, queries: DataFrame) -> DataFrame:
    """Every merge step: query_id, clause, step, op, term, df, result_size.

    Positive terms run in increasing document frequency; the size after step i is the number
    of documents whose run of held terms reaches i, so one pass over postings serves all steps.
    """
    terms, ok = _resolved(index, queries)
    terms = hold(terms)
    occurrence = F.row_number().over(Window.partitionBy("query_id", "clause").orderBy("df", "operand", "part"))
    plan = terms.filter("not negated").withColumn("i", occurrence)
    held = lookup_join(_wanted_docs(index, plan, ok), plan.select("query_id", "clause", "lookup", "i"), ["lookup"], ["doc_id"], checked=ok)
    runs = held.groupBy("query_id", "clause", "doc_id").agg(F.array_sort(F.collect_set("i")).alias("have")).select(
        "query_id", "clause", "doc_id", F.size(F.filter("have", lambda x, p: x == p + 1)).alias("run")
    )
    sizes = runs.filter("run > 0").groupBy("query_id", "clause", "run").agg(F.count(F.lit(1)).alias("n"))
    steps = plan.join(
        sizes.withColumnsRenamed({"run": "_run", "n": "_n"}), ["query_id", "clause"], "left"
    ).groupBy("query_id", "clause", "i", "term", "df").agg(
        F.coalesce(F.sum(F.when(F.col("_run") >= F.col("i"), F.col("_n"))), F.lit(0)).alias("result_size")
    )
    per_clause = Window.partitionBy("query_id", "clause")
    previous = F.lag("result_size").over(per_clause.orderBy("i"))
    positive = steps.withColumn("_prev", previous).filter("i = 1 or _prev > 0").select(
        "query_id", "clause", F.col("i").alias("step"), F.when(F.col("i") == 1, "START").otherwise("AND").alias("op"),
        "term", "df", "result_size",
    )
    only_not = terms.groupBy("query_id", "clause").agg(F.bool_and("negated").alias("o")).filter("o")
    n = row_count(index.docs)
    start_all = only_not.select("query_id", "clause", F.lit(1).alias("step"), F.lit("ALL").alias("op"),
                                F.lit("*").alias("term"), n.alias("df"), n.alias("result_size"))

    negated = terms.filter("negated")
    words = negated.groupBy("query_id", "clause", "operand").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "term"))), lambda s: s["term"]), " ").alias("term")
    ).withColumn("j", F.row_number().over(per_clause.orderBy("operand")))
    banned = hold(_operand_docs(index, negated, ["query_id", "clause", "operand"], ok))
    own = banned.groupBy("query_id", "clause", "operand").agg(F.count(F.lit(1)).alias("df"))
    hits = hold(_clause_docs(index, terms, ok))
    first_ban = banned.join(words.select("query_id", "clause", "operand", "j"), ["query_id", "clause", "operand"]).groupBy(
        "query_id", "clause", "doc_id").agg(F.min("j").alias("leaves"))
    life = hits.join(first_ban, ["query_id", "clause", "doc_id"], "left").groupBy("query_id", "clause", "leaves").agg(
        F.count(F.lit(1)).alias("n"))
    drops = words.join(own, ["query_id", "clause", "operand"], "left").join(
        life.withColumnsRenamed({"leaves": "_leaves", "n": "_n"}), ["query_id", "clause"], "left"
    ).groupBy("query_id", "clause", "j", "term", "df").agg(
        F.coalesce(F.sum(F.when(F.col("_leaves").isNull() | (F.col("_leaves") > F.col("j")), F.col("_n"))), F.lit(0)).alias("result_size")
    ).select("query_id", "clause", (F.col("j") + 1000).alias("step"), F.lit("AND NOT").alias("op"), "term",
             F.coalesce("df", F.lit(0)).alias("df"), "result_size")

    kept = hits.join(banned, ["query_id", "clause", "doc_id"], "left_anti")
    firsts = kept.groupBy("query_id", "doc_id").agg(F.min("clause").alias("clause"))
    new = firsts.groupBy("query_id", "clause").agg(F.count(F.lit(1)).alias("new"))
    size = kept.groupBy("query_id", "clause").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("query_id").orderBy("clause")
    merged = terms.select("query_id", "clause").distinct().join(new, ["query_id", "clause"], "left").join(
        size, ["query_id", "clause"], "left").select(
        "query_id", "clause", F.lit(1_000_000).alias("step"), F.lit("OR").alias("op"),
        F.concat(F.lit("clause "), F.row_number().over(order).cast("string")).alias("term"),
        F.coalesce("size", F.lit(0)).alias("df"), F.sum(F.coalesce("new", F.lit(0))).over(order).alias("result_size"))
    everything = positive.unionByName(start_all).unionByName(drops).unionByName(merged)
    return everything.withColumn("step", F.row_number().over(per_clause.orderBy("step")))


def ordered_hits(index: Index, queries: DataFrame, positions: DataFrame, k: int) -> DataFrame:
    """First ``k`` matches by ``(document_id, char_start)`` with their matched positive terms.

    ``positions``: doc_id, document_id, char_start of every indexed unit.
    """
    terms, ok = _resolved(index, queries)
    hits = top_k(
        search(index, queries).join(positions, "doc_id"), ["query_id"],
        [F.col("document_id").cast("string"), F.col("char_start"), F.col("doc_id")], k,
    )
    positive = terms.filter("not negated").groupBy("query_id", "lookup").agg(
        F.min_by("term", F.struct("operand", "part")).alias("term"), F.min(F.struct("operand", "part")).alias("at"))
    held = lookup_join(doc_postings(index.postings).withColumnRenamed("term", "lookup"), positive, ["lookup"], ["doc_id"], checked=ok)
    listed = held.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda s: s["term"]).alias("matched_terms"))
    return hits.join(listed, ["query_id", "doc_id"], "left").withColumn(
        "matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>")))
