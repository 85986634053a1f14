"""Highlights and snippets for hit rows that carry their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

SNIPPET_WIDTH = 320
NOT_IN_WORD = r"[\p{L}\p{N}]"
_GAP = "\ufdd0"  # a Unicode noncharacter, reserved for process-internal use


def surface_forms(hits: DataFrame, stemmer: str = "porter") -> DataFrame:
    """Add ``highlights``: distinct words of ``text`` (original case, first-seen order) whose
    term is in ``matched_terms``. Works inside each row; no shuffle."""
    raw = tx.raw_tokens("text")
    lists = hits.withColumn("_raw", raw).withColumn("_folded", F.transform("_raw", lambda t: t))
    # casefold each token on its own, so a token keeps its index
    folded = F.split(tx.fold(F.array_join("_raw", " ")), " ")
    lists = lists.withColumn("_stems", tx.stems(F.when(F.size("_raw") > 0, folded).otherwise(F.array().cast("array<string>")), stemmer))
    wanted = F.filter(
        F.arrays_zip(F.col("_raw").alias("raw"), F.col("_stems").alias("stem"), folded.alias("folded")),
        lambda s: F.array_contains(F.col("matched_terms"), s["stem"]) & ~s["folded"].isin(tx.STOP_WORDS),
    )
    return lists.withColumn("highlights", F.array_distinct(F.transform(wanted, lambda s: s["raw"]))).drop(
        "_raw", "_folded", "_stems")


def _pieces(text: Column) -> Column:
    """Gap, token, gap, token, ... of a text."""
    return F.split(F.regexp_replace(text, f"({tx.TOKEN})", f"{_GAP}$1{_GAP}"), _GAP)


def phrase_spans(text: str | Column, starts: Column, length: Column) -> Column:
    """Character spans ``(start, end)`` of phrase occurrences from raw-token positions; empty
    when normalization changed the token count."""
    t = F.col(text) if isinstance(text, str) else text
    wide = F.greatest(length, F.lit(1))

    def spans(of: Column) -> Column:
        upto = lambda n: F.aggregate(F.slice(of["sizes"], F.lit(1), n), F.lit(0), lambda a, x: a + x)
        n_tokens = (F.size(of["sizes"]) - 1) / 2
        span = lambda p: F.struct(upto(2 * p + 1).alias("start"), upto(2 * (p + wide)).alias("end"))
        found = F.transform(F.filter(starts, lambda p: (p >= 0) & (p + wide - 1 < n_tokens)), span)
        return F.when(n_tokens == of["n"], found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    # the text is split once for all its spans
    return tx.bind(F.struct(F.transform(_pieces(t), F.length).alias("sizes"), F.size(tx.tokenize(t)).alias("n")), spans)


def first_word(text: Column, words: Column) -> Column:
    """Zero-based start of the first whole-word occurrence of any word, -1 if none."""
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?<!{NOT_IN_WORD})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{NOT_IN_WORD})"))
    parts = F.split(text, pattern, 2)
    return F.when((F.size(words) > 0) & (F.size(parts) > 1), F.length(parts[0])).otherwise(F.lit(-1))


def snippet(text: str | Column, words: Column, anchor: Column | None = None, width: int = SNIPPET_WIDTH) -> Column:
    """About ``width`` characters around the anchor, else around the first highlighted word."""
    t = F.col(text) if isinstance(text, str) else text
    found = first_word(t, words)
    first = F.coalesce(anchor, found) if anchor is not None else found
    near = F.greatest(F.lit(0), first - width // 3)
    end = F.least(F.length(t), near + width)
    start = F.greatest(F.lit(0), end - width)
    cut = tx.strip(F.substring(t, start + 1, end - start))
    head = F.concat(F.regexp_replace(F.substring(t, 1, width), f"(?U){tx.BLANK}+\\z", ""), F.lit("…"))
    around = F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(end < F.length(t), F.lit("…")).otherwise(F.lit(""))
    )
    return F.when(F.length(t) <= width, t).when(first < 0, head).otherwise(around)


def phrase_response(hits: DataFrame, width: int = SNIPPET_WIDTH) -> DataFrame:
    """Snippet at the first verified body occurrence and the occurrences as highlights.

    ``hits``: text, starts (body positions), phrase_len, plus any keys.
    """
    spanned = hits.withColumn("_spans", phrase_spans("text", F.col("starts"), F.col("phrase_len")))
    shown = F.transform("_spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    out = spanned.withColumn("highlights", F.array_distinct(shown))
    anchor = F.try_element_at(F.col("_spans"), F.lit(1))["start"]
    return out.withColumn("snippet", snippet("text", F.col("highlights"), anchor, width)).drop("_spans")
