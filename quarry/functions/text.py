"""Text analysis: normalize, case-fold, tokenize, drop stop words, stem.

Tokenizing is native. Two steps have no built-in function and run as Arrow UDFs: Unicode
normalization with full case folding (non-ASCII rows only) and stemming (once per distinct
word of a batch).
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quarry.functions.porter import stem

# The English stop list (must equal the reference's for equal indexes).
STOP_WORDS = """
a about above after again against all am an and any are as at be because been
before being below between both but by can could did do does doing down during
each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me more most my myself no nor not of off
on once only or other our ours ourselves out over own same she should so some such
than that the their theirs them themselves then there these they this those through
to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves
""".split()
_STOP = frozenset(STOP_WORDS)

TOKEN = r"[\p{L}\p{N}]+"
SIMPLE_TOKEN = "[a-z0-9]+"
BLANK = r"[\s\x1c-\x1f]"  # with (?U): the characters Python's split() treats as white space


BATCH_BYTES = 4 << 20  # text that is changed at once
BATCH_TOKENS = 200_000  # tokens that are grouped at once


def runs(sizes: np.ndarray, most: int):
    """Start and end of runs of rows with at most ``most`` in all, of one row at least."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def _mapped(values: pa.Array, fn) -> pa.Array:
    """``fn`` of every text, of a bounded part of the batch at a time."""
    sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    parts = (values.slice(a, b - a).to_pylist() for a, b in runs(sizes, BATCH_BYTES))
    return pa.concat_arrays([pa.array([], pa.string()), *[pa.array([v and fn(v) for v in part], pa.string()) for part in parts]])


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return _mapped(values, lambda v: unicodedata.normalize("NFKC", v))


@F.arrow_udf(StringType())
def _nfkc_casefold(values: pa.Array) -> pa.Array:
    return _mapped(values, lambda v: unicodedata.normalize("NFKC", v).casefold())


def _map_words(lists: pa.Array, fn) -> pa.Array:
    """Apply ``fn`` to every word of a list array, once per distinct word."""
    lists = lists.cast(pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    mapped = pa.array([fn(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, mapped)


@F.arrow_udf(ArrayType(StringType()))
def _stem_lists(tokens: pa.Array) -> pa.Array:
    return _map_words(tokens, stem)


@F.arrow_udf(ArrayType(StringType()))
def _stem_lists_without_stop(tokens: pa.Array) -> pa.Array:
    return _map_words(tokens, lambda t: None if t in _STOP else stem(t))


TERM_GROUPS = StructType([
    StructField("size", IntegerType()),
    StructField("norm", DoubleType()),
    StructField("terms", ArrayType(StructType([
        StructField("term", StringType()), StructField("positions", ArrayType(IntegerType())),
    ]))),
])


def kept_words(lists: pa.Array, fn) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term number and position of every token of a list array that ``fn`` keeps, and the terms. ``fn`` runs once for a distinct word."""
    words = lists.flatten().dictionary_encode()
    names: dict[str, int] = {}
    term_of_word = np.array(
        [-1 if t is None else names.setdefault(t, len(names)) for t in map(fn, words.dictionary.to_pylist())], np.int64
    )
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    term = term_of_word[words.indices.to_numpy(zero_copy_only=False)] if len(row) else row
    kept = term >= 0
    return row[kept], term[kept], position[kept], pa.array(list(names), pa.string())


def _stemmed(token: str) -> str | None:
    return None if token in _STOP else stem(token)


def _plain(token: str) -> str | None:
    return None if token in _STOP else token


def word_terms(stemmer: str):
    """The index term of a folded word, None for stop words."""
    return _stemmed if _check(stemmer) else _plain


def _group_terms(lists: pa.Array, fn) -> pa.Array:
    """Per token list: term count, log-tf norm and every term with its positions.

    Rows of a batch are grouped together with one stable sort on (row, term)."""
    lists = lists.cast(pa.list_(pa.string()))
    sizes = len(lists)
    row, term, position, names = kept_words(lists, fn)
    key = row * max(len(names), 1) + term
    order = np.argsort(key, kind="stable")
    key, position = key[order], position[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], np.int64)
    group_row, group_term = np.divmod(key[starts], max(len(names), 1))
    tf = np.diff(np.r_[starts, len(key)])
    squares = np.bincount(group_row, weights=(1.0 + np.log10(np.maximum(tf, 1))) ** 2, minlength=sizes)
    offsets = lambda counts: pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
    groups = pa.StructArray.from_arrays(
        [names.take(pa.array(group_term)),
         pa.ListArray.from_arrays(offsets(tf), pa.array(position, pa.int32()))],
        names=["term", "positions"],
    )
    per_row = pa.ListArray.from_arrays(offsets(np.bincount(group_row, minlength=sizes)), groups)
    count = pa.array(np.bincount(row, minlength=sizes), pa.int32())
    return pa.StructArray.from_arrays([count, pa.array(np.sqrt(squares)), per_row], names=["size", "norm", "terms"])


@F.arrow_udf(TERM_GROUPS)
def _stemmed_groups(tokens: pa.Array) -> pa.Array:
    return _group_terms(tokens, _stemmed)


@F.arrow_udf(TERM_GROUPS)
def _plain_groups(tokens: pa.Array) -> pa.Array:
    return _group_terms(tokens, _plain)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(text: str | Column) -> Column:
    return F.length(_col(text)) == F.octet_length(_col(text))


def normalize(text: str | Column) -> Column:
    """NFKC; ASCII rows are unchanged by definition and never leave the JVM."""
    t = _col(text)
    return F.coalesce(_nfkc(F.when(~is_ascii(t), t)), t)


def fold(text: str | Column) -> Column:
    """NFKC then full case folding; plain ``lower`` for ASCII rows."""
    t = _col(text)
    return F.coalesce(_nfkc_casefold(F.when(~is_ascii(t), t)), F.lower(t))


def tokenize(text: str | Column) -> Column:
    """Every letter/digit run in order; an element's index is its position."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def raw_tokens(text: str | Column) -> Column:
    """Tokens of the normalized text in their original case."""
    return F.regexp_extract_all(normalize(text), F.lit(TOKEN), F.lit(0))


def simple_tokens(text: str | Column) -> Column:
    """The report analyzer: lower case, ASCII letters and digits only."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(SIMPLE_TOKEN), F.lit(0))


def is_stop(token: str | Column) -> Column:
    return _col(token).isin(STOP_WORDS)


def _check(stemmer: str) -> bool:
    if stemmer not in ("porter", "none"):
        raise ValueError(f"unknown stemmer {stemmer!r}")
    return stemmer == "porter"


def stems(tokens: Column, stemmer: str = "porter") -> Column:
    """Index terms of an array of folded tokens."""
    return _stem_lists(tokens) if _check(stemmer) else tokens


def token_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per token (stop words included) with its position; replaces ``text``."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(tokenize(text)).alias("pos", "token"))


def analyze(df: DataFrame, text: str = "text", stemmer: str = "porter") -> DataFrame:
    """Full analysis as rows ``..., pos, term``; removed stop words leave position gaps."""
    rest = [c for c in df.columns if c != text]
    if _check(stemmer):
        rows = df.select(*rest, F.posexplode(_stem_lists_without_stop(tokenize(text))).alias("pos", "term"))
        return rows.filter(F.col("term").isNotNull())
    rows = df.select(*rest, F.posexplode(tokenize(text)).alias("pos", "term"))
    return rows.filter(~is_stop("term"))


def term_groups(text: str | Column, stemmer: str = "porter") -> Column:
    """Analyzed text as ``(size, norm, terms array<(term, positions)>)``: a document's postings
    come out of its own row, with no grouping shuffle."""
    return (_stemmed_groups if _check(stemmer) else _plain_groups)(tokenize(text))


def term_rows(df: DataFrame, text: str = "text", stemmer: str = "porter") -> DataFrame:
    """One row per distinct term of each input row: ``..., size, norm, term, positions``."""
    rest = [c for c in df.columns if c != text]
    grouped = df.select(*rest, term_groups(text, stemmer).alias("g"))
    return grouped.select(*rest, "g.size", "g.norm", F.inline("g.terms"))


def _list_of(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)


def _group_pieces(lists: pa.Array, fn) -> list[pa.Array]:
    """For each row of lists of tokens: its distinct terms; how many of them each piece has; their places; their counts."""
    pieces = lists.flatten()
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    piece, term, _, names = kept_words(pieces, fn)
    width = max(len(names), 1)
    own = np.unique(of[piece] * width + term)
    first = np.searchsorted(own, np.arange(len(lists) + 1) * width)
    held, counts = np.unique(piece * width + term, return_counts=True)
    piece, term = np.divmod(held, width)
    place = np.searchsorted(own, of[piece] * width + term) - first[of[piece]]
    sizes, each = np.bincount(piece, minlength=len(pieces)), np.bincount(of[piece], minlength=len(lists))
    return [
        _list_of(np.diff(first), names.take(pa.array(own % width))),
        _list_of(np.bincount(of, minlength=len(lists)), pa.array(sizes, pa.int32())),
        _list_of(each, pa.array(place, pa.int32())), _list_of(each, pa.array(counts, pa.int32())),
    ]


def piece_terms(df: DataFrame, pieces: str, stemmer: str = "porter") -> DataFrame:
    """The analyzed pieces of each row's array ``pieces``, which they replace: ``terms`` (the row's distinct terms), ``sizes`` (distinct
    terms of each piece), ``places`` (of these in ``terms``, piece after piece) and ``counts`` (of each in its piece)."""
    of_word = word_terms(stemmer)
    rest = [c for c in df.columns if c != pieces]
    names = [*rest, "terms", "sizes", "places", "counts"]
    one = F.array_join(F.transform(pieces, lambda p: F.translate(p, "\n", " ")), "\n")  # all pieces are folded at once
    cut = F.transform(F.split(fold(one), "\n"), lambda p: F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0)))

    def group(batches):
        for batch in batches:
            lists = batch.column(len(rest)).cast(pa.list_(pa.list_(pa.string())))
            ends = np.r_[0, np.cumsum(lists.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            bounds = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            for a, b in runs(np.diff(ends[bounds]), BATCH_TOKENS):
                kept = [c.slice(a, b - a) for c in batch.columns[: len(rest)]]
                yield pa.RecordBatch.from_arrays([*kept, *_group_pieces(lists.slice(a, b - a), of_word)], names=names)

    added = zip(names[-4:], [StringType(), IntegerType(), IntegerType(), IntegerType()])
    schema = StructType([*df.select(*rest).schema.fields, *[StructField(n, ArrayType(t)) for n, t in added]])
    return df.select(*rest, cut.alias(pieces)).mapInArrow(group, schema)


def _documents_per_term(lists: pa.Array, fn) -> tuple[list[str], np.ndarray]:
    """The terms of a batch of token lists and how many of the lists hold each."""
    row, term, _, names = kept_words(lists.cast(pa.list_(pa.string())), fn)
    pairs = np.unique(row * max(len(names), 1) + term)
    return names.to_pylist(), np.bincount(pairs % max(len(names), 1), minlength=len(names))


def document_counts(texts: DataFrame, text: str = "text", stemmer: str = "porter") -> DataFrame:
    """``term, df``: how many rows hold each term. A task sends each of its terms once."""
    of_word = word_terms(stemmer)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            names, n = _documents_per_term(batch.column(0), of_word)
            held.update(dict(zip(names, n.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    found = texts.select(tokenize(text).alias("tokens")).mapInArrow(count, "term string, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("df"))


def terms_of(text: str | Column, stemmer: str = "porter") -> Column:
    """The analyzed term list of a text as one array (empty when nothing is left)."""
    return stems(F.filter(tokenize(text), lambda t: ~t.isin(STOP_WORDS)), stemmer)


def query_stages(queries: DataFrame, stemmer: str = "porter") -> DataFrame:
    """Staged analysis of each query: raw, folded, removed, kept and stemmed words."""
    base = queries.select("query_id", raw_tokens("query").alias("raw"), tokenize("query").alias("folded"))
    base = base.select(
        "query_id",
        F.when(F.size("raw") == F.size("folded"), F.col("raw")).otherwise(F.col("folded")).alias("raw_tokens"),
        F.col("folded").alias("casefolded"),
        F.filter("folded", lambda t: t.isin(STOP_WORDS)).alias("stop_words_removed"),
        F.filter("folded", lambda t: ~t.isin(STOP_WORDS)).alias("kept_tokens"),
    )
    return base.withColumn("stems", stems(F.col("kept_tokens"), stemmer))


def strip(text: str | Column) -> Column:
    """Remove surrounding white space the way Python's ``strip()`` does."""
    return F.regexp_replace(_col(text), f"(?U)^{BLANK}+|{BLANK}+\\z", "")


def phrase_text(query: str | Column) -> Column:
    """Query without surrounding blanks and quotation marks."""
    return strip(F.regexp_replace(strip(query), "^[\"“”']+|[\"“”']+\\z", ""))


def words(text: str | Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(_col(text), f"(?U){BLANK}+"), lambda w: w != "")


def analysis_text(query: str | Column, mode: str) -> Column:
    """The part of a query that is analyzed: Boolean operators and phrase quotes are syntax."""
    if mode == "boolean":
        return F.array_join(F.filter(words(query), lambda w: ~w.isin("AND", "OR", "NOT")), " ")
    return phrase_text(query) if mode == "phrase" else _col(query)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strict_json(text: Column) -> Column:
    """The text as one JSON value; null when it is malformed or has anything after the value."""
    return bind(
        F.concat(F.lit("["), text, F.lit("]")),
        lambda w: F.when(F.json_array_length(w) == 1, F.try_variant_get(F.try_parse_json(w), "$[0]", "variant")),
    )
