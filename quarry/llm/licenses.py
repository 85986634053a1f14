"""Licence scan: exact set-similarity join of text blocks with licence templates.

A template is found where a window of consecutive words, ``SPREAD`` times as long as the template, holds at
least ``THRESHOLD`` of its tokens; line ends do not matter. The words of a text are cut into overlapping
blocks, so that each window lies inside one. Tokens are ordered by how many texts hold them, rarest first. A
block with such a window must hold one of the template's first tokens (prefix filter), must have enough tokens
(length filter), and behind the first common token enough must be left on both sides (positional filter). What
passes is verified on all its windows, so every window above the threshold is found. Templates are a fixed list, so their side of the join is broadcast; a text is read once and
only its template tokens are kept.

Beside that, base phrases are found wherever their words stand consecutively.
Null and empty texts have no words; equal rows get equal results; a text without hits has empty label strings and score 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import inline
from quarry.scale import hold

THRESHOLD = 0.9
SPREAD = 1.5  # words of a window for each word of a template
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Usual sentences of licence notices, in lower case without punctuation.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _places(w: Column) -> Column:
    """(start, label) of each place where a base phrase stands."""
    return F.concat(*[_phrase_places(w, phrase.split(" "), label) for phrase, label in PHRASES.items()])


def _phrase_places(w: Column, parts: list[str], label: str) -> Column:
    def place(x: Column, i: Column) -> Column:
        stands = x == parts[0]
        for j, part in enumerate(parts[1:], 1):
            stands = stands & F.coalesce(F.get(w, i + j) == part, F.lit(False))
        return F.when(stands, F.struct(i.alias("start"), F.lit(label).alias("label")))

    return F.filter(F.transform(w, place), lambda p: p.isNotNull())


def _blocks(w: Column, step: int, known: Column) -> Column:
    """The words in overlapping blocks of twice ``step``, each with the template tokens it holds."""
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(step))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(w, i, 2 * step))
    return F.transform(blocks, lambda b: F.struct(F.array_intersect(b, known).alias("tokens"), b.alias("words")))


def _most(block: Column, width: Column, tokens: Column) -> Column:
    """The largest number of ``tokens`` in a window of ``width`` words."""
    starts = F.sequence(F.lit(1), F.size(block))
    return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(block, i, width), tokens))))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``n_words``, base counts and places, ``base_labels``, ``labels`` and ``score``:
    1 for a base phrase, else the largest containment of a template in a window."""
    spark = df.sparkSession
    sets = [(k, label, sorted(set(t.split(" ")))) for k, (label, t) in enumerate(templates)]
    need = {k: max(1, math.ceil(threshold * len(tokens) - 1e-9)) for k, _, tokens in sets}
    width = {k: math.ceil(SPREAD * len(t.split(" "))) for k, (_, t) in enumerate(templates)}
    vocabulary = sorted({t for _, _, tokens in sets for t in tokens})
    known = F.array(*[F.lit(v) for v in vocabulary])
    raw = F.coalesce(F.col(text), F.lit(""))
    last = sorted({p.rsplit(" ", 1)[-1] for p in PHRASES})
    hinted = F.lit(False)
    for word in last:
        hinted = hinted | F.contains(F.translate(raw, UPPER, LOWER), F.lit(word))
    none = F.array().cast("array<struct<start:int,label:string>>")
    # global order of the template tokens: by the number of texts that hold them, rarest first
    texts = {r["t"]: r["n"] for r in df.select(F.explode(F.array_intersect(words(raw), known)).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (texts.get(t, 0), t)))}
    prefix = []
    for k, label, tokens in sets:
        ordered = sorted(tokens, key=rank.get)
        for at, token in enumerate(ordered[: len(tokens) - need[k] + 1]):
            prefix.append((token, k, label, at, len(tokens), need[k], width[k], ordered))
    index = F.broadcast(inline(spark, prefix, "token string, template int, label string, at int, size int, need int, width int, tokens array<string>"))
    ranks = F.create_map(*[F.lit(x) for t, i in rank.items() for x in (t, i)])
    starting = F.array(*[F.lit(t) for t in sorted({p[0] for p in prefix})])
    rows = df.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("sig"),
        _let(words(raw), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.filter(_blocks(w, max(width.values()), known), lambda b: (F.size(b["tokens"]) >= min(need.values())) & F.arrays_overlap(b["tokens"], starting)).alias("blocks"),
        )).alias("r"),
        F.when(hinted, _let(words(raw), _places)).otherwise(none).alias("places"),
    )
    rows = hold(rows.select("id", "sig", "r.n_words", "r.blocks", "places"))
    blocks = rows.select("id", "sig", F.explode("blocks").alias("b")).select("id", "sig", F.col("b.tokens").alias("block"), F.col("b.words").alias("words"))
    blocks = blocks.withColumn("block", F.transform(F.array_sort(F.transform("block", lambda t: F.struct(ranks[t].alias("r"), t.alias("t")))), lambda s: s["t"]))
    probes = blocks.select("id", "sig", "block", "words", F.posexplode("block").alias("place", "token"))
    pairs = probes.join(index, "token").filter((F.size("block") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.size("block") - F.col("place")) >= F.col("need")))
    pairs = pairs.filter(F.size(F.array_intersect("block", "tokens")) >= F.col("need")).withColumn("common", _most(F.col("words"), F.col("width"), F.col("tokens")))
    hits = pairs.filter("common >= need").groupBy("id", "sig").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("best"))
    hits = hits.withColumnsRenamed({"id": "_id", "sig": "_sig"})
    out = rows.select("id", "sig", "n_words", "places").join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sig") == F.col("_sig")), "left")
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    starts = F.transform("places", lambda p: p["start"].cast("bigint"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
