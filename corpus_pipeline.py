"""From raw documents to tokens: drop toxic texts, keep one of each group of near copies, redact
secrets, mix the sources to their weights, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last return
the columns of ``documents``; the mix repeats rows that it takes more than once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, mixing, near_copies, secret_scan, simhash, toxicity
from quarry.llm.common import table
from quarry.scale import hold


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs, find=near_copies.near_copies)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: The seeded draw, the trained model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
