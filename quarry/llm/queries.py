"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, factors, fingerprints, licenses, mixing, neighbours, oracles, phrases, repeats, secret_scan, sharding, simhash, toxicity, treap
from quarry.llm.common import table
from quarry.scale import hold

TOKENIZER = "word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = hold(docs.select("doc_id", F.array("source").alias("members"), mixing.words("text").alias("size")))
    return mixing.mix(sized, "members", "size").select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.sha2("text", 256).alias("digest"))
    placed = sharding.minimax(sized, 40, "size", F.col("digest"), ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = docs.withColumn("held_out", F.coalesce(toxicity.fold("doc_id") == toxicity.HELD_OUT, F.lit(False)))
    return toxicity.score(held, model, ["doc_id", "held_out"])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.remove_repeats(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, docs = treap.index(table(spark, sf_dir, "documents"))
    return treap.search(shards, docs, table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_secret_scan, op4_licenses, op5_sharding, op6_bpe, op7_repeats, op8_neighbours, op9_toxicity, op10_fingerprints, op11_phrases, op12_factors, op13_ranked_search)}
ORACLE: dict[str, str] = {"op11_phrases": oracles.OP11_PHRASES, "op12_factors": oracles.OP12_REPEATS, "op13_ranked_search": oracles.OP13_RANKED}
