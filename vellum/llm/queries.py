"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, lm, quality, sharding, simhash, tokencount, warc
from .common import load
from .oracles import ORACLES  # noqa: F401  read by the entry module

#: Where vocabulary files lie; a parameter, for they are not part of this repository.
TOKENIZER_PATH = public_tokenizers.path


def vocabulary(name: str) -> bytes:
    with open(TOKENIZER_PATH(name), "rb") as file:
        return file.read()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("items", "spans")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(load(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(load(spark, sf_dir, "pages")).drop("uri", "date")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.examples(rows.unionByName(more)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(load(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))



def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_byte_bpe, op4_lm_scoring, op5_language_id, op6_warc, op7_chat_formatting, op8_quality_rules, op9_token_counts, op10_sharding)}
