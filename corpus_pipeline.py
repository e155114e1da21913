"""Corpus pipeline: quality rules, language ID, near-duplicates, benchmarks, tokens.

Counts as part of ``vellum.llm``. Every stage but the last returns the columns of
``documents``; each works on all that its predecessor kept. Further columns may have any
names. Ids may be null or repeat; a null or empty text fails the first stage, and in a
stage by itself is rejected by language ID, one of its kind stays in near-dedup, and it has
no benchmark passage and no tokens. Empty documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, decontaminate, langid, nearcopies, quality
from vellum.llm.common import load, remainder, shared_path, spread
from vellum.llm.queries import vocabulary


#: Columns of ``documents`` that stages read; others ride along.
READ = ("doc_id", "text", "lang")


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with names for the columns that ride along which no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@_apart
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go."""
    return quality.judge(docs, load(spark, sf_dir, "labels")).filter("__kept").select(*docs.columns)


@_apart
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those between two languages, go. If no language can
    be learned, all with a letter stay."""
    docs = spread(docs)
    codes = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    codes = codes if codes.names else langid.only("any")
    return langid.predict(docs, codes).filter("__lang <> 'und' and not __ambiguous").select(*docs.columns)


@_apart
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or
    more) the document of the least id stays. SimHash finds the candidates, whole sets
    confirm them. Pairs of that similarity differ in ten bits of 64 and more, which no few
    blocks bound; so what fingerprints leave apart is joined exactly (see the README)."""
    return nearcopies.keep_one(docs)


@_apart
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.find_items(docs, load(spark, sf_dir, "benchmark"), keep=True).filter(~F.col("__hit")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the round trip."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: Languages, fingerprints and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet in the shared
    folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
