"""The corpus pipeline: each stage takes what its predecessor kept of `documents`; the last returns packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shokuba.llm.common import stage
from shokuba.llm.decontaminate import drop_leaks
from shokuba.llm.exact_dedup import drop_exact_duplicates
from shokuba.llm.language import keep_known_languages
from shokuba.llm.packing import pack
from shokuba.llm.simhash import drop_near_duplicates, drop_near_fingerprints

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: null and empty texts and those without a letter."""
    return keep_known_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays; of rows that repeat it, the first."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints link at 4 or fewer bits the smallest doc_id stays; of those left, and linked by a
    Jaccard similarity of 0.8 or more of their five-word shingles, which fingerprints can't tell, the smallest again."""
    return drop_near_duplicates(stage(drop_near_fingerprints(docs), "near"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an empty benchmark removes none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 4096 tokens; every document, empty ones too, has its end token."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Language identification is fitted, so SQL can't say it; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's rows are written once, since the next one reads them more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
