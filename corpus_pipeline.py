"""A corpus from raw documents to tokens, as stages that can be run one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoor.llm import bpe, jaccard, language, mixing, secrets
from spoor.llm.common import documents, materialize, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told stay."""
    return language.keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles one stays."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its credentials masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and digests of every document that is left."""
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", identify_language), ("near_duplicates", join_near_duplicates), ("secrets", mask_secrets), ("mix", mix_sources), ("encode", encode)]

#: The learnt language model and the BPE vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
