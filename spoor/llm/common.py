"""Helpers that the corpus operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spoor.scratch import materialize, shared_dir

__all__ = ["materialize", "shared_dir"]

#: The word of all operators here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file: in the folder that ``SPOOR_TOKENIZERS`` names, or else that of the package
    ``public_tokenizers``."""
    if folder := os.environ.get("SPOOR_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
