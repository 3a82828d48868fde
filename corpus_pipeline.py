"""A training corpus from documents: quality, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes
each one's result as Parquet in the shared folder and reads it back for the
next. All stages but the last return the columns of documents. What a stage
stores for itself goes when it returns, but for the tables that its result
still reads; ``run`` removes those too, once the result is written. Python
workers get the texts in small batches, also when a result is read later.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.mixing import draw, mix
from quillon.llm.packing import pack_documents
from quillon.llm.quality import keep_good
from quillon.llm.secrets import redact_secrets
from quillon.llm.shared import read_table, scope, small_batches, stash, tidied, tidy
from quillon.llm.shingles import keep_one_alike

#: What mixing aims at, of the tokens that each domain has: junk is the quality stage's work.
SHARES = {"clean": 1.0, "junk": 1.0, "toxic": 0.05}


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, which tidies up and runs its Python in small batches."""
    inner = tidied(f)

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return inner(spark, docs, sf_dir)

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the quantile of their language's trusted documents."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: words in shingles of five, similarity 0.8 or more."""
    return keep_one_alike(docs, words=5)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return redact_secrets(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates round to, for SHARES of each domain's tokens."""
    taught = read_table(spark, sf_dir, "documents")  # with the junk that is gone by now
    return draw(mix(docs, read_table(spark, sf_dir, "labels"), shares=SHARES, taught=taught), nearest=True).select(*docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Models and fingerprints are not SQL; tests/llm/test_pipeline.py holds each stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = read_table(spark, sf_dir, "documents")
    with scope() as made:
        for name, one in STAGES:
            docs = stash(one(spark, docs, sf_dir), name)
            tidy(made, docs)
    return docs
