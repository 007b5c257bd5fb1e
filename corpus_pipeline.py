"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, byte-level BPE.

Every stage but the last returns the columns of documents, whatever they are
called. Defined cases: a document whose text is null or has no letter has no
language and goes in the first stage, so do null and empty texts; of texts
equal but for A-Z the row with the largest doc_id stays (a null id counts as
smaller than any), of texts alike the one with the smallest (a null id as
larger than any); rows repeated whole leave one row; the mix takes a row up
to twice, and a null source is a source of its own; very long texts are whole
in every stage; an empty table gives empty results.

The near-dedup stage links texts whose sets of five-word shingles have a
Jaccard likeness of 0.8 and more, found by long fingerprints in the grid of
``simhash`` and, across the groups found there, by an exact join: no link is lost.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, langid, mixing, simhash
from tidemark.llm.common import stored, table
from tidemark.llm.queries import VOCABULARY

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
