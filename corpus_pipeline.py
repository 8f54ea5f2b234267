"""Corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, pseudonyms, piece encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm.decontaminate import without_contaminated
from tabularium.llm.pieces import encode_pieces
from tabularium.llm.pseudonyms import pseudonyms
from tabularium.llm.quality import keep_good
from tabularium.llm.queries import PIECE_MODEL, PII_KEY
from tabularium.llm.simhash import one_per_group
from tabularium.session import scratch_root
from tabularium.sources.tables import Tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    return keep_good(docs, Tables(spark, sf_dir).labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    return without_contaminated(docs, Tables(spark, sf_dir).benchmark)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` is left as it was read."""
    return pseudonyms(docs, PII_KEY).select(*[f"`{c}`" for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return encode_pieces(docs, PIECE_MODEL, dropout=0.1, seed=7)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", pieces),
]
ORACLE_SQL = None  # the classifier and the tokenizer are not SQL; tests/llm compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each is written to the shared scratch folder and read again by the next."""
    docs = Tables(spark, sf_dir).documents
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
