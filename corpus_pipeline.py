"""A training corpus from raw documents: five stages, each an operator of gristmill.llm.

Every stage takes (spark, docs, sf_dir) and keeps the columns of documents, but for the last, which
returns the encoded corpus. Between stages the documents are written to the shared folder and reread,
so that a lost executor never sends a later stage back to the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, exact_dedup, mixing, quality, simhash
from gristmill.llm.common import discard, documents, materialize, owned
from gristmill.llm.queries import WORD_BPE, table, tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the document's ids, their number and digests."""
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), tokenizer(WORD_BPE)).select("doc_id", "lang", "source", "bpe.*")


STAGES = [("quality", classify), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: The classifier, the fingerprints and the encoder are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus. What a stage wrote and read on its way goes once its result is written."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with owned() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            discard(spark, before + made[:-1])
            before = made[-1:]
            made.clear()
    return docs
