"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and all that the one before it kept.
Between stages the documents are written as Parquet to the shared checkpoint
folder and read again, so that a lost executor costs a re-read of one stage's
input and never a run of the stages before it.

All stages take nulls in any column, empty and very long texts, repeated rows
and ids, empty tables and further columns of any name, which they leave out:
all but the last return the columns of documents.  Filtering stages drop rows
whole; of a group of near copies the row of the least doc_id stays, of equal
ids that of the least text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import language, near_copies, packing, pii, quality
from marlstone.llm.durable import drop, shared_dir
from marlstone.llm.registry import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is a half or more."""
    return quality.keep_good(docs.select(*COLUMNS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a learned language."""
    return language.keep_known(docs.select(*COLUMNS), language.fit(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies.

    Near copies have a Jaccard similarity of 0.8 or more of five-word shingles.
    SimHash and vantage-point trees propose, the exact similarity decides, and a
    prefix filter finds the near copies whose fingerprints are too far apart.
    Documents without an id stay, one of each set of shingles, if none with an
    id is among their near copies.
    """
    return near_copies.one_of_each(docs.select(*COLUMNS))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    return pii.replaced(docs.select(*COLUMNS), pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("known_language", known_language), ("one_of_near_copies", one_of_near_copies), ("pseudonyms", pseudonyms), ("packed", packed)]

#: Expectation-maximisation, fingerprints and tokenizers are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        # what a stage has read is needed no more once its own rows are written
        if before:
            drop(spark, before)
        before = f"{folder}/{name}"
    return docs
