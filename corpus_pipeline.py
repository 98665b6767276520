"""Documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, line_runs, mixing, packing, simhash_grid
from millrace.storage import discard, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that their words speak for, go."""
    return language.accepted(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; a document that consisted of such copies goes, too."""
    cut = line_runs.without_copies(docs)
    left = cut.filter("n_removed = 0 OR n_removed < n_lines")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by fingerprints or with 0.8 of their sets of five words in common, one document stays."""
    return simhash_grid.one_of_each(docs, by_words=True)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.repeated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", distinct_documents),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: The languages are learned and the tokens are a library's, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    before = []
    for name, stage in first:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        discard(*before)
        before = [docs]
    return last(spark, docs, sf_dir)
