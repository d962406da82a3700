"""A training-corpus pipeline: language, lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame; ``run`` writes it as
Parquet to the session's shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import shared_folder, table
from cadastra.llm.decontamination import without_benchmark
from cadastra.llm.language_id import confident
from cadastra.llm.line_dedup import drop_recurring_lines
from cadastra.llm.ngram_jaccard import one_of_each
from cadastra.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; one without a letter goes."""
    return confident(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates, and their n_chars; every document stays."""
    left = drop_recurring_lines(docs, ("lines of the text", "lines dropped")).select(docs.columns)
    return left.withColumn("n_chars", F.char_length("text").cast(left.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the trained language model, the template tree and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
