"""The training corpus: quality, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; all but the last return the columns of
documents. A stage's decisions take effect: documents it rejects are gone, bytes it removes are gone from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelake.llm import byte_cnn, importance, jaccard_join, packing, suffix_dedup
from codelake.llm.common import cut, table


PASSAGE_WORDS = 51  # repeated passages of more than 50 words go


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.selected(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_cnn.confident(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, words=PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: Models trained on the corpus have no SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
