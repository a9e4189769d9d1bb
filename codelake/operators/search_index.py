"""A search index over files: a bitmap of hashed trigrams for each, beside the texts in buckets of neighbouring paths.

A needle can only stand in a file whose bitmap has all of its trigrams, so a search reads the bitmaps, a small part of
the text, and then the texts of the buckets that hold such files. What is searched there is searched as ever, so hits and
scores are those of a search of everything. Needles of fewer than three bytes prune nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from codelake.operators import text_search
from codelake.sources.store import written

#: Bits of a bitmap for each of its trigrams, at least.
SPARSE = 4
MOST_BUCKETS = 4096


def trigrams(text: str) -> np.ndarray:
    """The hashed trigrams of the UTF-8 bytes of a text, each once."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint64)
    codes = np.unique(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:])
    return codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)


def bitmap(text: str) -> list[int]:
    """64-bit words, a power of two of them; bit h modulo their bits is set for each trigram's hash h."""
    h = trigrams(text)
    words = 1 << max(0, int(np.ceil(np.log2(max(1, len(h) * SPARSE / 64)))))
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[(h % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


@F.pandas_udf(ArrayType(LongType()))
def _bitmaps(text: pd.Series) -> pd.Series:
    return text.map(bitmap)


def write_index(files: DataFrame, folder: str, buckets: int = 64) -> None:
    """Write files(project, path, text) under a folder, with their bitmaps."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")
    placed = files.where("text IS NOT NULL").select("project", "path", "text").repartitionByRange(buckets, "project", "path")
    placed.withColumn("bucket", F.spark_partition_id()).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/texts")
    spark = files.sparkSession
    texts = spark.read.parquet(f"{folder}/texts")
    texts.select("project", "path", "bucket", _bitmaps(F.lower("text")).alias("bits")).write.mode("overwrite").parquet(f"{folder}/bitmaps")


def candidates(spark: SparkSession, folder: str, needles: list[str]) -> DataFrame:
    """(project, path, bucket) of the files in which one of the needles can stand, whatever its case."""
    lowered = [r[0] for r in spark.createDataFrame([(n,) for n in needles], "n string").select(F.lower("n")).collect()]
    size = F.size("bits") * 64

    def has(h: int):
        at = F.lit(h) % size
        return F.getbit(F.element_at("bits", (at / 64).cast("int") + 1), (at % 64).cast("int")) == 1

    def all_of(needle: str):
        out = F.lit(True)
        for h in trigrams(needle).tolist():
            out = out & has(h)
        return out

    any_ = F.lit(False)
    for n in lowered:
        any_ = any_ | all_of(n)
    return spark.read.parquet(f"{folder}/bitmaps").where(any_).select("project", "path", "bucket")


def found_files(spark: SparkSession, folder: str, needles: list[str]) -> DataFrame:
    """files(project, path, text) that may hold a needle; other buckets are not read."""
    some = written(candidates(spark, folder, needles))
    buckets = [r[0] for r in some.select("bucket").distinct().collect()]  # MOST_BUCKETS at most
    texts = spark.read.parquet(f"{folder}/texts").where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return texts.join(some.drop("bucket"), ["project", "path"], "left_semi").select("project", "path", "text")


def search(spark: SparkSession, folder: str, query: str, most: int | None = 200, by_score: bool = True) -> DataFrame:
    """What text_search.search finds in the indexed files."""
    return text_search.search(found_files(spark, folder, text_search.needles_of(query)), query, most, by_score)
