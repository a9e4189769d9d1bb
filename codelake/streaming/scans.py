"""Scans of sources as they arrive: stateless queries over a stream of files, written as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelake.functions import patterns as p
from codelake.functions.predicates import entry_kinds, has_needle, hit_score, stripped
from codelake.operators.text_search import needles_of
from codelake.sources.files import lines


def file_stream(spark: SparkSession, folder: str, project: str = "", most_files: int = 1000) -> DataFrame:
    """files(project, path, text) of a folder, new ones as they appear."""
    raw = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").option("maxFilesPerTrigger", most_files).load(folder)
    named = raw.select(F.lit(project).alias("project"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named.where(~F.exists(F.split("path", "/"), lambda x: x.isin(p.SKIPPED_FOLDERS)))


def hit_stream(files: DataFrame, query: str) -> DataFrame:
    needles = needles_of(query)
    return lines(files).where(has_needle(F.col("text"), needles)).select("project", F.col("path").alias("file"), F.col("line_no").alias("line"), "text", hit_score(F.col("path"), F.col("text")).alias("score"))


def entry_point_stream(files: DataFrame) -> DataFrame:
    """Entry points by line patterns; public methods of controllers need the whole file and are left to the batch scan."""
    return lines(files).select("project", F.explode(entry_kinds(F.col("text"))).alias("kind"), F.col("path").alias("file"), F.col("line_no").alias("line"), F.substring(stripped(F.col("text")), 1, 240).alias("preview"))


def run(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived so far, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
