"""Tables of facts about files that appear and change: every version of a file is judged whole, and replaces the last.

A stream hands on files in steps. A step's files are a plain table, so the operators of the batch run on it as they are
(windows over lines, whole-file conditions and all), and write rows with the version of their file. What is read is the
rows of each file's newest version; a version that gives no rows replaces those before it, too. Steps write folders of
their own, so one that is repeated after a failure writes the same again.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelake.operators import entry_points
from codelake.sources import files as source
from codelake.sources import tree
from codelake.sources.store import written

OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"entry-points": entry_points.entry_points, "rest-map": entry_points.rest_map}
#: Between a project and a path. Each file is a project of its own to the operators, since a step knows only some of a project's files.
MARK = "\u0001"


def file_stream(spark: SparkSession, roots: list[str], globs: str = tree.GLOBS, project: str = "") -> DataFrame:
    """files(project, path, text, version) under folders that all executors see: new ones, and changed ones again."""
    spark.dataSource.register(tree.SourceTree)
    raw = spark.readStream.format(tree.NAME).option("globs", globs).load(os.pathsep.join(roots))
    return raw.select(F.lit(project).alias("project"), "path", "text", F.col("changed").alias("version"))


def time_to_settle() -> None:
    """Wait until files that were touched a moment ago are no longer held back."""
    time.sleep(2 * tree.SETTLE_NS / 1e9)


def run(files: DataFrame, target: str, checkpoint: str, operators: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Bring the tables under `target` up to date with a stream of files, and stop."""
    made = operators or OPERATORS

    def step(batch: DataFrame, number: int) -> None:
        newest = Window.partitionBy("project", "path").orderBy(F.desc("version"))
        own = written(batch.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r"))
        alone = source.as_files(own.select(F.concat_ws(MARK, "project", "path").alias("project"), "path", "text"))
        versions = own.select("project", "path", "version")
        versions.write.mode("overwrite").parquet(f"{target}/files/step={number}")
        for name, f in made.items():
            rows = f(alone).withColumn("_path", F.substring_index("project", MARK, -1)).withColumn("project", F.substring_index("project", MARK, 1))
            rows.join(versions.withColumnRenamed("path", "_path"), ["project", "_path"]).write.mode("overwrite").parquet(f"{target}/{name}/step={number}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of a table for the newest version of every file, of main sources where a project has any."""
    versions = spark.read.parquet(f"{target}/files").groupBy("project", "path").agg(F.max("version").alias("version"))
    meant = source.main_sources(versions).withColumnRenamed("path", "_path")
    rows = spark.read.parquet(f"{target}/{name}")
    return rows.join(meant, ["project", "_path", "version"], "left_semi").drop("_path", "version", "step")
