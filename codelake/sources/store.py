"""Tables that are computed once and kept in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session gets one of its own where none is set."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "codelake-checkpoints"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The name of a folder there that nobody has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/codelake-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting on both sides. Spark estimates what texts and arrays are cut into by the size of the keys they are made from, and would send tables of any size through the driver to all executors."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions, by keys. Spark joins small partitions together by their compressed bytes, and texts and keys that are made from each other are ten times smaller compressed than sorted."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame) -> DataFrame:
    """df, computed once: lineage ends, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return large(df.checkpoint(eager=True))
