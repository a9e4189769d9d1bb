"""Small helpers that the operators of this package share."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder is used as it is; only a local session (tests, one machine) gets a folder of its own where it is unset."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "codelake-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lineage ends, lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Stored:
    """Tables kept for a while in the shared checkpoint folder, as compressed Parquet, and dropped when they have served."""

    #: While a table is written: files of shuffles go as soon as it is, and range partitioning takes smaller samples (its keys are long).
    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "20"}

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.base = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/codelake-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        before = {key: self.spark.conf.get(key, None) for key in self.SETTINGS}
        for key, value in self.SETTINGS.items():
            self.spark.conf.set(key, value)
        try:
            df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables, or all that was kept."""
        jvm = self.spark.sparkContext._jvm
        for path in [f"{self.base}/{name}" for name in names] or [self.base]:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def usable_vector(c: str) -> Column:
    """True for vectors that are not null or empty, hold finite numbers only and are not all zero."""
    v = F.col(c).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(F.col(c).isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by keys, joined and cut again so that no group of equal keys is torn apart."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n < rows:
            continue
        both = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = np.ones(len(both), dtype=bool)
        for k in keys:
            last &= (both[k] == both[k].iloc[-1]).to_numpy()
        at = int(np.argmax(last))
        if at:
            yield both.iloc[:at].reset_index(drop=True)
        held = [both.iloc[at:].reset_index(drop=True)]
        n = len(held[0])
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys begins, and at the end the number of rows."""
    new = np.zeros(len(pdf), dtype=bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def pairs_within(starts: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (a, b), a before b, of all pairs inside each run, at most about `most` at a time; nothing is emitted."""
    lengths = np.diff(starts)
    rest = np.repeat(starts[1:], lengths) - np.arange(starts[0], starts[-1]) - 1
    done = np.concatenate([[0], np.cumsum(rest)])
    i, n = 0, len(rest)
    while i < n:
        j = max(i + 1, int(np.searchsorted(done, done[i] + most, side="right")) - 1)
        cnt = rest[i:j]
        if total := int(cnt.sum()):
            a = np.repeat(np.arange(i, j), cnt)
            b = a + 1 + np.arange(total) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            yield a + starts[0], b + starts[0]
        i = j


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number that each of n rows is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new
