"""The queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that says the same."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each_supplier(sql: str, columns: str = "'shop' || s_suppkey AS project, q.*") -> str:
    """The rows of a query for every supplier."""
    return f"WITH q AS ({sql}) SELECT {columns} FROM supplier, q"
