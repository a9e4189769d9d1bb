"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from codelake import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "None"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def rows(df, columns):
    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


def compare(spark, sf_dir, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = f(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, core.QUERIES[name], core.SQL[name])


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_search_and_filters_stay_in_the_engine(spark, sf_dir):
    plan = core.QUERIES["grep_lines_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "TakeOrdered" in plan


def test_queries_are_registered_under_the_names_that_are_told():
    import re
    from pathlib import Path

    import bench

    told = re.findall(r"`((?:sample|java|manifest|controllers|op\d+)_\w+|point_queries|scoped_calls)`", (Path(bench.__file__).parent / "README.md").read_text(encoding="utf-8"))
    known = bench.entry.queries()
    assert set(bench.CORE) <= set(core.QUERIES) and {n for n in told if not n.startswith("op") or bench.LLM} <= set(known)
    assert all(f.__name__ == name for name, f in core.QUERIES.items())
