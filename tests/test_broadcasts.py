"""What texts are cut into is joined by sorting: Spark's estimate of its size goes by the keys that the texts are made from."""

from pyspark.sql import functions as F

from codelake import samples
from codelake.operators import links
from codelake.plans import call_graph, trace_starts
from codelake.queries import QUERIES
from codelake.sources.files import as_files
from codelake.sources.store import written


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_mappings_of_lines_are_not_broadcast(spark, sf_dir):
    assert broadcasts(QUERIES["controllers_top_entries"](spark, sf_dir)) == 0


def test_flags_of_lines_are_not_broadcast(spark, sf_dir):
    assert broadcasts(QUERIES["node_flags"](spark, sf_dir)) == 0


def test_sources_of_tables_are_not_broadcast(spark, sf_dir):
    files = samples.projects(spark, sf_dir)
    tables = written(files.select("project", F.lit("orders").alias("table")).distinct())
    assert broadcasts(links.repository_calls(tables, files)) == broadcasts(links.entity_files(tables, files)) == 0
    asked = files.where("ext = 'xml'").select("project", "path", F.lit(5).alias("line_no"))
    assert broadcasts(links.mapper_methods(asked, files)) == 0


def test_names_of_symbols_are_found_once(spark, sf_dir):
    """No filter finds the names of declarations a second time."""
    plan = QUERIES["controllers_symbols"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract" in x]


def test_keywords_that_names_answer_search_no_text(spark, monkeypatch):
    nodes = spark.createDataFrame([("k", "A", "run()", "src/A.java", 3)], "key string, class string, method string, file string, line int")
    files = as_files(spark.createDataFrame([("p", "src/A.java", "class A {\n\n  public void run() {\n  }\n}\n")], "project string, path string, text string"))
    monkeypatch.setattr(trace_starts, "text_starts", lambda *_: 1 / 0)
    assert [tuple(r) for r in trace_starts.keyword_starts(nodes, "run", files).select("key", "way").collect()] == [("k", "symbol")]
    assert [tuple(r) for r in trace_starts.keyword_starts(nodes, "A", files).select("key", "way").collect()] == [("k", "class_first_method")]


def test_calls_meet_nodes_once(spark):
    """Not once for each part of a union of nodes."""
    one = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "key string, class string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "src_key string, dst_key string")
    for f, want in ((call_graph.roots, [("a", "x"), (None, "z")]), (call_graph.leaves, [("b", "y"), (None, "z")])):
        found = f(one.union(one).union(one), edges)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want * 3, key=str)


def dealt_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_of_suppliers_are_dealt_before_they_become_texts(spark, sf_dir):
    nodes, edges = samples.project_graphs(spark, sf_dir)
    assert all("REPARTITION_BY_NUM" in dealt_plan(x) for x in (samples.projects(spark, sf_dir), nodes, edges))


def test_mapped_sources_are_dealt_once_and_whole(spark, sf_dir):
    """No line moves again for the windows of its file."""
    plan = dealt_plan(QUERIES["controllers_rest_map"](spark, sf_dir))
    assert "hashpartitioning(project" in plan and not [x for x in plan.splitlines() if "hashpartitioning(project" in x and "REPARTITION_BY_NUM" not in x]


def test_sources_of_table_hits_are_dealt_once_and_whole(spark, sf_dir):
    """Both kinds of hits and the windows of a file read them from one shuffle; no line moves."""
    plan = dealt_plan(QUERIES["controllers_table_hits"](spark, sf_dir))
    moved = [x for x in plan.splitlines() if "hashpartitioning(project" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)
