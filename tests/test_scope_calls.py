"""Who is called, by what Java's scopes say."""

import pytest
from pyspark.sql import functions as F

from codelake import queries  # noqa: F401 (before graph_queries, which it registers)
from codelake import graph_queries
from codelake.plans import scope_calls
from codelake.sources import files as source

SOURCES = {
    "a/Shop.java": """package a;
import b.Store;
import c.*;
public class Shop extends Base implements Named {
  private final Store<Item> store = new Store<>();
  Clock clock;
  public void sell(final Item item,
      Store<Item> local, int n) {
    store.put(item, name(n, 1)); // store.put(item)
    local.drop();
    String s = "store.drop(1, 2, 3)"; /* clock.stop() */
    Item other = find("a,b");
    other.touch(n);
    this.clock.tick(
        n,
        2);
    for (Plain each : all()) { each.go(); }
    Helper.help(Helper.one(), (n + 1) * 2);
    sell(item, local, n);
    item.owner().touch(n);
    if (n > 0) { audit(n); }
    System.out.println(n);
  }
  private Item find(String s) {
    return unknown(s);
  }
  private int find(String s, int n) { return n; }
}
""",
    "a/Base.java": "package a;\nabstract class Base extends Root {\n  protected String name(int a, int b) { return null; }\n}\n",
    "a/Root.java": "package a;\nabstract class Root {\n  protected void audit(int n) {\n  }\n}\n",
    "a/Item.java": "package a;\npublic interface Item {\n  void touch(int n);\n  Item owner();\n}\n",
    "a/Helper.java": "package a;\nclass Helper {\n  static void help(int a, int b) { }\n  static int one() { return 1; }\n}\n",
    "b/Store.java": "package b;\npublic class Store<T> {\n  public void put(T a, String b) { }\n  public void drop() { }\n}\n",
    "c/Clock.java": "package c;\npublic class Clock {\n  public void tick(int a, int b) { }\n}\n",
    "c/Plain.java": "package c;\npublic class Plain {\n}\n",
    "d/Store.java": "package d;\npublic class Store {\n  public void put(Object a, String b) { }\n}\n",
    "d/Red.java": "package d;\nimport c.Plain;\npublic class Red extends Plain {\n  public void go() { }\n}\n",
    "d/Blue.java": "package d;\nimport c.*;\npublic class Blue extends Plain {\n  public void go() { }\n}\n",
}


def edges(spark, sources):
    files = source.as_files(spark.createDataFrame([("p", k, v) for k, v in sources.items()], "project string, path string, text string"))
    return {(r["src_key"], r["dst_key"], r["edge_source"]) for r in scope_calls.scoped_edges(source.lines(files)).collect()}


@pytest.fixture(scope="module")
def found(spark):
    return edges(spark, SOURCES)


@pytest.mark.parametrize("dst", ["b/Store.java:3:put", "b/Store.java:4:drop", "a/Base.java:3:name", "a/Root.java:3:audit", "a/Shop.java:24:find", "a/Item.java:3:touch", "a/Item.java:4:owner", "c/Clock.java:3:tick", "a/Helper.java:3:help", "a/Helper.java:4:one", "a/Shop.java:7:sell"])
def test_resolved(found, dst):
    assert ("a/Shop.java:7:sell", dst, "resolved") in found


def test_many_implementations_and_unknown_receivers(found):
    more = {e for e in found if e[2] != "resolved"}
    assert more == {
        ("a/Shop.java:7:sell", "c.Plain#go/0", "implementation"), ("c.Plain#go/0", "d/Red.java:4:go", "implementation"), ("c.Plain#go/0", "d/Blue.java:4:go", "implementation"),
        ("a/Shop.java:7:sell", "*#touch/1", "ambiguous"), ("*#touch/1", "a/Item.java:3:touch", "ambiguous"),
    }


def test_nothing_else_is_called(found):
    """Comments, strings, other arities, equal names elsewhere and libraries give no edge."""
    assert len({e for e in found if e[2] == "resolved"}) == 11


def test_empty_and_odd_sources(spark):
    assert edges(spark, {"x.java": "", "y.java": "void f( {", "z.java": "class Z {\n  void a() { a(); b(); }\n"}) == {("z.java:2:a", "z.java:2:a", "resolved")}


def test_calls_of_a_line(spark):
    rows = [("f(g(x, y), h.i(1), \"a\")", ["g(x, y)", "h.i(1)", "f(_, _, \"\")"]), ("a.b(c).d()", ["a.b(c)", ".d()"]), ("if ((x + 1) * 2 > k(3))", ["k(3)", "if (_ * 2 > _)"]), ("none", [])]
    for text, calls in rows:
        got = spark.createDataFrame([(text,)], "t string").select(scope_calls.calls_in(scope_calls.plain_code(F.col("t"))).alias("c")).first()["c"]
        assert [c.replace(" ", "") for c in got] == [c.replace(" ", "") for c in calls], got


def test_files_with_very_many_calls(spark, found, monkeypatch):
    """Rows for each call and rows for each file give the same, each edge once."""
    monkeypatch.setattr(scope_calls, "MOST_MEETINGS", 0)
    files = source.as_files(spark.createDataFrame([("p", k, v) for k, v in SOURCES.items()], "project string, path string, text string"))
    rows = [(r["src_key"], r["dst_key"], r["edge_source"]) for r in scope_calls.file_edges(files).collect()]
    assert len(rows) == len(found) and set(rows) == found


def test_long_literals(spark):
    """A literal of many characters is skipped without a call for each of them."""
    text = 'class Z {\n  void a() {\n    b("' + "x(" * 20000 + "\", '" + "y" * 20000 + "');\n  }\n  void b(String s, String t) { }\n}\n"
    assert edges(spark, {"z.java": text}) == {("z.java:2:a", "z.java:5:b", "resolved")}


def test_sources_are_asked_once_a_file(spark, sf_dir, monkeypatch):
    """However many methods call, and no line is a row of its own; sources are dealt before they become texts."""
    files = graph_queries.workers(spark, sf_dir)
    assert "REPARTITION_BY_NUM" in files._jdf.queryExecution().executedPlan().toString()
    asked, targets = [], scope_calls.targets
    monkeypatch.setattr(scope_calls, "targets", lambda wanted, *rest: asked.append(wanted.count()) or targets(wanted, *rest))
    found = scope_calls.file_edges(files).count()
    assert asked[0] < 5 * files.count() < found
