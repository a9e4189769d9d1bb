"""Innermost ranges, counted chains, trees under a budget, statements of mappers, saved reports."""

import json
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from codelake.operators import intervals, links
from codelake.plans import call_graph, chain_counts, reports, saved_reports


def nearest(ranges, group, at):
    held = [(b - a, n) for g, a, b, n in ranges if g == group and a <= at <= b]
    return min(held)[1] if held else None


@pytest.mark.parametrize("width", [5, 200, 1 << 40])
def test_innermost_range(spark, width):
    r = Random(width)
    ranges = [(r.choice("ab"), a, a + r.randrange(-2, max(2, width // r.choice([1, 7, 50]))), n) for n in range(120) for a in [r.randrange(width)]] + [("a", 0, width * 2, 999)]
    points = [(r.choice("abc"), r.randrange(-3, width + 5)) for _ in range(300)]
    got = links.smallest_around(spark.createDataFrame(points, "g string, at long"), spark.createDataFrame(ranges, "g string, lo long, hi long, n int"), ["g"], "at", "lo", "hi", ["n"])
    assert got.columns == ["g", "at", "lo", "hi", "n"]
    want = [(g, at, nearest(ranges, g, at)) for g, at in points]
    assert sorted((x["g"], x["at"], x["n"]) for x in got.collect()) == sorted(w for w in want if w[2] is not None and w[1] >= 0)


def test_innermost_range_in_one_large_file(spark):
    """100 000 nested and overlapping ranges and as many points of one file: no join makes more rows than levels times points."""
    n = 100_000
    ranges = spark.range(n).selectExpr("'f' AS path", "id AS name", "id * 10 AS start_line", "id * 10 + 9 + (id % 64) * 100 AS end_line")
    points = spark.range(n).selectExpr("'f' AS path", "id * 10 + 5 AS line_no")
    got = links.smallest_around(points, ranges, ["path"], "line_no", "start_line", "end_line", ["name"])
    assert got.count() == n
    few = {r["line_no"]: r["name"] for r in got.where("line_no % 99990 = 5 OR line_no % 640 = 5 AND line_no < 64000").collect()}
    spans = [(i * 10, i * 10 + 9 + (i % 64) * 100, i) for i in range(n)]
    for at, name in few.items():
        near = spans[max(0, at // 10 - 700) : at // 10 + 1]
        assert name == min((b - a, i) for a, b, i in near if a <= at <= b)[1]
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct"):
        assert node not in got._jdf.queryExecution().executedPlan().toString()


def test_blocks_cover_ranges_exactly(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(a, 70, 5)] + [((1 << 60) - 5, (1 << 60) + 9)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", intervals.blocks(F.col("a"), F.col("b"), 62).alias("x")).collect()
    for r in got:
        places = sorted(p for x in r["x"] for p in range(x["block"] << x["level"], (x["block"] + 1) << x["level"]))
        assert places == list(range(r["a"], r["b"] + 1)) and len(r["x"]) <= 2 * 62


def graph(seed, n, m):
    r = Random(seed)
    edges = sorted({(f"k{r.randrange(n)}", f"k{r.randrange(n)}", "x") for _ in range(m)})
    nodes = [(f"k{i}", i % 9 == 4) for i in range(n)]
    return edges, nodes


@pytest.mark.parametrize("seed,n,m,depth", [(1, 8, 12, 20), (3, 9, 15, 4), (5, 6, 12, 20)])
def test_counts_equal_the_list(spark, seed, n, m, depth):
    rows, nodes = graph(seed, n, m)
    edges, nodes = spark.createDataFrame(rows, "src_key string, dst_key string, dst_name string"), spark.createDataFrame(nodes, "key string, is_rest boolean")
    seeds = spark.createDataFrame([("k0",), ("k1",), ("k5",), ("lost",)], "key string")
    want = Counter((r["seed"], r["chain"][-1], r["stop_reason"], len(r["chain"])) for r in call_graph.trace_up(edges, nodes, seeds, depth).collect())
    got = chain_counts.chain_counts(edges, nodes, seeds, depth)
    assert {(r["seed"], r["top"], r["stop_reason"], r["length"]): int(r["chains"]) for r in got.collect()} == dict(want)
    told = {r["seed"]: int(r["chain_count"]) for r in chain_counts.summary(got).collect()}
    assert told == Counter({s: sum(n for (x, *_), n in want.items() if x == s) for s, *_ in want})


def test_counts_where_no_list_can_finish(spark):
    """Forty levels of two nodes, all called by all: 2 ** 40 chains."""
    edges = spark.createDataFrame([(f"{i + 1}{a}", f"{i}{b}", "x") for i in range(40) for a in "ab" for b in "ab"], "src_key string, dst_key string, dst_name string")
    got = chain_counts.chain_counts(edges, spark.createDataFrame([], "key string"), spark.createDataFrame([("0a",)], "key string"), 60).collect()
    assert {(r["top"], r["stop_reason"], r["length"], int(r["chains"])) for r in got} == {(f"40{a}", "no_incoming", 41, 2**39) for a in "ab"}


def test_strong_parts(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("e", "g"), ("x", "a")]
    got = chain_counts.strong_parts(spark.createDataFrame(rows, "src_key string, dst_key string"))
    assert {(r["key"], r["part"]) for r in got.collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e"), ("f", "f")}


def test_tree_under_a_budget(spark):
    rows, _ = graph(7, 7, 18)
    edges = spark.createDataFrame(rows, "src_key string, dst_key string, dst_name string")
    whole = [tuple(r) for r in call_graph.shown_tree(edges, "k1", spark, 5).collect()]
    for most in (1, 7, 30):
        assert [tuple(r) for r in call_graph.shown_tree(edges, "k1", spark, 5, most).collect()] == whole[:most]
    dense = spark.createDataFrame([(f"k{a}", f"k{b}", "x") for a in range(30) for b in range(30)], "src_key string, dst_key string, dst_name string")
    assert len(call_graph.shown_tree(dense, "k0", spark, 20, 50).collect()) == 50  # 30 ** 20 paths


XML = """<mapper namespace="a.B">
  <select
     resultType="X"
     id = "first">
    select 1 <include refid="x"/>
  </select> <delete id='second'>delete</delete>
  <!-- filler -->
{filler}
  <update id="third">update</update>
  end
</mapper>"""


def test_statements_of_lines(spark):
    text = XML.format(filler="\n".join("  filler" for _ in range(60)))
    files = spark.createDataFrame([("p", "m.xml", text), ("p", "n.xml", text.replace("\n", "\r\n")), ("p", "none.xml", "<a/>")], "project string, path string, text string")
    n = text.count("\n") + 1
    asked = spark.createDataFrame([("p", f, i) for f in ("m.xml", "n.xml", "none.xml") for i in range(1, n + 1)] * 2, "project string, path string, line_no int")
    got = {(r["path"], r["line_no"]): r["statement_id"] for r in links.statements_at(asked, files).collect()}
    assert len(got) == 3 * n
    for f in ("m.xml", "n.xml"):
        told = [got[f, i] for i in range(1, n + 1)]
        assert told[:3] == [None] * 3 and told[3:5] == ["first", "first"] and told[5] == "second" and told[6 + 47] == "second"
        assert told[54:67] == [None] * 13 and told[-3:] == ["third"] * 3
    assert got["none.xml", 1] is None


def test_saved_reports_of_many_shapes(spark, tmp_path):
    nodes = {"svc": {"class": "a.OrderService", "method": "run()", "file": "S.java"}, "dao": {"class": "a.OrderDao", "method": "load()", "file": "D.java"}, "odd": "text"}
    edges = [{"from": "svc", "to": "dao"}, {"from": "ctl", "to": "svc"}, {"to": "svc"}, "text", {"from": 1}]
    given = [{"class": "a.X", "method": "m()", "file": "X.java", "score": 9}, {"class": "a.OrderService", "method": "run()", "file": "S.java", "score": 8}, "text", {"class": "a.Y"}]
    saved = {
        "a.json": json.dumps({"nodes": nodes, "edges": edges}), "sub/b.md": f"# Report\n\n## Raw JSON\n\n```json\n{json.dumps({'keyMethods': given, 'nodes': nodes, 'edges': edges}, indent=1)}\n```\n",
        "none.json": json.dumps({"keyMethods": None, "nodes": nodes, "edges": edges}), "broken.json": '{"nodes": ', "list.json": "[1]", "plain.md": "nothing here", "empty.md": "", "other.csv": "{}",
    }
    for name, text in saved.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    told = saved_reports.payloads(spark, str(tmp_path))
    assert {r["source"] for r in told.collect()} >= {"a.json", "sub/b.md", "none.json"}
    got = {(r["class"], r["method"], r["file"]): (r["score"], r["sources"]) for r in saved_reports.key_methods(told).collect()}
    # a service that a database stands below, called twice: 2 + 2 + 3
    assert got == {("a.X", "m()", "X.java"): (9, ["sub/b.md"]), ("a.OrderService", "run()", "S.java"): (8, ["sub/b.md"]), ("a.Y", "", ""): (0, ["sub/b.md"])}
    assert [(r["class"], r["score"]) for r in saved_reports.scored_key_methods(told.where("source = 'a.json'")).collect()] == [("a.OrderService", 7)]


@pytest.mark.parametrize("most,depth", [(10**6, 50), (6, 50), (10**6, 2)])
def test_scores_of_many_traces_equal_those_of_each(spark, most, depth):
    """Whether or not limits cut the traces."""
    rows, _ = graph(11, 24, 40)
    edges = spark.createDataFrame(rows, "src_key string, dst_key string, dst_name string")
    kinds = ["OrderService", "OrderDao", "Helper", "OrderController"]
    nodes = spark.createDataFrame([(f"k{i}", f"a.{kinds[i * 7 % 4] if i % 5 else 'Helper'}", "run(x)", f"a/F{i}.java", False, i % 6 == 0) for i in range(24)], "key string, class string, method string, file string, is_rest boolean, is_transactional boolean")
    found, called, stats = call_graph.trace_down_all(edges, nodes.select("key").where("key < 'k16'"), depth, most, 10**6)
    full = found.join(nodes, "key")
    want = call_graph.business_scores(full, called, found.where("depth = 0").select("seed", "key"), by="seed")
    pick = lambda df: sorted((r["seed"], r["key"], r["business_score"], tuple(r["business_signals"])) for r in df.collect())
    got = pick(call_graph.trace_scores(full, called, stats, nodes, edges))
    assert got == pick(want) and len(got) == found.count()


def made(spark, rows, names):
    """The rows as a table, and a count of how many of them were made so far."""
    count = spark.sparkContext.accumulator(0)

    def tell(parts):
        for p in parts:
            count.add(len(p))
            yield p

    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema).mapInPandas(tell, schema), count


def test_levels_of_a_search_do_not_make_the_calls_anew(spark):
    edges, count = made(spark, [(f"k{i}", f"k{i + 1}") for i in range(6)], ["src_key", "dst_key"])
    found = call_graph.depths(edges, spark.createDataFrame([("k0",)], "key string"))
    assert sorted((r["key"], r["depth"]) for r in found.collect()) == [(f"k{i}", i) for i in range(7)]
    assert count.value == 6


def test_counted_chains_do_not_make_calls_and_nodes_anew(spark):
    edges, calls = made(spark, [(f"k{i}", f"k{i + 1}") for i in range(5)], ["src_key", "dst_key"])
    nodes, keys = made(spark, [(f"k{i}",) for i in range(6)], ["key"])
    counts = chain_counts.chain_counts(edges, nodes.withColumn("is_rest", F.col("key") == "k1"), spark.createDataFrame([("k5",)], "key string"))
    assert [(r["top"], r["stop_reason"], r["length"], int(r["chains"])) for r in counts.collect()] == [("k1", "rest_endpoint", 5, 1)]
    assert (calls.value, keys.value) == (5, 6)


@pytest.mark.parametrize("most", [10**6, 9])
def test_nodes_of_one_seed_are_ranked_in_blocks(spark, monkeypatch, most):
    """In the order of (caller, branch), over many blocks of callers."""
    monkeypatch.setattr(call_graph, "CALLERS_A_BLOCK", 2)
    kids = {"r": [f"a{i}" for i in range(7)], **{f"a{i}": [f"b{j}" for j in range(i, i + 3)] for i in range(7)}}
    edges = spark.createDataFrame([(a, b, b) for a, bs in kids.items() for b in bs], "src_key string, dst_key string, dst_name string")
    want = ["r"]
    for k in want:
        want += [b for b in kids.get(k, []) if b not in want]
    nodes = call_graph.trace_down_all(edges, spark.createDataFrame([("r",)], "key string"), 8, most, 100)[0]
    assert [(r["ordinal"], r["key"]) for r in nodes.orderBy("ordinal").collect()] == list(enumerate(want))[:most]


def test_reports_are_kept_many_a_file(spark, tmp_path):
    given = [{"class": "a.X", "method": "m()", "file": "X.java", "score": 9}]
    rows = [(f"S{i}", json.dumps({"keyMethods": given})) for i in range(50)] + [("odd", "nothing here"), ("md", f"# Calls\n\n## Raw JSON\n\n```json\n{json.dumps({'keyMethods': given})}\n```\n")]
    reports.write_reports(spark.createDataFrame(rows, "entry_id string, value string").coalesce(2), str(tmp_path / "kept"))
    assert len(list((tmp_path / "kept").glob("*.parquet"))) == 2
    found = saved_reports.key_methods(saved_reports.table_payloads(spark, str(tmp_path / "kept"))).collect()
    assert [(r["class"], r["score"], len(r["sources"]), "odd" in r["sources"]) for r in found] == [("a.X", 9, 51, False)]
