import json

import pytest
from pyspark.sql import functions as F

from codelake import cli, samples
from codelake.operators import java_context, table_refs, text_search
from codelake.plans import call_graph, chain_drivers, project_design, reports, symbol_index, trace_starts
from codelake.sources import files as source
from codelake.streaming import scans


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in samples.PROJECT:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return root


def test_files_of_a_tree(spark, tree):
    files = source.read_files(spark, str(tree))
    paths = {r["path"] for r in files.collect()}
    assert "target/generated/Skip.java" not in paths and "pom.xml" in paths
    assert {r["path"] for r in source.java_files(files).collect()} == {p for p, _ in samples.PROJECT if p.startswith("src/main/") and p.endswith(".java")}
    assert source.project_root(str(tree / "src/main")) == str(tree)


def test_lines_and_listed_tables(spark):
    f = spark.createDataFrame([("", "a", "x\r\ny\n\nz\n"), ("", "b", ""), ("", "c", "one")], "project string, path string, text string")
    assert [(r["path"], r["line_no"], r["text"]) for r in source.lines(f).orderBy("path", "line_no").collect()] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("a", 4, "z"), ("c", 1, "one")]
    listed = source.listed_tables(spark, "Orders # main\n# all\n\nghost\n", "ORDERS，extra, ghost")
    assert [r["name"] for r in listed.orderBy("ordinal").collect()] == ["Orders", "ghost", "extra"]


def test_manifest_with_a_list(spark):
    m = table_refs.manifest(samples.project(spark).where("name = 'OrderDao.java'"), source.listed_tables(spark, "", "ORDERS,ghost"))
    assert [r["name"] for r in m["unresolved"].collect()] == ["ghost"]
    assert sorted(r["table"] for r in m["extracted_only"].collect()) == ["customer", "region", "stale"]
    assert {r["canonical"] for r in m["anchors_by_table"].collect()} == {"ORDERS", "customer", "region", "stale"}


def test_trace_limits(spark):
    nodes, edges = samples.call_graph(spark)
    up = lambda seed, depth: {(tuple(r["chain"]), r["stop_reason"]) for r in call_graph.trace_up(edges, nodes, spark.createDataFrame([(seed,)], "key string"), depth).collect()}
    assert up("C", 1) == {(("C", "B"), "max_depth")}
    assert up("C", 20) == {(("C", "B", "A"), "rest_endpoint"), (("C", "B", "D", "B"), "cycle")}
    down = lambda **o: call_graph.trace_down(edges, "A", spark, **o)
    n, e, stats = down(max_depth=2)
    assert {r["key"] for r in n.collect()} == set("ABCD") and e.count() == 3 and stats["stop_reason"] == "complete"
    assert down(max_depth=8)[1].count() == 4
    n, e, stats = down(max_branches=1)
    assert {r["key"] for r in n.collect()} == set("ABD") and stats["stop_reason"] == "branch_cap"
    n, _, stats = down(max_nodes=2)
    assert n.count() == 2 and stats["stop_reason"] == "max_nodes"
    implemented = call_graph.with_implementations(edges, spark.createDataFrame([("C", "E"), ("B", "F")], "decl_key string, impl_key string"))
    assert {(r["src_key"], r["dst_key"]) for r in implemented.where("is_implementation").collect()} == {("C", "E")}


def test_traversals_have_no_depth_of_their_own(spark):
    n = 150
    edges = spark.createDataFrame([(f"k{i}", f"k{i + 1}", "f") for i in range(n - 1)], "src_key string, dst_key string, dst_name string")
    start = spark.createDataFrame([("k0",)], "key string")
    assert call_graph.depths(edges, start).agg(F.count("*"), F.max("depth")).first()[:] == (n, n - 1)
    assert call_graph.reaching(edges.where("dst_key < 'k11'"), spark.createDataFrame([("k10",)], "key string")).count() == 2
    assert call_graph.depths(edges, start, max_depth=3).count() == 4


def test_traces_of_several_seeds(spark):
    nodes, edges = samples.call_graph(spark)
    n, e, stats = call_graph.trace_down_all(edges, spark.createDataFrame([("A",), ("C",), ("D",)], "key string"), max_nodes=3)
    assert {r["seed"]: (r["node_count"], r["stop_reason"]) for r in stats.collect()} == {"A": (3, "max_nodes"), "C": (1, "complete"), "D": (3, "max_nodes")}
    assert [r["key"] for r in n.where("seed = 'A'").orderBy("ordinal").collect()] == ["A", "B", "D"]
    assert call_graph.trace_down_all(edges, spark.createDataFrame([("A",)], "key string"), max_depth=0)[2].first()["edge_count"] == 0
    marked = call_graph.with_implementations(edges, spark.createDataFrame([("C", "E")], "decl_key string, impl_key string"))
    assert [r["dst_key"] for r in call_graph.trace_down(marked, "A", spark)[1].where("is_implementation").collect()] == ["E"]


def test_drawings_and_reports(spark):
    nodes, edges = samples.call_graph(spark)
    assert [r["line"] for r in call_graph.shown_tree(edges, "A", spark).collect()] == ["A", "  B", "    C", "    D", "      B (cycle)"]
    chains = call_graph.trace_up(edges, nodes, spark.createDataFrame([("C",)], "key string"))
    text = reports.chain_report(chains, {"query": "load"})
    payload = spark.range(1).select(source.report_payload(F.lit(text)).alias("v")).first()["v"]
    assert json.loads(payload)["summary"]["chain_count"] == 2
    n, e, stats = call_graph.trace_down(edges, "A", spark)
    report = reports.subgraph_report("A", n.join(nodes, "key"), e, stats, spark)
    assert "OrderService.find() (8)" in report and "database (leaf)" in report


def test_folding_and_buckets(spark):
    nodes = spark.createDataFrame([("A", "S", "run()", "s"), ("G", "Bean", "getX() : int", "b"), ("S", "Bean", "setX()", "b")], "key string, class string, method string, file string")
    edges = spark.createDataFrame([("A", "G", "getX"), ("A", "S", "setX")], "src_key string, dst_key string, dst_name string")
    n, e, folded = call_graph.folded_accessors(nodes, edges, keep="A")
    assert n.count() == 1 and e.count() == 0
    assert {(r["bean"], r["kind"], tuple(r["accessors"])) for r in folded.collect()} == {("Bean", "get", ("getX",)), ("Bean", "set", ("setX",))}


def test_flags_and_candidates(spark):
    lines = source.lines(samples.project(spark).where("project = 'shop'"))
    flags = {(r["path"].rsplit("/")[-1], r["line_no"]): r for r in java_context.node_flags(lines).collect()}
    assert flags["Jobs.java", 4]["is_message_listener"] and flags["Jobs.java", 7]["scheduled_markers"] == ["@Scheduled"]
    assert flags["OrderController.java", 9]["is_rest"] and flags["OrderServiceImpl.java", 8]["is_transactional"] and not flags["OrderDao.java", 4]["is_rest"]
    hit = lines.where("path LIKE '%OrderServiceImpl.java' AND line_no = 5")
    got = text_search.method_candidates(hit, lines).orderBy("rank").collect()
    assert [r["candidate"] for r in got] == [5, 8, 4]


def index(spark):
    return {**samples.symbol_index(spark), "call_nodes": samples.call_graph(spark)[0].withColumn("line", F.lit(9))}


def test_point_queries(spark):
    i = index(spark)
    ask = lambda op, **o: symbol_index.analyze(i, op, **o).collect()
    at = {"path": "x.java", "line": 3, "character": 5}
    assert len(ask("documentSymbol", path="web/OrderController.java")) == 3
    assert [r["name"] for r in ask("workspaceSymbol", query="ordercon|list")] == ["OrderController", "list()"]
    assert ask("definition", **at)[0]["sym_id"] == "A" and len(ask("references", **at)) == 2
    assert ask("hover", **at)[0]["contents"] == "lists" and ask("implementation", **at)[0]["impl_key"] == "I"
    inside = {"path": "web/OrderController.java", "line": 6, "character": 1}
    assert [r["dst_key"] for r in ask("outgoingCalls", **inside)] == ["B"] and ask("incomingCalls", **inside) == []
    assert {(r["side"], r["other"]) for r in ask("typeHierarchy", path="web/OrderController.java", line=2, character=1)} == {("sub", "Sub"), ("super", "Base")}
    with pytest.raises(ValueError):
        ask("rename")
    assert symbol_index.class_methods(i["symbols"], "a.OrderController", "list").count() == 1
    assert symbol_index.class_symbols(i["symbols"], "OrderController").count() == 1 and symbol_index.keyword_methods(i["symbols"], "li").count() == 1


def test_derived_calls(spark):
    lines = source.lines(samples.project(spark).where("project = 'shop' AND ext = 'java'"))
    found = {(r["src_key"].split(":")[-1], r["dst_name"]) for r in symbol_index.derived_edges(lines).collect()}
    assert ("list", "findAll") in found and ("create", "save") in found


def test_bundle_and_command_line(spark, tree, tmp_path, capsys):
    made = project_design.write_bundle(spark, source.read_files(spark, str(tree)), str(tmp_path / "design"))
    assert made.summary["rest-map"] == 2 and made.summary["tables-hits"] == 7 and len(made.warnings) == 3 and "no saved report" in made.warnings[-1]
    assert (tmp_path / "design/index.md").exists() and "list" in (tmp_path / "design/rest-map.mmd").read_text()
    assert cli.main(["java-grep", str(tree), "-q", "repo.save"]) == 0
    assert json.loads(capsys.readouterr().out)["line"] == 9
    assert cli.main(["java-grep", str(tree), "-q", "repo.save", "--format", "text"]) == 0
    assert "OrderServiceImpl.java:9:" in capsys.readouterr().out
    assert cli.main(["callchain-up", str(tree), "-q", "x"]) == 2
    for name, df in index(spark).items():
        df.write.parquet(str(tmp_path / f"index/{name}.parquet"))
    assert cli.main(["callchain-up", str(tree), "--index", str(tmp_path / "index"), "--class", "OrderStore", "--method", "load"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["callchain-down", str(tree), "--index", str(tmp_path / "index"), "-q", "find", "--format", "markdown"]) == 0
    assert "Calls below B" in capsys.readouterr().out
    full = project_design.write_bundle(spark, source.read_files(spark, str(tree)), str(tmp_path / "full"), index={**index(spark), "call_nodes": samples.call_graph(spark)[0].withColumn("line", F.lit(9)).withColumn("file", F.when(F.col("key") == "A", f"{samples.HOME}OrderController.java").otherwise(F.col("file")))})
    assert not full.warnings and full.summary["key-methods"] == 2 and "OrderService" in (tmp_path / "full/business.md").read_text()
    index_md = (tmp_path / "full/index.md").read_text()
    assert "(entry-down/controller=OrderController/)" in index_md and "`GET /api/orders` OrderController.list" in index_md and (tmp_path / "full/entry-down/controller=OrderController").is_dir()
    # a later run of one step reads the reports that this one saved
    want = (tmp_path / "full/business.md").read_text().split("\n")[4:]
    assert cli.main(["bundle", str(tree), "--out", str(tmp_path / "full"), "--steps", "business"]) == 0
    assert "warning" not in capsys.readouterr().out
    got = (tmp_path / "full/business.md").read_text().split("\n")[4:]
    assert [r.split("|")[1:5] for r in got if r] == [r.split("|")[1:5] for r in want if r] and len([r for r in got if r]) == 2
    assert cli.main(["bundle", str(tree), "--out", str(tmp_path / "part"), "--skip", "symbols", "business", "table-up", "entry-down", "rest-map", "--strict-tables"]) == 0
    assert not (tmp_path / "part/tables-extracted-only").exists() and (tmp_path / "part/modules").exists() and not (tmp_path / "part/rest-map").exists()


def test_anchor_caps_and_start_counts(spark):
    files = samples.project(spark).where("project = 'shop'")
    nodes, _ = samples.project_graph(spark)
    anchors, _ = chain_drivers.table_anchors(files, table_refs.table_hits(files))
    kept, counts = chain_drivers.capped_anchors(anchors.union(anchors.where("kind = 'jdbc_sql_literal'").withColumn("line", F.col("line") + 100)), 1)
    told = {(r["table"], r["kind"]): (r["found"], r["kept"]) for r in counts.collect()}
    assert told["customer", "jdbc_sql_literal"] == (2, 1) and told["orders", "service_impl"] == (1, 1)
    assert kept.count() == sum(k for _, k in told.values()) and kept.where("line > 100").count() == 0
    assert chain_drivers.capped_anchors(anchors, 0)[0].count() == anchors.count()
    one = trace_starts.start_counts(nodes, files, ["repo.save", "stale"], most=1).first()
    assert (one["found"], one["skipped_interfaces"], one["before_cap"], one["kept"]) == (2, 0, 2, 1)


def test_keyword_in_a_signature(spark):
    nodes = spark.createDataFrame([("a", "X", "run(Invoice) : void", "X.java", 3), ("b", "X", "invoiceOf(int)", "X.java", 9), ("c", "X", "go(Ledger)", "X.java", 12)], "key string, class string, method string, file string, line int")
    assert [r["key"] for r in trace_starts.method_starts(nodes, "Invoice").collect()] == ["b", "a"]
    assert [r["key"] for r in trace_starts.method_starts(nodes, "ledger").collect()] == ["c"]


def test_escapes_of_eight_digits(spark):
    text = r"a\U0001F600b\u0041\x42\103" + "\\\\"
    assert spark.createDataFrame([(text,)], "t string").select(table_refs.unescaped(F.col("t")).alias("u")).first()["u"] == "a\N{GRINNING FACE}bABC\\"


def test_streams(spark, tree, tmp_path):
    files = scans.file_stream(spark, str(tree))
    scans.run(scans.entry_point_stream(files), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"kafka_listener", "spring_async", "main", "scheduled"}
    scans.run(scans.hit_stream(files, "repo.save"), str(tmp_path / "hits"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 1


def test_equal_paths_of_two_projects(spark):
    nodes = spark.createDataFrame([("p", "a", "X.java", 3), ("q", "b", "X.java", 3)], "project string, key string, file string, line int")
    points = spark.createDataFrame([("p", "X.java", 2), ("q", "X.java", 3), ("r", "X.java", 3)], "project string, file string, line int")
    assert sorted((r["project"], r["key"]) for r in trace_starts.nodes_at(points, nodes).collect()) == [("p", "a"), ("q", "b")]
    assert trace_starts.nodes_at(points.drop("project"), nodes).count() == 3
