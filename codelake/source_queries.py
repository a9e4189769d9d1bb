"""Queries that run the operators over source code on sources generated from whole tables, and the drivers of call chains on the sample project; the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import samples
from codelake.functions import names
from codelake.operators import entry_points, java_context, links, structure, table_refs, text_search
from codelake.plans import call_graph, chain_drivers, reports, symbol_index, trace_starts
from codelake.registry import each_supplier, query, table
from codelake.sources import files as source
from codelake.sources.store import written

# -- every customer as a controller with one method an order ------------------

SQL_CONTROLLERS = """
ctl AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER w - 1 AS i, lead(o_orderkey) OVER w AS k2, count(*) OVER (PARTITION BY o_custkey) AS n,
               'src/main/java/com/shop/C' || o_custkey || 'Controller.java' AS file, 'com.shop.p' || (o_custkey % 7) AS package
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files: for each customer with orders a controller; each of its methods is mapped, and selects from a table."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    c = F.col("c")
    # the texts are many times larger than their keys, so the keys stay in as many partitions as they are dealt to; coalescing goes by the size of the keys
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    by = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    head = F.array(
        text("package com.shop.p", c % 7, ";"), F.when(c % 2 == 1, "@RestController @Transactional").otherwise("@RestController"), text('@RequestMapping("/c', c, '")'),
        F.concat(F.when(c % 3 == 0, "public abstract class ").otherwise("public class "), text("C", c, "Controller {")),
    )
    body = F.flatten(F.transform("keys", lambda k: F.array(text('  @GetMapping("/o', k, '")'), text("  public String get", k, "() {"), text('    return q("SELECT * FROM app.orders_', k % 3, ' o JOIN customer x ON f(a, (b)), \\u0072egion r"); }'))))
    return source.as_files(by.select(F.lit("shop").alias("project"), text("src/main/java/com/shop/C", c, "Controller.java").alias("path"), F.array_join(F.concat(head, body, F.array(F.lit("}"))), "\n").alias("text")))


@query(f"""WITH {SQL_CONTROLLERS}
SELECT 'GET' AS http_method, '/c' || c || '/o' || k AS path, package || '.C' || c || 'Controller' AS class_name, 'get' || k AS method_name, file, CAST(6 + 3 * i AS INT) AS line, '@GetMapping' AS annotation FROM ctl""")
def controllers_rest_map(spark, sf_dir):
    return entry_points.rest_map(controllers(spark, sf_dir)).select("http_method", "path", "class_name", "method_name", "file", "line", "annotation")


@query(f"""WITH {SQL_CONTROLLERS}
SELECT 'controller_public_method' AS kind, file, CAST(6 + 3 * i AS INT) AS line, 'public String get' || k || '() {{' AS preview FROM ctl""")
def controllers_entry_points(spark, sf_dir):
    return entry_points.entry_points(controllers(spark, sf_dir)).select("kind", "file", "line", "preview")


@query(f"""WITH {SQL_CONTROLLERS}, t AS (SELECT *, unnest([0, 1, 2]) AS nth FROM ctl)
SELECT CASE nth WHEN 0 THEN 'orders_' || (k % 3) WHEN 1 THEN 'customer' ELSE 'region' END AS "table", CAST(nth AS INT) AS nth, 'jdbc_sql_literal' AS source, file, CAST(7 + 3 * i AS INT) AS line,
       'get' || coalesce(k2, k) AS java_method, CAST(CASE WHEN k2 IS NULL THEN 6 + 3 * i ELSE 9 + 3 * i END AS INT) AS java_method_line FROM t""")
def controllers_table_hits(spark, sf_dir):
    """Joins, comma lists behind nested brackets and an escaped letter, each with the method that looking forward first gives."""
    return table_refs.table_hits(controllers(spark, sf_dir)).select("table", "nth", "source", "file", "line", "java_method", "java_method_line")


@query(f"""WITH {SQL_CONTROLLERS}, t AS (SELECT DISTINCT package, file, c FROM ctl)
SELECT 'shop' AS project, package, count(*) AS types, min(file || ':' || 'C' || c || 'Controller:5:4') AS first FROM t GROUP BY package""")
def controllers_by_package(spark, sf_dir):
    by = structure.by_package(structure.top_level_types(controllers(spark, sf_dir)))
    t = F.get("types", F.lit(0))
    return by.select("project", "package", F.size("types").cast("long").alias("types"), F.concat_ws(":", t["file"], t["name"], t["kind"].cast("string"), t["line"].cast("string")).alias("first"))


@query(f"""WITH {SQL_CONTROLLERS}, t AS (SELECT DISTINCT c, file, 5 + 3 * n AS lines FROM ctl)
SELECT file, lines, lines AS rest, CASE WHEN c % 2 = 1 THEN least(lines, 122) - 1 ELSE 0 END AS transactional, CASE WHEN c % 3 = 0 THEN least(lines, 124) - 3 ELSE 0 END AS abstract_class FROM t""")
def controllers_node_flags(spark, sf_dir):
    n = lambda c: F.sum(F.col(c).cast("int")).cast("long")
    flags = java_context.node_flags(source.lines(controllers(spark, sf_dir)))
    return flags.groupBy(F.col("path").alias("file")).agg(F.count("*").alias("lines"), n("is_rest").alias("rest"), n("is_transactional").alias("transactional"), n("is_abstract_class").alias("abstract_class"))


@query(f"""WITH {SQL_CONTROLLERS}
SELECT file, CAST(6 + 3 * i AS INT) AS line, '/c' || c AS class_base_path, 'GET' AS http_method, '/c' || c || '/o' || k AS rest_path, 'GET /c' || c || '/o' || k AS rest_summary FROM ctl""")
def controllers_top_entries(spark, sf_dir):
    lines = source.lines(controllers(spark, sf_dir))
    asked = lines.where(F.rlike("text", F.lit(r"^  public String get"))).select("project", "path", "line_no")
    return java_context.top_entries(asked, lines).select(F.col("path").alias("file"), F.col("line_no").alias("line"), "class_base_path", "http_method", "rest_path", "rest_summary")


@query(f"""WITH {SQL_CONTROLLERS}, t AS (SELECT DISTINCT file AS path, package || '.C' || c || 'Controller' AS fqcn FROM ctl) SELECT * FROM t""")
def controllers_type_names(spark, sf_dir):
    return structure.file_type_names(controllers(spark, sf_dir)).select("path", "fqcn")


@query(f"""WITH {SQL_CONTROLLERS}
SELECT file || ':' || (6 + 3 * i) || ':' || '  public String get' || k || '() {{' AS value FROM ctl""")
def controllers_hit_text(spark, sf_dir):
    """A search without a limit, as lines of text."""
    return reports.hit_text(text_search.search(controllers(spark, sf_dir), "String get", most=None))


@query(f"""WITH {SQL_CONTROLLERS}, t AS (SELECT DISTINCT file AS path FROM ctl) SELECT path FROM t ORDER BY path LIMIT 10""")
def first_java_paths(spark, sf_dir):
    return source.java_files(controllers(spark, sf_dir), most=10).select("path")


@query(f"""WITH {SQL_CONTROLLERS}
SELECT file, CAST(6 + 3 * i AS INT) AS line, 'get' || k AS name, CAST(CASE WHEN k2 IS NULL THEN NULL ELSE 8 + 3 * i END AS INT) AS end_line FROM ctl""")
def controllers_symbols(spark, sf_dir):
    """Approximate method symbols: each up to the line before the next."""
    found = symbol_index.derived_symbols(source.lines(controllers(spark, sf_dir)))
    return found.select(F.col("path").alias("file"), F.col("start_line").alias("line"), "name", "end_line")


@query(f"""WITH {SQL_CONTROLLERS} SELECT file, CAST(7 + 3 * i AS INT) AS line, 'get' || k AS name FROM ctl WHERE k2 IS NOT NULL""")
def controllers_symbol_at(spark, sf_dir):
    """The smallest symbol around each line of SQL; the last method of a file has no end, and holds nothing."""
    lines = source.lines(controllers(spark, sf_dir))
    symbols = symbol_index.derived_symbols(lines).where("end_line IS NOT NULL").select("path", "name", "start_line", "end_line")
    points = lines.where(F.contains("text", F.lit("SELECT"))).select("path", "line_no")
    return links.smallest_around(points, symbols, ["path"], "line_no", "start_line", "end_line", ["name"]).select(F.col("path").alias("file"), F.col("line_no").alias("line"), "name")


# -- names ---------------------------------------------------------------------

@query(r"""
SELECT p_partkey, coalesce(nullif(regexp_replace(left(regexp_replace(trim(p_name || ' /'), '[^\w\-.]+', '_', 'g'), 12), '^_+|_+$', '', 'g'), ''), 'table') AS safe, '/src/' || p_name AS path,
       regexp_replace('a.' || replace(p_type, ' ', '.'), '\.[^.]*$', '') AS package, 'T' || p_size || '.run() (F.java:' || p_size || ')' AS shown, 'src/F.java:' || p_size || ':3:run()' AS key, 'F.java' AS relative,
       CASE WHEN p_size % 2 = 0 THEN 'order_' || p_size ELSE '' END AS candidates
FROM part
""")
def shown_names(spark, sf_dir):
    n = F.col("p_size")
    listed = F.when(n % 2 == 0, F.concat(F.lit("order_"), n.cast("string"))).otherwise("no table!")
    return table(spark, sf_dir, "part").select(
        "p_partkey", names.safe_name(F.concat("p_name", F.lit(" /")), 12, "table").alias("safe"), names.uri_path(names.file_uri(F.concat(F.lit("/src/"), "p_name"))).alias("path"),
        names.package_of(F.concat(F.lit("a."), F.replace("p_type", F.lit(" "), F.lit(".")))).alias("package"),
        names.shown_node(F.concat(F.lit("x.T"), n.cast("string")), F.lit("run() : int"), F.lit("src/F.java"), n).alias("shown"), names.node_key(F.lit("src/F.java"), n, F.lit(3), F.lit("run()")).alias("key"),
        names.relative_to(F.lit("src/F.java"), "src").alias("relative"), F.array_join(names.table_candidates(listed), ",").alias("candidates"),
    )


# -- traces of many seeds --------------------------------------------------------

@query("""
WITH r AS (SELECT r_regionkey AS k, count(DISTINCT n_nationkey) AS n, count(c_custkey) AS c FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey)
SELECT 'r' || k AS seed, 1 + n + c AS node_count, n + c AS edge_count, 1 + n AS expanded_count, 'complete' AS stop_reason FROM r
""")
def trace_down_seeds(spark, sf_dir):
    """What every region sets off, two levels down, all regions at once."""
    from codelake.queries import _edges

    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"))
    return call_graph.trace_down_all(_edges(spark, sf_dir), seeds, max_depth=2, max_nodes=10**9, max_branches=10**9)[2]


def _shops(spark, sf_dir):
    """(files, nodes, edges) of the sample project for every supplier; paths begin with the project."""
    nodes, edges = samples.project_graphs(spark, sf_dir)
    return samples.projects(spark, sf_dir, own_paths=True).where("project LIKE 'shop%'"), nodes, edges


def _seeds(nodes, *keys):
    return nodes.where(F.substring_index("key", ":", -1).isin(*keys)).select("key")


def _keyed(sql: str, columns: str) -> str:
    """For every supplier; `@` stands for its key and a colon."""
    return each_supplier(sql, columns.replace("@", "s_suppkey || ':'"))


@query("""SELECT query, replace(key, '@', k || ':') AS key, way, hit_line FROM (SELECT min(s_suppkey) AS k FROM supplier), (VALUES ('list', '@ctl.list', 'symbol', NULL), ('OrderDao', '@dao.count', 'class_first_method', NULL), ('app.orders', '@dao.count', 'java_text', 4), ('repo.save|stale', '@svc.save', 'java_text', 9), ('repo.save|stale', '@dao.purge', 'java_text', 7)) t(query, key, way, hit_line)""")
def sample_keyword_starts(spark, sf_dir):
    """What keywords mean in the first supplier's project."""
    first = samples.suppliers(spark, sf_dir).agg(F.min(F.col("s").cast("long"))).first()[0]
    files, nodes, _ = _shops(spark, sf_dir)
    files, nodes = files.where(F.col("project") == f"shop{first}"), nodes.where(F.col("s") == str(first))
    out = None
    for words in ("list", "OrderDao", "app.orders", "repo.save|stale", "nothing at all"):
        part = trace_starts.keyword_starts(nodes, words, files).select(F.lit(words).alias("query"), "key", "way", "hit_line")
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH {SQL_CONTROLLERS}, m AS (SELECT 'get' || k AS key, c, k, file, 6 + 3 * i AS line FROM ctl), hits AS (SELECT * FROM m ORDER BY file, line LIMIT 40),
picked AS (SELECT 'a method' AS query, key, 'symbol' AS way, NULL::INT AS hit_line FROM m WHERE k = (SELECT min(o_orderkey) FROM orders)
  UNION ALL SELECT 'a class', arg_min(key, line), 'class_first_method', NULL FROM m WHERE c = (SELECT min(o_custkey) FROM orders)
  UNION ALL SELECT 'a text', arg_min(key, line), 'java_text', CAST(min(line) + 1 AS INT) FROM hits GROUP BY file)
SELECT * FROM picked""")
def controllers_keyword_starts(spark, sf_dir):
    """A method's name, a class's name and a text, over the controllers of all customers: the one method, the first of the class, and one of each of the best files."""
    orders = table(spark, sf_dir, "orders")
    files = controllers(spark, sf_dir)
    found = symbol_index.derived_symbols(source.lines(files))
    nodes = written(found.select(F.col("name").alias("key"), F.regexp_extract("path", r"(\w+)\.java", 1).alias("class"), F.concat("name", F.lit("()")).alias("method"), F.col("path").alias("file"), F.col("start_line").alias("line")))  # every search reads them
    k, c = orders.agg(F.min("o_orderkey"), F.min("o_custkey")).first()
    parts = [trace_starts.keyword_starts(nodes, words, files).select(F.lit(name).alias("query"), "key", "way", "hit_line") for name, words in (("a method", f"get{k}"), ("a class", f"C{c}Controller"), ("a text", "FROM app.orders"))]
    return parts[0].union(parts[1]).union(parts[2])


@query(_keyed("""SELECT * FROM (VALUES ('@dao.count<@svc.save<@ctl.create', 'POST /api/orders', NULL), ('@dao.count<@svc.save<@job.tick', NULL, NULL), ('@dao.purge<@job.onMessage', NULL, '@KafkaListener'), ('@map.findAll<@svc.findAll<@ctl.list', 'GET /api/orders', NULL)) t(chain, rest_summary, markers)""", "replace(chain, '%', @) AS chain, rest_summary, markers").replace("'@dao", "'%dao").replace("<@", "<%").replace("'@map", "'%map"))
def sample_top_entries(spark, sf_dir):
    """What stands at the top of each chain."""
    files, nodes, edges = _shops(spark, sf_dir)
    chains = call_graph.trace_up(edges, nodes, _seeds(nodes, "dao.count", "dao.purge", "map.findAll"))
    told = trace_starts.with_top_entries(chains, nodes, source.lines(source.java_files(files)))
    return told.select(F.array_join("chain", "<").alias("chain"), F.col("top_entry.rest_summary").alias("rest_summary"), F.array_join("top_entry.markers", ",").alias("markers"))


@query(_keyed("""SELECT * FROM (VALUES ('ctl.create', '1'), ('job.tick', '2'), ('job.onMessage', '3'), ('ctl.list', '4')) t(entry, chains)""", "@ || entry AS entry, chains"))
def sample_entry_groups(spark, sf_dir):
    _, nodes, edges = _shops(spark, sf_dir)
    chains = call_graph.trace_up(edges, nodes, _seeds(nodes, "dao.count", "dao.purge", "map.findAll"))
    bare = F.array_join(F.transform("chain", lambda x: F.substring_index(x, ":", -1)), "<")
    numbered = chains.withColumn("chain_no", F.when(bare == "dao.count<svc.save<ctl.create", 1).when(bare == "dao.count<svc.save<job.tick", 2).when(bare == "dao.purge<job.onMessage", 3).otherwise(4))
    return call_graph.entry_groups(numbered, [F.element_at("chain", -1)]).select(F.col("k0").alias("entry"), F.array_join(F.transform("chains", lambda x: x.cast("string")), ",").alias("chains"))


@query(_keyed("""SELECT * FROM (VALUES ('orders', 'service_impl', '%svc.save<%ctl.create'), ('orders', 'service_impl', '%svc.save<%job.tick'), ('orders', 'jdbc_sql_literal', '%dao.purge<%job.onMessage'),
  ('customer', 'jdbc_sql_literal', '%dao.purge<%job.onMessage'), ('region', 'jdbc_sql_literal', '%dao.purge<%job.onMessage'), ('stale', 'jdbc_sql_literal', '%dao.purge<%job.onMessage'), ('customer', 'mybatis_mapper_method', '%map.findAll<%svc.findAll<%ctl.list')) t("table", kind, chain)""", """'shop' || s_suppkey AS project, "table", kind, replace(chain, '%', @) AS chain"""))
def sample_table_callers(spark, sf_dir):
    files, nodes, edges = _shops(spark, sf_dir)
    anchors, _ = chain_drivers.table_anchors(files, table_refs.table_hits(files))
    return chain_drivers.table_callers(anchors, nodes, edges)[0].select("project", "table", "kind", F.array_join("chain", "<").alias("chain"))


@query("""SELECT kind, reason, errors * (SELECT count(*) FROM supplier) AS errors, tables FROM (VALUES ('table', 'no service of its repository and no entity', 3::BIGINT, 'customer,region,stale'), ('entity', 'no method in the call index', 1::BIGINT, 'orders')) t(kind, reason, errors, tables)""")
def sample_table_errors(spark, sf_dir):
    files, nodes, edges = _shops(spark, sf_dir)
    anchors, errors = chain_drivers.table_anchors(files, table_refs.table_hits(files))
    lost = chain_drivers.table_callers(anchors, nodes, edges)[1]
    return chain_drivers.error_groups(errors.union(lost)).withColumn("tables", F.array_join("tables", ","))


def _traced_entries(spark, sf_dir):
    files, nodes, edges = _shops(spark, sf_dir)
    named = lambda c: F.concat_ws(":", "project", c).alias("entry_id")
    entries = reports.endpoint_ids(entry_points.rest_map(files)).select(named("slug"), F.lit("rest").alias("kind"), "file", "line")
    scanned = entry_points.entry_points(files).where("kind <> 'controller_public_method'").select(named("kind"), "kind", "file", "line")
    return chain_drivers.entry_callees(entries.union(scanned), nodes, edges)


@query(_keyed("""SELECT * FROM (VALUES ('GET_api_orders', 'ctl.list', 3::BIGINT, 2::BIGINT, 'complete'), ('POST_api_orders', 'ctl.create', 3, 2, 'complete'), ('kafka_listener', 'job.onMessage', 2, 1, 'complete'), ('spring_async', 'job.onMessage', 2, 1, 'complete'),
  ('scheduled', 'job.tick', 3, 2, 'complete'), ('main', 'job.tick', 3, 2, 'complete')) t(entry_id, seed, node_count, edge_count, stop_reason)""", "q.* REPLACE ('shop' || @ || entry_id AS entry_id, @ || seed AS seed)"))
def sample_entry_rows(spark, sf_dir):
    return _traced_entries(spark, sf_dir)["rows"].select("entry_id", "seed", "node_count", "edge_count", "stop_reason")


@query(_keyed("""SELECT * FROM (VALUES ('POST_api_orders', 'save(Orders)', 6::BIGINT), ('scheduled', 'save(Orders)', 6), ('main', 'save(Orders)', 6)) t(source, method, score)""", "q.* REPLACE ('shop' || @ || source AS source)"))
def sample_entry_methods(spark, sf_dir):
    return chain_drivers.entry_key_methods(_traced_entries(spark, sf_dir)).select("source", "method", "score")


@query(each_supplier(f"""SELECT * FROM (VALUES ('{samples.HOME}Jobs.java', 4::BIGINT, 10::BIGINT), ('{samples.HOME}OrderController.java', 2, 6)) t(file, entries, nodes)""", "q.* REPLACE ('shop' || s_suppkey || '/' || file AS file)"))
def sample_controller_rows(spark, sf_dir):
    return chain_drivers.controller_rows(_traced_entries(spark, sf_dir)).select("file", F.size("entries").cast("long").alias("entries"), "nodes")


@query(_keyed("""SELECT * FROM (VALUES ('GET_api_orders', true, true, true), ('POST_api_orders', true, true, true), ('kafka_listener', true, true, true), ('spring_async', true, true, true), ('scheduled', true, true, true), ('main', true, true, true)) t(entry_id, anchored, counted, titled)""", "q.* REPLACE ('shop' || @ || entry_id AS entry_id)"))
def sample_entry_reports(spark, sf_dir):
    """The reports' payload, read back: it has the anchor of its entry, and the counts."""
    r = chain_drivers.entry_reports(_traced_entries(spark, sf_dir))
    payload = F.from_json(source.report_payload(F.col("value")), "query struct<seed: string, restMapAnchor: struct<entry_id: string>>, stats struct<node_count: long>")
    return r.select("entry_id", payload.alias("p"), "value").select("entry_id", (F.col("p.query.restMapAnchor.entry_id") == F.col("entry_id")).alias("anchored"), (F.col("p.stats.node_count") > 0).alias("counted"), F.startswith("value", F.lit("# Calls below ")).alias("titled"))


@query(each_supplier("SELECT * FROM (VALUES ('a/Bean.java', 'Bean', 2::BIGINT)) t(file, class, accessors)", "q.* REPLACE ('shop' || s_suppkey || '/' || file AS file)"))
def sample_accessor_leaves(spark, sf_dir):
    nodes = spark.createDataFrame([("A", "S", "run()", "s"), ("G", "Bean", "getX() : int", "a/Bean.java"), ("S", "Bean", "setX(int)", "a/Bean.java")], "key string, class string, method string, file string")
    edges = spark.createDataFrame([("A", "G"), ("A", "S")], "src_key string, dst_key string")
    return call_graph.accessor_leaves(samples.copies(spark, sf_dir, nodes, ["key"], ["file"]), samples.copies(spark, sf_dir, edges, ["src_key", "dst_key"]))
