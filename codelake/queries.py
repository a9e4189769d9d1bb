"""Queries that apply the operators to the driver's tables and to the sample project, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import samples
from codelake.functions import names
from codelake.functions import predicates as q
from codelake.operators import entry_points, java_context, links, structure, table_refs, text_search
from codelake.plans import call_graph, reports, symbol_index
from codelake.registry import QUERIES, SQL, each_supplier, query, table  # noqa: F401  QUERIES and SQL are read from here
from codelake.sources import files as source

# -- text search over documents as source files ----------------------------

PATH = "concat(source, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '/OrderServiceImpl' WHEN 1 THEN '/OrderService' WHEN 2 THEN '/OrderRepository' WHEN 3 THEN '/HomeController' ELSE '/Plain' END, CAST(doc_id AS STRING), '.java')"
SQL_LINES = """
files AS (SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN '/OrderServiceImpl' WHEN 1 THEN '/OrderService' WHEN 2 THEN '/OrderRepository' WHEN 3 THEN '/HomeController' ELSE '/Plain' END || doc_id || '.java' AS path, text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT path, string_split(text, chr(10)) AS a FROM files),
lines AS (SELECT path, unnest(a) AS text, generate_subscripts(a, 1) AS line_no FROM (SELECT path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM parts))"""
SQL_SCORE = """
CASE WHEN contains(path, 'ServiceImpl') OR contains(path, 'Controller') THEN 25 WHEN contains(path, 'Service') AND NOT contains(path, 'Impl') THEN 12 ELSE 0 END
 + CASE WHEN contains(path, 'Repository') THEN 8 ELSE 0 END
 + CASE WHEN regexp_matches(t, '^(public|private|protected) ') THEN CASE WHEN contains(t, '(') THEN 15 ELSE 6 END ELSE 0 END
 + CASE WHEN contains(t, '@') THEN 5 ELSE 0 END
 - CASE WHEN regexp_matches(t, '^(public|private|protected|static)\\s+class\\s') THEN 20 ELSE 0 END
 - CASE WHEN contains(t, 'interface ') AND NOT contains(left(t, 80), '{') THEN 10 ELSE 0 END"""


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.lit("").alias("project"), F.expr(PATH).alias("path"), "text")


def _grep_sql(exact: str, loose: str, tail: str) -> str:
    return f"""WITH {SQL_LINES},
found AS (SELECT *, ({exact}) AS exact FROM lines WHERE ({exact}) OR ({loose})),
chosen AS (SELECT path, line_no, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM found WHERE exact OR NOT (SELECT coalesce(bool_or(exact), false) FROM found))
SELECT path AS file, CAST(line_no AS INT) AS line, text, CAST({SQL_SCORE} AS INT) AS score FROM chosen {tail}"""


@query(_grep_sql("contains(text, 'License') OR contains(text, '@')", "contains(lower(text), 'license') OR contains(text, '@')", "ORDER BY score DESC, file, line LIMIT 200"))
def grep_lines_topk(spark, sf_dir):
    return text_search.search(_document_files(spark, sf_dir), "License|@")


@query(_grep_sql("contains(text, 'mit LICENSE') OR contains(text, 'apache LICENSE')", "contains(lower(text), 'mit license') OR contains(lower(text), 'apache license')", ""))
def grep_case_fallback(spark, sf_dir):
    """Nothing matches as written, so the search falls back to any case."""
    return text_search.search(_document_files(spark, sf_dir), "mit LICENSE ｜ apache LICENSE", most=None)


@query("""
WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), n(needle) AS (VALUES ('the'), ('und'), ('que'))
SELECT needle, count(*) AS hits, count(DISTINCT conv_id) AS conversations FROM t JOIN n ON contains(lower(text), needle) GROUP BY needle
""")
def needle_counts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    needles = text_search.needles_of("the|und｜que|the")
    found = F.array_compact(F.array(*[F.when(q.has_needle(F.col("text"), [n]), F.lit(n)) for n in needles]))
    return turns.select("conv_id", F.explode(found).alias("needle")).groupBy("needle").agg(F.count("*").alias("hits"), F.countDistinct("conv_id").alias("conversations"))


TAGS = [("link", r"<a\s"), ("image", r"<img\s"), ("script", r"<script"), ("heading", r"<h[1-6]"), ("paragraph", r"<p[ >]"), ("style", r"<style")]


@query("""
WITH parts AS (SELECT page_id, string_split(html, chr(10)) AS a FROM pages WHERE html IS NOT NULL),
lines AS (SELECT page_id, unnest(a) AS text FROM parts),
k(kind, pattern) AS (VALUES ('link', '<a\\s'), ('image', '<img\\s'), ('script', '<script'), ('heading', '<h[1-6]'), ('paragraph', '<p[ >]'), ('style', '<style'))
SELECT page_id, kind, count(*) AS lines FROM lines JOIN k ON regexp_matches(text, pattern) GROUP BY page_id, kind
""")
def line_pattern_scan(spark, sf_dir):
    """The scan of entry points, with patterns of markup instead."""
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.lit("").alias("project"), F.col("page_id").alias("path"), F.col("html").alias("text"))
    return source.lines(pages).select(F.col("path").alias("page_id"), F.explode(q.line_kinds(F.col("text"), TAGS)).alias("kind")).groupBy("page_id", "kind").agg(F.count("*").alias("lines"))


@query("""
SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages WHERE html IS NOT NULL
""")
def href_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


# -- windows over ordered lines --------------------------------------------

def _turn_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.lit("").alias("project"), F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), "role", "text")


@query("""
SELECT conv_id, turn, max(CASE WHEN contains(text, '?') THEN 1 ELSE 0 END) OVER w AS near_question
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 2 FOLLOWING)
""")
def window_flag(spark, sf_dir):
    flag = F.when(F.contains("text", F.lit("?")), 1).otherwise(0)
    return _turn_lines(spark, sf_dir).select(F.col("path").alias("conv_id"), F.col("line_no").alias("turn"), source.around(flag, 8, 2).alias("near_question"))


@query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN turn END AS m FROM conversations),
d AS (SELECT conv_id, turn, coalesce(first_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING),
                                     last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 159 PRECEDING AND CURRENT ROW)) AS answer FROM t)
SELECT conv_id, turn, CASE WHEN answer IS NULL THEN '_line' || turn ELSE 'answer' || answer END AS java_method, coalesce(answer, turn) AS java_method_line FROM d
""")
def enclosing_asof(spark, sf_dir):
    """The two-way lookup of enclosing methods: every answer of a conversation is a declaration, and each turn belongs to the next one below, else to the last one above."""
    answer = F.when(F.col("role") == "assistant", F.concat(F.lit("public void answer"), F.col("line_no").cast("string"), F.lit("() {"))).otherwise("x = 1;")
    found = java_context.enclosing_methods(_turn_lines(spark, sf_dir).withColumn("text", answer))
    return found.select(F.col("path").alias("conv_id"), F.col("line_no").alias("turn"), "java_method", "java_method_line")


@query("""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS line, CASE WHEN role = 'user' THEN turn END AS m FROM conversations),
s AS (SELECT conv_id, line, last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line ROWS BETWEEN 48 PRECEDING AND CURRENT ROW) AS q FROM t)
SELECT conv_id, CAST(line AS INT) AS line, 'com.M' || conv_id AS namespace, 'q' || q AS statement_id, CASE WHEN q IS NULL THEN 'no statement id around the line' ELSE 'no source of the interface' END AS reason FROM s
""")
def preceding_asof(spark, sf_dir):
    """The look-back for mapper statements: conversations as mapper files in which every question is a statement."""
    turn = F.when(F.col("role") == "user", F.concat(F.lit('<select id="q'), F.col("turn").cast("string"), F.lit('">'))).otherwise("select 1")
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    text = F.concat(F.lit('<mapper namespace="com.M'), F.col("conv_id").cast("string"), F.lit('">\n'), F.array_join("turns", "\n"))
    files = source.as_files(by.select(F.lit("").alias("project"), F.concat(F.lit("src/main/resources/"), F.col("conv_id").cast("string"), F.lit(".xml")).alias("path"), text.alias("text")))
    asked = source.lines(files).where("line_no > 1").select("project", "path", "line_no")
    told = links.mapper_methods(asked, files)
    return told.select(F.regexp_extract("xml_file", r"(\d+)\.xml$", 1).cast("long").alias("conv_id"), F.col("xml_line").alias("line"), "namespace", "statement_id", "reason")


RANGES = [("all", 0.0, 1e9), ("small", 0.0, 50000.0), ("tiny", 1000.0, 20000.0), ("large", 100000.0, 400000.0), ("huge", 200000.0, 300000.0)]


@query("""
WITH r(name, lo, hi) AS (VALUES ('all', 0.0::DOUBLE, 1e9::DOUBLE), ('small', 0.0, 50000.0), ('tiny', 1000.0, 20000.0), ('large', 100000.0, 400000.0), ('huge', 200000.0, 300000.0))
SELECT o_orderkey, arg_min(name, hi - lo) AS bucket FROM orders JOIN r ON o_totalprice BETWEEN lo AND hi GROUP BY o_orderkey
""")
def interval_smallest(spark, sf_dir):
    """Each position in the smallest range that holds it."""
    ranges = F.broadcast(spark.createDataFrame([(1, *r) for r in RANGES], "g int, name string, lo double, hi double"))
    points = table(spark, sf_dir, "orders").select(F.lit(1).alias("g"), "o_orderkey", "o_totalprice")
    return links.smallest_around(points, ranges, ["g"], "o_totalprice", "lo", "hi", ["name"]).select("o_orderkey", F.col("name").alias("bucket"))


# -- joins and groups of table references -----------------------------------

@query("""
SELECT c_custkey AS ordinal, c_name AS name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000)
""")
def unresolved_anti(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"))
    hits = table(spark, sf_dir, "orders").where("o_totalprice > 300000").join(listed, F.col("o_custkey") == F.col("ordinal")).select(F.upper("name").alias("table"))
    return table_refs.unresolved(hits, listed)


@query("""
SELECT DISTINCT upper(p_brand) || '-' || p_size AS "table" FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_size > 25
""")
def extracted_only_anti(spark, sf_dir):
    name = F.concat(F.upper("p_brand"), F.lit("-"), F.col("p_size").cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("table"))
    hits = parts.join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    listed = parts.where("p_size <= 25").select(F.col("p_partkey").alias("ordinal"), F.lower("table").alias("name"))
    return table_refs.extracted_only(hits, listed)


def _brand_hits(spark, sf_dir):
    """Line items as table hits: the brand of the part is the table, the supplier the file."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace("p_brand", "#", "Type").alias("table"))
    item = table(spark, sf_dir, "lineitem")
    return item.join(part, "l_partkey").select(
        F.lit("").alias("project"), "table", F.col("l_returnflag").alias("source"), F.lit("high").alias("confidence"), F.concat(F.lit("s"), "l_suppkey").alias("file"),
        F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("nth"), F.concat(F.lit("m"), (F.col("l_orderkey") % 7).cast("string")).alias("java_method"),
    )


SQL_BRANDS = """
hits AS (SELECT replace(p_brand, '#', 'Type') AS "table", l_returnflag AS source, 's' || l_suppkey AS file, l_linenumber AS line, l_orderkey AS nth, 'm' || (l_orderkey % 7) AS java_method
         FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH {SQL_BRANDS}, named AS (SELECT *, lower(regexp_replace(regexp_replace("table", '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS physical_table FROM hits)
SELECT physical_table, file, line, source, min(nth) AS nth FROM named GROUP BY physical_table, file, line, source""")
def anchors_dedup(spark, sf_dir):
    return table_refs.physical_hits(_brand_hits(spark, sf_dir)).select("physical_table", "file", "line", "source", "nth")


@query(f"""WITH {SQL_BRANDS}, small AS (SELECT "table", file, min(line) AS line FROM hits GROUP BY "table", file)
SELECT "table", count(*) AS files, string_agg(file || ':' || line, ',' ORDER BY file, line) AS anchors FROM small GROUP BY "table" """)
def anchors_grouped(spark, sf_dir):
    small = _brand_hits(spark, sf_dir).groupBy("project", "table", "file").agg(F.min("line").alias("line"))
    grouped = table_refs.anchors_by(small.withColumn("name", F.col("table")), "name")
    return grouped.select(F.col("name").alias("table"), F.size("anchors").cast("long").alias("files"), F.array_join(F.transform("anchors", lambda a: F.concat_ws(":", a["file"], a["line"].cast("string"))), ",").alias("anchors"))


@query(f"""WITH {SQL_BRANDS}, j AS (SELECT * FROM hits WHERE source = 'R')
SELECT "table", file, java_method, line, nth FROM (SELECT *, row_number() OVER (PARTITION BY "table", file, java_method ORDER BY line, nth) AS r FROM j) WHERE r = 1""")
def min_per_group(spark, sf_dir):
    hits = _brand_hits(spark, sf_dir).where("source = 'R'").withColumns({"source": F.lit("jdbc_sql_literal"), "file": F.concat("file", F.lit(".java"))})
    return table_refs.first_per_method(hits).select("table", F.regexp_replace("file", r"\.java$", "").alias("file"), "java_method", "line", "nth")


@query("""
WITH s AS (SELECT source, lang AS class, CAST(quality AS VARCHAR) AS method, substr(source, 1, 4) AS file, n_chars % 50 AS score FROM documents JOIN labels USING (doc_id)),
b AS (SELECT class, method, file, max(score) AS score FROM s GROUP BY class, method, file)
SELECT class, method, file, score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM s JOIN b USING (class, method, file, score) GROUP BY class, method, file, score
""")
def max_merge_sources(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "source", F.col("lang").alias("class"), F.col("quality").cast("string").alias("method"), F.substring("source", 1, 4).alias("file"), (F.col("n_chars") % 50).alias("score"))
    return call_graph.merged_key_methods(scored).withColumn("sources", F.array_join("sources", ","))


# -- graphs: regions over nations over customers over orders ----------------

SQL_EDGES = """
edges AS (SELECT 'r' || n_regionkey AS src_key, 'n' || n_nationkey AS dst_key, n_name AS dst_name FROM nation
          UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name FROM customer
          UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderpriority FROM orders),
nodes AS (SELECT 'r' || r_regionkey AS key, 'RegionController' AS class, r_regionkey % 2 = 0 AS is_rest, '' AS status FROM region
          UNION ALL SELECT 'n' || n_nationkey, 'NationService', false, '' FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'CustomerHelper', false, '' FROM customer
          UNION ALL SELECT 'o' || o_orderkey, 'OrderDao', false, o_orderstatus FROM orders)"""


def _edges(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [t("nation").select(key("r", "n_regionkey"), key("n", "n_nationkey"), "n_name"), t("customer").select(key("n", "c_nationkey"), key("c", "c_custkey"), "c_name"), t("orders").select(key("c", "o_custkey"), key("o", "o_orderkey"), "o_orderpriority")]
    return parts[0].union(parts[1]).union(parts[2]).toDF("src_key", "dst_key", "dst_name")


def _nodes(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    row = lambda df, prefix, c, cls, rest, status: df.select(F.concat(F.lit(prefix), F.col(c).cast("string")), F.lit(cls), rest, status)
    no, blank = F.lit(False), F.lit("")
    out = row(t("region"), "r", "r_regionkey", "RegionController", F.col("r_regionkey") % 2 == 0, blank).union(row(t("nation"), "n", "n_nationkey", "NationService", no, blank))
    return out.union(row(t("customer"), "c", "c_custkey", "CustomerHelper", no, blank)).union(row(t("orders"), "o", "o_orderkey", "OrderDao", no, F.col("o_orderstatus"))).toDF("key", "class", "is_rest", "status")


@query(f"WITH {SQL_EDGES} SELECT dst_key AS key, count(*) AS in_degree FROM edges GROUP BY dst_key")
def in_degree(spark, sf_dir):
    return call_graph.in_degree(_edges(spark, sf_dir))


@query(f"WITH {SQL_EDGES} SELECT key, class FROM nodes WHERE key NOT IN (SELECT src_key FROM edges)")
def leaf_nodes(spark, sf_dir):
    return call_graph.leaves(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("key", "class")


@query(f"WITH {SQL_EDGES} SELECT key, class FROM nodes WHERE key NOT IN (SELECT dst_key FROM edges)")
def root_nodes(spark, sf_dir):
    return call_graph.roots(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("key", "class")


@query(f"""WITH {SQL_EDGES}
SELECT src_key, dst_key, branch, branches FROM (
  SELECT *, row_number() OVER (PARTITION BY src_key ORDER BY dst_name, dst_key) AS branch, count(*) OVER (PARTITION BY src_key) AS branches FROM edges) WHERE branch <= 3""")
def per_node_topk(spark, sf_dir):
    return call_graph.first_branches(_edges(spark, sf_dir), 3).select("src_key", "dst_key", "branch", "branches")


@query(f"""WITH RECURSIVE {SQL_EDGES},
bfs AS (SELECT 'r' || r_regionkey AS key, 0 AS depth FROM region UNION SELECT dst_key, depth + 1 FROM bfs JOIN edges ON src_key = key)
SELECT key, CAST(min(depth) AS INT) AS depth FROM bfs GROUP BY key""")
def bfs_depth(spark, sf_dir):
    return call_graph.depths(_edges(spark, sf_dir), _nodes(spark, sf_dir).where("class = 'RegionController'").select("key"))


@query(f"""WITH {SQL_EDGES}
SELECT 'o' || o_orderkey AS seed, 'o' || o_orderkey || '<c' || o_custkey || '<n' || c_nationkey || '<r' || n_regionkey AS chain,
       CASE WHEN n_regionkey % 2 = 0 THEN 'rest_endpoint' ELSE 'max_depth' END AS stop_reason
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def simple_paths_up(spark, sf_dir):
    seeds = _nodes(spark, sf_dir).where("class = 'OrderDao'").select("key")
    found = call_graph.trace_up(_edges(spark, sf_dir), _nodes(spark, sf_dir).select("key", "is_rest"), seeds, max_depth=3)
    return found.withColumn("chain", F.array_join("chain", "<"))


@query(f"""WITH RECURSIVE {SQL_EDGES},
up AS (SELECT key FROM nodes WHERE status = 'F' UNION SELECT src_key FROM up JOIN edges ON dst_key = key)
SELECT key FROM up""")
def reach_sink(spark, sf_dir):
    return call_graph.reaching(_edges(spark, sf_dir), _nodes(spark, sf_dir).where("status = 'F'").select("key"))


@query(f"""WITH RECURSIVE {SQL_EDGES},
up AS (SELECT key FROM nodes WHERE class = 'OrderDao' UNION SELECT src_key FROM up JOIN edges ON dst_key = key),
below AS (SELECT 'r0' AS key UNION SELECT dst_key FROM below JOIN edges ON src_key = key),
scored AS (
  SELECT n.key, CASE WHEN class IN ('OrderDao', 'RegionController') THEN 0 ELSE
    CASE WHEN class = 'NationService' THEN 2 ELSE 0 END + CASE WHEN u.key IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN b.key IS NOT NULL AND n.key <> 'r0' THEN 1 ELSE 0 END END AS business_score
  FROM nodes n LEFT JOIN up u USING (key) LEFT JOIN below b USING (key))
SELECT key, CAST(business_score AS BIGINT) AS business_score, business_score >= 4 AS business_candidate FROM scored""")
def business_score(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumns({"method": F.lit("run()"), "file": F.concat(F.lit("src/"), "class", F.lit(".java")), "is_transactional": F.lit(False)})
    return call_graph.business_scores(nodes, _edges(spark, sf_dir), spark.createDataFrame([("r0",)], "key string")).select("key", "business_score", "business_candidate")


@query("""
SELECT 'c' || o_custkey AS key, o_orderpriority AS bean, CASE o_orderstatus WHEN 'O' THEN 'get' WHEN 'F' THEN 'set' ELSE 'is' END AS kind,
       string_agg(DISTINCT CASE o_orderstatus WHEN 'O' THEN 'get' WHEN 'F' THEN 'set' ELSE 'is' END || 'P' || (o_orderkey % 3), ',' ORDER BY CASE o_orderstatus WHEN 'O' THEN 'get' WHEN 'F' THEN 'set' ELSE 'is' END || 'P' || (o_orderkey % 3)) AS accessors
FROM orders GROUP BY ALL
""")
def fold_accessors(spark, sf_dir):
    """Orders as accessors of beans, folded into the customers that call them."""
    name = F.concat(F.expr("CASE o_orderstatus WHEN 'O' THEN 'get' WHEN 'F' THEN 'set' ELSE 'is' END"), F.lit("P"), (F.col("o_orderkey") % 3).cast("string"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("class"), F.concat(name, F.lit("() : Value")).alias("method"))
    others = _nodes(spark, sf_dir).where("class <> 'OrderDao'").select("key", "class", F.lit("run()").alias("method"))
    return call_graph.folded_accessors(orders.union(others), _edges(spark, sf_dir))[2].withColumn("accessors", F.array_join("accessors", ","))


@query("""
SELECT CASE WHEN contains(lower(p_name), 'redis') OR p_size % 4 = 1 THEN 'middleware' WHEN p_size % 4 = 2 THEN 'external_api' WHEN p_size % 4 = 3 THEN 'database' ELSE 'other' END AS kind, count(*) AS nodes FROM part GROUP BY kind
""")
def sink_kinds(spark, sf_dir):
    cls = F.expr("CASE CAST(p_size % 4 AS INT) WHEN 1 THEN 'x.KafkaSender' WHEN 2 THEN 'x.RestTemplateClient' WHEN 3 THEN 'x.PartDao' ELSE 'x.Part' END")
    part = table(spark, sf_dir, "part")
    return part.select(q.sink_kind(cls, F.lit("src/Part.java"), F.col("p_name")).alias("kind")).groupBy("kind").agg(F.count("*").alias("nodes"))


# -- names -------------------------------------------------------------------

@query("""SELECT o_orderkey, 'ma-' || left(sha256(lower('Tab_' || (o_orderkey % 9)) || '|jdbc_sql_literal|src/' || o_custkey || '.java|' || (o_orderkey % 500) || '|'), 16) AS hit_id FROM orders""")
def stable_hit_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name, file = F.concat(F.lit("Tab_"), (F.col("o_orderkey") % 9).cast("string")), F.concat(F.lit("src\\"), F.col("o_custkey").cast("string"), F.lit(".java"))
    return o.select("o_orderkey", names.table_hit_id(name, F.lit("jdbc_sql_literal"), file, F.col("o_orderkey") % 500).alias("hit_id"))


@query("""
WITH t AS (SELECT p_partkey, p_type AS words, replace(lower(p_type), ' ', '_') AS snaked FROM part),
n AS (SELECT p_partkey, snaked, list_aggregate(list_transform(list_filter(string_split(snaked, '_'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS pascal FROM t)
SELECT p_partkey, pascal, lower(regexp_replace(regexp_replace(pascal, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS physical FROM n
""")
def table_names(spark, sf_dir):
    """Type names as snake-case tables, as entity classes, and back from a qualified name."""
    pascal = names.entity_class(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "part").select("p_partkey", pascal.alias("pascal"), names.physical_table(F.concat(F.lit("app."), pascal)).alias("physical"))


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(replace(regexp_replace(path, '^/+|/+$', '', 'g'), '/', '_'), '[^a-zA-Z0-9_\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS body FROM u),
s AS (SELECT page_id, left('GET_' || CASE WHEN left(body, 72) = '' THEN 'root' ELSE left(body, 72) END, 100) AS slug FROM b)
SELECT page_id, CASE WHEN nth > 1 THEN slug || '_' || nth ELSE slug END AS slug,
       're-' || left(sha256('GET|' || trim(path) || '|x.Pages|show|' || CASE WHEN nth > 1 THEN slug || '_' || nth ELSE slug END || '|P.java|' || page_id), 16) AS endpoint_id
FROM (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS nth FROM s) JOIN u USING (page_id)
""")
def slug_dedup(spark, sf_dir):
    """Pages as endpoints of one class: equal slugs are numbered, and ids follow from them."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select(F.lit("").alias("project"), F.lit("get").alias("http_method"), path.alias("path"), F.lit("x.Pages").alias("class_name"), F.lit("show").alias("method_name"), F.lit("P.java").alias("file"), F.col("page_id").alias("line"))
    return reports.endpoint_ids(pages).select(F.col("line").alias("page_id"), "slug", "endpoint_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'orders_' || (o_orderkey % 3) ELSE 'orders_' || (o_orderkey % 3) || ',customer,region' END AS tables FROM orders
""")
def sql_tables(spark, sf_dir):
    """Tables in SQL text: schemas, joins, comma lists, nested selects, quoted commas and names that WITH defines."""
    o = F.concat(F.lit("app.orders_"), (F.col("o_orderkey") % 3).cast("string"))
    plain = F.concat(F.lit("WITH t AS (SELECT 1) SELECT ', nope' FROM "), o, F.lit(" JOIN customer c ON f(a, b), region r WHERE x IN (SELECT 1 FROM t, (VALUES (1)) v)"))
    sql = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("DELETE FROM "), o)).otherwise(plain)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(table_refs.sql_tables(sql), ",").alias("tables"))


# -- the sample project ------------------------------------------------------

HOME = samples.HOME


def _asked(spark, sf_dir, path, lines):
    return samples.suppliers(spark, sf_dir).select(F.concat(F.lit("shop"), "s").alias("project"), F.lit(path).alias("path"), F.explode(F.array(*map(F.lit, lines))).alias("line_no"))


@query(each_supplier(f"""SELECT * FROM (VALUES
  ('controller_public_method', '{HOME}OrderController.java', 9), ('controller_public_method', '{HOME}OrderController.java', 13),
  ('kafka_listener', '{HOME}Jobs.java', 3), ('spring_async', '{HOME}Jobs.java', 3), ('main', '{HOME}Jobs.java', 5), ('scheduled', '{HOME}Jobs.java', 6)) t(kind, file, line)"""))
def java_entry_points(spark, sf_dir):
    return entry_points.entry_points(samples.projects(spark, sf_dir)).select("project", "kind", "file", "line")


@query(each_supplier(f"""SELECT * FROM (VALUES
  ('GET', '/api/orders', 'com.example.OrderController', 'list', '{HOME}OrderController.java', 9, '@GetMapping'),
  ('POST', '/api/orders', 'com.example.OrderController', 'create', '{HOME}OrderController.java', 13, '@PostMapping')) t(http_method, path, class_name, method_name, file, line, annotation)"""))
def java_rest_map(spark, sf_dir):
    return entry_points.rest_map(samples.projects(spark, sf_dir)).select("project", "http_method", "path", "class_name", "method_name", "file", "line", "annotation")


@query(each_supplier(f"""SELECT * FROM (VALUES
  ('orders', 'entity_annotation', '{HOME}Orders.java', 3, NULL, NULL), ('orders', 'jdbc_sql_literal', '{HOME}OrderDao.java', 4, 'purge', 6), ('customer', 'jdbc_sql_literal', '{HOME}OrderDao.java', 4, 'purge', 6),
  ('region', 'jdbc_sql_literal', '{HOME}OrderDao.java', 4, 'purge', 6), ('stale', 'jdbc_sql_literal', '{HOME}OrderDao.java', 7, 'purge', 6), ('orders', 'jdbc_sql_literal', '{HOME}OrderDao.java', 7, 'purge', 6),
  ('customer', 'mybatis_xml', 'src/main/resources/OrderMapper.xml', 5, NULL, NULL)) t("table", source, file, line, java_method, java_method_line)"""))
def java_table_hits(spark, sf_dir):
    return table_refs.table_hits(samples.projects(spark, sf_dir)).select("project", "table", "source", "file", "line", "java_method", "java_method_line")


@query(each_supplier(f"""SELECT * FROM (VALUES
  ('com.example', '{HOME}OrderController.java', 'OrderController', 5, 5), ('com.example', '{HOME}OrderDao.java', 'OrderDao', 5, 2), ('com.example', '{HOME}OrderMapper.java', 'OrderMapper', 11, 2),
  ('com.example', '{HOME}Jobs.java', 'Jobs', 5, 2), ('com.example', '{HOME}Orders.java', 'Orders', 5, 4), ('com.example', '{HOME}OrdersRepository.java', 'OrdersRepository', 11, 2),
  ('com.example', '{HOME}OrderServiceImpl.java', 'OrderServiceImpl', 5, 2), ('p', '{HOME}Kinds.java', 'A', 5, 1), ('p', '{HOME}Kinds.java', 'R', 5, 1), ('p', '{HOME}Kinds.java', 'E', 10, 1)) t(package, file, name, kind, line)"""))
def java_top_level_types(spark, sf_dir):
    return structure.top_level_types(samples.projects(spark, sf_dir)).select("project", "package", "file", "name", "kind", "line")


@query(each_supplier("""SELECT * FROM (VALUES ('shop', 'core', 'core', 'root-pom-modules', true, 'shop-core', 'jar'), ('shop', 'web', 'web', 'root-pom-modules', false, NULL, NULL),
  ('other', 'api', 'api', 'settings-include', false, NULL, NULL), ('other', 'admin', 'web/admin', 'settings-include', false, NULL, NULL), ('other', 'tools', 'tools', 'settings-include', false, NULL, NULL)) t(project, name, path, source, has_pom, artifact_id, packaging)""", 'q.* REPLACE (project || s_suppkey AS project)'))
def project_modules(spark, sf_dir):
    return structure.modules(samples.projects(spark, sf_dir))


@query(each_supplier(f"""SELECT * FROM (VALUES ('{HOME}OrderController.java', 9, '/api', 'GET', '/api/orders', 'GET /api/orders', 'List orders.'), ('{HOME}OrderController.java', 13, '/api', 'POST', '/api/orders', 'POST /api/orders', NULL)) t(file, line, class_base_path, http_method, rest_path, rest_summary, javadoc)"""))
def java_top_entries(spark, sf_dir):
    asked = _asked(spark, sf_dir, f"{HOME}OrderController.java", (9, 13))
    return java_context.top_entries(asked, source.lines(samples.projects(spark, sf_dir))).select("project", F.col("path").alias("file"), F.col("line_no").alias("line"), "class_base_path", "http_method", "rest_path", "rest_summary", "javadoc")


@query(each_supplier(f"""SELECT * FROM (VALUES (5, 'com.example.OrderMapper', 'findAll', '{HOME}OrderMapper.java', 4, 15, true), (1, 'com.example.OrderMapper', NULL, NULL, NULL, NULL, false)) t(xml_line, namespace, statement_id, java_file, line, "character", ok)"""))
def mybatis_links(spark, sf_dir):
    asked = _asked(spark, sf_dir, "src/main/resources/OrderMapper.xml", (5, 1))
    return links.mapper_methods(asked, samples.projects(spark, sf_dir)).select("project", "xml_line", "namespace", "statement_id", "java_file", "line", "character", "ok")


@query(each_supplier(f"""SELECT * FROM (VALUES ('orders', 'OrdersRepository', '{HOME}OrderServiceImpl.java', 'repo', 'save', 8, 105)) t("table", repository, service_file, field, method, method_line, score)"""))
def repository_links(spark, sf_dir):
    tables = samples.suppliers(spark, sf_dir).select(F.concat(F.lit("shop"), "s").alias("project"), F.lit("orders").alias("table"))
    return links.repository_calls(tables, samples.projects(spark, sf_dir)).select("project", "table", "repository", "service_file", "field", "method", "method_line", "score")


@query(each_supplier(f"""SELECT * FROM (VALUES ('orders', '{HOME}Orders.java', 4, 14)) t("table", entity_file, class_line, class_character)"""))
def entity_links(spark, sf_dir):
    tables = samples.suppliers(spark, sf_dir).select(F.concat(F.lit("shop"), "s").alias("project"), F.lit("orders").alias("table"))
    return links.entity_files(tables, samples.projects(spark, sf_dir)).select("project", "table", "entity_file", "class_line", "class_character")


@query(each_supplier("SELECT * FROM (VALUES ('C', '.C<.B<.A', 'rest_endpoint'), ('C', '.C<.B<.D<.B', 'cycle'), ('A', '.A', 'rest_endpoint')) t(seed, chain, stop_reason)", "s_suppkey || ':' || seed AS seed, replace(chain, '.', s_suppkey || ':') AS chain, stop_reason"))
def sample_trace_up(spark, sf_dir):
    nodes, edges = samples.call_graphs(spark, sf_dir)
    return call_graph.trace_up(edges, nodes, nodes.where("key LIKE '%:C' OR key LIKE '%:A'").select("key")).withColumn("chain", F.array_join("chain", "<"))


@query(each_supplier("SELECT * FROM (VALUES ('A', 'B'), ('B', 'D'), ('D', 'B')) t(a, b)", "s_suppkey || ':' || a AS src_key, s_suppkey || ':' || b AS dst_key"))
def sample_trace_down(spark, sf_dir):
    nodes, edges = samples.call_graphs(spark, sf_dir)
    return call_graph.trace_down_all(edges, nodes.where("key LIKE '%:A'").select("key"), max_branches=1)[1].select("src_key", "dst_key")


@query(each_supplier("SELECT * FROM (VALUES ('A', 0::BIGINT, ''), ('B', 8::BIGINT, 'service_layer,in_degree_2,reaches_persistence_subgraph,below_root'), ('C', 0::BIGINT, ''), ('D', 4::BIGINT, 'reaches_persistence_subgraph,below_root')) t(key, business_score, signals)", "q.* REPLACE (s_suppkey || ':' || key AS key)"))
def sample_business(spark, sf_dir):
    nodes, edges = samples.call_graphs(spark, sf_dir)
    scored = call_graph.business_scores(nodes, edges, nodes.where("key LIKE '%:A'").select("s", "key"), by="s")
    return scored.select("key", "business_score", F.array_join("business_signals", ",").alias("signals"))


@query("""SELECT kind, is_leaf, nodes * (SELECT count(*) FROM supplier) AS nodes, methods FROM (VALUES ('database', true, 1::BIGINT, 'OrderStore.load()'), ('other', false, 3::BIGINT, 'Helper.go(),OrderController.list(),OrderService.find()')) t(kind, is_leaf, nodes, methods)""")
def sample_sinks(spark, sf_dir):
    return call_graph.sink_buckets(*samples.call_graphs(spark, sf_dir)).withColumn("methods", F.array_join("methods", ","))


@query("""SELECT replace(line, '.', k || ':') AS line FROM (SELECT min(s_suppkey) AS k FROM supplier), (VALUES ('.A'), ('  .B'), ('    .C'), ('    .D'), ('      .B (cycle)')) t(line)""")
def sample_tree(spark, sf_dir):
    """The tree of one supplier's graph among those of all."""
    first = samples.suppliers(spark, sf_dir).agg(F.min(F.col("s").cast("long"))).first()[0]
    return call_graph.shown_tree(samples.call_graphs(spark, sf_dir)[1], f"{first}:A", spark).select("line")


@query(each_supplier("SELECT * FROM (VALUES ('A', 0, 0::BIGINT), ('B', 1, 1::BIGINT), ('D', 2, 2::BIGINT)) t(key, depth, ordinal)", "q.* REPLACE (s_suppkey || ':' || key AS key)"))
def sample_node_cap(spark, sf_dir):
    nodes, edges = samples.call_graphs(spark, sf_dir)
    return call_graph.trace_down_all(edges, nodes.where("key LIKE '%:A'").select("key"), max_nodes=3)[0].drop("seed")


@query("""SELECT 2 * count(*) AS chain_count, 'cycle=' || count(*) || ',rest_endpoint=' || count(*) AS stop_reasons, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT s_suppkey || ':' || k AS t FROM supplier, (VALUES ('A'), ('B')) v(k) ORDER BY t LIMIT 12)) AS tops FROM supplier""")
def sample_chain_summary(spark, sf_dir):
    nodes, edges = samples.call_graphs(spark, sf_dir)
    s = reports.chain_summary(call_graph.trace_up(edges, nodes, nodes.where("key LIKE '%:C'").select("key")))
    return s.select("chain_count", F.array_join(F.transform(F.map_entries("stop_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("stop_reasons"), F.array_join("tops", ",").alias("tops"))


@query("""
WITH n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END AS name FROM part WHERE p_partkey % 5 <> 0),
f AS (SELECT min(k) AS k, arg_min(name, k) AS name FROM n GROUP BY lower(name))
SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS ordinal, name FROM f
""")
def listed_tables(spark, sf_dir):
    """Types of parts as a list of tables: every fifth line is a comment, names come in two spellings."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type"))
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), name)).otherwise(F.concat(F.lit(" "), name, F.lit(" # a type")))
    return source.listed_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), line.alias("text")))


def _manifest(spark, sf_dir):
    return table_refs.manifest(samples.projects(spark, sf_dir), source.listed_tables(spark, "", "ORDERS,ghost"))


@query("SELECT 'ghost' AS name FROM supplier LIMIT 1")
def manifest_unresolved(spark, sf_dir):
    return _manifest(spark, sf_dir)["unresolved"].select("name")


@query("SELECT * FROM (VALUES ('customer'), ('region'), ('stale')) t(\"table\")")
def manifest_extracted_only(spark, sf_dir):
    return _manifest(spark, sf_dir)["extracted_only"]


@query("SELECT canonical, anchors FROM supplier, (VALUES ('ORDERS', 3::BIGINT), ('customer', 2::BIGINT), ('region', 1::BIGINT), ('stale', 1::BIGINT)) t(canonical, anchors)")
def manifest_by_name(spark, sf_dir):
    return _manifest(spark, sf_dir)["anchors_by_table"].select("canonical", F.size("anchors").cast("long").alias("anchors"))


@query("""
WITH n AS (SELECT p_partkey AS k, lower(replace(p_type, ' ', '_')) AS name FROM part), f AS (SELECT min(k) AS k, name FROM n GROUP BY name)
SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS ordinal, name AS physical_table FROM f
""")
def manifest_physical(spark, sf_dir):
    """The physical tables of a list of types of parts, as a manifest of every supplier's project has them."""
    listed = source.listed_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("APP."), F.replace("p_type", F.lit(" "), F.lit("_"))).alias("text")))
    return table_refs.manifest(samples.projects(spark, sf_dir), listed)["canonical_physical"]


@query(each_supplier(f"SELECT * FROM (VALUES ('{HOME}OrderDao.java', 4, 'purge'), ('{HOME}OrderDao.java', 7, 'purge'), ('{HOME}Orders.java', 3, NULL)) t(file, line, java_method)"))
def rows_of_table(spark, sf_dir):
    return table_refs.rows_of_table(table_refs.table_hits(samples.projects(spark, sf_dir)), "app.ORDERS").select("project", "file", "line", "java_method")


@query(each_supplier(f"SELECT * FROM (VALUES (true, 'customer', '{HOME}OrderMapper.java', 'findAll', 4, 5)) t(ok, \"table\", java_file, statement_id, line, xml_line)"))
def mapper_anchors(spark, sf_dir):
    files = samples.projects(spark, sf_dir)
    found, lost = links.mapper_anchors(table_refs.xml_hits(files), files)
    none = F.lit(None)
    return found.select("project", F.lit(True).alias("ok"), "table", "java_file", "statement_id", "line", "xml_line").union(lost.select("project", F.lit(False), "table", none.cast("string"), none.cast("string"), none.cast("int"), "xml_line"))


@query(each_supplier("SELECT * FROM (VALUES (5, 1), (8, 2), (4, 3)) t(candidate, \"rank\")"))
def method_candidates(spark, sf_dir):
    lines = source.lines(samples.projects(spark, sf_dir).where("name = 'OrderServiceImpl.java'"))
    return text_search.method_candidates(lines.where("line_no = 5"), lines).select("project", "candidate", "rank")


@query(each_supplier("""SELECT * FROM (VALUES ('k1', 'Jobs.java', 4, false, true, true, '@KafkaListener'), ('k2', 'OrderController.java', 9, true, false, false, ''), ('k3', 'Gone.java', 1, false, false, false, NULL)) t(key, name, line, is_rest, is_message_listener, is_async_method, listeners)"""))
def node_flags(spark, sf_dir):
    nodes = samples.each(spark, sf_dir, [("k1", f"{HOME}Jobs.java", 4), ("k2", f"{HOME}OrderController.java", 9), ("k3", "Gone.java", 1)], ["key", "file", "line"]).withColumn("project", F.concat(F.lit("shop"), "s"))
    flagged = java_context.flagged_nodes(nodes, source.lines(samples.projects(spark, sf_dir)))
    return flagged.select("project", "key", F.substring_index("file", "/", -1).alias("name"), "line", "is_rest", "is_message_listener", "is_async_method", F.array_join("listener_markers", ",").alias("listeners"))


@query(each_supplier("SELECT * FROM (VALUES ('create', 'save'), ('list', 'findAll')) t(caller, callee)"))
def derived_calls(spark, sf_dir):
    """Calls guessed from the text: of receivers whose type some source declares or implements."""
    edges = symbol_index.derived_file_edges(source.java_files(samples.projects(spark, sf_dir)))
    return edges.select("project", F.substring_index("src_key", ":", -1).alias("caller"), F.col("dst_name").alias("callee")).distinct()


@query(each_supplier("SELECT * FROM (VALUES ('GET_api_orders', 'GET /api/orders (OrderController.list)'), ('POST_api_orders', 'POST /api/orders (OrderController.create)')) t(slug, shown)"))
def endpoint_names(spark, sf_dir):
    e = reports.endpoint_ids(entry_points.rest_map(samples.projects(spark, sf_dir)))
    return e.select("project", "slug", names.shown_endpoint(*[F.col(c) for c in ("http_method", "path", "class_name", "method_name")]).alias("shown"))


@query(each_supplier(f"SELECT * FROM (VALUES ('{HOME}Jobs.java', 'com.example.Jobs'), ('{HOME}Kinds.java', 'p.A'), ('{HOME}OrderController.java', 'com.example.OrderController'), ('{HOME}OrderDao.java', 'com.example.OrderDao'), ('{HOME}OrderMapper.java', 'com.example.OrderMapper'), ('{HOME}OrderServiceImpl.java', 'com.example.OrderServiceImpl'), ('{HOME}Orders.java', 'com.example.Orders'), ('{HOME}OrdersRepository.java', 'com.example.OrdersRepository')) t(path, fqcn)"))
def file_type_names(spark, sf_dir):
    return structure.file_type_names(samples.projects(spark, sf_dir)).select("project", "path", "fqcn")


POINT_QUERIES = {
    "documentSymbol": {"path": "web/OrderController.java"}, "workspaceSymbol": {"query": "ordercon|list"}, "definition": {"path": "x.java", "line": 3, "character": 5}, "references": {"path": "x.java", "line": 3, "character": 5}, "hover": {"path": "x.java", "line": 3, "character": 5},
    "implementation": {"path": "x.java", "line": 3, "character": 5}, "incomingCalls": {"path": "web/OrderController.java", "line": 6, "character": 1}, "outgoingCalls": {"path": "web/OrderController.java", "line": 6, "character": 1}, "typeHierarchy": {"path": "web/OrderController.java", "line": 2, "character": 1},
}


RESULT_OF = {
    "documentSymbol": "concat_ws(':', name, kind, start_line)", "workspaceSymbol": "concat_ws(':', path, name, kind)", "definition": "sym_id", "references": "concat_ws(':', path, line, character, is_decl)", "hover": "contents", "implementation": "impl_key",
    "incomingCalls": "src_key", "outgoingCalls": "dst_key", "typeHierarchy": "concat_ws(':', side, other)",
}


@query("""SELECT operation, replace(result, '@', k || ':') AS result FROM (SELECT min(s_suppkey) AS k FROM supplier), (VALUES ('documentSymbol', 'OrderController:5:1'), ('documentSymbol', 'list():6:4'), ('documentSymbol', 'drop():6:7'),
  ('definition', '@A'), ('references', '@x.java:2:4:false'), ('references', '@web/OrderController.java:4:2:true'), ('hover', 'lists'), ('implementation', '@I'), ('outgoingCalls', '@B'), ('typeHierarchy', 'sub:@Sub'), ('typeHierarchy', 'super:@Base')) t(operation, result)""")
def point_queries(spark, sf_dir):
    """Operations at a place of the first supplier's files, over the index of all, and their results."""
    index = samples.symbol_indexes(spark, sf_dir)
    first = samples.suppliers(spark, sf_dir).agg(F.min(F.col("s").cast("long"))).first()[0]
    out = None
    for op, where in POINT_QUERIES.items():
        if op == "workspaceSymbol":  # by name, over all files: workspace_symbols is a query of its own below
            continue
        n = symbol_index.analyze(index, op, **where | {"path": f"{first}:{where['path']}"}).select(F.lit(op).alias("operation"), F.expr(RESULT_OF[op]).alias("result"))
        out = n if out is None else out.union(n)
    return out


@query("""SELECT c_custkey || '.java' AS path, c_name AS name FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_name), 'omer#00000001')""")
def workspace_symbols(spark, sf_dir):
    """Customers as classes of an index, searched by two needles without a limit."""
    c = table(spark, sf_dir, "customer")
    symbols = c.select(F.col("c_custkey").cast("string").alias("sym_id"), F.concat(F.col("c_custkey").cast("string"), F.lit(".java")).alias("path"), F.col("c_name").alias("name"), F.lit(5).alias("kind"), F.lit("").alias("container"), F.lit(1).alias("sel_line"), F.lit(0).alias("sel_char"))
    return symbol_index.workspace_symbols(symbols, ["7", "omer#00000001"], most=None).select("path", "name")


@query(each_supplier("SELECT * FROM (VALUES ('list', 5, 0), ('OrderController', 5, 1)) t(needle, method_line, way)", "s_suppkey || ':web/OrderController.java' AS path, q.*"))
def resolved_keywords(spark, sf_dir):
    symbols = samples.symbol_indexes(spark, sf_dir)["symbols"]
    found = [symbol_index.resolved_keyword(symbols, n).select("path", F.lit(n).alias("needle"), "method_line", "way") for n in ("list", "OrderController", "nothing")]
    return found[0].union(found[1]).union(found[2])


@query("""SELECT c_name AS project, count(o_orderkey) AS hits FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def saved_report(spark, sf_dir):
    """The JSON inside Markdown reports, one of each customer, read back."""
    told = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("hits")), "c_custkey", "left")
    payload = F.to_json(F.struct(F.col("c_name").alias("project"), F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits")))
    text = F.concat(F.lit("# Report\n\n## Raw JSON\n\n```json\n"), payload, F.lit("\n```\n"))
    return told.select(F.from_json(source.report_payload(text), "project string, hits array<long>").alias("p")).select("p.project", F.size("p.hits").cast("long").alias("hits"))


from codelake import graph_queries, source_queries  # noqa: E402, F401  register their queries
