import pytest
from pyspark.sql import functions as F

from codelake.functions import names, predicates as q
from codelake.operators import table_refs
from codelake.operators.structure import types_in
from codelake.operators.text_search import needles_of
from codelake.plans.symbol_index import one_entry, query_parts
from codelake.sources.files import as_files


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


@pytest.mark.parametrize(("path", "line", "score"), [
    ("a/OrderServiceImpl.java", "    public void saveOrder(Order o) {", 40), ("a/OrderService.java", "public class OrderService {", -2),
    ("a/OrderRepository.java", "interface OrderRepository", -2), ("a/X.java", "", 0), ("a/X.java", "@Test private int x;", 5),
])
def test_hit_score(spark, path, line, score):
    assert one(spark, q.hit_score(F.lit(path), F.lit(line))) == score


@pytest.mark.parametrize(("name", "physical"), [("MonitorData", "monitor_data"), ("app.ORDERS", "orders"), ("T_ORDER", "t_order"), ("db.s.monitor_data", "monitor_data"), ("", ""), ("MonitorDataURL", "monitor_data_url")])
def test_physical_table(spark, name, physical):
    assert one(spark, names.physical_table(F.lit(name))) == physical


def test_names_and_ids(spark):
    lit = F.lit
    assert one(spark, names.entity_class(lit("monitor__data"))) == "MonitorData"
    assert one(spark, names.table_hit_id(lit("monitor_data"), lit("jdbc_sql_literal"), lit("src/main/java/a/B.java"), lit(3))) == "ma-7efc042adf3067e7"
    rest = [lit(x) for x in ("get", "/api/orders", "com.example.OrderController", "list", "GET_api_orders", "src/main/java/com/example/OrderController.java")]
    assert one(spark, names.endpoint_id(*rest, lit(9))) == "re-7558ec51a3cdc6e7"
    assert one(spark, names.endpoint_slug(lit("get"), lit("/api/{id}/x"))) == "GET_api__id__x"
    assert one(spark, names.endpoint_slug(lit(""), lit("/"))) == "X_root"
    assert [one(spark, names.mapping_path(lit(b), lit(s))) for b, s in (("api/", "x"), ("", "/x"), ("/api", ""), ("", ""))] == ["/api/x", "/x", "/api", ""]
    assert [one(spark, names.entry_path(lit(b), lit(s))) for b, s in (("api", "x"), ("", "x"), ("", ""))] == ["/api/x", "/x", ""]
    assert one(spark, names.table_candidates(lit("AlertRecord"))) == ["alert_record"]
    assert one(spark, names.package_of(lit("a.b.C"))) == "a.b" and one(spark, names.package_of(lit("C"))) == ""
    assert one(spark, names.safe_name(lit(" a b/c "), 80, "table")) == "a_b_c"
    assert one(spark, names.uri_path(names.file_uri(lit("/a b")))) == "/a b"
    assert one(spark, names.shown_node(lit("a.B"), lit("f() : int"), lit("x/B.java"), lit(3))) == "B.f() (B.java:3)"


@pytest.mark.parametrize(("line", "name"), [("public int count() {", "count"), ("  List<Order> findAll();", "findAll"), ("return foo(1);", None), ("if (x) {", None), ("new Foo(1)", None), ("Order load(int id)", "load"), ("// void f()", None), ("@Get void f()", None)])
def test_declared_method(spark, line, name):
    assert one(spark, q.declared_method(F.lit(line))) == name


def test_markers_and_kinds(spark):
    assert one(spark, q.entry_kinds(F.lit('@KafkaListener(topics="t") @Async'))) == ["kafka_listener", "spring_async"]
    from codelake.functions.patterns import LISTENER_MARKERS

    assert one(spark, q.markers(F.lit("@KafkaListener @JmsListener"), LISTENER_MARKERS, 1)) == ["@KafkaListener"]


@pytest.mark.parametrize(("cls", "file", "kind"), [("OrderRepository", "a/persistence/OrderRepository.java", "other"), ("OrderStore", "a/repository/OrderStore.java", "database"), ("OrderDao", "x", "database"), ("KafkaSender", "x", "middleware"), ("X", "a/feign/X.java", "external_api")])
def test_sink_kind(spark, cls, file, kind):
    assert one(spark, q.sink_kind(F.lit(cls), F.lit(file), F.lit("run()"))) == kind


@pytest.mark.parametrize(("sql", "tables"), [
    ("SELECT count(*) FROM app.orders o JOIN customer c ON 1=1, region", ["orders", "customer", "region"]),
    ("WITH t AS (SELECT * FROM stale) DELETE FROM orders WHERE id IN (SELECT id FROM t)", ["stale", "orders"]),
    ("WITH a AS (SELECT 1), b AS (SELECT (2)) SELECT * FROM a, b, c", ["c"]), ("hello from", []), ("no sql", []), ("insert into s.t values (1)", ["t"]), ("select 1 from (select 2 from x) q, y", ["x", "y"]), ("from dual", []), ("select ', z' from a", ["a"]),
])
def test_sql_tables(spark, sql, tables):
    assert one(spark, table_refs.sql_tables(F.lit(sql))) == tables


def test_sql_nested_deeply(spark):
    deep = "(select 1, " * 20 + "x" + ")" * 20
    assert one(spark, table_refs.sql_tables(F.lit(f"select * from a, {deep} q, b where f(1, (2)) in (select y from c)"))) == ["a", "c", "b"]
    assert one(spark, table_refs.sql_tables(F.lit("select * from a where x in (1, 2"))) == ["a"]


@pytest.mark.parametrize(("literal", "plain"), [(r"a\nb", "a\nb"), (r"\u0041\x42\103\7", "ABC\x07"), (r"\\u0041", r"\u0041"), (r"\"q\"", '"q"'), ("no escapes", "no escapes"), ("ends\\", "ends\\"), (r"\u00e9\q", "éq")])
def test_escapes(spark, literal, plain):
    assert one(spark, table_refs.unescaped(F.lit(literal))) == plain


def test_tables_of_a_long_literal(spark):
    """No pattern goes deeper with every character of a literal, nor with every bracket."""
    sql = "select * from a, " + "(x, (y)), " * 3000 + "b where t = " + r"\'z\' and " * 3000 + "1 = 1"
    files = spark.createDataFrame([("p", "A.java", f'class A {{\n  void f() {{\n    q("{sql}");\n  }}\n}}\n')], "project string, path string, text string")
    assert [tuple(r) for r in table_refs.table_hits(as_files(files)).select("table", "line", "java_method").collect()] == [("a", 3, "f"), ("b", 3, "f")]


def test_stripped(spark):
    texts = ["", " a b ", "\t\x0b\f\r\na\n", "\u00a0 a \u00a0", "a \u2028", "a \u0085\u0085", "a \x1c", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(q.stripped(F.col("t")), F.regexp_replace("t", r"^\s+|\s+$", "")).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_types_in():
    assert [t[0] for t in types_in("package p; /* class X { */ @interface Ann { } public class A extends B { class In {} } record R(int x) {} enum E {A}")] == ["A", "R", "E"]
    assert types_in('class A { String s = "class B {"; }\n@X(a={1})\ninterface C {\n}') == [("A", 5, "class", 1), ("C", 11, "interface", 3)]
    assert types_in(None) == [] and types_in("class") == []


def test_query_parts():
    assert query_parts("Foo.bar") == ("class_method", "Foo", "bar")
    assert query_parts("SCHEMA.TABLE") == ("keyword", "SCHEMA.TABLE", None)
    assert query_parts(r"schema\.tab") == ("keyword", "schema.tab", None)
    assert query_parts("a.b.C.run") == ("class_method", "a.b.C", "run")
    assert needles_of("a|b｜a") == ["a", "b"]
    with pytest.raises(ValueError):
        one_entry()
    with pytest.raises(ValueError):
        one_entry(query="x", file="y", line=1)


def test_enclosing_methods_look_down_first_and_stop_at_their_distances(spark):
    from codelake.operators.java_context import enclosing_methods

    plain = {n: f"x = {n};" for n in range(1, 471)}
    texts = plain | {60: "  public void a() {", 90: "\tprotected List<Map<String, int[]>> b (", 140: "  // public void c() {", 300: "@Override public int d() {", 301: "static  String e(", 302: "if (x) {", 303: "return f(1);"}
    declared = {60: "a", 90: "b", 301: "e"}
    lines = spark.createDataFrame([("p", path, n, t) for path in ("A.java", "B.java") for n, t in texts.items()] + [("p", "C.java", 1, None)], "project string, path string, line_no int, text string")

    def want(n):
        below = [m for m in declared if n <= m <= n + 47]
        above = [m for m in declared if n - 159 <= m <= n]
        m = min(below) if below else max(above) if above else n
        return declared.get(m, f"_line{n}"), m

    for asked in (None, F.col("text").rlike("x = |return"), F.col("line_no") > 0):
        found = enclosing_methods(lines, asked)
        got = {(r.path, r.line_no): (r.java_method, r.java_method_line) for r in found.collect()}
        kept = [n for n, t in texts.items() if asked is None or "line_no" in str(asked) or "x = " in t or "return" in t]
        assert found.columns == [*lines.columns, "java_method", "java_method_line"]
        assert {k: v for k, v in got.items() if k[0] != "C.java"} == {(path, n): want(n) for path in ("A.java", "B.java") for n in kept}
        assert got.get(("C.java", 1), ("_line1", 1)) == ("_line1", 1)
