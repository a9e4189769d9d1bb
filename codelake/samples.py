"""A small project in Java, XML and Gradle, on which queries over source code are shown and tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.registry import table
from codelake.sources.files import as_files
from codelake.sources.store import dealt, large

CONTROLLER = """package com.example;

@RestController
@RequestMapping("/api")
public class OrderController {
  private OrderService svc;
  /** List orders. */
  @GetMapping("/orders")
  public List<Order> list() {
    return svc.findAll();
  }
  @PostMapping(path = "/orders", produces = "application/json")
  public void create(Order o) {
    svc.save(o);
  }
}
"""
DAO = """package com.example;
public class OrderDao {
  public int count() {
    return q("SELECT count(*) FROM app.orders o JOIN customer c ON 1=1, region");
  }
  public void purge() {
    q("WITH t AS (SELECT * FROM stale) DELETE FROM orders WHERE id IN (SELECT id FROM t)");
  }
}
"""
MAPPER_XML = """<mapper namespace="com.example.OrderMapper">
  <select id="findAll" resultType="Order">
    select * from orders
  </select>
  <resultMap table="customer"/>
</mapper>
"""
MAPPER = """package com.example;
public interface OrderMapper {
  // findAll( in a comment does not count
  List<Order> findAll();
}
"""
TYPES = "package p; /* class X { */ @interface Ann { } public class A extends B { class In {} } record R(int x) {} enum E {A}\n"
JOBS = """package com.example;
public class Jobs {
  @KafkaListener(topics="t") @Async
  public void onMessage(String m) { }
  public static void main(String[] args) { }
  @Scheduled(fixedRate = 5)
  public void tick() { }
}
"""
ENTITY = """package com.example;
@Entity
@Table(name = "app.orders")
public class Orders {
}
"""
REPOSITORY = """package com.example;
public interface OrdersRepository {
}
"""
SERVICE = """package com.example;
public class OrderServiceImpl implements OrderService {
  private final OrdersRepository repo;
  public List<Orders> findAll() {
    return repo.findAll();
  }
  @Transactional
  public void save(Orders o) {
    repo.save(o);
  }
}
"""
POM = """<project xmlns="http://maven.apache.org/POM/4.0.0">
  <artifactId>shop</artifactId><packaging>pom</packaging>
  <modules><module>core</module><module>web/</module></modules>
</project>
"""
CORE_POM = "<project><artifactId>shop-core</artifactId><packaging>jar</packaging></project>\n"
GRADLE = "include(':api', \":web:admin\")\ninclude 'tools'\n"
HOME = "src/main/java/com/example/"
PROJECT = [
    (f"{HOME}OrderController.java", CONTROLLER), (f"{HOME}OrderDao.java", DAO), (f"{HOME}OrderMapper.java", MAPPER), (f"{HOME}Kinds.java", TYPES), (f"{HOME}Jobs.java", JOBS),
    (f"{HOME}Orders.java", ENTITY), (f"{HOME}OrdersRepository.java", REPOSITORY), (f"{HOME}OrderServiceImpl.java", SERVICE),
    ("src/main/resources/OrderMapper.xml", MAPPER_XML), ("pom.xml", POM), ("core/pom.xml", CORE_POM), ("target/generated/Skip.java", CONTROLLER), ("tools/Elsewhere.java", JOBS),
]


def project(spark: SparkSession) -> DataFrame:
    return as_files(spark.createDataFrame([("shop", *f) for f in PROJECT] + [("other", "settings.gradle", GRADLE)], "project string, path string, text string"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s"))


def each(spark: SparkSession, sf_dir: str, rows: list[tuple], names: list[str]) -> DataFrame:
    """(s, ...): the rows for every supplier."""
    literal = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return large(dealt(suppliers(spark, sf_dir), "s").select("s", F.explode(literal).alias("x")).select("s", "x.*"))  # texts are many times larger than keys, of which one task would read all


def projects(spark: SparkSession, sf_dir: str, own_paths: bool = False) -> DataFrame:
    """The sample's files as a project of every supplier, `shop` and `other` with its key; with `own_paths`, paths begin with the project."""
    files = each(spark, sf_dir, [("shop", *f) for f in PROJECT] + [("other", "settings.gradle", GRADLE)], ["kind", "path", "text"])
    project = F.concat("kind", "s")
    return as_files(files.select(project.alias("project"), F.concat_ws("/", project, "path").alias("path") if own_paths else "path", "text"))


def copies(spark: SparkSession, sf_dir: str, df: DataFrame, keys: list[str], files: list[str] = []) -> DataFrame:
    """A small table for every supplier: keys begin with its key and a colon, files with its project; `s` tells them apart."""
    each_ = F.broadcast(df).crossJoin(dealt(suppliers(spark, sf_dir), "s"))  # df is a handful of rows of the sample
    changed = {c: F.concat("s", F.lit(":"), c) for c in keys} | {c: F.concat(F.lit("shop"), "s", F.lit("/"), c) for c in files}
    return large(each_.withColumns(changed))


def call_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = call_graph(spark)
    return copies(spark, sf_dir, nodes, ["key"]), copies(spark, sf_dir, edges, ["src_key", "dst_key"])


def project_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = project_graph(spark)
    return copies(spark, sf_dir, nodes, ["key"], ["file"]), copies(spark, sf_dir, edges, ["src_key", "dst_key"])


def symbol_indexes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The index of every supplier in one: its paths and keys begin with the supplier's."""
    keys = {"symbols": ["sym_id", "path"], "refs": ["path", "target_key"], "hover": ["key"], "call_nodes": ["key"], "call_edges": ["src_key", "dst_key"], "impl_edges": ["decl_key", "impl_key"], "type_edges": ["sub_key", "super_key"]}
    return {name: copies(spark, sf_dir, df, keys[name]).drop("s") for name, df in symbol_index(spark).items()}


def call_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a controller A calls a service B, B a store C and a helper D, D calls B again."""
    nodes = spark.createDataFrame(
        [("A", "OrderController", "list()", "web/OrderController.java", True, False), ("B", "OrderService", "find()", "a/service/OrderService.java", False, False), ("C", "OrderStore", "load()", "a/repository/OrderStore.java", False, False), ("D", "Helper", "go()", "a/Helper.java", False, False)],
        "key string, class string, method string, file string, is_rest boolean, is_transactional boolean",
    )
    edges = spark.createDataFrame([("A", "B", "find"), ("B", "C", "load"), ("B", "D", "go"), ("D", "B", "find")], "src_key string, dst_key string, dst_name string")
    return nodes, edges


def symbol_index(spark: SparkSession) -> dict[str, DataFrame]:
    """A small index as an indexer would write it; positions count from 0."""
    nodes, edges = call_graph(spark)
    symbols = spark.createDataFrame(
        [("A", "web/OrderController.java", "list()", 6, "OrderController", 4, 2, 4, 0, 6, 1), ("A2", "web/OrderController.java", "drop()", 6, "OrderController", 7, 2, 7, 0, 8, 1), ("K", "web/OrderController.java", "OrderController", 5, "", 1, 0, 1, 0, 9, 1)],
        "sym_id string, path string, name string, kind int, container string, sel_line int, sel_char int, start_line int, start_char int, end_line int, end_char int",
    )
    return {
        "symbols": symbols, "refs": spark.createDataFrame([("x.java", 2, 4, "A", False), ("web/OrderController.java", 4, 2, "A", True)], "path string, line int, character int, target_key string, is_decl boolean"),
        "hover": spark.createDataFrame([("A", "lists")], "key string, contents string"), "call_nodes": nodes, "call_edges": edges, "impl_edges": spark.createDataFrame([("A", "I")], "decl_key string, impl_key string"),
        "type_edges": spark.createDataFrame([("K", "Base"), ("Sub", "K")], "sub_key string, super_key string"),
    }


def project_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the calls in the sample project, at the lines where its methods are declared."""
    rows = [
        ("ctl.list", "com.example.OrderController", "list()", "OrderController", 9, True, []), ("ctl.create", "com.example.OrderController", "create(Order)", "OrderController", 13, True, []),
        ("dao.count", "com.example.OrderDao", "count()", "OrderDao", 3, False, []), ("dao.purge", "com.example.OrderDao", "purge()", "OrderDao", 6, False, []),
        ("map.findAll", "com.example.OrderMapper", "findAll()", "OrderMapper", 4, False, []), ("svc.findAll", "com.example.OrderServiceImpl", "findAll()", "OrderServiceImpl", 4, False, []),
        ("svc.save", "com.example.OrderServiceImpl", "save(Orders)", "OrderServiceImpl", 8, False, []), ("job.onMessage", "com.example.Jobs", "onMessage(String)", "Jobs", 4, False, ["@KafkaListener"]),
        ("job.tick", "com.example.Jobs", "tick()", "Jobs", 7, False, []),
    ]
    nodes = spark.createDataFrame(
        [(k, c, m, f"{HOME}{f}.java", n, rest, bool(marks), False, marks) for k, c, m, f, n, rest, marks in rows],
        "key string, class string, method string, file string, line int, is_rest boolean, is_message_listener boolean, is_transactional boolean, listener_markers array<string>",
    )
    calls = [("ctl.list", "svc.findAll"), ("ctl.create", "svc.save"), ("svc.findAll", "map.findAll"), ("svc.save", "dao.count"), ("job.onMessage", "dao.purge"), ("job.tick", "svc.save")]
    return nodes, spark.createDataFrame([(a, b, b.split(".")[1]) for a, b in calls], "src_key string, dst_key string, dst_name string")
