"""What saved reports of downward traces say about the business: key methods of many reports, merged.

A report is JSON, or Markdown that ends in its JSON. Its payload is read as VARIANT, so reports of any age and shape are
one table: `keyMethods` are taken as they are; a report that has none, but `nodes` and `edges`, is scored anew, all such
reports at once, each as a graph of its own. What is no report, or no JSON, gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators import java_context
from codelake.plans import call_graph, reports
from codelake.sources import files as source
from codelake.sources.store import written

NODE = {"class": "class", "method": "method", "file": "file", "line": "line", "is_rest": "isRest", "is_transactional": "isTransactional"}


def payloads(spark: SparkSession, folder: str, globs: str = "*.{json,md,txt}") -> DataFrame:
    """(source, payload): the JSON of every saved report of a downward trace below a folder, by its path there."""
    base = folder.rstrip("/").rpartition("://")[2] + "/"
    return _of_traces(reports.read_reports(spark, folder, globs).select(F.substring_index("path", base, -1).alias("source"), "payload"))


def table_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The same of a table of reports, as `reports.write_reports` keeps it: a file holds many reports, so that neither writing, listing nor opening goes report by report."""
    return _of_traces(reports.read_report_table(spark, folder).withColumnRenamed("entry_id", "source"))


def _of_traces(told: DataFrame) -> DataFrame:
    return told.where(F.arrays_overlap(F.json_object_keys("payload"), F.array(F.lit("keyMethods"), F.lit("nodes"))))


def _field(v, name: str, kind: str = "string"):
    return F.try_variant_get(v, f"$.{name}", kind)


def told_key_methods(told: DataFrame) -> DataFrame:
    """(source, class, method, file, score) of the key methods that reports name themselves."""
    each = told.where(F.array_contains(F.json_object_keys("payload"), "keyMethods")).select("source", F.explode(F.try_variant_get(F.try_parse_json("payload"), "$.keyMethods", "array<variant>")).alias("k"))
    named = each.where(F.startswith(F.schema_of_variant("k"), F.lit("OBJECT")))
    text = [F.coalesce(_field(F.col("k"), c), F.lit("")).alias(c) for c in ("class", "method", "file")]
    return named.select("source", *text, F.coalesce(_field(F.col("k"), "score", "long"), F.lit(0)).alias("score"))


def graphs(told: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes(source, key, ordinal, class, ...), edges(source, src_key, dst_key), roots(source, key)) of reports that name no key methods.

    The root is the first node of the document that nobody calls; VARIANT sorts names, so their order is read from the text.
    """
    bare = told.where(~F.array_contains(F.json_object_keys("payload"), "keyMethods")).withColumn("v", F.try_parse_json("payload"))
    keys = F.posexplode(F.json_object_keys(F.get_json_object("payload", "$.nodes"))).alias("ordinal", "key")
    listed = bare.select("source", F.try_variant_get("v", "$.nodes", "map<string, variant>").alias("nodes"), keys).withColumn("n", F.element_at("nodes", F.col("key")))
    kinds = {"is_rest": "boolean", "is_transactional": "boolean", "line": "int"}
    fields = [_field(F.col("n"), name, kinds.get(c, "string")).alias(c) for c, name in NODE.items()]
    nodes = written(listed.where(F.startswith(F.schema_of_variant("n"), F.lit("OBJECT"))).select("source", "key", "ordinal", *fields))
    called = bare.select("source", F.explode(F.try_variant_get("v", "$.edges", "array<variant>")).alias("e"))
    edges = written(called.select("source", _field(F.col("e"), "from").alias("src_key"), _field(F.col("e"), "to").alias("dst_key")).where("dst_key IS NOT NULL"))
    free = nodes.join(edges.select("source", F.col("dst_key").alias("key")).distinct(), ["source", "key"], "left_anti")
    return nodes, edges, free.groupBy("source").agg(F.min_by("key", "ordinal").alias("key"))


def scored_key_methods(told: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(source, class, method, file, score) of reports that name no key methods; with the sources at hand, transactions are read from them."""
    nodes, edges, roots = graphs(told)
    if files is not None:
        flags = java_context.node_flags(source.lines(source.java_files(files))).groupBy(F.col("path").alias("file"), F.col("line_no").alias("line")).agg(F.max("is_transactional").alias("marked"))
        nodes = nodes.join(flags, ["file", "line"], "left").withColumn("is_transactional", F.coalesce("is_transactional", "marked")).drop("marked")
    full = nodes.na.fill("", ["class", "method", "file"])
    scored = call_graph.business_scores(full, edges, roots, by="source")
    return scored.where("business_candidate").select("source", "class", "method", "file", F.col("business_score").alias("score"))


def key_methods(told: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """told(source, payload) -> (class, method, file, score, sources): the best score of each method over all reports, and the reports that gave it."""
    told = written(told.where(F.try_parse_json("payload").isNotNull()))
    return call_graph.merged_key_methods(told_key_methods(told).union(scored_key_methods(told, files)))
