"""Results as files: JSON, Markdown, diagrams. Rows are shaped by Spark; what goes into one document is aggregated and capped first."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.functions import names
from codelake.plans import call_graph
from codelake.sources.files import report_payload
from codelake.sources.store import dealt

DIAGRAM_ENDPOINTS = 48
REPORT_EDGES, REPORT_KEY_METHODS, REPORT_BEANS, REPORT_LEAVES = 200, 28, 60, 40


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row, without fields that are null."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "true"}).alias("value"))


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines under a folder; with `by`, a folder for each value."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "true")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_reports(spark: SparkSession, folder: str, globs: str = "*.{json,md}") -> DataFrame:
    """(path, payload) of the saved reports below a folder, JSON and Markdown, each file once."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", globs).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), report_payload(F.col("value")).alias("payload")).where("payload IS NOT NULL").dropDuplicates(["path"])


def write_reports(rows: DataFrame, folder: str) -> None:
    """Reports(entry_id, value) as a table, many a file."""
    rows.select("entry_id", "value").write.parquet(folder)


def read_report_table(spark: SparkSession, folder: str) -> DataFrame:
    """(entry_id, payload) of the reports that `write_reports` keeps."""
    kept = dealt(spark.read.schema("entry_id string, value string").parquet(folder), "entry_id")
    return kept.select("entry_id", report_payload(F.col("value")).alias("payload")).where("payload IS NOT NULL")


def hit_text(hits: DataFrame) -> DataFrame:
    """`file:line:text`, long lines cut at 200 characters."""
    return hits.select(F.concat_ws(":", "file", F.col("line").cast("string"), F.substring(F.rtrim("text"), 1, 200)).alias("value"))


def endpoint_diagram(endpoints: DataFrame) -> DataFrame:
    """A Mermaid diagram of the first endpoints: one row of text."""
    few = endpoints.orderBy("file", "line", "http_method").limit(DIAGRAM_ENDPOINTS)
    label = F.replace(F.concat_ws(" ", "http_method", "path"), F.lit('"'), F.lit("'"))
    edge = F.concat(F.lit("  "), F.regexp_replace("simple_class_name", r"\W", "_"), F.lit(' --> |"'), label, F.lit('"| '), F.regexp_replace("method_name", r"\W", "_"))
    return few.agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.array_sort(F.collect_list(edge)), "\n")).alias("value"))


def endpoint_ids(endpoints: DataFrame) -> DataFrame:
    """endpoints with a slug, its occurrence among equal slugs, and an id that stays the same from run to run."""
    slug = names.endpoint_slug(F.col("http_method"), F.col("path"))
    nth = F.row_number().over(Window.partitionBy("project", "slug").orderBy("file", "line", "class_name", "method_name"))
    out = endpoints.withColumn("slug", slug).withColumn("nth", nth).withColumn("slug", F.when(F.col("nth") > 1, F.concat_ws("_", "slug", F.col("nth").cast("string"))).otherwise(F.col("slug")))
    return out.withColumn("endpoint_id", names.endpoint_id(*[F.col(c) for c in ("http_method", "path", "class_name", "method_name", "slug", "file", "line")])).drop("nth")


def anchor_ids(hits: DataFrame) -> DataFrame:
    extra = F.coalesce("java_method", F.lit("")) if "java_method" in hits.columns else F.lit("")
    return hits.withColumn("anchor_id", names.table_hit_id(names.physical_table(F.col("table")), F.col("source"), F.col("file"), F.col("line"), extra))


def with_anchor(payload: Column, name: str, anchor: Column) -> Column:
    """A report's payload (a struct with a struct `query`) with an anchor added to its query."""
    return payload.withField("query", payload["query"].withField(name, anchor))


def chain_summary(chains: DataFrame) -> DataFrame:
    """chain_count, the stop reasons and how often each came, and the first 12 tops."""
    top = F.element_at("chain", -1)
    counts = chains.groupBy("stop_reason").agg(F.count("*").alias("n"))
    reasons = counts.agg(F.sum("n").alias("chain_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stop_reason", "n")))).alias("stop_reasons"))
    tops = chains.select(top.alias("top")).distinct().orderBy("top").limit(12).agg(F.array_sort(F.collect_list("top")).alias("tops"))
    return reasons.join(tops)


def down_summary(stats: dict, implementation_edges: int = 0, anchor: str | None = None) -> dict:
    """The short summary of a downward trace: how much it found, how many edges lead to implementations, why it stopped."""
    out = {"nodeCount": stats["node_count"], "edgeCount": stats["edge_count"], "implementationFallbackEdges": implementation_edges, "stopReason": stats["stop_reason"]}
    return out | ({"restHitId": anchor} if anchor else {})


def _section(title: str, rows: Iterable[str]) -> str:
    return "\n".join([f"## {title}", "", *(rows or ["(none)"]), ""])


def chain_report(chains: DataFrame, query: dict, most: int = 200) -> str:
    """A Markdown report of an upward trace, ending in its rows as JSON. At most `most` chains are shown; the summary counts all. Chains with the same entry at the top are named together; with a column top_entry its mapping, comment or markers are told."""
    summary = json.loads(as_json(chain_summary(chains)).first()["value"])
    few = chains.orderBy("seed", F.size("chain"), "chain").limit(most)
    # at most `most` rows, so one window over all of them is small
    shown = few.withColumn("chain_no", F.row_number().over(Window.orderBy("seed", F.size("chain"), "chain")).cast("long")).withColumn("drawn", call_graph.shown_chain(F.col("chain")))
    has_entry = "top_entry" in chains.columns
    named = F.coalesce(F.col("top_entry.rest_summary"), F.element_at("chain", -1)) if has_entry else F.element_at("chain", -1)
    groups = call_graph.entry_groups(shown, [named]).collect()
    rows = shown.withColumn("entry_json", F.to_json("top_entry") if has_entry else F.lit(None).cast("string")).orderBy("chain_no").collect()
    parts = [f"# Callers of {query.get('query', '')}", "", _section("Summary", [f"- {k}: {v}" for k, v in summary.items()])]
    parts.append(_section("Entries", [f"- {g['k0']}: chains {', '.join(map(str, g['chains']))}" for g in groups]))
    parts += [_section(f"Chain {r['chain_no']} ({r['stop_reason']})", [*([f"Entry: `{r['entry_json']}`", ""] if r["entry_json"] else []), "```", r["drawn"], "```"]) for r in rows]
    told = [{"seed": r["seed"], "chain": r["chain"], "stopReason": r["stop_reason"]} | ({"topEntry": json.loads(r["entry_json"])} if r["entry_json"] else {}) for r in rows]
    payload = {"query": query, "summary": summary, "chains": told}
    return "\n".join([*parts, "## Raw JSON", "", "```json", json.dumps(payload, ensure_ascii=False, indent=1), "```", ""])


def subgraph_report(seed: str, nodes: DataFrame, edges: DataFrame, stats: dict, spark) -> str:
    """A Markdown report of a downward trace: sinks by kind, the tree, folded accessors, key methods, edges; each list capped as noted."""
    scored = call_graph.business_scores(nodes, edges, spark.createDataFrame([(seed,)], "key string"))
    buckets = call_graph.sink_buckets(nodes, edges).orderBy("kind", F.desc("is_leaf")).collect()
    tree = call_graph.shown_tree(edges, seed, spark, stats["max_depth"], REPORT_EDGES).collect()
    folded = call_graph.folded_accessors(nodes, edges, seed)[2].orderBy("key", "bean", "kind").limit(REPORT_BEANS).collect()
    beans = call_graph.accessor_leaves(nodes, edges).orderBy("file").limit(REPORT_LEAVES).collect()
    added = edges.where("is_implementation").count() if "is_implementation" in edges.columns else 0
    best = call_graph.key_methods(scored).limit(REPORT_KEY_METHODS).collect()
    few = edges.orderBy("src_key", "dst_key").limit(REPORT_EDGES).collect()
    parts = [
        f"# Calls below {seed}", "",
        _section("Summary", [f"- {k}: {v}" for k, v in stats.items()]),
        _section("Sinks", [f"- {r['kind']}{' (leaf)' if r['is_leaf'] else ''}: {', '.join(r['methods'][:REPORT_LEAVES])}" for r in buckets]),
        _section("Tree", ["```", *[r["line"] for r in tree], "```"]),
        _section("Accessors", [f"- {r['key']}: {r['bean']} {r['kind']} {', '.join(r['accessors'])}" for r in folded]),
        _section("Accessors by file", [f"- {r['file']} {r['class']}: {r['accessors']}" for r in beans]),
        _section("Key methods", [f"- {r['class']}.{r['method']} ({r['business_score']}): {', '.join(r['business_signals'])}" for r in best]),
        _section("Edges", [f"- {r['src_key']} -> {r['dst_key']}{' (implementation)' if r.asDict().get('is_implementation') else ''}" for r in few]),
    ]
    payload = {"query": {"seed": seed}, "stats": stats, "summary": down_summary(stats, added), "edges": [r.asDict() for r in few], "keyMethods": [r["key"] for r in best]}
    return "\n".join([*parts, "## Raw JSON", "", "```json", json.dumps(payload, ensure_ascii=False, indent=1), "```", ""])


def business_report(merged: DataFrame, most: int = 200) -> str:
    rows = merged.orderBy(F.desc("score"), "class").limit(most).collect()
    return "\n".join(["# Key methods", "", "| score | class | method | file | sources |", "| --- | --- | --- | --- | --- |", *[f"| {r['score']} | {r['class']} | {r['method']} | {r['file']} | {', '.join(r['sources'])} |" for r in rows], ""])
