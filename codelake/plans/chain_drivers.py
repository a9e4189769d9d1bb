"""From many anchors to call chains at once: who works on a table, and what an entry point sets off.

All anchors of a kind are one table, all their traces are one traversal, and reports are rows of text made by executors.
Anchors that lead nowhere come back as error rows with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import names
from codelake.functions import predicates as q
from codelake.operators import links, table_refs
from codelake.plans import call_graph, reports
from codelake.plans.trace_starts import nodes_at
from codelake.sources.store import written

ANCHOR = ["project", "table", "kind", "anchor_id", "file", "line", "detail"]
ERROR = ["project", "table", "kind", "file", "line", "reason"]
REPORT_CHAINS = 200


def capped_anchors(anchors: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(anchors, counts(project, table, kind, found, kept)): of literals and of mapper methods the first `most` of each table, in the order of their places; 0: all."""
    ranked = anchors.withColumn("_r", F.row_number().over(Window.partitionBy("project", "table", "kind").orderBy("file", "line", "detail", "anchor_id")))
    stays = ~F.col("kind").isin("jdbc_sql_literal", "mybatis_mapper_method") | (F.col("_r") <= most) if most else F.lit(True)
    counts = ranked.groupBy("project", "table", "kind").agg(F.count("*").alias("found"), F.count(F.when(stays, 1)).alias("kept"))
    return ranked.where(stays).drop("_r"), counts


def table_anchors(files: DataFrame, hits: DataFrame, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(anchors, errors): the places in the source that work on each table(project, table), physical names; all tables of the hits where none are given.

    Kinds: the service method that calls the table's repository most, the table's entity class, methods with SQL
    literals, and methods of mapper interfaces. A table without service and entity is an error row, and so is each line of
    mapper XML that leads to no method; the others still count.
    """
    placed = hits.withColumn("table", names.physical_table(F.col("table")))
    asked = placed.select("project", "table").distinct() if tables is None else tables.select("project", "table").distinct()
    asked = written(asked)
    placed = written(placed.join(asked, ["project", "table"], "left_semi"))
    row = lambda df, kind, source, file, line, id_line, extra, detail: df.select(
        "project", "table", F.lit(kind).alias("kind"), names.table_hit_id(F.col("table"), source, F.col(file), id_line, extra).alias("anchor_id"), F.col(file).alias("file"), F.col(line).alias("line"), detail.alias("detail"))
    blank = F.lit("")
    services = links.repository_calls(asked, files)
    method = F.concat_ws(".", "service_class", "method")
    entities = links.entity_files(asked, files, hits)
    literals = table_refs.first_per_method(placed).withColumn("at", F.coalesce("java_method_line", "line"))
    mapped, lost = links.mapper_anchors(placed, files)
    anchors = (
        row(services, "service_impl", F.lit("service_impl_heuristic"), "service_file", "method_line", F.lit(0), method, method)
        .union(row(entities, "entity", F.lit("entity_class_declaration"), "entity_file", "class_line", F.col("class_line"), blank, F.lit("(class declaration)")))
        .union(row(literals, "jdbc_sql_literal", F.lit("jdbc_sql_literal"), "file", "at", F.col("line"), blank, F.col("java_method")))
        .union(row(mapped, "mybatis_mapper_method", F.lit("mybatis_xml"), "java_file", "line", F.col("xml_line"), F.col("statement_id"), F.col("statement_id")))
    )
    anchors = written(anchors)  # every use below and outside would find it anew
    found = anchors.where("kind IN ('service_impl', 'entity')").select("project", "table").distinct()
    none = F.lit(None)
    errors = asked.join(found, ["project", "table"], "left_anti").select("project", "table", F.lit("table").alias("kind"), none.cast("string").alias("file"), none.cast("int").alias("line"), F.lit("no service of its repository and no entity").alias("reason"))
    return anchors, written(errors.union(lost.select("project", "table", F.lit("mybatis_mapper_method"), "xml_file", "xml_line", "reason")))


def table_callers(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 20, most_chains: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chains(project, table, kind, anchor_id, file, line, detail, seed, chain, stop_reason), errors): who calls what works on each table. One upward trace serves all anchors."""
    # the declaration of a class is far above its first method
    placed = nodes_at(anchors.where("kind <> 'entity'"), nodes).union(nodes_at(anchors.where("kind = 'entity'"), nodes, below=None))
    placed = written(placed)
    seeds = placed.select("key").distinct()
    chains = call_graph.trace_up(edges, nodes, seeds, max_depth, most_chains)
    lost = anchors.join(placed.select("anchor_id").distinct(), "anchor_id", "left_anti")
    return placed.withColumnRenamed("key", "seed").join(chains, "seed").select(*ANCHOR, "seed", "chain", "stop_reason"), lost.select("project", "table", "kind", "file", "line", F.lit("no method in the call index").alias("reason"))


def error_groups(errors: DataFrame) -> DataFrame:
    """(kind, reason, errors, tables): how often each reason came, and up to 12 of its tables."""
    return errors.groupBy("kind", "reason").agg(F.count("*").alias("errors"), F.slice(F.array_sort(F.collect_set("table")), 1, 12).alias("tables"))


def _fenced(payload: Column) -> Column:
    return F.concat(F.lit("## Raw JSON\n\n```json\n"), F.to_json(payload), F.lit("\n```\n"))


def _bullets(title: str, rows: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("(none)"), F.lit("\n\n"))


def anchor_reports(chains: DataFrame) -> DataFrame:
    """(slug, anchor_id, value): for each anchor of a table a Markdown report of its chains, with the anchor in its JSON; at most `REPORT_CHAINS` chains are drawn, the counts are of all."""
    ranked = chains.withColumn("nth", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.size("chain"), "chain", "stop_reason")))
    shown = F.when(F.col("nth") <= REPORT_CHAINS, F.struct("nth", call_graph.shown_chain(F.col("chain")).alias("drawn"), "chain", "stop_reason"))
    each = ranked.groupBy(*ANCHOR).agg(F.count("*").alias("chain_count"), F.array_sort(F.collect_list(shown)).alias("shown"), F.array_sort(F.collect_set("stop_reason")).alias("stop_reasons"))
    payload = F.struct(F.struct("table").alias("query"), F.struct("chain_count", "stop_reasons").alias("summary"), F.transform("shown", lambda c: F.struct(c["chain"].alias("chain"), c["stop_reason"].alias("stopReason"))).alias("chains"))
    anchored = reports.with_anchor(payload, "manifestAnchor", F.struct("anchor_id", "kind", "file", "line", "detail"))
    drawn = F.transform("shown", lambda c: F.concat(F.lit("## Chain "), c["nth"].cast("string"), F.lit(" ("), c["stop_reason"], F.lit(")\n\n```\n"), c["drawn"], F.lit("\n```\n\n")))
    head = F.concat(F.lit("# Callers of "), F.col("table"), F.lit(" from "), F.col("kind"), F.lit("\n\n"))
    slug = names.safe_name(F.col("table"), 80, "table")
    return each.select(slug.alias("slug"), "anchor_id", F.concat(head, _bullets("Summary", F.array(F.concat(F.lit("chains: "), F.col("chain_count").cast("string")))), F.array_join(drawn, ""), _fenced(anchored)).alias("value"))


def entry_callees(entries: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 16, max_nodes: int = 500, max_branches: int = 48) -> dict[str, DataFrame]:
    """entries(entry_id, kind, file, line) -> what each sets off: `nodes`, `edges` (both by seed), `rows` (one an entry, with its seed and counts), `errors`, and `scored` nodes by seed. One downward trace serves all entries."""
    entries = written(entries)
    placed = written(nodes_at(entries, nodes).withColumnRenamed("key", "seed"))
    found, called, stats = call_graph.trace_down_all(edges, placed.select(F.col("seed").alias("key")).distinct(), max_depth, max_nodes, max_branches)
    full = written(found.join(nodes, "key"))
    added = called.where("is_implementation").groupBy("seed").agg(F.count("*").alias("implementation_edges"))
    rows = placed.join(stats, "seed").join(added, "seed", "left").withColumn("implementation_edges", F.coalesce("implementation_edges", F.lit(0)))
    lost = entries.join(placed.select("entry_id").distinct(), "entry_id", "left_anti").withColumn("reason", F.lit("no method in the call index"))
    return {"nodes": full, "edges": called, "rows": rows, "errors": lost, "scored": call_graph.trace_scores(full, called, written(stats), nodes, edges)}


def entry_key_methods(traced: dict[str, DataFrame]) -> DataFrame:
    """(source, class, method, file, score): the methods of each entry that matter to the business."""
    best = traced["scored"].where("business_candidate").select("seed", "class", "method", "file", F.col("business_score").alias("score"))
    return traced["rows"].select(F.col("entry_id").alias("source"), "seed").join(best, "seed").drop("seed")


def controller_rows(traced: dict[str, DataFrame]) -> DataFrame:
    """(file, entries, nodes, edges): the entries of each controller file in order, and how much they set off together."""
    e = traced["rows"]
    return e.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "entry_id", "kind"))).alias("entries"), F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges"))


def entry_reports(traced: dict[str, DataFrame]) -> DataFrame:
    """(entry_id, value): a Markdown report for each entry: counts, sinks by kind, accessors by file, key methods and edges; its lists are bounded by the trace's limits and cut as reports.py says."""
    nodes, edges, scored = traced["nodes"], traced["edges"], traced["scored"]
    shown = F.concat_ws(".", "class", "method")
    sinks = nodes.groupBy("seed", q.sink_kind(F.col("class"), F.col("file"), F.col("method")).alias("kind")).agg(F.slice(F.array_sort(F.collect_set(shown)), 1, reports.REPORT_LEAVES).alias("m"))
    sinks = sinks.groupBy("seed").agg(F.array_sort(F.collect_list(F.concat(F.col("kind"), F.lit(": "), F.array_join("m", ", ")))).alias("sinks"))
    ends = nodes.join(edges.select("seed", F.col("src_key").alias("key")).distinct(), ["seed", "key"], "left_anti").where(q.is_accessor(F.col("method")))
    beans = ends.groupBy("seed", "file").agg(F.min("class").alias("class"), F.count("*").alias("n")).groupBy("seed").agg(F.slice(F.array_sort(F.collect_list(F.concat("file", F.lit(" "), "class", F.lit(": "), F.col("n").cast("string")))), 1, reports.REPORT_BEANS).alias("beans"))
    best = scored.where("business_candidate").groupBy("seed").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("business_score")).alias("o"), shown.alias("m"), F.col("business_score").alias("score")))), 1, reports.REPORT_KEY_METHODS).alias("best"))
    calls = edges.groupBy("seed").agg(F.slice(F.array_sort(F.collect_list(F.concat("src_key", F.lit(" -> "), "dst_key", F.when(F.col("is_implementation"), " (implementation)").otherwise("")))), 1, reports.REPORT_EDGES).alias("calls"))
    # the graph itself, in the order in which nodes were found, as saved_reports reads it
    node = F.struct("class", "method", "file", "line", *[F.col(c).alias(n) for c, n in (("is_rest", "isRest"), ("is_transactional", "isTransactional")) if c in nodes.columns])
    listed = nodes.groupBy("seed").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "key", node.alias("n")))), lambda x: F.struct(x["key"], x["n"]))).alias("nodes"))
    arrows = edges.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(F.col("src_key").alias("from"), F.col("dst_key").alias("to"), F.col("is_implementation").alias("syntheticImplementation")))).alias("edges"))
    ranked = scored.where("business_candidate").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct((-F.col("business_score")).alias("o"), "class", "method", "key", "file", "business_signals"))).alias("r"))
    named = ranked.select("seed", F.transform("r", lambda x: F.struct(x["key"].alias("nodeKey"), x["class"].alias("class"), x["method"].alias("method"), x["file"].alias("file"), (-x["o"]).alias("score"), x["business_signals"].alias("signals"))).alias("keyMethods"))
    each = traced["rows"]
    for part in (sinks, beans, best, calls, listed, arrows, named):
        each = each.join(part, "seed", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    ranked = F.coalesce(F.transform("best", lambda x: F.concat(x["m"], F.lit(" ("), x["score"].cast("string"), F.lit(")"))), F.array().cast("array<string>"))
    counts = F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("node_count", "edge_count", "implementation_edges", "stop_reason")])
    payload = reports.with_anchor(F.struct(F.struct("seed").alias("query"), F.struct("node_count", "edge_count", "implementation_edges", "stop_reason").alias("stats"), "nodes", "edges", F.coalesce("keyMethods", F.expr("CAST(array() AS array<struct<nodeKey: string, class: string, method: string, file: string, score: bigint, signals: array<string>>>)")).alias("keyMethods")), "restMapAnchor", F.struct("entry_id", "kind", "file", "line"))
    text = F.concat(F.lit("# Calls below "), F.col("seed"), F.lit("\n\n"), _bullets("Summary", counts), _bullets("Sinks", empty("sinks")), _bullets("Accessors", empty("beans")), _bullets("Key methods", ranked), _bullets("Edges", empty("calls")), _fenced(payload))
    return each.select("entry_id", text.alias("value"))
