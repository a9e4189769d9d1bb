"""Command line: python -m codelake.cli COMMAND PATH [options]. Prints JSON lines; errors end with code 2."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codelake.operators import entry_points, structure, table_refs, text_search
from codelake.plans import call_graph, project_design, reports, symbol_index, trace_starts
from codelake.sources import files as source

INDEX = ("symbols", "refs", "hover", "call_nodes", "call_edges", "impl_edges", "type_edges")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codelake")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("java-grep", "entrypoints", "rest-map", "db-tables", "scan", "symbols", "bundle", "analyze", "callchain-up", "callchain-down"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--index", help="folder with the index tables as Parquet")
        c.add_argument("-q", "--query", default="")
        c.add_argument("--max-hits", type=int, default=200)
        c.add_argument("--max-files", type=int)
        c.add_argument("--format", choices=("json", "text", "markdown"), default="json")
        c.add_argument("--class", dest="class_name")
        c.add_argument("--method")
        c.add_argument("--file", default="")
        c.add_argument("--line", type=int, default=0)
        c.add_argument("--char", type=int, default=0)
        c.add_argument("--operation", choices=symbol_index.OPERATIONS, default="documentSymbol")
        c.add_argument("--max-depth", type=int)
        c.add_argument("--max-nodes", type=int, default=500)
        c.add_argument("--max-branches", type=int)
        c.add_argument("--tables-file")
        c.add_argument("--tables", default="")
        c.add_argument("--out", default="design")
        c.add_argument("--skip-interfaces", action="store_true", help="starts from text hits: not in files of interfaces")
        c.add_argument("--skip-rest", action="store_true", help="starts from text hits: not at web mappings")
        c.add_argument("--max-entries", type=int, help="the most starts from text hits")
        c.add_argument("--fold-accessors", action="store_true", help="downward: accessors that call nothing are listed with their callers")
        c.add_argument("--keywords", nargs="*", default=[], help="bundle: keywords whose callers are traced")
        c.add_argument("--steps", nargs="*", choices=project_design.Options.steps, help="bundle: only these steps; others are read from an earlier run where they are needed")
        c.add_argument("--skip", nargs="*", choices=project_design.Options.steps, default=[], help="bundle: all steps but these")
        c.add_argument("--depth-down", type=int, default=16, help="bundle: levels below an entry")
        c.add_argument("--max-endpoints", type=int, default=0, help="bundle: the most entries that are traced (0: all)")
        c.add_argument("--max-chains", type=int, default=1_000_000, help="upward: more open chains than this are an error; a bundle then counts them")
        c.add_argument("--max-anchors", type=int, default=24, help="bundle: literals and mapper methods of a table, each (0: all)")
        c.add_argument("--strict-tables", action="store_true", help="bundle: no list of tables that only the sources name")
    return top


def _index(spark: SparkSession, folder: str | None) -> dict:
    if not folder:
        raise ValueError("this command needs --index, a folder with the tables " + ", ".join(INDEX))
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in INDEX}


def _seeds(index: dict, a: argparse.Namespace, files):
    """(key) of what a trace starts from: a place, a class and a method, or keywords."""
    mode, left, right = symbol_index.one_entry(a.query or None, a.class_name, a.method, a.file or None, a.line or None)
    nodes = index["call_nodes"]
    if mode == "file_line":
        return trace_starts.nodes_at(nodes.sparkSession.createDataFrame([(left, right)], "file string, line int"), nodes, above=None).select("key")
    if mode == "class_method":
        return nodes.where((trace_starts.simple_class() == left.rsplit(".", 1)[-1]) & (trace_starts.bare_method() == right)).select("key")
    return trace_starts.keyword_starts(nodes, left, files, a.skip_interfaces, a.skip_rest, a.max_entries).select("key")


def _output(spark: SparkSession, a: argparse.Namespace):
    """A DataFrame of rows to print, or a text."""
    if a.command in ("analyze", "callchain-up", "callchain-down"):
        index = _index(spark, a.index)
        if a.command == "analyze":
            return symbol_index.analyze(index, a.operation, a.file, a.line, a.char, a.query)
        edges = call_graph.with_implementations(index["call_edges"], index["impl_edges"])
        files = source.read_tree(spark, [source.project_root(a.path)])
        seeds = _seeds(index, a, files)
        if a.command == "callchain-up":
            chains = call_graph.trace_up(edges, index["call_nodes"], seeds, a.max_depth if a.max_depth is not None else 20, a.max_chains)
            chains = trace_starts.with_top_entries(chains, index["call_nodes"], source.lines(source.java_files(files)))
            return reports.chain_report(chains, {"query": a.query or f"{a.class_name}.{a.method}"}) if a.format == "markdown" else chains
        starts = [r["key"] for r in seeds.limit(2).collect()]
        if len(starts) != 1:
            raise ValueError("a downward trace needs exactly one start; found " + ("several" if starts else "none"))
        nodes, found, stats = call_graph.trace_down(edges, starts[0], spark, a.max_depth if a.max_depth is not None else 8, a.max_nodes, a.max_branches if a.max_branches is not None else 32)
        full = nodes.join(index["call_nodes"], "key")
        if a.fold_accessors:
            full, found, folded = call_graph.folded_accessors(full, found, starts[0])
            if a.format != "markdown":
                return found.select("src_key", "dst_key", "is_implementation", F.lit(None).cast("string").alias("bean"), F.lit(None).cast("array<string>").alias("accessors")).union(folded.select("key", F.lit(None).cast("string"), F.lit(None).cast("boolean"), "bean", "accessors"))
        return reports.subgraph_report(starts[0], full, found, stats, spark) if a.format == "markdown" else found
    files = source.read_tree(spark, [source.project_root(a.path)])
    if a.command == "java-grep":
        hits = text_search.search(source.java_files(files), a.query, a.max_hits)
        return reports.hit_text(hits) if a.format == "text" else hits
    if a.command == "entrypoints":
        return entry_points.entry_points(files, a.max_files).orderBy("file", "line", "kind")
    if a.command == "rest-map":
        return reports.endpoint_ids(entry_points.rest_map(files, a.max_files)).orderBy("file", "line")
    if a.command == "scan":
        return structure.modules(files)
    if a.command == "symbols":
        return structure.by_package(structure.top_level_types(files, a.max_files))
    listed = None
    if a.tables_file or a.tables:
        text = open(a.tables_file, encoding="utf-8").read() if a.tables_file else ""
        listed = source.listed_tables(spark, text, a.tables)
    if a.command == "db-tables":
        hits = table_refs.table_hits(files)
        return reports.anchor_ids(table_refs.canonical_names(hits, listed) if listed is not None else hits).orderBy("file", "line", "nth")
    options = project_design.Options(
        steps=tuple(s for s in project_design.Options.steps if s in (a.steps or project_design.Options.steps) and s not in a.skip), queries=tuple(a.keywords), max_depth_up=a.max_depth if a.max_depth is not None else 20,
        max_depth_down=a.depth_down, max_nodes=a.max_nodes, max_branches=a.max_branches if a.max_branches is not None else 48, max_endpoints=a.max_endpoints, most_chains=a.max_chains, most_anchors=a.max_anchors,
        most_files=a.max_files, strict_tables=a.strict_tables, skip_interfaces=a.skip_interfaces, skip_rest=a.skip_rest, most_starts=a.max_entries,
    )
    bundle = project_design.write_bundle(spark, files, a.out, listed, _index(spark, a.index) if a.index else None, options)
    return "\n".join([f"{k}: {v}" for k, v in bundle.summary.items()] + [f"warning: {w}" for w in bundle.warnings])


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("codelake").getOrCreate()
    try:
        out = _output(spark, a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if isinstance(out, str):
        print(out)
    else:
        for r in (out if out.columns == ["value"] else reports.as_json(out)).toLocalIterator():
            print(r["value"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
