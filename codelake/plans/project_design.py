"""From a source tree to a design bundle: modules, mappings, tables, types, traces, key methods, an index.

Steps write their tables and documents under one folder and hand DataFrames on. A step that fails adds a warning and
the rest goes on; traces need the tables of a call index, and are left out where there is none. A step that is not asked
for leaves what an earlier run wrote in the folder, and later steps read it from there.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codelake.functions import names
from codelake.operators import entry_points, structure, table_refs
from codelake.plans import call_graph, chain_counts, chain_drivers, reports, saved_reports, trace_starts
from codelake.sources import files as source


@dataclass
class Options:
    steps: tuple[str, ...] = ("modules", "entrypoints", "rest-map", "db-tables", "symbols", "keyword-up", "table-up", "entry-down", "business")
    queries: tuple[str, ...] = ()  # keywords whose callers are traced
    max_depth_up: int = 20
    max_depth_down: int = 16
    max_nodes: int = 500
    max_branches: int = 48
    max_endpoints: int = 0  # 0: all
    most_chains: int = 1_000_000
    most_anchors: int = 24  # of a table's literals, and of its mapper methods; 0: all
    most_files: int | None = None  # Java files that are read for types
    strict_tables: bool = False  # no list of tables that only the sources name
    skip_interfaces: bool = False  # starts from text hits
    skip_rest: bool = False
    most_starts: int | None = None


@dataclass
class Bundle:
    folder: str
    summary: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def _document(folder: str, name: str, text: str) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


STEP_OF = {
    "modules": ["modules"], "entrypoints": ["entrypoints"], "rest-map": ["rest-map"], "symbols": ["symbols-by-package"], "keyword-up": ["keyword-callers", "keyword-counts"], "table-up": ["table-callers", "table-errors", "table-error-groups", "table-anchor-counts"],
    "entry-down": ["entry-rows", "entry-errors", "entry-controllers", "key-methods"], "business": ["merged-key-methods"],
}
SHOWN = 200


def _index(made: dict[str, DataFrame], bundle: Bundle, options: Options) -> str:
    """What a bundle holds, step by step, with links to tables and reports; lists show their first rows."""
    lines, left = ["# Design", ""], dict(bundle.summary)
    for step in options.steps:
        named = [n for n in left if n in STEP_OF.get(step, ()) or (step == "db-tables" and n.startswith("tables-"))]
        lines += [f"## {step}", "", *([f"- [{n}]({n}/): {left[n]}" for n in named] or ["(nothing)"]), ""]
        if step == "rest-map" and "rest-map" in named:
            few = made["rest-map"].orderBy("file", "line", "slug").limit(SHOWN).collect()
            lines += ["[diagram](rest-map.mmd)", "", *[f"- `{r['http_method']} {r['path']}` {r['simple_class_name']}.{r['method_name']} ({r['file']}:{r['line']})" for r in few], ""]
        if step == "entry-down" and "entry-controllers" in named:
            stem = names.safe_name(F.regexp_replace(F.substring_index("file", "/", -1), r"\.java$", ""), 80, "file")
            few = made["entry-controllers"].select("file", stem.alias("stem"), F.size("entries").alias("n"), "nodes").orderBy("file").limit(SHOWN).collect()
            lines += [*[f"- [{r['file']}](entry-down/controller={r['stem']}/): {r['n']} entries, {r['nodes']} methods" for r in few], ""]
        if step == "table-up" and "table-callers" in named:
            slug = names.safe_name(F.col("table"), 80, "table")
            few = made["table-callers"].groupBy("table", slug.alias("slug")).agg(F.count("*").alias("n"), F.count_distinct("anchor_id").alias("anchors")).orderBy("table").limit(SHOWN).collect()
            lines += [*[f"- [{r['table']}](table-up/slug={r['slug']}/): {r['anchors']} anchors, {r['n']} chains" for r in few], ""]
        if step == "business" and named:
            lines += ["[key methods](business.md)", ""]
    return "\n".join([*lines, *(["## Warnings", "", *[f"- {w}" for w in bundle.warnings], ""] if bundle.warnings else [])])


def write_bundle(spark: SparkSession, files: DataFrame, folder: str, user_tables: DataFrame | None = None, index: dict[str, DataFrame] | None = None, options: Options = Options()) -> Bundle:
    """Run the steps in order. Tables are written by executors under `folder`; index and reports, which are small, by the driver."""
    bundle = Bundle(folder)
    made: dict[str, DataFrame] = {}

    def keep(step: str, name: str, df: DataFrame) -> None:
        path = f"{folder}/{name}"
        reports.write_json(df, path)
        _document(os.path.join(folder, "schemas"), f"{name}.json", df.schema.json())
        made[name] = spark.read.schema(df.schema).json(path)
        bundle.summary[name] = made[name].count()

    def modules() -> None:
        keep("modules", "modules", structure.modules(files))

    def entries() -> None:
        keep("entrypoints", "entrypoints", entry_points.entry_points(files))

    def rest_map() -> None:
        keep("rest-map", "rest-map", reports.endpoint_ids(entry_points.rest_map(files)))
        _document(folder, "rest-map.mmd", reports.endpoint_diagram(made["rest-map"]).first()["value"])

    def tables() -> None:
        for name, df in table_refs.manifest(files, user_tables).items():
            if options.strict_tables and name == "extracted_only":
                continue
            keep("db-tables", f"tables-{name.replace('_', '-')}", reports.anchor_ids(df) if name == "hits" else df)

    def symbols() -> None:
        keep("symbols", "symbols-by-package", structure.by_package(structure.top_level_types(files, options.most_files)))

    def edges() -> DataFrame:
        return call_graph.with_implementations(index["call_edges"], index["impl_edges"]) if "impl_edges" in index else index["call_edges"]

    def keyword_up() -> None:
        starts = None
        for text in options.queries:
            found = trace_starts.keyword_starts(index["call_nodes"], text, files, options.skip_interfaces, options.skip_rest, options.most_starts).withColumn("query", F.lit(text))
            starts = found if starts is None else starts.union(found)
        if starts is not None:
            seeds = starts.select("key").distinct()
            try:
                chains = call_graph.trace_up(edges(), index["call_nodes"], seeds, options.max_depth_up, options.most_chains)
            except ValueError as e:  # too many to list; they can still be counted
                bundle.warnings.append(f"keyword-up: {e}; counted instead")
                keep("keyword-up", "keyword-counts", chain_counts.summary(chain_counts.chain_counts(edges(), index["call_nodes"], seeds, options.max_depth_up)))
                return
            told = trace_starts.with_top_entries(chains, index["call_nodes"], source.lines(source.java_files(files)))
            keep("keyword-up", "keyword-callers", starts.select("query", "way", F.col("key").alias("seed")).join(told, "seed"))

    def saved(name: str) -> DataFrame:
        """A table of this run, or of an earlier one in the same folder whose step was left out now."""
        if name not in made:
            path = f"{folder}/{name}"
            if not os.path.isdir(path):
                raise ValueError(f"{name} was not made, and an earlier run left none in {folder}")
            with open(os.path.join(folder, "schemas", f"{name}.json"), encoding="utf-8") as f:
                made[name] = spark.read.schema(StructType.fromJson(json.load(f))).json(path)
        return made[name]

    def table_up() -> None:
        hits = saved("tables-hits")
        asked = None if user_tables is None else hits.select("project").distinct().crossJoin(F.broadcast(user_tables.select(names.physical_table(F.col("name")).alias("table")).distinct()))
        anchors, errors = chain_drivers.table_anchors(files, hits, asked)
        anchors, counts = chain_drivers.capped_anchors(anchors, options.most_anchors)
        keep("table-up", "table-anchor-counts", counts)
        chains, lost = chain_drivers.table_callers(anchors, index["call_nodes"], edges(), options.max_depth_up, options.most_chains)
        keep("table-up", "table-callers", chains)
        keep("table-up", "table-errors", errors.union(lost))
        keep("table-up", "table-error-groups", chain_drivers.error_groups(made["table-errors"]))
        chain_drivers.anchor_reports(made["table-callers"]).write.mode("overwrite").partitionBy("slug", "anchor_id").text(f"{folder}/table-up")

    def entry_down() -> None:
        rest = saved("rest-map").select(F.col("endpoint_id").alias("entry_id"), F.lit("rest").alias("kind"), "file", "line")
        scanned = saved("entrypoints").where("kind <> 'controller_public_method'").select(F.concat_ws(":", "kind", "file", F.col("line").cast("string")).alias("entry_id"), "kind", "file", "line")
        entries = rest.union(scanned).distinct().orderBy("file", "line", "entry_id")
        entries = entries.limit(options.max_endpoints) if options.max_endpoints else entries
        traced = chain_drivers.entry_callees(entries, index["call_nodes"], edges(), options.max_depth_down, options.max_nodes, options.max_branches)
        keep("entry-down", "entry-rows", traced["rows"])
        keep("entry-down", "entry-errors", traced["errors"])
        keep("entry-down", "entry-controllers", chain_drivers.controller_rows(traced))
        keep("entry-down", "key-methods", chain_drivers.entry_key_methods(traced))
        stem = names.safe_name(F.regexp_replace(F.substring_index("file", "/", -1), r"\.java$", ""), 80, "file")
        placed = chain_drivers.entry_reports(traced).join(traced["rows"].select("entry_id", stem.alias("controller")).distinct(), "entry_id")
        placed.write.mode("overwrite").partitionBy("controller", "entry_id").text(f"{folder}/entry-down")

    def business() -> None:
        """From this run's traces, else from the reports that earlier runs, or others, saved in the folder."""
        if "key-methods" in made:
            merged = call_graph.merged_key_methods(made["key-methods"])
        else:
            told = saved_reports.payloads(spark, folder)
            if told.isEmpty():
                raise ValueError(f"no trace of this run, and no saved report in {folder}")
            merged = saved_reports.key_methods(told, files)
        keep("business", "merged-key-methods", merged)
        _document(folder, "business.md", reports.business_report(made["merged-key-methods"]))

    run = {"modules": modules, "entrypoints": entries, "rest-map": rest_map, "db-tables": tables, "symbols": symbols, "keyword-up": keyword_up, "table-up": table_up, "entry-down": entry_down, "business": business}
    needs_index = {"keyword-up", "table-up", "entry-down"}
    for step in options.steps:
        if step == "keyword-up" and not options.queries:
            continue
        if step in needs_index and index is None:
            bundle.warnings.append(f"{step}: no call index given")
            continue
        try:
            run[step]()
        except (ValueError, OSError) as e:  # bad input of one step; the others still have their use
            bundle.warnings.append(f"{step}: {type(e).__name__}: {str(e)[:300]}")
    _document(folder, "index.md", _index(made, bundle, options))
    _document(folder, "summary.json", json.dumps({"tables": bundle.summary, "warnings": bundle.warnings}, ensure_ascii=False, indent=1))
    return bundle
