"""Point queries over an index of symbols, references and calls, and the resolution of what a query names.

The index is tables that any indexer may write: symbols, refs, call_edges, impl_edges, type_edges, hover. Where there
is none, `derived_edges` gives approximate calls from the text, marked as heuristic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.predicates import entry_tier, method_at, matches
from codelake.operators.links import symbol_at
from codelake.plans import call_graph, scope_calls

CLASS_KINDS = [5, 10, 11]
METHOD_KIND = 6
OPERATIONS = ["documentSymbol", "workspaceSymbol", "definition", "references", "hover", "implementation", "incomingCalls", "outgoingCalls", "typeHierarchy"]


def document_symbols(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("start_line", "start_char")


def workspace_symbols(symbols: DataFrame, needles: list[str], most: int | None = 20) -> DataFrame:
    """Symbols whose name holds a needle, each once, by the first needle that finds it; up to `most` a needle and in all."""
    spark = symbols.sparkSession
    asked = spark.createDataFrame(list(enumerate(needles)), "ordinal int, needle string")
    found = symbols.join(F.broadcast(asked), F.contains(F.lower("name"), F.lower("needle")))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("ordinal").orderBy("path", "sel_line", "sel_char", "name")))
    ranked = ranked if most is None else ranked.where(F.col("r") <= most)
    once = ranked.groupBy("path", "name", "kind", "sel_line").agg(F.min(F.struct("ordinal", "r", "sym_id", "container", "sel_char")).alias("s"))
    out = once.orderBy("s.ordinal", "s.r").select("s.sym_id", "path", "name", "kind", "s.container", "sel_line", "s.sel_char")
    return out if most is None else out.limit(most)


def _target(refs: DataFrame, path: str, line: int, character: int) -> DataFrame:
    return refs.where((F.col("path") == path) & (F.col("line") == line) & (F.col("character") == character)).select("target_key").distinct()


def definition(refs: DataFrame, symbols: DataFrame, path: str, line: int, character: int) -> DataFrame:
    return symbols.join(_target(refs, path, line, character), F.col("sym_id") == F.col("target_key"), "left_semi")


def references(refs: DataFrame, path: str, line: int, character: int) -> DataFrame:
    """All places that refer to what stands at a place, its declaration included."""
    return refs.join(_target(refs, path, line, character), "target_key", "left_semi").orderBy("path", "line", "character")


def hover(hovers: DataFrame, refs: DataFrame, path: str, line: int, character: int) -> DataFrame:
    return hovers.join(_target(refs, path, line, character), F.col("key") == F.col("target_key"), "left_semi")


def implementations(impl_edges: DataFrame, refs: DataFrame, path: str, line: int, character: int) -> DataFrame:
    return impl_edges.join(_target(refs, path, line, character), F.col("decl_key") == F.col("target_key"), "left_semi")


def query_parts(query: str) -> tuple[str, str | None, str | None]:
    """(mode, class or needle, method): `Class.method` is split at its last unescaped dot; SCHEMA.TABLE in capitals, and escaped dots, stay one keyword."""
    m = re.fullmatch(r"((?:[^\\.]|\\.|\.(?=.*(?<!\\)(?:\\\\)*\.))*)\.([^.]*)", query.strip(), re.S)
    if m and m[1] and m[2] and not (re.fullmatch(r"[A-Z][A-Z0-9_]*", m[1]) and re.fullmatch(r"[A-Z][A-Z0-9_]*", m[2])):
        return "class_method", m[1], m[2]
    return "keyword", query.strip().replace(r"\.", "."), None


def one_entry(query: str | None = None, class_name: str | None = None, method: str | None = None, file: str | None = None, line: int | None = None) -> tuple:
    """The one way in which a trace's start is named; none or several is an error."""
    ways = [w for w, given in (("keyword", query), ("class_method", class_name and method), ("file_line", file and line)) if given]
    if len(ways) != 1:
        raise ValueError("name exactly one of: a query; a class and a method; a file and a line")
    if ways[0] == "keyword":
        return query_parts(query)
    return (ways[0], class_name, method) if ways[0] == "class_method" else (ways[0], file, line)


def class_methods(symbols: DataFrame, class_name: str, method: str) -> DataFrame:
    """Method symbols of a class, nested in it or named after it."""
    simple = class_name.rsplit(".", 1)[-1]
    bare = F.trim(F.substring_index("name", "(", 1))
    return symbols.where((F.col("kind") == METHOD_KIND) & (bare == method) & (F.substring_index("container", ".", -1) == simple)).orderBy("path", "sel_line")


def class_symbols(symbols: DataFrame, class_name: str) -> DataFrame:
    """Class symbols of a name: by exact name, by the path of its full name, by suffix; the best way only."""
    simple, rel = class_name.rsplit(".", 1)[-1], class_name.replace(".", "/") + ".java"
    way = F.when(F.endswith("path", F.lit(f"src/main/java/{rel}")), 0).when((F.col("path") == rel) | F.endswith("path", F.lit("/" + rel)), 1).otherwise(2)
    found = symbols.where(F.col("kind").isin(CLASS_KINDS) & (F.col("name") == simple)).withColumn("way", way if "." in class_name else F.lit(0))
    return found.withColumn("best", F.min("way").over(Window.partitionBy("name"))).where("way = best").drop("way", "best").orderBy("path", "sel_line")


def keyword_methods(symbols: DataFrame, needle: str) -> DataFrame:
    """Methods that a keyword may mean: the same name, then those that begin with it, then those that hold it, shorter names first."""
    bare = F.trim(F.substring_index("name", "(", 1))
    tier = F.when(bare == needle, 0).when(F.startswith(bare, F.lit(needle)), 1).when(F.contains(bare, F.lit(needle)), 2).otherwise(3)
    found = symbols.where((F.col("kind") == METHOD_KIND) & F.contains(F.lower("name"), F.lit(needle.lower())))
    return found.withColumn("tier", tier).orderBy("tier", F.length("name"), "path", "sel_line")


def resolved_keyword(symbols: DataFrame, needle: str, text_methods: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(path, method_line, name, way) that a keyword means: methods of that name, else the first method of a class of that name, else methods around text hits; only the best way that finds any."""
    methods = symbols.where(F.col("kind") == METHOD_KIND)
    bare = F.trim(F.substring_index("name", "(", 1))
    row = lambda df, way: df.select("path", (F.col("sel_line") + 1).alias("method_line"), "name", F.lit(way).alias("way"))
    first = F.row_number().over(Window.partitionBy("path", "container").orderBy("sel_line", "sel_char"))
    of_class = methods.withColumn("r", first).where("r = 1").join(class_symbols(symbols, needle).select("path", F.col("name").alias("container")), ["path", "container"], "left_semi")
    every = row(methods.where(bare == needle), 0).union(row(of_class, 1))
    if text_methods is not None:
        every = every.union(text_methods.select("path", "method_line", "name", F.lit(2)))
    best = every.join(F.broadcast(every.agg(F.min("way").alias("best"))), F.col("way") == F.col("best")).drop("best")
    return best if most is None else best.orderBy("path", "method_line").limit(most)


def hit_methods(candidates: DataFrame, symbols: DataFrame, skip_rest: DataFrame | None = None, skip_interfaces: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """candidates(path, hit, candidate, rank) -> path, method line: the method at the first candidate line that is inside one, each once, the likeliest files first."""
    methods = symbols.where(F.col("kind") == METHOD_KIND)
    at = candidates.select("path", "hit", "rank", (F.col("candidate") - 1).alias("line")).join(methods, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    first = at.withColumn("r", F.row_number().over(Window.partitionBy("path", "hit").orderBy("rank", F.col("end_line") - F.col("start_line")))).where("r = 1")
    found = first.select("path", (F.col("sel_line") + 1).alias("method_line"), "name").distinct()
    for gone, on in ((skip_rest, ["path", "method_line"]), (skip_interfaces, ["path"])):
        found = found.join(gone, on, "left_anti") if gone is not None else found
    ordered = found.withColumn("tier", entry_tier(F.col("path"))).orderBy("tier", "path", "method_line")
    return ordered.limit(most) if most is not None else ordered


def derived_symbols(lines: DataFrame) -> DataFrame:
    """Approximate method symbols: each declaration up to the line before the next one."""
    text, no_word = F.col("text"), ~matches(F.col("text"), r"^\s*(return|throw|else)\b")
    # a filter on the name would be pushed below it and find it anew, each of its patterns several times; so it waits until the window is done
    told = lines.where(F.contains(text, F.lit("("))).select("project", "path", "line_no", method_at(text).alias("name"), no_word.alias("declares"))
    below = Window.partitionBy("project", "path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    declared = F.col("name").isNotNull() & F.col("declares")
    told = told.withColumn("next", F.last(F.when(declared, F.col("line_no")), True).over(below))
    return told.where(declared).select("project", "path", "name", F.col("line_no").alias("start_line"), (F.col("next") - 1).alias("end_line"))


def derived_edges(lines: DataFrame) -> DataFrame:
    """Approximate calls from the text: receivers are resolved by scopes, imports and types, and calls are joined by type, name and number of arguments; see scope_calls."""
    return scope_calls.scoped_edges(lines)


def derived_file_edges(files: DataFrame) -> DataFrame:
    """derived_edges of files(project, path, text), which need no shuffle to get their lines together."""
    return scope_calls.file_edges(files)


def analyze(index: dict[str, DataFrame], operation: str, path: str = "", line: int = 0, character: int = 0, query: str = "") -> DataFrame:
    """One of OPERATIONS over the index tables; line and character count from 1, as people do."""
    l, c = line - 1, character - 1
    if operation == "documentSymbol":
        return document_symbols(index["symbols"], path)
    if operation == "workspaceSymbol":
        return workspace_symbols(index["symbols"], [x.strip() for x in re.split("[|｜]", query) if x.strip()])
    if operation == "definition":
        return definition(index["refs"], index["symbols"], path, l, c)
    if operation == "references":
        return references(index["refs"], path, l, c)
    if operation == "hover":
        return hover(index["hover"], index["refs"], path, l, c)
    if operation == "implementation":
        return implementations(index["impl_edges"], index["refs"], path, l, c)
    if operation in ("incomingCalls", "outgoingCalls", "typeHierarchy"):
        spot = index["symbols"].sparkSession.createDataFrame([(path, l, c)], "path string, line int, character int")
        keys = symbol_at(spot, index["symbols"]).select(F.col("sym_id").alias("key"))
        if operation == "typeHierarchy":
            return call_graph.type_hierarchy(index["type_edges"], keys)
        return (call_graph.callers if operation == "incomingCalls" else call_graph.callees)(index["call_edges"], keys)
    raise ValueError(f"unknown operation {operation}; one of {', '.join(OPERATIONS)}")

