"""Where a trace starts and where it ends: what a query names in a call graph, and what stands at the top of a chain.

Nodes are call_nodes(key, class, method, file, line). Everything is a join over all hits, points or chains at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import predicates as q
from codelake.operators import java_context, text_search
from codelake.sources import files as source
from codelake.sources.store import written

ONE_FILE_HITS, MANY_NEEDLE_HITS, MOST_TRIES = 40, 200, 51
WITH_ENTRY = ("no_incoming", "rest_endpoint")
MARKERS = {"message_listener": "listener_markers", "scheduled_task": "scheduled_markers", "async_method": "async_markers"}


def simple_class(c: str = "class"):
    return F.substring_index(c, ".", -1)


def bare_method(c: str = "method"):
    return F.trim(F.substring_index(F.substring_index(c, " : ", 1), "(", 1))


def nodes_at(points: DataFrame, nodes: DataFrame, below: int | None = 16, above: int | None = 0) -> DataFrame:
    """points(file, line, ...) -> each with the key of the node there: the one that begins at the line, else the last within `above` lines over it, else the first within `below` lines under it (null: any number). Points without such a node are left out.

    Annotations stand above the signature at which a node begins, so looking down a little is the default. Points and
    nodes that both have a `project` meet within it only.
    """
    each = written(points.withColumn("_point", F.monotonically_increasing_id()))  # numbered once, so that a lost task numbers nothing anew
    at = [c for c in ("project", "file") if c in points.columns and c in nodes.columns]  # equal paths of two projects are told apart where nodes name theirs
    held = each.join(nodes.select(*at, "key", F.col("line").alias("_line")), at).withColumn("_down", F.col("_line") - F.col("line"))
    near = (F.col("_down") == 0) | ((F.col("_down") > 0) & (F.col("_down") <= below if below is not None else F.lit(True))) | ((F.col("_down") < 0) & (-F.col("_down") <= above if above is not None else F.lit(True)))
    nearest = F.row_number().over(Window.partitionBy("_point").orderBy(F.col("_down") > 0, F.abs("_down"), "key"))
    return held.where(near).withColumn("_r", nearest).where("_r = 1").drop("_r", "_line", "_point", "_down")


def method_starts(nodes: DataFrame, needle: str) -> DataFrame:
    """(key, file, line) of the methods that a keyword may mean, the best first: of that name, then those that hold it, then those that hold it elsewhere in their signature, shorter names first."""
    bare = bare_method()
    tier = F.when(bare == needle, 0).when(F.contains(F.lower(bare), F.lit(needle.lower())), 1).when(F.contains(F.lower("method"), F.lit(needle.lower())), 2)
    return nodes.where(tier.isNotNull()).orderBy(tier, F.when(tier == 0, 0).otherwise(F.length(bare)), "file", "line", "key").select("key", "file", "line")


def class_starts(nodes: DataFrame, needle: str) -> DataFrame:
    """(key, file, line) of the first methods of the classes that a keyword may mean, the best first: controllers and implementations of services, services and repositories, others, plain data; longer names first."""
    name = simple_class()
    tier = F.when(q.contains_any(name, ["Controller", "ServiceImpl"]), 0).when(q.contains_any(name, ["Service", "Repository"]), 1).when(F.endswith(name, F.lit("DTO")) | (name == "MonitorData"), 3).otherwise(2)
    of_class = nodes.where(F.contains(F.lower(name), F.lit(needle.lower())))
    first = of_class.withColumn("r", F.row_number().over(Window.partitionBy("class", "file").orderBy("line", "key"))).where("r = 1")
    return first.orderBy(tier, -F.length(name), "file", "key").select("key", "file", "line")


def _marked_starts(nodes: DataFrame, files: DataFrame, needles: list[str], skip_interfaces: bool, skip_rest: bool) -> DataFrame:
    """The starts that text hits give, and why some are not wanted (gone: interface or rest)."""
    several = len(needles) > 1
    java = source.java_files(files)
    found = text_search.search(java, "|".join(needles), MANY_NEEDLE_HITS if several else ONE_FILE_HITS)
    ranked = written(found.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "file", "line"))))
    lines = written(source.lines(java.join(F.broadcast(ranked.select(F.col("file").alias("path")).distinct()), "path", "left_semi").select("project", "path", "text")))
    asked = ranked.join(lines.select("project", F.col("path").alias("file"), F.col("line_no").alias("line")), ["file", "line"]).select("project", F.col("file").alias("path"), F.col("line").alias("line_no"), "nth")
    tried = text_search.method_candidates(asked, lines).where(F.col("rank") <= MOST_TRIES).join(asked.withColumnRenamed("line_no", "hit"), ["project", "path", "hit"])
    spans = nodes.withColumn("end", F.lead("line").over(Window.partitionBy("file").orderBy("line", "key"))).select(F.col("file").alias("path"), "key", "line", "end", *[c for c in ("is_rest",) if c in nodes.columns])
    inside = tried.join(spans, "path").where("candidate >= line AND (end IS NULL OR candidate < end)")
    first = inside.withColumn("r", F.row_number().over(Window.partitionBy("nth").orderBy("rank", "key"))).where("r = 1")
    once = first.withColumn("r", F.row_number().over(Window.partitionBy("key" if several else "path").orderBy("nth"))).where("r = 1")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.java$", "")
    own = lines.where(q.is_interface_file(stem, F.col("text"))).select("path").distinct().withColumn("interface", F.lit(True)) if skip_interfaces else lines.select("path").limit(0).withColumn("interface", F.lit(True))
    rest = F.coalesce("is_rest", F.lit(False)) if skip_rest and "is_rest" in nodes.columns else F.lit(False)
    return once.join(own, "path", "left").withColumn("gone", F.when(F.col("interface"), "interface").when(rest, "rest"))


def start_counts(nodes: DataFrame, files: DataFrame, needles: list[str], skip_interfaces: bool = False, skip_rest: bool = False, most: int | None = None) -> DataFrame:
    """(found, skipped_interfaces, skipped_rest, before_cap, kept): how many starts text hits give, and what becomes of them."""
    n = lambda c: F.count(F.when(c, 1))
    told = _marked_starts(nodes, files, needles, skip_interfaces, skip_rest).agg(F.count("*").alias("found"), n(F.col("gone") == "interface").alias("skipped_interfaces"), n(F.col("gone") == "rest").alias("skipped_rest"))
    left = F.col("found") - F.col("skipped_interfaces") - F.col("skipped_rest")
    return told.select("*", left.alias("before_cap"), (left if most is None else F.least(left, F.lit(most))).cast("long").alias("kept"))


def text_starts(nodes: DataFrame, files: DataFrame, needles: list[str], skip_interfaces: bool = False, skip_rest: bool = False, most: int | None = None) -> DataFrame:
    """The methods around the best text hits of some needles, likelier files first (ordinal).

    One needle gives each file one start, by its best hit that lies in a method; several give every method one. Of a
    hit's candidate lines the first that lies in a method counts.
    """
    once = _marked_starts(nodes, files, needles, skip_interfaces, skip_rest).where("gone IS NULL")
    ordered = once.withColumn("ordinal", F.row_number().over(Window.orderBy(q.entry_tier(F.col("path")), "path", "nth")))
    out = ordered.select("key", F.col("path").alias("file"), "line", "ordinal", F.col("hit").alias("hit_line"))
    return out if most is None else out.where(F.col("ordinal") <= most)


def keyword_starts(nodes: DataFrame, query: str, files: DataFrame | None = None, skip_interfaces: bool = False, skip_rest: bool = False, most: int | None = None) -> DataFrame:
    """(key, file, line, ordinal, way, hit_line) that a keyword means: the best method of that name, else the first method of the best class, else methods around text hits. Several keywords (`a|b`) go to the text at once."""
    needles = text_search.needles_of(query)
    none = F.lit(None).cast("int")
    ways = (method_starts, class_starts) if len(needles) == 1 else ()
    best = None
    for i, f in enumerate(ways):  # one row each; only the best way counts, so texts are searched where no name says it
        best = written(f(nodes, needles[0]).limit(1).select("*", F.lit(1).alias("ordinal"), F.lit(i).alias("w"), none.alias("hit_line")))
        if not best.isEmpty():
            break
    else:
        if files is not None and needles:
            best = text_starts(nodes, files, needles, skip_interfaces, skip_rest, most).select("key", "file", "line", "ordinal", F.lit(2).alias("w"), "hit_line")
    if best is None:
        return nodes.select("key", "file", "line", F.lit(0).alias("ordinal"), F.lit("").alias("way"), none.alias("hit_line")).limit(0)
    way = F.element_at(F.array(*map(F.lit, ("symbol", "class_first_method", "java_text"))), F.col("w") + 1)
    return best.select("key", "file", "line", "ordinal", way.alias("way"), "hit_line")


def with_top_entries(chains: DataFrame, nodes: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """chains(seed, chain, stop_reason) with top_entry: web mapping and comment of the method at the top, or its listener, schedule or asynchronous markers; null where a chain was cut or nothing is known."""
    marks = [c for c in MARKERS.values() if c in nodes.columns]
    top = chains.withColumn("top", F.element_at("chain", -1)).join(nodes.select(F.col("key").alias("top"), "file", "line", *marks), "top", "left")
    told = F.lit(None).cast("array<string>")
    for reason, c in MARKERS.items():
        if c in marks:
            told = F.when((F.col("stop_reason") == reason) & (F.size(c) > 0), F.col(c)).otherwise(told)
    names = ["class_base_path", "http_method", "rest_path", "rest_summary", "javadoc"]
    if lines is not None:
        asked = top.where(F.col("stop_reason").isin(*WITH_ENTRY)).select(F.col("file").alias("path"), F.col("line").alias("line_no")).distinct()
        placed = asked.join(lines.select("project", "path").distinct(), "path")
        known = java_context.top_entries(placed, lines).withColumnsRenamed({"path": "file", "line_no": "line"}).drop("project")
        top = top.join(known.withColumn("_known", F.lit(True)), ["file", "line"], "left")
        values = [F.when(F.col("stop_reason").isin(*WITH_ENTRY), F.col(c)).alias(c) for c in names]
    else:
        values = [F.lit(None).cast("string").alias(c) for c in names]
    entry = F.struct(*values, told.alias("markers"))
    some = F.coalesce(*[entry[c] for c in names]).isNotNull() | entry["markers"].isNotNull()
    return top.select(*chains.columns, F.when(some, entry).alias("top_entry"))
