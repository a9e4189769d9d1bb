"""Queries over call graphs: edges(src_key, dst_key, dst_name, ...) and nodes(key, flags ...).

Traversals are loops of joins, one per level, over all seeds at once; each level's table is written to the shared
checkpoint folder, so a lost executor costs one level and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.functions import predicates as q
from codelake.sources.store import dealt, large, written

STOPS = [("is_rest", "rest_endpoint"), ("is_message_listener", "message_listener"), ("is_scheduled_task", "scheduled_task"), ("is_async_method", "async_method"), ("is_abstract_class", "abstract_class")]

CALLERS_A_BLOCK = 256  # whose callees are ranked together


def with_implementations(edges: DataFrame, implementations: DataFrame) -> DataFrame:
    """edges, and for declarations that call nothing themselves edges to what implements them."""
    calling = edges.select("src_key").distinct()
    added = implementations.join(calling, F.col("decl_key") == F.col("src_key"), "left_anti").select(F.col("decl_key").alias("src_key"), F.col("impl_key").alias("dst_key")).distinct()
    return edges.withColumn("is_implementation", F.lit(False)).unionByName(added.withColumn("is_implementation", F.lit(True)), allowMissingColumns=True)


def callers(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(F.col("key").alias("dst_key")), "dst_key")


def callees(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(F.col("key").alias("src_key")), "src_key")


def type_hierarchy(type_edges: DataFrame, keys: DataFrame) -> DataFrame:
    """key, side (sub or super), other: the types right below and above."""
    below = keys.join(type_edges, F.col("key") == F.col("super_key")).select("key", F.lit("sub").alias("side"), F.col("sub_key").alias("other"))
    return below.union(keys.join(type_edges, F.col("key") == F.col("sub_key")).select("key", F.lit("super").alias("side"), F.col("super_key").alias("other")))


def trace_up(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 20, most_chains: int | None = None) -> DataFrame:
    """seeds(key) -> seed, chain (keys from the seed up), stop_reason: every simple path against the calls.

    A path stops at a node it has already (which ends the chain), at an entry point, at an abstract class, at the
    greatest depth, or where nobody calls. The number of paths can grow exponentially; `most_chains` stops with an error.
    """
    stops = [F.when(F.coalesce(c, F.lit(False)), r) for c, r in STOPS if c in nodes.columns]
    flags = nodes.select("key", F.coalesce(*stops, F.lit(None).cast("string")).alias("node_stop") if stops else F.lit(None).cast("string").alias("node_stop"))
    ways = edges.select(F.col("dst_key").alias("at"), F.col("src_key").alias("next")).distinct()
    called = ways.select("at").distinct().withColumn("has_callers", F.lit(True))
    now = seeds.select(F.col("key").alias("seed"), F.array().cast("array<string>").alias("before"), F.col("key").alias("at"))
    done: list[DataFrame] = []
    for depth in range(max_depth + 1):
        told = now.join(flags, now["at"] == flags["key"], "left").drop("key").join(called, "at", "left")
        reason = F.when(F.array_contains("before", F.col("at")), "cycle").otherwise(F.coalesce("node_stop", F.when(F.lit(depth >= max_depth), "max_depth"), F.when(F.col("has_callers").isNull(), "no_incoming")))
        told = written(told.select("seed", F.concat("before", F.array("at")).alias("chain"), "at", reason.alias("stop_reason")))
        done.append(told.where("stop_reason IS NOT NULL").select("seed", "chain", "stop_reason"))
        rest = told.where("stop_reason IS NULL")
        n = rest.count()
        if not n:
            break
        if most_chains is not None and n > most_chains:
            raise ValueError(f"{n} open chains at depth {depth}; at most {most_chains} are asked for")
        now = rest.join(ways, "at").select("seed", F.col("chain").alias("before"), F.col("next").alias("at"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def first_branches(edges: DataFrame, most: int) -> DataFrame:
    """The first `most` callees of every node by name; `branches` is how many it has."""
    order = ["dst_name", *[c for c in ("ord",) if c in edges.columns], "dst_key"]
    by = Window.partitionBy("src_key")
    ranked = edges.withColumns({"branch": F.row_number().over(by.orderBy(*order)), "branches": F.count("*").over(by)})
    return ranked.where(F.col("branch") <= most)


def trace_down_all(edges: DataFrame, seeds: DataFrame, max_depth: int = 8, max_nodes: int = 500, max_branches: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes(seed, key, depth, ordinal), edges(seed, src_key, dst_key, is_implementation), stats(seed, node_count, edge_count, expanded_count, stop_reason)) of all seeds(key) at once: breadth first along the calls.

    Each seed has limits of its own. Nodes are admitted level by level in the order of (caller, branch) until a seed has
    `max_nodes`; edges to nodes that were not admitted stay in the result. Every node is expanded once. An edge marked
    as `is_implementation` stays marked. A level is one join and one ranking for all seeds.
    """
    extra = [c for c in ("ord", "is_implementation") if c in edges.columns]
    ways = written(first_branches(edges.select("src_key", "dst_key", "dst_name", *extra), max_branches))
    mark = F.coalesce("is_implementation", F.lit(False)) if "is_implementation" in extra else F.lit(False)
    level = nodes = written(seeds.select(F.col("key").alias("seed"), "key").distinct().select("seed", "key", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ordinal")))
    found, cut_short = [], []
    for depth in range(max_depth):
        steps = written(level.select("seed", F.col("key").alias("src_key"), "ordinal").join(ways, "src_key").select("seed", "src_key", "dst_key", mark.alias("is_implementation"), "ordinal", "branch", "branches"))
        found.append(steps)
        fresh = steps.join(nodes.select("seed", F.col("key").alias("dst_key")), ["seed", "dst_key"], "left_anti").groupBy("seed", "dst_key").agg(F.min(F.struct("ordinal", "branch")).alias("o"))
        fresh = written(fresh.withColumn("block", F.expr(f"o.ordinal DIV {CALLERS_A_BLOCK}")))
        # a seed's nodes are ranked block by block, and blocks are added up, so that no seed is sorted in one task
        above = Window.partitionBy("seed").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        have = nodes.groupBy("seed").agg(F.count("*").alias("have"))
        blocks = fresh.groupBy("seed", "block").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(above), F.lit(0))).join(have, "seed")
        # a block's rank never goes far beyond the limit, so Spark keeps few rows a partition before it shuffles them
        ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy("seed", "block").orderBy("o"))).where(F.col("r") <= max_nodes + 1).join(blocks, ["seed", "block"])
        ranked = ranked.withColumn("n", F.col("before") + F.col("r")).where(F.col("n") <= max_nodes + 1)
        told = written(ranked.select("seed", F.col("dst_key").alias("key"), F.lit(depth + 1).alias("depth"), (F.col("have") - 1 + F.col("n")).alias("ordinal")))
        cut_short.append(told.where(F.col("ordinal") >= max_nodes).select("seed"))
        level = told.where(F.col("ordinal") < max_nodes)
        if not level.limit(1).count():
            break
        nodes = written(nodes.unionByName(level))
    none = nodes.limit(0)
    every = none.select("seed", F.col("key").alias("src_key"), F.col("key").alias("dst_key"), F.lit(False).alias("is_implementation"), "ordinal", F.lit(0).alias("branch"), F.lit(0).cast("long").alias("branches"))
    full = none.select("seed")
    for f, c in zip(found, cut_short):
        every, full = every.union(f), full.union(c)
    edges_out = written(every.groupBy("seed", "src_key", "dst_key").agg(F.max("is_implementation").alias("is_implementation"), F.max("branches").alias("branches")))
    counted = nodes.groupBy("seed").agg(F.count("*").alias("node_count"), F.count(F.when(F.col("depth") < max_depth, 1)).alias("expanded_count"))
    called = edges_out.groupBy("seed").agg(F.count("*").alias("edge_count"), F.max(F.col("branches") > max_branches).alias("branchy"))
    reason = F.when(F.col("full"), "max_nodes").when(F.col("branchy"), "branch_cap").when(F.col("node_count") >= max_nodes, "max_nodes").otherwise("complete")
    stats = counted.join(called, "seed", "left").join(full.distinct().withColumn("full", F.lit(True)), "seed", "left")
    return nodes, edges_out.drop("branches"), stats.select("seed", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "expanded_count", reason.alias("stop_reason"))


def trace_down(edges: DataFrame, seed: str, spark: SparkSession, max_depth: int = 8, max_nodes: int = 500, max_branches: int = 32) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes(key, depth, ordinal), edges(src_key, dst_key, is_implementation), stats) of one seed; see trace_down_all."""
    nodes, found, stats = trace_down_all(edges, spark.createDataFrame([(seed,)], "key string"), max_depth, max_nodes, max_branches)
    limits = {"max_depth": max_depth, "max_nodes": max_nodes, "max_branches": max_branches}
    return nodes.drop("seed"), found.drop("seed"), {**stats.drop("seed", "stop_reason").first().asDict(), **limits, "stop_reason": stats.first()["stop_reason"]}


def in_degree(edges: DataFrame, by: str | None = None) -> DataFrame:
    return edges.groupBy(*([by] if by else []), F.col("dst_key").alias("key")).agg(F.count("*").alias("in_degree"))


def _without(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """nodes whose key is not among keys(key). An anti join would be pushed into each part of a union, and every task would sort the keys once for each part."""
    known = large(dealt(keys, "key").distinct().withColumn("_known", F.lit(True)))
    return dealt(nodes, "key").join(known, "key", "left").where("_known IS NULL").select(*nodes.columns)


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _without(nodes, edges.select(F.col("src_key").alias("key")))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nobody calls."""
    return _without(nodes, edges.select(F.col("dst_key").alias("key")))


def depths(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, by: str | None = None) -> DataFrame:
    """(key, depth): the fewest calls from any of the starts(key), level by level until no new node is found. With `by`, a column of edges and starts, within each of its values.

    With max_depth, nodes that are farther away are left out. Each level is written once; what was seen is one table that
    is written anew whenever it has doubled, so that neither the plan nor the number of files grows with the depth.
    """
    keys = [by] if by else []
    # every level reads them, so they are made once, and dealt and sorted as each level meets them
    ways = written(dealt(edges.select(*keys, "src_key", "dst_key").distinct(), *keys, "src_key").sortWithinPartitions(*keys, "src_key"))
    seen = level = written(starts.select(*keys, "key").distinct().withColumn("depth", F.lit(0)))
    base = size = level.count()
    n, d = size, 0
    while n and (max_depth is None or d < max_depth):
        d += 1
        ahead = level.select(*keys, F.col("key").alias("src_key")).join(ways, [*keys, "src_key"]).select(*keys, F.col("dst_key").alias("key")).distinct()
        level = written(ahead.join(seen, [*keys, "key"], "left_anti").withColumn("depth", F.lit(d)))
        n = level.count()
        size += n
        seen = seen.union(level)
        if size >= 2 * base or d % 16 == 0:
            seen, base = written(seen), size
    return seen


def reaching(edges: DataFrame, targets: DataFrame, max_depth: int | None = None, by: str | None = None) -> DataFrame:
    """(key): all nodes from which a target(key) can be reached, targets included: one search from the targets back."""
    keys = [by] if by else []
    back = edges.select(*keys, F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"))
    return depths(back, targets, max_depth, by).select(*keys, "key")


def first_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key) of the first node that nobody calls: in the order of a trace's ordinals, else by key."""
    order = ["ordinal", "key"] if "ordinal" in nodes.columns else ["key"]
    return roots(nodes, edges).select("key", *order[:-1]).orderBy(*order).limit(1).select("key")


def business_scores(nodes: DataFrame, edges: DataFrame, root: DataFrame | None = None, by: str | None = None, below: DataFrame | None = None, reach: DataFrame | None = None) -> DataFrame:
    """nodes(key, class, method, file, is_rest, is_transactional) with business_score, business_signals and business_candidate.

    Services count 2, being called twice or more up to 3, reaching a database 3, a transaction 2, standing below the
    root 1; controllers, persistence and accessors that call nothing count 0. Candidates have 4 or more. With `by`, a
    column of nodes, edges and roots (which then must be given), each of its values is a graph of its own. What stands
    below the root, and what reaches a database, are searched for where they are not given, as tables of keys.
    """
    keys = [by] if by else []
    cls, file, method = F.col("class"), F.col("file"), F.col("method")
    kinds = nodes.withColumn("sink", q.sink_kind(cls, file, method))
    if below is None:
        below = depths(edges, root if root is not None else first_root(nodes, edges), by=by).where("depth >= 1")
    if reach is None:
        reach = reaching(edges, kinds.where("sink = 'database'").select(*keys, "key"), by=by)
    below, on = below.select(*keys, "key", F.lit(True).alias("below_root")), [*keys, "key"]
    within = [c for c in on if c in reach.columns]
    told = kinds.join(in_degree(edges, by), on, "left").join(below, on, "left").join(reach.select(*within, F.lit(True).alias("reaches")), within, "left")
    degree = F.coalesce("in_degree", F.lit(0))
    none = (F.col("sink") == "database") | q.is_controller_layer(cls, file, F.col("is_rest"))
    accessor = q.is_accessor(method)
    parts = [
        (q.is_service_layer(cls, file, method), F.lit(2), F.lit("service_layer")),
        (degree >= 2, F.least(F.lit(3), degree), F.concat(F.lit("in_degree_"), degree.cast("string"))),
        (F.coalesce("reaches", F.lit(False)), F.lit(3), F.lit("reaches_persistence_subgraph")),
        (F.coalesce("is_transactional", F.lit(False)), F.lit(2), F.lit("transactional")),
        (F.coalesce("below_root", F.lit(False)), F.lit(1), F.lit("below_root")),
    ]
    score = sum((F.when(c, v).otherwise(0) for c, v, _ in parts), F.lit(0))
    signals = F.array_compact(F.array(*[F.when(c, s) for c, _, s in parts]))
    out = told.select(*nodes.columns, F.when(none | accessor, 0).otherwise(score).cast("long").alias("business_score"), F.when(none, F.array().cast("array<string>")).when(accessor, F.array(F.lit("accessor_skipped"))).otherwise(signals).alias("business_signals"))
    return out.withColumn("business_candidate", F.col("business_score") >= 4)


def trace_scores(found: DataFrame, called: DataFrame, stats: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """business_scores of many downward traces: found (nodes by seed, with their depth and what is known of them), called and stats as `trace_down_all` gives them; nodes and edges are the whole graph.

    All of a trace stands below its seed. A trace that was not cut holds all that its nodes reach, so one search back
    from the databases of the whole graph serves all of these; only those that limits cut are searched one by one.
    """
    whole = stats.where("stop_reason = 'complete' AND expanded_count = node_count").select("seed")
    part = lambda df, how: df.join(whole, "seed", how)
    below = found.where("depth >= 1").select("seed", "key")
    sinks = nodes.where(q.sink_kind(F.col("class"), F.col("file"), F.col("method")) == "database").select("key")
    complete = business_scores(part(found, "left_semi"), part(called, "left_semi"), by="seed", below=below, reach=reaching(edges, sinks))
    cut = stats.join(whole, "seed", "left_anti")
    if cut.isEmpty():
        return complete
    return complete.unionByName(business_scores(part(found, "left_anti"), part(called, "left_anti"), by="seed", below=below))


def key_methods(scored: DataFrame) -> DataFrame:
    return scored.where("business_candidate").orderBy(F.desc("business_score"), "class", "method")


def merged_key_methods(scored: DataFrame) -> DataFrame:
    """scored(source, class, method, file, score) of many traces: the best score of each method and the sources that gave it."""
    best = scored.groupBy("class", "method", "file").agg(F.max("score").alias("score"))
    return scored.join(best, ["class", "method", "file", "score"]).groupBy("class", "method", "file", "score").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def folded_accessors(nodes: DataFrame, edges: DataFrame, keep: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, folded(key, bean, kind, accessors)): accessors that call nothing leave the graph and are listed with their callers by bean and kind."""
    gone = leaves(nodes, edges).where(q.is_accessor(F.col("method")))
    if keep is not None:
        gone = gone.where(F.col("key") != keep)
    calls = edges.join(gone.select(F.col("key").alias("dst_key"), "class", "method"), "dst_key")
    folded = calls.groupBy(F.col("src_key").alias("key"), F.col("class").alias("bean"), q.accessor_kind(F.col("method")).alias("kind")).agg(F.array_sort(F.collect_set(q.accessor_name(F.col("method")))).alias("accessors"))
    keys = gone.select("key")
    return nodes.join(keys, "key", "left_anti"), edges.join(keys.withColumnRenamed("key", "dst_key"), "dst_key", "left_anti"), folded


def sink_buckets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, is_leaf, methods) of a downward trace."""
    ends = leaves(nodes, edges).select("key", F.lit(True).alias("leaf"))
    kind = q.sink_kind(F.col("class"), F.col("file"), F.col("method"))
    return nodes.join(ends, "key", "left").groupBy(kind.alias("kind"), F.coalesce("leaf", F.lit(False)).alias("is_leaf")).agg(F.count("*").alias("nodes"), F.array_sort(F.collect_set(F.concat_ws(".", "class", "method"))).alias("methods"))


def accessor_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, class, accessors): how many accessors that call nothing each file has, and the first class they belong to."""
    gone = leaves(nodes, edges).where(q.is_accessor(F.col("method")))
    return gone.groupBy("file").agg(F.min("class").alias("class"), F.count("*").alias("accessors"))


def entry_groups(chains: DataFrame, key: list[Column]) -> DataFrame:
    """Chains(chain_no, ...) with the same entry as one row, with their numbers, in the order of the first."""
    named = [c.alias(f"k{i}") for i, c in enumerate(key)]
    return chains.select("chain_no", *named).groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.array_sort(F.collect_set("chain_no")).alias("chains"), F.min("chain_no").alias("first")).orderBy("first")


def shown_chain(chain: Column) -> Column:
    """A chain as text, the caller at the top, each step indented below it."""
    top = F.reverse(chain)
    return F.array_join(F.transform(top, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.repeat(F.lit("  "), i), F.lit("└─ "), x))), "\n")


def shown_tree(edges: DataFrame, seed: str, spark: SparkSession, max_depth: int = 8, most: int | None = None) -> DataFrame:
    """(path, line) of the calls below a seed as an indented tree; callees in order, `(cycle)` where a path meets itself.

    With `most`, the first so many rows of it: of each level only the first `most` paths are made, since a path among the
    first of the tree is among the first of its level, as are those above it; so the work is bounded by the rows shown
    and the levels, however many paths there are.
    """
    ways = edges.select("src_key", "dst_key").distinct()
    if most is not None:
        first = F.row_number().over(Window.partitionBy("src_key").orderBy("dst_key"))
        ways = written(ways.withColumn("r", first).where(F.col("r") <= most).drop("r"))
    level = spark.createDataFrame([([seed], False)], "path array<string>, cycle boolean")
    rows = level
    for _ in range(max_depth):
        step = level.where("NOT cycle").withColumn("src_key", F.element_at("path", -1)).join(ways, "src_key")
        told = step.select(F.concat("path", F.array("dst_key")).alias("path"), F.array_contains("path", F.col("dst_key")).alias("cycle"))
        level = written(told if most is None else told.orderBy("path").limit(most))
        if level.isEmpty():
            break
        rows = rows.union(level)
    depth = F.size("path") - 1
    out = rows.select("path", F.concat(F.repeat(F.lit("  "), depth), F.element_at("path", -1), F.when(F.col("cycle"), " (cycle)").otherwise("")).alias("line")).orderBy("path")
    return out if most is None else out.limit(most)
