"""How many chains of callers there are, where they end and why, without listing them.

`call_graph.trace_up` makes every simple path, of which there can be exponentially many. Here paths are counted: nodes
on cycles are condensed into their strongly connected parts, simple paths are enumerated only inside a part, and over
the acyclic rest counts are added up, level by level for all seeds at once. That is exact: a simple path passes through
a part in one piece, so its pieces are independent of each other. Work grows with seeds x nodes x levels, and with the
paths inside single parts; `most_paths` turns too many of these into an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.plans import call_graph
from codelake.sources.store import written

COUNT = "decimal(38,0)"


def on_cycles(edges: DataFrame) -> DataFrame:
    """edges(src_key, dst_key) without those that no cycle passes near: nodes that nobody calls, or that call nobody, are taken away until there are none."""
    now = written(edges.select("src_key", "dst_key").distinct())
    n = now.count()
    while n:
        heads, tails = now.select(F.col("dst_key").alias("src_key")).distinct(), now.select(F.col("src_key").alias("dst_key")).distinct()
        now = written(now.join(heads, "src_key", "left_semi").join(tails, "dst_key", "left_semi"))
        if (left := now.count()) == n:
            break
        n = left
    return now


def strong_parts(edges: DataFrame) -> DataFrame:
    """(key, part) of all nodes on cycles: the strongly connected part of each, named by its greatest key.

    Every node takes the greatest key from which it can be reached; of the nodes with the same one, those that reach that
    key back are a part. Parts that were found leave, and the rest goes on.
    """
    rest = on_cycles(edges)
    found = rest.select(F.col("src_key").alias("key"), F.col("src_key").alias("part")).limit(0)
    while not rest.isEmpty():
        label = written(rest.select(F.col("src_key").alias("key")).union(rest.select("dst_key")).distinct().withColumn("part", F.col("key")))
        changed = label
        while not changed.isEmpty():
            ahead = changed.join(rest, F.col("key") == F.col("src_key")).groupBy(F.col("dst_key").alias("key")).agg(F.max("part").alias("new"))
            told = written(label.join(ahead, "key", "left").select("key", F.greatest("part", "new").alias("part"), (F.col("new") > F.col("part")).alias("up")))
            changed, label = told.where("up").select("key", "part"), told.select("key", "part")
        ends = lambda end: label.select(F.col("key").alias(f"{end}_key"), F.col("part").alias(f"{end}_part"))
        same = written(rest.join(ends("src"), "src_key").join(ends("dst"), "dst_key").where("src_part = dst_part").select("src_key", "dst_key"))
        back = same.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"))
        part = written(call_graph.depths(back, label.where("key = part").select("key")).select("key").join(label, "key"))
        # a node that left only to be its own part has to have a call of its own
        alone = part.groupBy("part").agg(F.count("*").alias("n")).where("n = 1").select("part")
        loops = rest.where("src_key = dst_key").select(F.col("src_key").alias("part")).distinct()
        found = written(found.union(part.join(alone.join(loops, "part", "left_anti"), "part", "left_anti").select("key", "part")))
        gone = part.select("key")
        rest = on_cycles(rest.join(gone.withColumnRenamed("key", "src_key"), "src_key", "left_anti").join(gone.withColumnRenamed("key", "dst_key"), "dst_key", "left_anti"))
    return found


def inner_paths(parts: DataFrame, ways: DataFrame, flags: DataFrame, max_depth: int, most_paths: int | None) -> tuple[DataFrame, DataFrame]:
    """(pieces(entry, at, steps, m), cycles(entry, at, steps, m)): how many simple paths lead from each node of a part to each other one in so many steps, and how many run into themselves; nothing goes on from a node at which chains end."""
    own = parts.select(F.col("key").alias("at"), "part").join(ways, "at").join(parts.select(F.col("key").alias("next"), F.col("part").alias("other")), "next").where("part = other").select("at", "next")
    inner = written(own.join(flags.select(F.col("key").alias("at")), "at", "left_anti"))
    now = parts.select(F.col("key").alias("entry"), F.array("key").alias("path"), F.col("key").alias("at"))
    pieces, cycles = None, None
    for steps in range(max_depth + 1):
        n = now.count()
        if most_paths is not None and n > most_paths:
            raise ValueError(f"{n} paths inside parts that call themselves; at most {most_paths} are asked for")
        counted = written(now.groupBy("entry", "at").agg(F.count("*").alias("m")).withColumn("steps", F.lit(steps)))
        pieces = counted if pieces is None else pieces.union(counted)
        ahead = now.join(inner, "at").select("entry", "path", F.col("next").alias("at"), F.array_contains("path", F.col("next")).alias("again"))
        ahead = written(ahead)
        closed = ahead.where("again").groupBy("entry", "at").agg(F.count("*").alias("m")).withColumn("steps", F.lit(steps + 1))
        cycles = closed if cycles is None else cycles.union(closed)
        now = ahead.where("NOT again").select("entry", F.concat("path", F.array("at")).alias("path"), "at")
        if now.isEmpty():
            break
    return written(pieces), written(cycles)


def chain_counts(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 20, most_paths: int | None = 1_000_000) -> DataFrame:
    """seeds(key) -> (seed, top, stop_reason, length, chains): what `trace_up` would list, counted by where chains end, why, and how many keys they have."""
    stops = [F.when(F.coalesce(c, F.lit(False)), r) for c, r in call_graph.STOPS if c in nodes.columns]
    flags = nodes.select("key", (F.coalesce(*stops) if stops else F.lit(None).cast("string")).alias("node_stop")).where("node_stop IS NOT NULL")
    # what every level reads is made once, however it is derived
    flags, seeds = written(flags), written(seeds.select("key").distinct())
    back = written(edges.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key")).distinct())
    near = call_graph.depths(back, seeds, max_depth).select("key")
    back = written(back.join(near.withColumnRenamed("key", "src_key"), "src_key", "left_semi"))
    ways = back.select(F.col("src_key").alias("at"), F.col("dst_key").alias("next"))
    parts = strong_parts(back)
    pieces, cycles = inner_paths(parts, ways, flags, max_depth, most_paths)
    ends = lambda c: parts.select(F.col("key").alias(c), F.col("part").alias(f"{c}_part"))
    outer = written(ways.join(ends("at"), "at", "left").join(ends("next"), "next", "left").where("at_part IS NULL OR next_part IS NULL OR at_part <> next_part").select("at", "next"))
    called = ways.select("at").distinct().withColumn("has_callers", F.lit(True))

    open_ = seeds.select(F.col("key").alias("seed"), "key").distinct().select("seed", "key", F.lit(0).alias("depth"), F.lit(1).cast(COUNT).alias("n"))
    done = None
    for depth in range(max_depth + 1):
        now = open_.where(F.col("depth") == depth).withColumnRenamed("key", "entry")
        through = now.join(pieces, "entry", "left").select("seed", F.coalesce("at", "entry").alias("at"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"), (F.col("n") * F.coalesce("m", F.lit(1))).cast(COUNT).alias("n")).where(F.col("depth") <= max_depth)
        told = through.join(flags.withColumnRenamed("key", "at"), "at", "left").join(called, "at", "left")
        reason = F.coalesce("node_stop", F.when(F.col("depth") >= max_depth, "max_depth"), F.when(F.col("has_callers").isNull(), "no_incoming"))
        told = written(told.select("seed", "at", "depth", "n", reason.alias("stop_reason")))
        closed = now.join(cycles, "entry").select("seed", "at", (F.col("depth") + F.col("steps")).alias("depth"), (F.col("n") * F.col("m")).cast(COUNT).alias("n"), F.lit("cycle").alias("stop_reason")).where(F.col("depth") <= max_depth)
        ended = written(told.where("stop_reason IS NOT NULL").union(closed).groupBy("seed", "at", "stop_reason", "depth").agg(F.sum("n").cast(COUNT).alias("n")))
        done = ended if done is None else done.union(ended)
        ahead = told.where("stop_reason IS NULL").join(outer, "at").select("seed", F.col("next").alias("key"), (F.col("depth") + 1).alias("depth"), "n")
        open_ = written(open_.where(F.col("depth") > depth).union(ahead).groupBy("seed", "key", "depth").agg(F.sum("n").cast(COUNT).alias("n")))
        if open_.isEmpty():
            break
    total = done.groupBy("seed", F.col("at").alias("top"), "stop_reason", (F.col("depth") + 1).alias("length")).agg(F.sum("n").cast(COUNT).alias("chains"))
    return total


def summary(counts: DataFrame) -> DataFrame:
    """(seed, chain_count, stop_reasons, tops): for each seed what `reports.chain_summary` says of listed chains; the first 12 tops."""
    reasons = counts.groupBy("seed", "stop_reason").agg(F.sum("chains").cast(COUNT).alias("n")).groupBy("seed").agg(F.sum("n").cast(COUNT).alias("chain_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stop_reason", "n")))).alias("stop_reasons"))
    return reasons.join(counts.groupBy("seed").agg(F.slice(F.array_sort(F.collect_set("top")), 1, 12).alias("tops")), "seed")
