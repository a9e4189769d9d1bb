"""The innermost of many ranges around a point, without joining all ranges of a group to all of its points.

A range is cut into the dyadic blocks that cover it exactly (at most two of each power of two), and of all ranges that
share a block only the smallest is kept, so there is one row a block. A point lies in one block of each size; it looks
up only the sizes that occur, and takes the smallest range it meets. That is linear in ranges and points but for the
logarithm of the places, whatever a group (a file) holds and however its ranges overlap, and keys are blocks, not
groups, so no large group is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.sources.store import written

MOST_BITS = 62


def blocks(start: Column, end: Column, bits: int) -> Column:
    """The dyadic blocks (level, block) that make up start to end, both included and not negative; block b of a level holds the places b * 2^level and on."""
    none = F.array().cast("array<struct<level: int, block: bigint>>")
    state = F.struct(start.cast("long").alias("l"), (end.cast("long") + 1).alias("r"), none.alias("out"))

    def step(s: Column, level: Column) -> Column:
        one = lambda take, block: F.when(take, F.array(F.struct(level.alias("level"), block.alias("block")))).otherwise(none)
        left = (s["l"] < s["r"]) & (s["l"] % 2 == 1)
        l = F.when(left, s["l"] + 1).otherwise(s["l"])
        right = (l < s["r"]) & (s["r"] % 2 == 1)
        r = F.when(right, s["r"] - 1).otherwise(s["r"])
        return F.when(s["l"] < s["r"], F.struct(F.shiftright(l, 1).alias("l"), F.shiftright(r, 1).alias("r"), F.concat(s["out"], one(left, s["l"]), one(right, r)).alias("out"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), state, step, lambda s: s["out"])


def innermost(points: DataFrame, ranges: DataFrame, by: list[str], at: Column, start: Column, end: Column, size: list[Column]) -> DataFrame:
    """points with the columns of the range of their group (`by`) that holds them and comes first by `size`; points in no range are left out.

    at, start and end are whole numbers from 0 on; ranges that end before they start hold nothing, as do those with nulls.
    """
    held = ranges.where((start >= 0) & (start <= end))
    top = held.agg(F.max(end.cast("long"))).first()[0]
    if top is None:
        return points.join(ranges.limit(0), by)
    bits = min(MOST_BITS, int(top + 1).bit_length())
    rest = [c for c in ranges.columns if c not in by]
    cut = held.select(*by, F.struct(*rest).alias("_range"), F.struct(*size).alias("_size"), F.explode(blocks(start, end, bits)).alias("_b"))
    cut = written(cut.groupBy(*by, "_b.level", "_b.block").agg(F.min_by("_range", "_size").alias("_range"), F.min("_size").alias("_size")))
    levels = sorted(r[0] for r in cut.select("level").distinct().collect())  # one row a power of two
    spots = points.select(*by, at.cast("long").alias("_at")).where("_at >= 0").distinct()
    asked = spots.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("block", F.expr("shiftright(_at, level)"))
    found = asked.join(cut, [*by, "level", "block"]).groupBy(*by, "_at").agg(F.min_by("_range", "_size").alias("_range"))
    placed = points.withColumn("_at", at.cast("long")).join(found, [*by, "_at"])
    return placed.select(*points.columns, *[F.col(f"_range.{c}").alias(c) for c in rest])
