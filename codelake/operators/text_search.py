"""Searching lines for needles, with relevance."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import patterns as p
from codelake.functions.predicates import has_needle, hit_score, matches
from codelake.sources import files as source
from codelake.sources.store import written


def needles_of(query: str) -> list[str]:
    """`a|b` (also with a full-width bar) -> [a, b], each once."""
    return list(dict.fromkeys(x.strip() for x in re.split(r"[|｜]", query) if x.strip()))


def hits(lines: DataFrame, needles: list[str]) -> DataFrame:
    """Lines that hold a needle as written; where there is none in the whole table, those that hold one whatever the case.

    Both kinds are found in one pass and written, being few; which of them it is, is then read from what was written.
    """
    found = written(lines.where(has_needle(F.col("text"), needles)).withColumn("exact", has_needle(F.col("text"), needles, case_sensitive=True)))
    if found.where("exact").limit(1).count():
        found = found.where("exact")
    return found.drop("exact")


def of_files(files: DataFrame, needles: list[str]) -> DataFrame:
    """The lines of those files(project, path, text) in which a needle stands: only these are cut into lines."""
    return source.lines(files.where(has_needle(F.col("text"), needles)))


def search(lines: DataFrame, query: str, most: int | None = 200, by_score: bool = True) -> DataFrame:
    """file, line, text, score of the hits of a query in lines(project, path, line_no, text), or in whole files(project, path, text), best first; the cap comes after the order, so it is the same on every run."""
    needles = needles_of(query)
    each = lines if "line_no" in lines.columns else of_files(lines, needles)
    scored = hits(each, needles).select(F.col("path").alias("file"), F.col("line_no").alias("line"), "text", hit_score(F.col("path"), F.col("text")).alias("score"))
    ordered = scored.orderBy(F.desc("score"), "file", "line") if by_score else scored.orderBy("file", "line")
    return ordered.limit(most) if most is not None else ordered


def method_candidates(hit_lines: DataFrame, lines: DataFrame, forward: int = 220, backward: int = 40, most_forward: int = 36) -> DataFrame:
    """For each hit (project, path, line_no): the lines to try as its method, in order: itself, those below that look like methods, those above."""
    spots = lines.where(matches(F.col("text"), p.METHOD_LIKE)).select("project", "path", F.col("line_no").alias("candidate"))
    asked = hit_lines.select("project", "path", F.col("line_no").alias("hit"))
    near = asked.join(spots, ["project", "path"]).withColumn("away", F.col("candidate") - F.col("hit")).where(f"away BETWEEN 1 AND {forward - 1} OR away BETWEEN {-backward} AND -1")
    below = near.where("away > 0").withColumn("r", F.row_number().over(Window.partitionBy("project", "path", "hit").orderBy("away"))).where(f"r < {most_forward}")
    parts = [asked.select("project", "path", "hit", F.col("hit").alias("candidate"), F.lit(0).alias("side"), F.lit(0).alias("away")), below.select("project", "path", "hit", "candidate", F.lit(1), "away"), near.where("away < 0").select("project", "path", "hit", "candidate", F.lit(2), -F.col("away"))]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("project", "path", "hit").orderBy("side", "away"))).select("project", "path", "hit", "candidate", "rank")
