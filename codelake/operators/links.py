"""Links between facts: mapper files to interfaces, tables to repositories, services and entities, positions to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import patterns as p
from codelake.functions.names import entity_class
from codelake.functions.predicates import group, is_entity_of, matches, repository_call_score, starts_with_any, stripped
from codelake.operators import intervals
from codelake.sources.files import LINE_BREAK, by_file, java_files, lines
from codelake.sources.store import large


def mapper_methods(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked(project, path, line_no) of mapper XML -> the interface method of the statement there, or the reason why there is none.

    The statement is the last id within 48 lines up, also where its tag runs over several lines.
    """
    xml = large(files.join(asked.select("project", "path").distinct(), ["project", "path"], "left_semi"))
    each = statements_at(asked, xml)
    spaces = xml.select("project", "path", F.trim(group(F.col("text"), p.MAPPER_NAMESPACE)).alias("namespace"))
    told = asked.select("project", "path", "line_no").join(spaces, ["project", "path"], "left").join(each, ["project", "path", "line_no"], "left").withColumn("rel", F.concat(F.translate("namespace", ".", "/"), F.lit(".java")))
    sources = java_files(files)
    homes = told.select("project", "rel").distinct().withColumn("name", F.substring_index("rel", "/", -1)).join(sources.select("project", "name", F.col("path").alias("java_file")), ["project", "name"]).where(F.endswith("java_file", F.col("rel")))
    rank = F.when(F.col("java_file") == F.concat(F.lit("src/main/java/"), "rel"), 0).when(F.col("java_file") == F.col("rel"), 1).otherwise(2)
    homes = homes.withColumn("r", F.row_number().over(Window.partitionBy("project", "rel").orderBy(rank, "java_file"))).where("r = 1").select("project", "rel", "java_file")
    placed = told.join(homes, ["project", "rel"], "left")
    called = placed.where("statement_id IS NOT NULL").select("project", "java_file", "statement_id").distinct()
    spots = called.join(lines(sources).withColumnRenamed("path", "java_file"), ["project", "java_file"]).where(~starts_with_any(stripped(F.col("text")), ["//", "*"]) & F.rlike("text", F.concat(F.lit(r"\b\Q"), "statement_id", F.lit(r"\E\s*\("))))
    first = large(spots.groupBy("project", "java_file", "statement_id").agg(F.min(F.struct("line_no", F.length(F.regexp_extract("text", r"^(.*?)\b\w+\s*\(", 1)).alias("c"), "text")).alias("at")))
    character = F.regexp_instr("at.text", F.concat(F.lit(r"\b\Q"), "statement_id", F.lit(r"\E\s*\(")))
    out = placed.join(first, ["project", "java_file", "statement_id"], "left")
    reason = (
        F.when(F.col("namespace").isNull(), "no mapper namespace").when(F.col("statement_id").isNull(), "no statement id around the line")
        .when(F.col("java_file").isNull(), "no source of the interface").when(F.col("at").isNull(), "no such method in the interface")
    )
    return out.select("project", F.col("path").alias("xml_file"), F.col("line_no").alias("xml_line"), "namespace", "statement_id", F.when(F.col("statement_id").isNotNull(), F.col("java_file")).alias("java_file"), F.col("at.line_no").alias("line"), F.when(F.col("at").isNotNull(), character).alias("character"), reason.isNull().alias("ok"), reason.alias("reason"))


def statements(files: DataFrame) -> DataFrame:
    """(project, path, first, last, statement_id): where the tag of each statement with an id begins, and where its id ends, as line numbers.

    The text is cut at the tags, and their lines are running sums of the line breaks before them.
    """
    tag, breaks = F.lit(p.STATEMENT_ID), lambda c: F.size(F.regexp_extract_all(c, F.lit(LINE_BREAK), 0))
    tagged = files.where(F.rlike("text", tag)).select("project", "path", F.split("text", p.STATEMENT_ID).alias("between"), F.regexp_extract_all("text", tag, 0).alias("tags"), F.regexp_extract_all("text", tag, 1).alias("ids"))
    each = tagged.select("project", "path", F.posexplode(F.arrays_zip(F.slice("between", 1, F.size("ids")).alias("between"), F.col("tags"), F.col("ids"))).alias("i", "t"))
    each = each.select("project", "path", "i", breaks(F.col("t.between")).alias("above"), breaks(F.col("t.tags")).alias("within"), F.trim("t.ids").alias("statement_id"))
    so_far = F.sum(F.col("above") + F.col("within")).over(Window.partitionBy("project", "path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("project", "path", (so_far - F.col("within") + 1).cast("int").alias("first"), (so_far + 1).cast("int").alias("last"), "statement_id")


def statements_at(asked: DataFrame, files: DataFrame, most: int = 48) -> DataFrame:
    """asked(project, path, line_no) -> the last statement whose id ends at the line or above, if its tag begins within `most` lines up: one pass over statements and lines in order."""
    found = statements(files).select("project", "path", F.col("last").alias("line_no"), F.struct("first", "statement_id").alias("s"))
    both = found.withColumn("ask", F.lit(0)).unionByName(asked.select("project", "path", "line_no", F.lit(None).cast("struct<first: int, statement_id: string>").alias("s"), F.lit(1).alias("ask")))
    # of statements that end on one line the last begins last
    order = Window.partitionBy("project", "path").orderBy("line_no", "ask", "s.first").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("s", F.last("s", True).over(order)).where("ask = 1")
    return large(told.select("project", "path", "line_no", F.when(F.col("s.first") >= F.col("line_no") - most, F.col("s.statement_id")).alias("statement_id")).distinct())


def repository_calls(tables: DataFrame, files: DataFrame) -> DataFrame:
    """tables(project, table) -> the service method that works most on the table's repository: class file, field, method, line, score."""
    named = tables.select("project", "table", F.concat(entity_class(F.col("table")), F.lit("Repository")).alias("repository"))
    services = java_files(files, r".*ServiceImpl\.java").where("path LIKE '%src/main/%' OR path NOT LIKE '%src/test/%'")
    fields = services.select("project", "path", F.col("name").alias("file_name"), F.explode(F.regexp_extract_all("text", F.lit(r"(?:private|protected)\s+(?:final\s+)?(\w+Repository\s+\w+)\s*;"), 1)).alias("f"))
    fields = fields.select("project", "path", F.regexp_replace("file_name", r"\.java$", "").alias("stem"), F.regexp_extract("f", r"^(\w+)", 1).alias("repository"), F.regexp_extract("f", r"(\w+)$", 1).alias("field"))
    used = named.join(fields, ["project", "repository"])
    code = lines(services)
    public = F.when(matches(F.col("text"), r"^\s*public\b"), F.col("line_no"))
    name = group(F.array_join(F.collect_list(stripped(F.col("text"))).over(by_file().rowsBetween(0, 15)), " "), r"^public\s+(?:static\s+)?(?:final\s+)?(?:[\w.<>,?\[\]]+\s+)+(\w+)\s*\(")
    named_public = F.when(public.isNotNull() & name.isNotNull() & ~name.isin(p.NOT_METHODS), F.struct(F.col("line_no").alias("line"), name.alias("method")))
    told = code.withColumn("np", named_public).withColumn("m", F.last("np", True).over(by_file().rowsBetween(Window.unboundedPreceding, 0)))
    calls = used.join(told, ["project", "path"]).withColumn("score", repository_call_score(F.col("text"), F.col("field"))).where("score >= 0 AND m IS NOT NULL AND m.method <> stem")
    best = calls.withColumn("r", F.row_number().over(Window.partitionBy("project", "table").orderBy(F.desc("score"), "path", "line_no"))).where("r = 1")
    return best.select("project", "table", "repository", F.col("path").alias("service_file"), F.col("stem").alias("service_class"), "field", F.col("m.method").alias("method"), F.col("m.line").alias("method_line"), "score")


def entity_files(tables: DataFrame, files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """tables(project, table) -> the source of the table's entity and its class line; a file that a manifest names goes before one found by its name."""
    named = tables.select("project", "table", entity_class(F.col("table")).alias("entity")).withColumn("name", F.concat("entity", F.lit(".java")))
    by_name = named.join(java_files(files).select("project", "name", "path", "text"), ["project", "name"]).where(is_entity_of(F.col("text"), F.col("entity"), F.col("table"))).select("project", "table", "path", F.lit(1).alias("priority"))
    if hits is not None:
        noted = hits.where("source = 'entity_annotation'").select("project", F.lower("table").alias("key"), F.col("file").alias("path"))
        by_name = by_name.union(named.join(noted, "project").where(F.lower("table") == F.col("key")).select("project", "table", "path", F.lit(0)))
    chosen = by_name.withColumn("r", F.row_number().over(Window.partitionBy("project", "table").orderBy("priority", "path"))).where("r = 1").drop("r", "priority")
    spot = r"\bclass\s+\w+"
    declared = lines(java_files(files)).where(matches(F.col("text"), spot)).groupBy("project", "path").agg(F.min(F.struct("line_no", F.regexp_instr("text", F.lit(spot)).alias("c"))).alias("at"))
    return chosen.join(declared, ["project", "path"], "left").select("project", "table", F.col("path").alias("entity_file"), F.col("at.line_no").alias("class_line"), (F.col("at.c") + 6).alias("class_character"))


def smallest_around(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Each point with the shortest range of its group that holds it; by blocks where places are whole numbers, else (few ranges, such as classes of prices) by an interval join and an arg-min."""
    kinds = dict(points.dtypes) | dict(ranges.dtypes)
    if all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in (at, start, end)):
        return intervals.innermost(points, ranges, by, F.col(at), F.col(start), F.col(end), [F.col(end) - F.col(start), *map(F.col, order)])
    held = points.join(ranges, by).where(F.col(at).between(F.col(start), F.col(end)))
    keys = [*by, *[c for c in points.columns if c not in by]]
    return held.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(end) - F.col(start), *order))).where("r = 1").drop("r")


def symbol_at(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points(path, line, character) -> the innermost symbol there. A character beyond the first million of a line counts as that."""
    place = lambda line, c: F.col(line).cast("long") * (1 << 20) + F.least(F.col(c).cast("long"), F.lit((1 << 20) - 1))
    size = [F.col("end_line") - F.col("start_line"), F.col("end_char") - F.col("start_char"), F.col("sym_id")]
    return intervals.innermost(points, symbols, ["path"], place("line", "character"), place("start_line", "start_char"), place("end_line", "end_char"), size)


def mapper_anchors(hits: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table hits in mapper XML -> (the interface methods of a table's statements, each at its first line; the lines that lead nowhere, with the reason)."""
    spots = hits.where("source LIKE 'mybatis%'").select("project", F.lower("table").alias("table"), F.col("file").alias("path"), F.col("line").alias("line_no")).distinct()
    linked = mapper_methods(spots.select("project", "path", "line_no").distinct(), files).withColumnsRenamed({"xml_file": "path", "xml_line": "line_no"})
    told = spots.join(linked, ["project", "path", "line_no"])
    first = F.row_number().over(Window.partitionBy("project", "table", "java_file", "statement_id").orderBy("path", "line_no"))
    found = told.where("ok").withColumn("r", first).where("r = 1").select("project", "table", "java_file", "statement_id", "line", "character", F.col("path").alias("xml_file"), F.col("line_no").alias("xml_line"))
    return found, told.where("NOT ok").select("project", "table", F.col("path").alias("xml_file"), F.col("line_no").alias("xml_line"), "reason")
