"""Database tables named in source code, and the manifest that groups them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import patterns as p
from codelake.functions.names import physical_table
from codelake.functions.predicates import matches, stripped
from codelake.operators.java_context import enclosing_methods
from codelake.sources.files import java_files, lines, xml_files
from codelake.sources.store import dealt, large

HIDDEN = "\x01"
ESCAPE = r"\\U[0-9a-fA-F]{8}|\\u+[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|(?s)\\.|[^\\]+|\\$"
# brackets with at most one more level inside
SHALLOW = r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\x07", "v": "\x0b", "\n": ""}


def unescaped(literal: Column) -> Column:
    """A string literal as the program sees it: characters by number (eight, four or two hexadecimal or up to three octal digits), control characters, and quotes and backslashes."""

    def one(x: Column) -> Column:
        # ESCAPE has checked the digits: a letter with more behind it is a number
        kind, numbered = F.substring(x, 2, 1), F.length(x) > 2
        unit = lambda digits: F.decode(F.unhex(F.lpad(digits, 4, "0")), "UTF-16BE")
        named = kind
        for code, plain in PLAIN.items():
            named = F.when(kind == code, plain).otherwise(named)
        return (
            F.when(~F.startswith(x, F.lit("\\")) | (F.length(x) < 2), x).when(numbered & (kind == "u"), unit(F.right(x, F.lit(4)))).when(numbered & (kind == "x"), unit(F.right(x, F.lit(2))))
            .when(numbered & (kind == "U"), F.decode(F.unhex(F.right(x, F.lit(8))), "UTF-32")).when(kind.between("0", "7"), unit(F.conv(F.substring(x, 2, 3), 8, 16))).otherwise(named)
        )

    pieces = F.regexp_extract_all(literal, F.lit(ESCAPE), 0)
    return F.when(F.contains(literal, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(literal)


def outer_sql(sql: Column) -> Column:
    """A statement without its string literals and with what stands in parentheses hidden, however deep: where one level inside another is not all, the depth is counted from bracket to bracket."""
    sql = F.when(F.contains(sql, F.lit("'")) | F.contains(sql, F.lit('"')), F.regexp_replace(sql, r"'(?:[^']|'')*'|\"[^\"]*\"", "''")).otherwise(sql)
    state = lambda depth, out: F.struct(depth.alias("depth"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        outside = s["depth"] == 0
        return state(
            s["depth"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0),
            F.when(outside & (x == "("), F.concat(s["out"], F.lit(HIDDEN))).when(outside & (x != ")"), F.concat(s["out"], x)).otherwise(s["out"]),
        )

    def counted(s: Column) -> Column:
        return F.aggregate(F.regexp_extract_all(s, F.lit(r"[()]|[^()]+"), 0), state(F.lit(0), F.lit("")), step)["out"]

    # each form is made once for the next: an array of one is a name for it
    def hidden(s: Column) -> Column:
        flat = F.transform(F.array(F.regexp_replace(s, SHALLOW, HIDDEN)), lambda x: F.when(F.rlike(x, F.lit("[()]")), counted(s)).otherwise(x))
        return F.get(flat, F.lit(0))

    return F.get(F.transform(F.array(sql), lambda s: F.when(F.rlike(s, F.lit("[()]")), hidden(s)).otherwise(s)), F.lit(0))


def _defined(outer: Column) -> Column:
    """The names that WITH defines, in lower case."""
    with_list = F.regexp_extract(outer, rf"(?i)\bWITH\s+(?:RECURSIVE\s+)?((?:[\s,]*\w+\s+AS\s*{HIDDEN})+)", 1)
    names = F.transform(F.regexp_extract_all(with_list, F.lit(rf"(?i)(\w+)\s+AS\s*{HIDDEN}"), 1), F.lower)
    return F.when(F.contains(outer, F.lit(HIDDEN)), names).otherwise(F.array().cast("array<string>"))


def _named(sql: Column, outer: Column) -> Column:
    """The names after FROM, JOIN, INTO and UPDATE, then those after commas of the outer FROM."""
    body = F.regexp_extract(outer, r"(?is)\bFROM\s+(.*)$", 1)
    # not by splitting, which compiles its pattern anew for every statement
    clause = F.regexp_replace(body, f"(?s)(?:{p.END_OF_FROM}).*", "")
    listed = F.transform(F.slice(F.split(clause, ","), 2, 1 << 20), lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)", 1))
    behind = F.when(F.contains(outer, F.lit(",")), F.filter(listed, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(sql, F.lit(p.SQL_TABLE), 1), behind)


def _real(name: Column, defined: Column) -> Column:
    return ~F.upper(name).isin(p.SQL_RESERVED) & (F.contains(name, F.lit(".")) | ~F.array_contains(defined, F.lower(name)))


def tables_of_each(statements: Column) -> Column:
    """The tables that an array of pieces of SQL names, in order: after FROM, JOIN, INTO and UPDATE, then after commas of the outer FROM; without schemas, reserved words and names that WITH defines."""
    # pieces without a trace of SQL go first; the outer statement is an array of its own, so that it is made once for each
    likely = F.filter(statements, lambda x: matches(x, p.SQL_HINT))
    both = F.transform(likely, lambda x: F.struct(x.alias("sql"), outer_sql(x).alias("outer")))
    told = F.transform(both, lambda s: F.struct(_named(s["sql"], s["outer"]).alias("names"), _defined(s["outer"]).alias("defined")))
    real = F.transform(told, lambda s: F.filter(s["names"], lambda x: _real(x, s["defined"])))
    return F.transform(F.flatten(real), lambda x: F.substring_index(x, ".", -1))


def sql_tables(sql: Column) -> Column:
    """The tables that a piece of SQL names."""
    return tables_of_each(F.array(sql))


def annotated_tables(text: Column) -> Column:
    """The tables that entity annotations of a source name."""
    return F.transform(F.regexp_extract_all(text, F.lit(p.TABLE_ANNOTATION), 1), lambda x: F.substring_index(F.trim(x), ".", -1))


def _hit(found: Column, source: str, confidence: str) -> list[Column]:
    return [F.posexplode(found).alias("nth", "table"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.col("path").alias("file"), F.col("line_no").alias("line"), F.substring(stripped(F.col("text")), 1, 240).alias("snippet")]


def java_hits(files: DataFrame, most: int | None = None) -> DataFrame:
    """Tables in entity annotations and in SQL of string literals, these with the method around them."""
    # whole files without a trace of SQL or of an entity are left out before windows move any line
    text = F.col("text")
    noted = F.contains(text, F.lit("@Table("))
    # dealt as whole texts, once for both kinds of hits and for the windows of each file
    found = dealt(java_files(files, most=most).where(matches(text, p.SQL_HINT) | noted), "project", "path")
    notes = lines(found.where(noted)).where(F.contains(text, F.lit("@Table(")) & ~F.contains(text, F.lit("@TableField"))).select("project", *_hit(annotated_tables(text), "entity_annotation", "high"))
    literals = F.concat(F.regexp_extract_all(text, F.lit(p.DOUBLE_QUOTED), 1), F.regexp_extract_all(text, F.lit(p.SINGLE_QUOTED), 1))
    # the cheap test of the line comes first; most lines have no SQL in them
    named = tables_of_each(F.transform(literals, unescaped))
    sql = enclosing_methods(lines(found.where(matches(text, p.SQL_HINT))), matches(text, p.SQL_HINT)).select("project", *_hit(named, "jdbc_sql_literal", "medium"), "java_method", "java_method_line")
    return notes.unionByName(sql, allowMissingColumns=True)


def xml_hits(files: DataFrame, most: int | None = None) -> DataFrame:
    """Tables in `table` attributes and in SQL of double-quoted attributes; SQL in the body of elements is not read."""
    each = lines(xml_files(files, most=most))
    text = F.col("text")
    attributes = F.transform(F.regexp_extract_all(text, F.lit(p.TABLE_ATTRIBUTE), 1), F.trim)
    quoted = tables_of_each(F.regexp_extract_all(text, F.lit(p.DOUBLE_QUOTED), 1))
    return each.select("project", *_hit(attributes, "mybatis_xml", "high")).unionByName(each.where(matches(text, p.SQL_HINT)).select("project", *_hit(quoted, "mybatis_sql_literal", "medium")))


def table_hits(files: DataFrame) -> DataFrame:
    """project, table, source, confidence, file, line, nth, snippet, java_method, java_method_line."""
    return large(java_hits(files).unionByName(xml_hits(files), allowMissingColumns=True))


def canonical_names(hits: DataFrame, user_tables: DataFrame) -> DataFrame:
    """hits with the name as the user list writes it, whatever the case; as found where the list has none."""
    listed = user_tables.select(F.lower("name").alias("key"), F.col("name").alias("canonical"))
    return hits.join(listed, F.lower(hits["table"]) == listed["key"], "left").withColumn("canonical", F.coalesce("canonical", "table")).drop("key")


def unresolved(hits: DataFrame, user_tables: DataFrame) -> DataFrame:
    """Listed tables that no hit names."""
    return user_tables.join(hits.select(F.lower("table").alias("key")).distinct(), F.lower("name") == F.col("key"), "left_anti")


def extracted_only(hits: DataFrame, user_tables: DataFrame) -> DataFrame:
    """Tables that hits name and the list does not."""
    return hits.select("table").distinct().join(user_tables.select(F.lower("name").alias("key")), F.lower("table") == F.col("key"), "left_anti")


def physical_hits(hits: DataFrame) -> DataFrame:
    """hits by physical table; of those with the same table, file, line and source the first stays."""
    keys = ["project", "physical_table", "file", "line", "source"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("nth", "table"))
    return hits.withColumn("physical_table", physical_table(F.col("table"))).withColumn("r", first).where("r = 1").drop("r")


def anchors_by(hits: DataFrame, key: str) -> DataFrame:
    """(project, key, anchors): hits of each table as an ordered array."""
    rest = [c for c in ("file", "line", "nth", "table", "source", "confidence", "snippet", "java_method", "java_method_line") if c in hits.columns]
    return hits.groupBy("project", key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("anchors"))


def first_per_method(hits: DataFrame) -> DataFrame:
    """Of the SQL literals of a table in one method, the first line; placeholder names of unknown methods are blank."""
    named = hits.where("source = 'jdbc_sql_literal' AND file LIKE '%.java'").withColumn("java_method", F.when(F.startswith("java_method", F.lit("_line")), "").otherwise(F.coalesce("java_method", F.lit(""))))
    r = F.row_number().over(Window.partitionBy("project", "table", "file", "java_method").orderBy("line", "nth"))
    return named.withColumn("r", r).where("r = 1").drop("r")


def manifest(files: DataFrame, user_tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a manifest: hits, canonical names, anchors by name and by physical table, unresolved and extracted-only names."""
    hits = table_hits(files)
    listed = hits.select(F.col("table").alias("name")).distinct().withColumn("ordinal", F.struct(F.lower("name"), F.col("name").alias("raw"))) if user_tables is None else user_tables
    named, placed = canonical_names(hits, listed), physical_hits(hits)
    first = F.row_number().over(Window.partitionBy("physical_table").orderBy("ordinal"))
    return {
        "hits": hits,
        "canonical": listed.select("ordinal", "name"),
        "canonical_physical": listed.withColumn("physical_table", physical_table(F.col("name"))).withColumn("r", first).where("r = 1").select("ordinal", "physical_table"),
        "anchors_by_table": anchors_by(named, "canonical"),
        "anchors_by_physical": anchors_by(placed, "physical_table"),
        "unresolved": unresolved(hits, listed),
        "extracted_only": extracted_only(hits, listed),
    }


def rows_of_table(hits: DataFrame, table: str) -> DataFrame:
    """The hits of one physical table, whatever the spelling."""
    return physical_hits(hits).where(F.lower("physical_table") == physical_table(F.lower(F.lit(table))))
