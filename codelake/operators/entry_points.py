"""Entry points of applications, and the web mappings of controllers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import patterns as p
from codelake.functions.names import mapping_path
from codelake.functions.predicates import entry_kinds, group, has_mappings, is_controller_text, matches, starts_with_any, stripped
from codelake.sources.files import by_file, java_files, lines, package_name
from codelake.sources.store import dealt


def entry_points(files: DataFrame, most_files: int | None = None) -> DataFrame:
    """project, kind, file, line, preview of every line that begins execution, and of public methods of controllers."""
    each = lines(java_files(files, most=most_files).withColumn("controller", is_controller_text(F.col("text"))), keep=["controller"])
    public = F.when(F.col("controller") & matches(F.col("text"), p.PUBLIC_METHOD_LINE), F.lit("controller_public_method"))
    kinds = F.concat(F.array_compact(F.array(public)), entry_kinds(F.col("text")))
    return each.select("project", F.explode(kinds).alias("kind"), F.col("path").alias("file"), F.col("line_no").alias("line"), F.substring(stripped(F.col("text")), 1, 240).alias("preview"))


def _first_literal(parens):
    return F.coalesce(group(parens, r"""["']([^"']+)["']"""), F.lit(""))


def _verb(annotation, parens):
    verb = F.coalesce(group(parens, p.REQUEST_METHOD), F.lit("GET"))
    for name, v in p.VERB.items():
        verb = F.when(annotation == name, v).otherwise(verb)
    return verb


def rest_map(files: DataFrame, most_files: int | None = None) -> DataFrame:
    """http_method, path, class_name, simple_class_name, method_name, file, line, annotation of every mapped method.

    Annotations wait for the class, method or other code below them. Each such line ends a segment of its file, so
    what belongs to it is one group: a running count of segment ends, and an aggregate per segment.
    """
    sources = java_files(files, most=most_files).where(has_mappings(F.col("text"))).withColumn("package", package_name(F.col("text"), 120))
    # dealt as whole texts, once for all windows of a file
    each = lines(dealt(sources, "project", "path"), keep=["package"]).withColumn("s", stripped(F.col("text")))
    annotation = F.startswith("s", F.lit("@"))
    kind = (
        F.when(annotation, "annotation")
        .when(matches(F.col("text"), p.CLASS_LINE), "class")
        .when(matches(F.col("text"), p.METHOD_LINE), "method")
        .when((F.col("s") != "") & ~starts_with_any(F.col("s"), ["//", "*", "import "]), "other")
    )
    each = each.withColumn("kind", kind).where("kind IS NOT NULL")
    ends = F.sum((F.col("kind") != "annotation").cast("int")).over(by_file().rowsBetween(Window.unboundedPreceding, -1))
    of_end = lambda c: F.max(F.when(F.col("kind") != "annotation", c))
    segments = (
        each.withColumn("segment", F.coalesce(ends, F.lit(0)))
        .groupBy("project", "path", "segment")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "annotation", F.struct("line_no", "text")))), lambda x: x["text"]).alias("notes"),
            of_end(F.col("kind")).alias("kind"), of_end(F.col("line_no")).alias("line_no"), of_end(F.col("text")).alias("text"), F.first("package").alias("package"),
        )
        .where("kind IN ('class', 'method')")
    )
    base_note = F.get(F.filter("notes", lambda x: F.contains(x, F.lit("@RequestMapping"))), F.lit(0))
    of_class = F.when(F.col("kind") == "class", F.struct(group(F.col("text"), p.CLASS_LINE).alias("name"), F.coalesce(_first_literal(F.regexp_extract(base_note, r"@RequestMapping\s*(\([^)]*\))?", 1)), F.lit("")).alias("base")))
    methods = segments.withColumn("class", F.last(of_class, ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, -1))).where("kind = 'method'")
    methods = methods.withColumn("method_name", group(F.col("text"), p.METHOD_LINE)).where(~F.col("method_name").isin(p.NOT_METHODS))
    found = methods.withColumn("mapping", F.explode(F.regexp_extract_all(F.array_join("notes", "\n"), F.lit(p.MAPPING), 0)))
    note, parens = F.regexp_extract("mapping", p.MAPPING, 1), F.regexp_extract("mapping", p.MAPPING, 2)
    name = F.col("class.name")
    return found.select(
        "project", _verb(note, parens).alias("http_method"), mapping_path(F.coalesce("class.base", F.lit("")), _first_literal(parens)).alias("path"),
        F.coalesce(F.when(F.col("package").isNotNull() & name.isNotNull(), F.concat_ws(".", "package", name)), name, F.lit("?")).alias("class_name"), name.alias("simple_class_name"),
        "method_name", F.col("path").alias("file"), F.col("line_no").alias("line"), F.concat(F.lit("@"), note).alias("annotation"),
    )
