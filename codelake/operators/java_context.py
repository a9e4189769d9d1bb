"""What stands around a line of Java: its method, its documentation comment, the mapping of a trace's top entry, flags of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from codelake.functions import patterns as p
from codelake.functions.names import entry_path
from codelake.functions.predicates import any_of, group, is_bare_brace, is_method_line, markers, matches, method_at, stripped
from codelake.sources.files import around, by_file, of_files
from codelake.sources.store import large

FILE_LINE = ["project", "path", "line_no"]


def above() -> WindowSpec:
    return by_file().rowsBetween(Window.unboundedPreceding, -1)


def up_to() -> WindowSpec:
    return by_file().rowsBetween(Window.unboundedPreceding, 0)


def enclosing_methods(lines: DataFrame, asked: Column | None = None) -> DataFrame:
    """lines with java_method and java_method_line: the first declaration from the line down within 48 lines, else the nearest one up within 160.

    Looking down first suits annotations above signatures; a line inside a body can so be given to the next method.
    Lines are numbered without gaps. With `asked` only the lines where it holds are returned, and only they and likely
    declarations are moved and sorted. Both lookups carry the last declaration along, once in each direction.
    """
    text = F.col("text")
    if asked is not None:
        lines = lines.withColumn("asked", F.coalesce(asked, F.lit(False))).where(F.col("asked") | F.contains(text, F.lit("(")) & matches(text, p.LIKELY_DECLARATION))
    told = lines.withColumn("name", method_at(text)).withColumn("found", F.when(F.col("name").isNotNull(), F.struct("line_no", "name")))
    nearest = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy("project", "path").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("down", nearest(F.col("found"), F.desc("line_no"))).withColumn("up", nearest(F.when(F.col("found").isNotNull() & ~F.startswith(stripped(text), F.lit("//")), F.col("found")), F.asc("line_no")))
    if asked is not None:
        told = told.where("asked")
    m = F.coalesce(F.when(F.col("down.line_no") < F.col("line_no") + 48, F.col("down")), F.when(F.col("up.line_no") > F.col("line_no") - 160, F.col("up")))
    kept = [c for c in lines.columns if c != "asked"]
    return told.withColumn("m", m).select(*kept, F.coalesce("m.name", F.concat(F.lit("_line"), "line_no")).alias("java_method"), F.coalesce("m.line_no", "line_no").alias("java_method_line"))


def node_flags(lines: DataFrame) -> DataFrame:
    """Per line, what a call-graph node there is marked with: web mappings, listeners, schedulers, asynchronous calls, abstract classes, transactions."""
    text = F.col("text")
    mapping = any_of([F.contains(text, F.lit(f"@{m}")) for m in p.MAPPINGS])
    near = F.array_join(F.collect_list("text").over(by_file().rowsBetween(-35, 2)), "\n")
    flagged = lines.select(
        *FILE_LINE, around(mapping, 8, 2).alias("is_rest"), near.alias("near"),
        around(F.contains(text, F.lit(" class ")) & F.contains(text, F.lit("abstract class")), 120, 0).alias("is_abstract_class"),
        around(matches(text, r"@Transactional\b"), 120, 0).alias("is_transactional"),
    )
    marked = flagged.select(
        *FILE_LINE, "is_rest", "is_abstract_class", "is_transactional",
        markers(F.col("near"), p.LISTENER_MARKERS, 6).alias("listener_markers"), markers(F.col("near"), p.SCHEDULED_MARKERS, 4).alias("scheduled_markers"), markers(F.col("near"), p.ASYNC_MARKERS, 1).alias("async_markers"),
    )
    return marked.withColumns({"is_message_listener": F.size("listener_markers") > 0, "is_scheduled_task": F.size("scheduled_markers") > 0, "is_async_method": F.size("async_markers") > 0})


def _plain(text):
    """A line that is neither blank nor an annotation."""
    s = stripped(text)
    return (s != "") & ~F.startswith(s, F.lit("@"))


def javadocs(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """asked(project, path, line_no) -> javadoc: the comment right above the method that each line belongs to, else null.

    The method is the first signature within 16 lines down, else the nearest within 48 up. A closing brace right
    above it means there is no comment.
    """
    lines = of_files(lines, asked)
    text = F.col("text")
    at = lambda c: F.when(c, F.col("line_no"))
    told = lines.select(
        *FILE_LINE, "text",
        F.coalesce(F.first(at(is_method_line(text)), True).over(by_file().rowsBetween(0, 15)), F.last(at(is_method_line(text)), True).over(by_file().rowsBetween(-47, 0)), "line_no").alias("signature"),
        F.last(at(_plain(text)), True).over(above()).alias("above"),
        F.last(at(F.contains(text, F.lit("/**"))), True).over(up_to()).alias("opening"),
        F.first(at(F.contains(text, F.lit("*/"))), True).over(by_file().rowsBetween(0, 199)).alias("closing"),
    )
    pick = lambda *cols: told.select("project", "path", *cols)
    by = ["project", "path"]
    spots = asked.select(*FILE_LINE).join(told.select(*FILE_LINE, "signature"), FILE_LINE)
    spots = spots.join(pick(F.col("line_no").alias("signature"), "above"), [*by, "signature"])
    spots = spots.join(pick(F.col("line_no").alias("above"), "opening", F.col("text").alias("above_text")), [*by, "above"]).where(~is_bare_brace(F.col("above_text")))
    spots = spots.join(pick(F.col("line_no").alias("opening"), "closing"), [*by, "opening"]).where("closing IS NOT NULL")
    block = spots.join(pick(F.col("line_no").alias("n"), "text"), by).where("n BETWEEN opening AND closing")
    joined = block.groupBy(*FILE_LINE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("raw"))
    body = F.regexp_replace(stripped(F.regexp_replace("raw", r"(?s)^\s*/\*\*?\s*", "")), r"\s*\*/\s*$", "")
    clean = F.array_join(F.transform(F.split(body, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"^\s*\*\s?", ""))), "\n")
    found = large(joined.select(*FILE_LINE, F.nullif(stripped(clean), F.lit("")).alias("javadoc")))
    return large(asked.select(*FILE_LINE).join(found, FILE_LINE, "left"))


def top_entries(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """asked(project, path, line_no) -> class_base_path, http_method, rest_path, rest_summary, javadoc of the method that each line belongs to."""
    lines = of_files(lines, asked)
    text, s = F.col("text"), stripped(F.col("text"))
    by = ["project", "path"]
    signature = matches(s, r"^(public|private|protected|static)") & F.contains(s, F.lit("("))
    told = lines.select(
        *FILE_LINE, "text", s.alias("s"), F.coalesce(F.last(F.when(signature, F.col("line_no")), True).over(up_to()), "line_no").alias("signature"),
        F.coalesce(F.last(F.when(_plain(text), F.col("line_no")), True).over(above()), F.lit(0)).alias("stop"),
    )
    spots = asked.select(*FILE_LINE).join(told.select(*FILE_LINE, "signature"), FILE_LINE)
    spots = spots.join(told.select(*by, F.col("line_no").alias("signature"), "stop"), [*by, "signature"])
    one_of = F.regexp_extract("s", "@(" + "|".join(p.MAPPINGS) + ")", 1)
    notes = told.where(F.startswith("s", F.lit("@")) & (one_of != "")).select(*by, "stop", F.col("line_no").alias("n"), "s")
    first = spots.join(notes, [*by, "stop"]).where("n < signature").groupBy(*FILE_LINE).agg(F.min_by("s", "n").alias("s"))
    note = F.coalesce(*[F.when(F.contains("s", F.lit(f"@{m}")), m) for m in p.MAPPINGS])
    verb = F.coalesce(group(F.col("s"), r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH)"), F.lit("GET"))
    for name, v in p.VERB.items():
        verb = F.when(note == name, v).otherwise(verb)
    literal = lambda key, c: group(c, rf"""{key}\s*["']([^"']+)["']""")
    sub = F.coalesce(literal(r"\(", F.col("s")), literal(r"value\s*=", F.col("s")), literal(r"path\s*=", F.col("s")), F.lit(""))
    mapped = large(first.select(*FILE_LINE, verb.alias("http_method"), sub.alias("sub")))
    public = lines.where(matches(text, r"^\s*public\s+class\s+")).groupBy(*by).agg(F.min("line_no").alias("class_line"))
    opened = lambda key: literal(r"@RequestMapping\s*\(\s*" + key, text)
    base = F.coalesce(opened(r"path\s*="), opened(r"value\s*="), opened(""))
    bases = large(lines.join(public, by, "left").where("class_line IS NULL OR line_no < class_line").withColumn("base", base).where("base IS NOT NULL").groupBy(*by).agg(F.trim(F.max_by("base", "line_no")).alias("base")))
    notes_of = javadocs(large(spots).select(*by, F.col("signature").alias("line_no")).distinct(), lines).withColumnRenamed("line_no", "signature").join(spots, [*by, "signature"]).select(*FILE_LINE, "javadoc")
    out = asked.select(*FILE_LINE).join(mapped, FILE_LINE, "left").join(bases, by, "left").join(large(notes_of), FILE_LINE, "left")
    path = F.nullif(entry_path(F.coalesce("base", F.lit("")), F.coalesce("sub", F.lit(""))), F.lit(""))
    return out.select(
        *FILE_LINE, F.concat(F.lit("/"), F.regexp_replace(F.nullif(F.col("base"), F.lit("")), "^/+", "")).alias("class_base_path"), "http_method", path.alias("rest_path"),
        F.when(path.isNotNull(), F.concat_ws(" ", "http_method", path)).alias("rest_summary"), "javadoc",
    )


def flagged_nodes(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Call-graph nodes(key, class, method, file, line, ...) with the flags of the lines they stand on; false where the source is not at hand."""
    flags = node_flags(lines).withColumnsRenamed({"path": "file", "line_no": "line"})
    at = ["project", "file", "line"] if "project" in nodes.columns else ["file", "line"]
    names = [c for c in flags.columns if c not in ("project", "file", "line")]
    joined = nodes.drop(*names).join(flags.select(*at, *names), at, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in names if c.startswith("is_")})
