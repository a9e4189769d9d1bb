"""Source trees as tables: files, lines, listed tables, build files, saved reports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from codelake.functions import patterns as p
from codelake.functions.predicates import group, stripped
from codelake.sources import tree
from codelake.sources.store import dealt, large

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
OTHER_BREAK = r"[\r\x0b\x0c\x1c-\x1e\u0085  ]"
BUILD_MARKERS = ("pom.xml", "build.gradle", "build.gradle.kts", ".project", ".classpath")


def by_file() -> WindowSpec:
    """The lines of each file in their order."""
    return Window.partitionBy("project", "path").orderBy("line_no")


def project_root(path: str) -> str:
    """The nearest folder upwards with a build file; else the folder itself, or the one the file is in."""
    start = at = os.path.abspath(path if os.path.isdir(path) else os.path.dirname(path))
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in BUILD_MARKERS):
            return at
        if (up := os.path.dirname(at)) == at:
            return start
        at = up


def read_tree(spark: SparkSession, roots: list[str], globs: str = tree.GLOBS, project: str = "") -> DataFrame:
    """files(project, path, name, ext, text) below folders that all executors see, walked in parallel; folders of build output are never listed, and what lies under several roots comes once."""
    spark.dataSource.register(tree.SourceTree)
    raw = spark.read.format(tree.NAME).option("globs", globs).load(os.pathsep.join(roots))
    return as_files(raw.select(F.lit(project).alias("project"), "path", "text"), overlapping=len(roots) > 1)


def read_files(spark: SparkSession, root: str, globs: str = "*.{java,xml,gradle,kts,kt}", project: str = "") -> DataFrame:
    """files(project, path, name, ext, text): every file under a root, whole, by its path below the root; folders of build output are left out. By Spark's own reader, for stores that are not mounted as folders."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", globs).option("ignoreCorruptFiles", "true").text(root, wholetext=True)
        .select(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")).alias("full"), F.regexp_replace("value", r"^\ufeff", "").alias("text"))
    )
    base = os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    return as_files(raw.select(F.lit(project).alias("project"), F.when(F.startswith("full", F.lit(base)), F.substring("full", len(base) + 1, 1 << 20)).otherwise(F.col("full")).alias("path"), "text"))


def as_files(df: DataFrame, overlapping: bool = False) -> DataFrame:
    """files from any (project, path, text), without build output. Where roots overlap a path can come several times, and only then are the texts shuffled to keep it once."""
    skipped = F.exists(F.split("path", "/"), lambda x: x.isin(p.SKIPPED_FOLDERS))
    named = df.where(~skipped)
    named = named.dropDuplicates(["project", "path"]) if overlapping else named
    name = F.substring_index("path", "/", -1)
    return large(named.select("project", "path", name.alias("name"), F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("").alias("ext"), "text"))


def main_sources(files: DataFrame) -> DataFrame:
    """Only what lies under `src/main` folders, in projects that have any; the whole tree of the others."""
    inside = F.rlike(F.concat(F.lit("/"), F.col("path")), F.lit("/src/main/"))
    standard = files.where(inside).select("project").distinct()
    # only texts outside `src/main` meet the list of projects; the rest passes without a shuffle
    return large(files.where(inside).unionByName(files.where(~inside).join(standard, "project", "left_anti")))


def java_files(files: DataFrame, name: str = r".*\.java", most: int | None = None) -> DataFrame:
    found = main_sources(files.where(F.rlike("name", F.lit(f"^(?:{name})$"))))
    return found.orderBy("project", "path").limit(most) if most is not None else found


def xml_files(files: DataFrame, most: int | None = None) -> DataFrame:
    found = main_sources(files.where((F.col("ext") == "xml") & ~F.startswith("name", F.lit(".")) & ~F.contains(F.concat(F.lit("/"), "path"), F.lit("/test/"))))
    return found.orderBy("project", "path").limit(most) if most is not None else found


def split_lines(text: Column) -> Column:
    """The lines of a text; a line break at the end begins no other line. Texts with plain line feeds only, which most are, need no regular expression."""
    at_end = F.when(F.endswith(text, F.lit("\r\n")), 2).when(F.rlike(F.right(text, F.lit(1)), F.lit(f"^(?:{LINE_BREAK})$")), 1).otherwise(0)
    body = F.substring(text, F.lit(1), F.length(text) - at_end)
    parts = F.when(F.rlike(text, F.lit(OTHER_BREAK)), F.split(body, LINE_BREAK)).otherwise(F.split(body, "\n"))
    return F.when(text != "", parts).otherwise(F.array().cast("array<string>"))


def lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """lines(project, path, line_no, text), numbered from 1, with the columns of the file to `keep`."""
    kept = keep or []
    return large(files.select("project", "path", *kept, F.posexplode(split_lines(F.col("text"))).alias("n", "text")).select("project", "path", (F.col("n") + 1).alias("line_no"), "text", *kept))


def package_name(text: Column, most_lines: int) -> Column:
    """The package that a source declares within its first lines, else null."""
    head = F.slice(split_lines(text), 1, most_lines)
    return F.regexp_extract(F.get(F.filter(head, lambda x: F.rlike(x, F.lit(p.PACKAGE))), F.lit(0)), p.PACKAGE, 1)


def of_files(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """The lines of the files that are asked about, before windows move them."""
    # dealt once, for the join and for the windows of each file
    return large(dealt(lines, "project", "path").join(large(dealt(asked.select("project", "path"), "project", "path")), ["project", "path"], "left_semi"))


def around(c: Column, before: int, after: int, how=F.max) -> Column:
    """An aggregate over the lines from `before` above to `after` below, in the same file."""
    return how(c).over(by_file().rowsBetween(-before, after))


def _named_once(names: DataFrame) -> DataFrame:
    """user_tables(ordinal, name): of names that differ in case only, the first."""
    first = names.where("name <> ''").groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("ordinal", "name")).alias("n"))
    return first.select("n.ordinal", "n.name").withColumn("ordinal", F.row_number().over(Window.orderBy("ordinal")))


def listed_lines(listed: DataFrame) -> DataFrame:
    """user_tables(ordinal, name) from the lines(ordinal, text) of a list: `#` begins a comment."""
    return _named_once(listed.select("ordinal", stripped(F.regexp_replace("text", "#.*$", "")).alias("name")))


def listed_tables(spark: SparkSession, text: str = "", inline: str = "") -> DataFrame:
    """user_tables(ordinal, name) from a list file's text (one a line, `#` begins a comment), then an inline list (`,` or its full-width form)."""
    both = spark.createDataFrame([(0, text.removeprefix("﻿")), (1, inline)], "part int, text string")
    pieces = both.select("part", F.posexplode(F.when(F.col("part") == 0, F.split("text", LINE_BREAK)).otherwise(F.split("text", "[,，]"))).alias("i", "raw"))
    name = stripped(F.when(F.col("part") == 0, F.regexp_replace("raw", "#.*$", "")).otherwise(F.col("raw")))
    return _named_once(pieces.select((F.col("part").cast("long") * 1_000_000_000 + F.col("i")).alias("ordinal"), name.alias("name")))


def xml_values(text: Column, tag: str) -> Column:
    """The texts of all elements of a name, whatever their namespace prefix, in document order. Read by pattern, since a file that is not well formed must not stop the job."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<(?:[\w.\-]+:)?{tag}(?:\s[^>]*)?>([^<]*)</"), 1), lambda x: stripped(x))


def poms(files: DataFrame) -> DataFrame:
    """(project, path, artifact_id, packaging, pom_name, modules) of Maven files: the first artifactId of the document, the last packaging, whatever the namespace."""
    bare = files.where("name = 'pom.xml'").select("project", "path", F.regexp_replace("text", r"(?s)<!--.*?-->", "").alias("text"))
    text = F.col("text")
    listed = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<(?:[\w.\-]+:)?modules(?:\s[^>]*)?>(.*?)</(?:[\w.\-]+:)?modules>"), 1), "")
    return bare.select(
        "project", "path", F.get(xml_values(text, "artifactId"), F.lit(0)).alias("artifact_id"), F.try_element_at(xml_values(text, "packaging"), F.lit(-1)).alias("packaging"),
        F.get(xml_values(text, "name"), F.lit(0)).alias("pom_name"), F.filter(xml_values(listed, "module"), lambda x: x != "").alias("modules"),
    )


def gradle_includes(text: Column) -> Column:
    """The modules that a settings file includes, as paths, each once."""
    inner = F.array_join(F.regexp_extract_all(text, F.lit(r"include\s*\(\s*([^)]+)\)"), 1), "\n")
    listed = F.concat(F.regexp_extract_all(inner, F.lit(r"""['"]([^'"]+)['"]"""), 1), F.regexp_extract_all(text, F.lit(r"""include\s+['"]([^'"]+)['"]"""), 1))
    return F.array_distinct(F.filter(F.transform(listed, lambda x: F.translate(F.regexp_replace(F.trim(x), "^:+", ""), ":", "/")), lambda x: x != ""))


def report_payload(text: Column) -> Column:
    """The JSON of a saved report: the text itself, or the last fenced block after its heading of raw JSON."""
    t = stripped(text)
    block = group(t, r"(?s).*##\s*(?:原始 JSON|Raw JSON)\s*```(?:json)?\s*(.*?)```")
    return F.when(F.startswith(t, F.lit("{")), t).otherwise(F.trim(block))
