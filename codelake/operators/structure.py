"""What a project consists of: modules, packages and their top-level types."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.predicates import matches
from codelake.sources.files import gradle_includes, java_files, package_name, poms

KIND = {"class": 5, "record": 5, "interface": 11, "enum": 10}
NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)", re.S)
STEP = re.compile(r"[{}();]|(?<!@)\b(class|interface|enum|record)\s+([A-Za-z_]\w*)")
TYPES = "array<struct<name: string, kind: int, kind_label: string, line: int>>"


def types_in(source: str | None) -> list[tuple[str, int, str, int]]:
    """The types that a source declares outside all braces: the last one named before each opening brace, at that brace's line."""
    code = NOISE.sub(lambda m: "\n" * m[0].count("\n") or " ", source or "")
    braces = parens = 0
    waiting, found = None, []
    for m in STEP.finditer(code):
        c = m[0]
        if m[1]:
            waiting = (m[2], m[1]) if not braces and not parens else waiting
        elif c == "{":
            if not braces and not parens:
                if waiting:
                    found.append((waiting[0], KIND[waiting[1]], waiting[1], code.count("\n", 0, m.start()) + 1))
                waiting = None
            braces += 1 if braces or not parens else 0
        elif c == "}":
            braces = max(0, braces - 1)
        elif not braces:
            parens = max(0, parens + (c == "(") - (c == ")"))
            waiting = None if c == ";" else waiting
    return found


def top_level_types(files: DataFrame, most_files: int | None = None) -> DataFrame:
    """project, package, file, nth, name, kind, kind_label, line. Braces, strings and comments need a scan of the text, in batches and only of files that declare a type."""

    @F.pandas_udf(TYPES)
    def types(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("name", "kind", "kind_label", "line"), t)) for t in types_in(s)] for s in text])

    sources = java_files(files, most=most_files).where(matches(F.col("text"), r"\b(class|interface|enum|record)\s"))
    package = F.coalesce(package_name(F.col("text"), 80), F.lit("")).alias("package")
    return sources.select("project", package, F.col("path").alias("file"), F.posexplode(types("text")).alias("nth", "t")).select("project", "package", "file", "nth", "t.*")


def by_package(types: DataFrame) -> DataFrame:
    """(project, package, types): the types of each package as an ordered array."""
    return types.groupBy("project", "package").agg(F.array_sort(F.collect_list(F.struct("file", "line", "name", "kind", "kind_label"))).alias("types"))


def file_type_names(files: DataFrame) -> DataFrame:
    """(project, path, fqcn): the full name of the first top-level type of every source."""
    t = top_level_types(files)
    return t.groupBy("project", F.col("file").alias("path")).agg(F.min_by(F.concat_ws(".", F.nullif("package", F.lit("")), "name"), "nth").alias("fqcn"))


def modules(files: DataFrame) -> DataFrame:
    """project, name, path, source, has_pom, artifact_id, packaging: one level of Maven modules of the root's file, else the root itself; Gradle includes where there is no Maven."""
    pom = poms(files)
    root = pom.where("path = 'pom.xml'")
    listed = root.select("project", F.explode("modules").alias("m")).select("project", F.regexp_replace("m", "/+$", "").alias("path")).where("path <> ''").distinct().withColumn("source", F.lit("root-pom-modules"))
    single = root.where(F.size("modules") == 0).select("project", F.lit(".").alias("path"), F.lit("single-maven-project").alias("source"))
    gradle = files.where("path IN ('settings.gradle', 'settings.gradle.kts')").select("project", F.explode(gradle_includes(F.col("text"))).alias("path")).distinct().withColumn("source", F.lit("settings-include"))
    gradle = gradle.join(root.select("project"), "project", "left_anti")
    own = pom.select("project", F.when(F.col("path") == "pom.xml", ".").otherwise(F.regexp_replace("path", "/pom.xml$", "")).alias("path"), "artifact_id", "packaging", F.lit(True).alias("found"))
    every = listed.unionByName(single).unionByName(gradle).join(own, ["project", "path"], "left")
    maven = F.col("source") != "settings-include"
    return every.select(
        "project", F.when(F.col("path") == ".", F.coalesce("artifact_id", "project")).otherwise(F.substring_index("path", "/", -1)).alias("name"), "path", "source", F.coalesce("found", F.lit(False)).alias("has_pom"),
        F.when(maven, F.col("artifact_id")).alias("artifact_id"), F.when(maven, F.col("packaging")).alias("packaging"),
    )
