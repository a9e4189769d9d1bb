"""Predicates and scores over lines, files and graph nodes, as Column -> Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions import patterns as p


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([F.contains(c, F.lit(w)) for w in words])


def starts_with_any(c: Column, words: list[str]) -> Column:
    return any_of([F.startswith(c, F.lit(w)) for w in words])


def ends_with_any(c: Column, words: list[str]) -> Column:
    return any_of([F.endswith(c, F.lit(w)) for w in words])


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once, however often f uses it; inside arrays too, where Spark computes each use anew. An array of one element would do as well, but its element's type is worked out for every row."""
    return F.aggregate(F.array().cast("array<int>"), c, lambda x, _: x, f)


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def group(c: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match, or null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def stripped(c: Column) -> Column:
    """Without the white space at both ends. Trimmed, which costs a tenth of the pattern; only before a last line break of another kind does the pattern see an end."""
    before_break = any_of([F.endswith(c, F.lit(x)) for x in "\u0085\u2028\u2029"])
    return F.when(before_break, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.trim(c, F.lit(" \t\n\x0b\f\r")))


def has_needle(text: Column, needles: list[str], case_sensitive: bool = False) -> Column:
    """Any of the needles is a substring."""
    found = [F.contains(text, F.lit(n)) for n in needles if n]
    if not case_sensitive:
        found += [F.contains(F.lower(text), F.lit(n.lower())) for n in needles if n]
    return any_of(found)


def hit_score(path: Column, text: Column) -> Column:
    """Relevance of a text hit: services and controllers, then signatures; class declarations and interfaces last."""
    t = stripped(text)
    modifier = starts_with_any(t, ["public ", "private ", "protected "])
    return (
        F.when(contains_any(path, ["ServiceImpl", "Controller"]), 25).when(F.contains(path, F.lit("Service")) & ~F.contains(path, F.lit("Impl")), 12).otherwise(0)
        + F.when(F.contains(path, F.lit("Repository")), 8).otherwise(0)
        + F.when(modifier & F.contains(t, F.lit("(")), 15).when(modifier, 6).otherwise(0)
        + F.when(F.contains(t, F.lit("@")), 5).otherwise(0)
        - F.when(matches(t, r"^\s*(public|private|protected|static)\s+class\s+"), 20).otherwise(0)
        - F.when(F.contains(t, F.lit("interface ")) & ~F.contains(F.substring(t, 1, 80), F.lit("{")), 10).otherwise(0)
    )


def line_kinds(text: Column, kinds: list[tuple[str, str]]) -> Column:
    """The kinds whose pattern a line matches, in the order of the list."""
    return F.array_compact(F.array(*[F.when(matches(text, r), F.lit(k)) for k, r in kinds]))


def entry_kinds(text: Column) -> Column:
    """The kinds of entry point that a line shows."""
    return line_kinds(text, p.ENTRYPOINTS)


def is_controller_text(text: Column) -> Column:
    return matches(text, p.REST_CONTROLLER) | matches(text, p.CONTROLLER)


def has_mappings(text: Column) -> Column:
    """A file whose web mappings are read: a controller, or a mapping at the start of a line."""
    return is_controller_text(text) | any_of([matches(text, rf"(?m)^\s*@{m}\b") for m in p.MAPPINGS])


def markers(text: Column, labels: list[tuple[str, str]], most: int) -> Column:
    return F.slice(F.array_compact(F.array(*[F.when(matches(text, p.BY_KIND[k]), F.lit(label)) for label, k in labels])), 1, most)


def _declared(s: Column, kind: Column, name: Column) -> Column:
    typed = matches(kind, p.TYPE_WORDS) | matches(kind, r"(?:^|\s)\p{Lu}\S*\z")
    skipped = (s == "") | starts_with_any(s, ["@", "//", "*", "/*", *p.STATEMENT_STARTS])
    return F.when(~skipped & ~name.isin(p.NOT_NAMES) & typed, name)


DECLARED = r"^([\w.<>,?\[\]\s]+?)\s+(\w+)\s*\("


def declared_method(text: Column) -> Column:
    """The name of the method that a line seems to declare, else null."""
    s = stripped(text)
    return _declared(s, stripped(F.regexp_extract(s, DECLARED, 1)), group(s, DECLARED, 2))


def modified_method(text: Column) -> Column:
    """The name in a line that begins with a modifier and goes on like a signature, else null."""
    name = group(text, r"^\s*(?:public|protected|private|static)\s+[\w.<>,?\[\]\s]+\s+(\w+)\s*\(")
    return F.when(~name.isin(["if", "for", "while", "switch"]), name)


def method_at(text: Column) -> Column:
    return F.coalesce(declared_method(text), modified_method(text))


def method_once(text: Column) -> Column:
    """method_at where text is an element of an array: there each use of an expression computes it anew."""
    kind = lambda s: bound(F.regexp_extract(s, DECLARED, 1), stripped)
    declared = bound(stripped(text), lambda s: bound(F.struct(kind(s).alias("kind"), group(s, DECLARED, 2).alias("name")), lambda m: _declared(s, m["kind"], m["name"])))
    return F.coalesce(declared, modified_method(text))


def is_method_line(text: Column) -> Column:
    """A line that a documentation comment may stand above."""
    t = stripped(text)
    return ~starts_with_any(t, ["//", "/*"]) & matches(t, r"^(?:public|protected|private)\b") & ~matches(t, r"\b(?:class|interface|enum)\s+\w+") & F.contains(t, F.lit("("))


def is_bare_brace(text: Column) -> Column:
    return matches(stripped(text), r"^}\s*;?\s*$")


def bare_method(method: Column) -> Column:
    """A method without its return type: `getA() : String` -> `getA()`."""
    return F.trim(F.substring_index(F.trim(method), " : ", 1))


def is_accessor(method: Column) -> Column:
    return matches(bare_method(method), p.ACCESSOR)


def accessor_kind(method: Column) -> Column:
    s = accessor_name(method)
    return F.when(F.startswith(s, F.lit("set")), "set").when(F.startswith(s, F.lit("get")), "get").when(F.startswith(s, F.lit("is")), "is").otherwise("unknown")


def accessor_name(method: Column) -> Column:
    return F.trim(F.substring_index(bare_method(method), "(", 1))


def entry_tier(path: Column) -> Column:
    """Implementations first, then controllers and web folders, repositories, the rest."""
    low = F.lower(F.translate(path, "\\", "/"))
    return (
        F.when(contains_any(path, ["ServiceImpl", "Impl.java"]) | F.contains(low, F.lit("/impl/")), 0)
        .when(F.contains(path, F.lit("Controller")), 2)
        .when(contains_any(low, ["/web/", "/api/", "/rest/", "/resource/"]) & ~contains_any(low, ["/client/", "/feign/"]), 2)
        .when(F.contains(path, F.lit("Repository")), 3)
        .otherwise(4)
    )


def is_interface_file(stem: Column, text: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"\binterface\s+"), stem, F.lit(r"\b")))


def sink_kind(cls: Column, file: Column, method: Column) -> Column:
    """database, middleware, external_api or other. Class names are looked at as written, so `OrderRepository` needs its folder."""
    low = F.lower(F.translate(file, "\\", "/"))
    blob = F.concat_ws(" ", F.lower(cls), low, F.lower(method))
    return (
        F.when(F.contains(cls, F.lit("repository")) | F.contains(low, F.lit("/repository/")), "database")
        .when(F.contains(cls, F.lit("mapper")) & contains_any(low, ["mapper", "mybatis"]), "database")
        .when(contains_any(blob, p.DATABASE_WORDS) | F.contains(cls, F.lit("Dao")), "database")
        .when(contains_any(blob, p.MIDDLEWARE_WORDS) | contains_any(cls, ["Kafka", "Rabbit", "Redis", "Amqp", "MongoTemplate"]), "middleware")
        .when(contains_any(blob, p.EXTERNAL_WORDS) | F.contains(low, F.lit("feign")), "external_api")
        .otherwise("other")
    )


def is_controller_layer(cls: Column, file: Column, is_rest: Column) -> Column:
    low = F.lower(F.translate(file, "\\", "/"))
    return (
        F.coalesce(is_rest, F.lit(False))
        | F.contains(low, F.lit("/controller/")) | F.endswith(low, F.lit("controller.java"))
        | F.endswith(cls, F.lit("Controller")) | F.contains(F.lower(cls), F.lit(".controller."))
        | (contains_any(low, ["/web/", "/api/", "/rest/", "/resource/"]) & ends_with_any(F.substring_index(cls, ".", -1), ["Resource", "Rest", "Api", "Endpoint", "Handler"]))
    )


def is_service_layer(cls: Column, file: Column, method: Column) -> Column:
    low = F.lower(F.translate(file, "\\", "/"))
    return (sink_kind(cls, file, method) != "database") & (contains_any(low, ["service/", "service.impl"]) | ends_with_any(F.substring_index(cls, ".", -1), ["ServiceImpl", "Service"]))


def repository_call_score(text: Column, field: Column) -> Column:
    """How much a line looks like the call on a repository field worth naming; -1 where it is none."""
    s = stripped(text)
    return F.when(~F.contains(text, F.concat(field, F.lit("."))) | starts_with_any(s, ["//", "*"]), -1).otherwise(
        5
        + F.when(contains_any(text, [".save(", ".saveAll("]), 100)
        .when(contains_any(text, [".delete", ".remove("]), 80)
        .when(contains_any(text, [".insert", ".update", ".execute"]), 70)
        .when(contains_any(text, [".find", ".get", ".query", ".count", ".exists"]), 20)
        .otherwise(0)
    )


def is_entity_of(text: Column, entity: Column, table: Column) -> Column:
    """Source of the entity class of a table: the annotation, the first class's name, and the table's name where one is given."""
    named = F.transform(F.regexp_extract_all(text, F.lit(p.TABLE_ANNOTATION), 1), lambda x: F.lower(F.substring_index(x, ".", -1)))
    return matches(text, r"@Entity\b") & (group(text, r"\bclass\s+(\w+)") == entity) & ((F.size(named) == 0) | F.array_contains(named, F.lower(table)))
