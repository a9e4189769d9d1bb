"""Names: tables and types, stable ids, slugs, safe file names, paths of web mappings, how nodes are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions import patterns as p
from codelake.functions.predicates import bare_method, matches, stripped


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(.)([A-Z][a-z]+)", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))


def physical_table(name: Column) -> Column:
    """The last dotted part; snake case stays, Pascal case becomes snake case, anything else lower case."""
    t = F.trim(name)
    parts = F.filter(F.transform(F.split(t, r"\."), F.trim), lambda x: x != "")
    t = F.when(F.contains(t, F.lit(".")) & (F.size(parts) > 0), F.element_at(parts, -1)).otherwise(t)
    return F.when(matches(t, p.PHYSICAL_TABLE), t).when(matches(t, p.PASCAL_TYPE) & matches(snake(t), p.PHYSICAL_TABLE), snake(t)).otherwise(F.lower(t))


def entity_class(table: Column) -> Column:
    """`monitor_data` -> `MonitorData`."""
    parts = F.filter(F.split(table, "_"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def table_candidates(name: Column) -> Column:
    """The physical tables that a listed name stands for: itself in snake case, or a type's name in snake case."""
    t = F.trim(name)
    return F.array_distinct(F.array_compact(F.array(F.when(matches(t, p.PHYSICAL_TABLE), t), F.when(matches(t, p.PASCAL_TYPE) & matches(snake(t), p.PHYSICAL_TABLE), snake(t)))))


def _hash16(prefix: str, payload: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, 16))


def table_hit_id(table: Column, source: Column, file: Column, line: Column, extra: Column | None = None) -> Column:
    rel = F.trim(F.translate(file, "\\", "/"))
    return _hash16("ma-", F.concat_ws("|", F.lower(table), source, rel, line.cast("string"), extra if extra is not None else F.lit("")))


def endpoint_id(verb: Column, path: Column, cls: Column, method: Column, slug: Column, file: Column, line: Column) -> Column:
    rel = F.trim(F.translate(file, "\\", "/"))
    return _hash16("re-", F.concat_ws("|", F.upper(F.trim(verb)), F.trim(path), F.trim(cls), F.trim(method), slug, rel, line.cast("string")))


def endpoint_slug(verb: Column, path: Column) -> Column:
    """`GET_api_foo_bar`: a file name for an endpoint."""
    v = F.coalesce(F.nullif(F.upper(F.trim(verb)), F.lit("")), F.lit("X"))
    body = F.translate(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), "^/+|/+$", ""), "/", "_")
    body = F.substring(F.regexp_replace(F.regexp_replace(body, r"[^\w\-]+", "_"), "^_+|_+$", ""), 1, 72)
    return F.substring(F.concat_ws("_", v, F.coalesce(F.nullif(body, F.lit("")), F.lit("root"))), 1, 100)


def safe_name(c: Column, most: int, otherwise: str) -> Column:
    s = F.substring(F.regexp_replace(F.trim(c), r"[^\w\-.]+", "_"), 1, most)
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit(otherwise))


def mapping_path(base: Column, sub: Column) -> Column:
    """Path of a scanned mapping: its class's and its own, with one slash before each."""
    b, s = F.regexp_replace(stripped(base), "/+$", ""), F.regexp_replace(stripped(F.coalesce(sub, F.lit(""))), "^/", "")
    rooted = F.when((b == "") | F.startswith(b, F.lit("/")), b).otherwise(F.concat(F.lit("/"), b))
    return F.when(stripped(F.coalesce(sub, F.lit(""))) == "", rooted).otherwise(F.concat(rooted, F.lit("/"), s))


def entry_path(base: Column, sub: Column) -> Column:
    """Path of a trace's top entry; unlike scanned mappings it is empty where nothing is mapped."""
    b, s = F.regexp_replace(F.trim(base), "/+$", ""), F.trim(sub)
    joined = F.when(s == "", b).otherwise(F.concat(b, F.lit("/"), F.regexp_replace(s, "^/", "")))
    return F.when((joined == "") | F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def node_key(file: Column, line: Column, character: Column, method: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), character.cast("string"), method)


def file_uri(path: Column) -> Column:
    """An absolute path as a file URI, white space escaped."""
    return F.concat(F.lit("file://"), F.replace(path, F.lit(" "), F.lit("%20")))


def uri_path(uri: Column) -> Column:
    return F.url_decode(F.regexp_replace(uri, "^file://", ""))


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def package_of(fqcn: Column) -> Column:
    return F.regexp_replace(F.trim(fqcn), r"(^|\.)[^.]*$", "")


def shown_node(cls: Column, method: Column, file: Column, line: Column) -> Column:
    """`OrderService.find (OrderService.java:12)`."""
    return F.concat(F.substring_index(cls, ".", -1), F.lit("."), bare_method(method), F.lit(" ("), F.substring_index(file, "/", -1), F.lit(":"), line.cast("string"), F.lit(")"))


def shown_endpoint(verb: Column, path: Column, cls: Column, method: Column) -> Column:
    """`GET /api/orders (OrderController.list)`, without what is not known."""
    mapped = F.concat_ws(" ", F.nullif(verb, F.lit("")), F.nullif(path, F.lit("")))
    where = F.concat_ws(".", F.substring_index(cls, ".", -1), bare_method(method))
    return F.when(mapped == "", where).otherwise(F.concat(mapped, F.lit(" ("), where, F.lit(")")))
