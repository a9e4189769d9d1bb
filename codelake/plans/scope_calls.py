"""Approximate calls from the text alone, by what Java's scopes say: who is called is looked up by type, name and number of arguments.

A receiver is a local variable or a parameter of the method around the call, else a field of the class, else a type's
name; no receiver means the own class. Type names are resolved by imports, the own package and imported packages. A
method is looked for in the type itself, then in the types it extends and implements (`UP` levels), then in those that
extend or implement it. Every lookup is a join on (type, name, number of arguments); none is on a name alone.

Where several types implement what is called, the call leads to one row for them all (`type#name/arguments`), and that
row to each of them, so the number of edges grows with the source, not with callers times implementations. The same goes
for receivers whose type cannot be told (`*#name/arguments`). Calls into libraries give no edge. What this cannot see:
reflection, overloads of equal length (taken together, by the first), variable numbers of arguments beyond those written,
nested types (taken as their file's first type).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions import patterns as p
from codelake.functions.predicates import bound, contains_any, matches, method_once, stripped
from codelake.sources.files import split_lines
from codelake.sources.store import large, written

UP, NESTED = 4, 6
# runs are taken whole and never given back: what may follow one cannot stand in it
# and patterns begin with what they look for, and look back from there
CALL = r"\w(?:(?<![\w.]\w)\w*+\s*+\.\s*+\w++|(?<=\b\w)\w*+)\s*+\([^()]*+\)|\.\s*+\w++\s*+\([^()]*+\)"
BRACKETS = r"\s\((?<!\w\s\()[^()]*+\)|\((?<!\w\()[^()]*+\)"
NO_CALLS = [*p.NOT_METHODS, "return", "synchronized", "super", "this", "assert", "else", "throw"]
FILE = ["project", "path"]
ASKED = ["project", "type", "callee", "arity"]
ANY = "*"  # the type of receivers that cannot be told
SALTS = 16  # what many files ask for is met in so many tasks
MOST_MEETINGS = 1_000_000  # of calls and methods, that one file's row may make

LIKELY = p.LIKELY_DECLARATION.replace(r"^\s*", r"^\s*+")
BARE = r"^\s*(?:[\w.\[\]]+\s+)+(\w+)\s*\([^)]*(?:\)[\w\s,.]*;)?\s*$"
INTERFACE = r"^\s*(?:(?:public|abstract|sealed|static|strictfp|@\w+)\s+)*interface\s+\w+"
TYPE = r"^[^\"(=]*?\b(?:class|interface|enum|record)\s+(\w+)([^{]*)"
ARGUMENTS = r"\w\s*+\(([^)]*+)\)"
VARIABLE = r"^\s*+(?:((?:(?:private|protected|public|static|transient|volatile)\s+)+))?(?:final\s+)?(?:(?:private|protected|public|static)\s+)*([A-Z]\w*)(?:\s*\[\])*\s+(\w+)\s*(?:=|;|$)"
SIMPLE = r"^(?:[a-z]\w*\.)*([A-Z]\w*)\b"
LOOP = r"\(\s*(?:final\s+)?([A-Z]\w*)\s+(\w+)\s*:"
IMPORT = r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+|\*)\s*;"


def _without(signs: list[str], pattern: str, by: str) -> Callable[[Column], Column]:
    """Each pattern waits for a sign of it, since most lines have none."""
    return lambda c: F.when(contains_any(c, signs), F.regexp_replace(c, pattern, by)).otherwise(c)


def _without_arguments(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<")), F.aggregate(F.sequence(F.lit(1), F.lit(3)), c, lambda x, _: F.regexp_replace(x, r"<[\w\s,?.&\[\]]*>", ""))).otherwise(c)


CLEANING = [
    _without(['"'], r'"(?:[^"\\]|\\.)*+"', '""'), _without(["'"], r"'(?:[^'\\]|\\.)++'", "0"), _without(["/", "*"], r"//.*$|/\*.*?\*/|^\s*\*.*$", ""), _without_arguments,
]


def plain_code(text: Column) -> Column:
    """A line without what strings, characters and comments hold, and without type arguments."""
    return reduce(bound, CLEANING, text)


def _calls(text: Column) -> Column:
    none = F.array().cast("array<string>")
    every = lambda c: F.regexp_extract_all(c, F.lit(CALL), 0)

    def step(s: Column, _: Column) -> Column:
        outer = F.regexp_replace(F.regexp_replace(s["rest"], CALL, "_"), BRACKETS, "_")
        return F.when(F.contains(s["rest"], F.lit("(")), F.struct(outer.alias("rest"), F.concat(s["found"], every(s["rest"])).alias("found"))).otherwise(s)

    # where one bracket opens, nothing stands in another's
    nested = F.aggregate(F.sequence(F.lit(1), F.lit(NESTED)), F.struct(text.alias("rest"), none.alias("found")), step, lambda s: s["found"])
    return F.when(~F.contains(text, F.lit("(")), none).when(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("("), F.lit(""))) == 1, every(text)).otherwise(nested)


without_this = _without(["this"], r"\bthis\s*\.\s*", "")


def calls_in(text: Column) -> Column:
    """The calls of a piece of plain code as `receiver.name(arguments)`, the innermost first; what they hold is `_`."""
    return bound(without_this(text), _calls)


def listed(params: Column) -> Column:
    """The parameters or arguments between two brackets; commas in them are gone with type arguments and inner calls."""
    return F.filter(F.transform(F.split(params, ","), lambda x: stripped(x)), lambda x: x != "")


def part(c: Column, start: Column, end: Column) -> Column:
    """The elements of an array from one place, counted from 0, to before another; slice would read the whole array for them."""
    return F.transform(F.sequence(start, end - 1), lambda i: F.get(c, i))


def how_many(params: Column) -> Column:
    """The number of those."""
    return F.when(params == "", 0).otherwise(F.regexp_count(params, F.lit(r"[^,\s][^,]*+")))


def unmarked(text: Column, more: str = "") -> Column:
    """A declaration without annotations, and without what `more` matches."""
    return F.when(contains_any(text, ["@", *(["final"] if more else [])]), F.regexp_replace(text, r"@\w+(?:\([^)]*\))?\s*" + more, "")).otherwise(text)


def declared_name(code: Column, interface: Column) -> Column:
    """The name of the method that a line declares, else null; in interfaces also without a modifier."""
    no_word = ~(F.contains(code, F.lit("=")) | matches(code, r"^\s*+(return|throw|else|new|assert|case|package|import)\b"))

    def name(plain: Column) -> Column:
        bare = F.when(interface & plain, F.nullif(F.regexp_extract(code, BARE, 1), F.lit("")))
        found = F.coalesce(F.when(plain | matches(code, r"\)\s*\{"), method_once(code)), bare)
        return bound(found, lambda n: F.when(~n.isin(NO_CALLS) & (plain | ~matches(code, r"^\s*+(return|throw|else)\b")), n))

    return F.when(F.contains(code, F.lit("(")) & matches(code, LIKELY), bound(no_word, name))


def variable_type(vars_: Column, name: Column) -> Column:
    """The simple name of a variable's type, of several the first."""
    return F.array_min(F.transform(F.filter(vars_, lambda v: v["name"] == name), lambda v: v["simple"]))


def ask_of(call: Column, inside: Column, fields: Column) -> Column:
    """What a call asks for, as `type#name/arguments` with the simple name of the receiver's type: none for the own class, `?` where it cannot be told."""

    def told(before: Column) -> Column:
        arguments = F.substring(call, F.length(before) + 2, F.length(call) - F.length(before) - 2)
        return bound(F.translate(before, " \t\n\x0b\f\r", ""), lambda named: of_name(named, arguments))

    def of_name(named: Column, arguments: Column) -> Column:
        simple = lambda r: F.when(r == "", "?").otherwise(F.coalesce(variable_type(inside, r), variable_type(fields, r), F.when(matches(r, "^[A-Z]"), r), F.lit("?")))
        kind = F.when(F.contains(named, F.lit(".")), bound(F.substring_index(named, ".", 1), simple)).otherwise("")
        return bound(F.substring_index(named, ".", -1), lambda n: F.when(~n.isin(NO_CALLS), F.concat(kind, F.lit("#"), n, F.lit("/"), bound(arguments, how_many).cast("string"))))

    return bound(F.substring_index(call, "(", 1), told)


def marked_files(sources: DataFrame) -> DataFrame:
    """sources(project, path, numbers, texts), a row a file -> with `codes`, what is left of each line, `names`, those of the methods that lines declare, and `wholes`, where brackets stay open with the code of the next lines."""
    cleaned = sources.withColumn("codes", reduce(F.transform, CLEANING, F.col("texts")))
    interface = F.exists("codes", lambda c: F.contains(c, F.lit("interface")) & matches(c, INTERFACE))
    without = lambda c, x: F.octet_length(F.replace(c, F.lit(x), F.lit("")))
    whole = lambda codes: lambda c, i: F.when(F.contains(c, F.lit("(")) & (without(c, "(") < without(c, ")")), F.array_join(part(codes, i, F.least(i + 5, F.size(codes))), " ")).otherwise(c)
    return cleaned.select(
        *FILE, "numbers", "texts", "codes", bound(interface, lambda told: F.transform("codes", lambda c: declared_name(c, told))).alias("names"), bound(F.col("codes"), lambda codes: F.transform(codes, whole(codes))).alias("wholes"),
    )


def told_files(marked: DataFrame) -> DataFrame:
    """marked_files -> (project, path, package, imports, type, parents, fields, methods): a file's first type by full name with what it extends or implements, what it imports (simple is null for whole packages), its fields, and each method with its variables and calls."""
    pair = lambda name, simple: F.struct(name.alias("name"), simple.alias("simple"))
    variable = lambda r: lambda s, i: F.when((s != "") & F.get(r["names"], i).isNull(), bound(F.get(r["codes"], i), lambda c: F.struct((F.regexp_extract(c, VARIABLE, 1) != "").alias("field"), pair(F.regexp_extract(c, VARIABLE, 3), s).alias("v"))))
    loop = lambda c: F.when(F.contains(c, F.lit(":")) & F.contains(c, F.lit("(")), bound(F.regexp_extract(c, LOOP, 1), lambda s: F.when(s != "", pair(F.regexp_extract(c, LOOP, 2), s))))
    first = lambda codes: lambda w, i: F.when(contains_any(w, ["class", "interface", "enum", "record"]), bound(F.regexp_extract(w, TYPE, 1), lambda t: F.when(t != "", F.struct(t.alias("t"), F.get(codes, i).alias("code")))))
    by_line = marked.select(
        *FILE, "numbers", "names", "wholes",
        F.array_compact(F.transform("names", lambda n, i: F.when(n.isNotNull(), i))).alias("starts"),
        bound(F.struct("codes", "names"), lambda r: F.transform(F.transform("codes", lambda c: F.regexp_extract(c, VARIABLE, 2)), variable(r))).alias("variables"),
        F.transform("codes", loop).alias("loops"),
        bound(F.col("codes"), lambda codes: F.get(F.array_compact(F.transform("wholes", first(codes))), F.lit(0))).alias("first"),
        F.filter("texts", lambda t: contains_any(t, ["import", "package"]) & matches(t, r"^\s*(import|package)\s")).alias("head"),
    )

    package = F.array_min(F.filter(F.transform("head", lambda t: F.regexp_extract(t, r"^\s*package\s+([\w.]+)", 1)), lambda x: x != ""))
    imports = F.filter(F.transform("head", lambda t: F.struct(F.regexp_extract(t, IMPORT, 1).alias("package"), F.nullif(F.regexp_extract(t, IMPORT, 2), F.lit("*")).alias("simple"))), lambda x: x["package"] != "")
    parents = F.regexp_extract_all(F.regexp_replace(F.regexp_extract("first.code", r"\b(?:extends|implements)\b([^{]*)", 1), r"\b(extends|implements)\b", ","), F.lit(r"([A-Z]\w*)\s*(?:,|$)"), 1)
    param = lambda x: bound(F.regexp_extract(x, SIMPLE, 1), lambda s: F.when(s != "", pair(F.regexp_extract(x, r"(\w++)\s*+$", 1), s)))
    params = lambda w: F.array_compact(F.transform(listed(F.regexp_extract(unmarked(w, r"|\bfinal\s+"), ARGUMENTS, 1)), param))

    def method(r: Column, i: Column, after: Column) -> Column:
        """r: the columns of a file."""
        of = lambda c: part(r[c], i, after)
        inside = F.concat(
            params(F.get(r["wholes"], i)), F.transform(F.filter(of("variables"), lambda v: v.isNotNull() & ~v["field"]), lambda v: v["v"]), F.array_compact(of("loops")),
        )
        # the line that declares a method says its own name first
        bodies = F.transform(of("wholes"), lambda w, k: F.when(k == 0, F.regexp_extract(w, r"(?s)^[^{]*\{(.*)$", 1)).otherwise(w))
        calls = F.flatten(F.transform(F.transform(bodies, without_this), _calls))
        return F.struct(
            F.concat_ws(":", F.get(r["numbers"], i).cast("string"), F.get(r["names"], i)).alias("src"), F.get(r["names"], i).alias("callee"),
            how_many(F.regexp_extract(unmarked(F.get(r["wholes"], i)), ARGUMENTS, 1)).alias("arity"), inside.alias("inside"), F.array_distinct(calls).alias("calls"),
        )

    row = F.struct("numbers", "names", "wholes", "starts", "variables", "loops")
    methods = bound(row, lambda r: F.transform(r["starts"], lambda i, j: method(r, i, F.coalesce(F.get(r["starts"], j + 1), F.size(r["names"])))))
    head_end = F.coalesce(F.get("starts", F.lit(0)), F.size("names"))
    fields = bound(head_end, lambda end: F.transform(F.filter(F.transform("variables", lambda v, i: F.when(v["field"] | (i < end), v)), lambda v: v.isNotNull()), lambda v: v["v"]))
    return by_line.select(
        *FILE, package.alias("package"), imports.alias("imports"), F.when(F.col("first").isNotNull(), F.concat_ws(".", package, "first.t")).alias("type"), F.array_distinct(parents).alias("parents"), fields.alias("fields"), methods.alias("methods"),
    )


def asking_files(told: DataFrame) -> DataFrame:
    """told_files -> (project, path, type, parents, declared, asks), all that is known about a file without the others.

    parents and asks.types: the full names that a simple one can have, the likeliest first: imported by name, else in the own package, else in imported packages.
    declared: (callee, arity, src) of its methods. asks: what they call, with the methods that do (srcs); `rival` where several asks may lead to one method."""
    calls = bound(F.col("fields"), lambda fields: F.transform("methods", lambda m: F.struct(m["src"].alias("src"), F.array_distinct(F.array_compact(F.transform(m["calls"], lambda c: ask_of(c, m["inside"], fields)))).alias("asks"))))
    declared = F.transform("methods", lambda m: F.struct(m["callee"].alias("callee"), m["arity"].alias("arity"), m["src"].alias("src")))
    called = told.select(*FILE, "package", "imports", "type", "parents", declared.alias("declared"), calls.alias("calls"))
    asks = F.flatten(F.transform("calls", lambda m: m["asks"]))
    grouped = called.withColumn("all", asks).withColumn("asks", F.array_distinct("all"))

    def types(simple: Column, r: Column) -> Column:
        by_name = F.array_min(F.transform(F.filter(r["imports"], lambda x: x["simple"] == simple), lambda x: F.concat_ws(".", x["package"], simple)))
        near = F.when(r["type"].isNotNull(), F.concat_ws(".", r["package"], simple))
        wide = F.array_sort(F.transform(F.filter(r["imports"], lambda x: x["simple"].isNull()), lambda x: F.concat_ws(".", x["package"], simple)))
        return F.coalesce(by_name, F.array_join(F.array_distinct(F.concat(F.array_compact(F.array(near)), wide)), "|"))

    def ask(a: Column, srcs: Column, r: Column, rival: Column) -> Column:
        name = F.substring_index(a, "#", -1)
        return bound(F.substring_index(a, "#", 1), lambda simple: F.struct(
            F.substring_index(name, "/", 1).alias("callee"), F.substring_index(name, "/", -1).cast("int").alias("arity"), (simple == "").alias("here"),
            F.when(simple == "", r["type"]).when(simple != "?", F.nullif(types(simple, r), F.lit(""))).alias("types"), srcs.alias("srcs"), rival.alias("rival"),
        ))

    row = F.struct("package", "imports", "type", "calls", "asks")
    few = F.size("asks").cast("long") * F.size("all") <= MOST_MEETINGS
    several = F.size(F.array_distinct(F.transform("asks", lambda a: F.substring_index(a, "#", -1)))) < F.size("asks")
    srcs = lambda a, r: F.transform(F.filter(r["calls"], lambda m: F.array_contains(m["asks"], a)), lambda m: m["src"])
    met = bound(several, lambda rival: bound(row, lambda r: F.transform(r["asks"], lambda a: ask(a, srcs(a, r), r, rival))))
    # a file with very many calls gives a row for each, and these meet like asks of which several lead to one method
    each = bound(row, lambda r: F.flatten(F.transform(r["calls"], lambda m: F.transform(m["asks"], lambda a: ask(a, F.array(m["src"]), r, F.lit(True))))))
    above = bound(row, lambda r: F.filter(F.transform("parents", lambda s: types(s, r)), lambda x: x != ""))
    return grouped.select(*FILE, "type", above.alias("parents"), "declared", F.when(few, met).otherwise(each).alias("asks"))


def resolved_types(df: DataFrame, known: DataFrame) -> DataFrame:
    """df(project, types) -> with `type`: of the names that stand in types the first that exists, else the first. known(project, type)."""
    many = F.contains("types", F.lit("|"))
    lists = df.where(many).select("project", "types").distinct()
    found = large(lists.select("project", "types", F.posexplode(F.split("types", r"\|")).alias("place", "type"))).join(known, ["project", "type"], "left_semi")
    found = found.groupBy("project", "types").agg(F.min_by("type", "place").alias("found"))
    open_ = large(df.where(many)).join(large(found), ["project", "types"], "left").withColumn("type", F.coalesce("found", F.substring_index("types", "|", 1)))
    return df.where(~many | F.col("types").isNull()).withColumn("type", F.col("types")).union(open_.drop("found").select(*df.columns, "type"))


def lineage(up: DataFrame) -> DataFrame:
    """up(project, low, high) -> with `way`, the least number of steps from a type to one above it, at most UP. Only types that stand above others are followed."""
    tops = written(up.join(large(up.select("project", F.col("high").alias("low")).distinct()), ["project", "low"], "left_semi"))
    level = tops.select("project", F.col("low").alias("mid"), F.col("high").alias("at"), F.lit(1).alias("way"))
    chains = level
    step = tops.withColumnsRenamed({"low": "at", "high": "next"})
    for way in range(2, UP):
        level = level.join(step, ["project", "at"]).select("project", "mid", F.col("next").alias("at"), F.lit(way).alias("way")).distinct()
        chains = chains.union(level)
    chains = chains.groupBy("project", "mid", "at").agg(F.min("way").alias("way"))
    longer = up.withColumnRenamed("high", "mid").join(large(chains), ["project", "mid"]).select("project", "low", F.col("at").alias("high"), F.col("way") + 1).where("low <> high")
    return up.withColumn("way", F.lit(1)).union(longer).groupBy("project", "low", "high").agg(F.min("way").alias("way"))


def targets(wanted: DataFrame, declared: DataFrame, lines_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found(project, type, callee, arity, salt, dst_key, edge_source), members(project, src_key, dst_key, callee, edge_source)): where what is wanted leads, and where the rows for many lead. Declared in the type itself, else the nearest above it, else all below it."""
    name = ["project", "callee", "arity"]
    own = written(declared.where("type IS NOT NULL").groupBy(*ASKED).agg(F.min("key").alias("key")))
    typed = wanted.where(F.col("type") != ANY)
    text = lambda *parts: F.concat(*parts, F.lit("#"), "callee", F.lit("/"), F.col("arity").cast("string"))
    low, high = F.col("low").alias("type"), F.col("high").alias("at")
    # upwards from what is wanted, downwards from what is declared: neither meets all that a type has with all types below it
    looked = typed.select("*", F.col("type").alias("at"), F.lit(0).alias("way")).union(typed.join(large(lines_.select("project", low, high, "way")), ["project", "type"]).select(*typed.columns, "at", "way"))
    above = large(looked).join(own.withColumnRenamed("type", "at"), ["project", "at", "callee", "arity"]).groupBy(*ASKED, "salt").agg(F.min(F.struct("way", "key")).alias("m"))
    above = written(above.select(*ASKED, "salt", F.col("m.key").alias("dst_key"), F.lit("resolved").alias("edge_source")))
    missed = written(typed.join(above, [*ASKED, "salt"], "left_anti"))
    below = own.join(large(lines_.select("project", low, high)), ["project", "type"]).select("project", F.col("at").alias("type"), "callee", "arity", "key")
    below = written(large(below).join(large(missed.select(*ASKED).distinct()), ASKED, "left_semi"))
    ends = below.groupBy(*ASKED).agg(F.min("key").alias("one"), F.max("key").alias("last"))
    several = F.col("one") != F.col("last")
    ends = written(ends.select(*ASKED, F.when(several, text("type")).otherwise(F.col("one")).alias("dst_key"), F.when(several, "implementation").otherwise("resolved").alias("edge_source")))
    under = missed.join(ends, ASKED).select(*ASKED, "salt", "dst_key", "edge_source")
    loose = written(wanted.where(F.col("type") == ANY).join(large(declared.select(*name).distinct()), name, "left_semi"))
    any_ = loose.select(*ASKED, "salt", text("type").alias("dst_key"), F.lit("ambiguous").alias("edge_source"))
    member = lambda df, source: df.select("project", text("type").alias("src_key"), F.col("key").alias("dst_key"), "callee", F.lit(source).alias("edge_source"))
    of_types = member(below.join(ends.where("edge_source = 'implementation'").select(*ASKED), ASKED, "left_semi"), "implementation")
    of_any = member(declared.join(large(loose.select(*name).distinct()), name, "left_semi").withColumn("type", F.lit(ANY)), "ambiguous")
    return above.union(under).union(any_), of_types.union(of_any)


def source_edges(sources: DataFrame) -> DataFrame:
    """The edges of sources(project, path, numbers, texts), a row a file with the numbers and texts of its lines; see scoped_edges.

    What a file says is found in its own row, and what its methods call is asked once a file, not once a call; only these asks meet other files."""
    files = written(asking_files(told_files(marked_files(sources))))
    known = large(files.where("type IS NOT NULL").select("project", "type").distinct())
    salt = F.when(F.col("ask.here"), 0).otherwise(F.pmod(F.hash("path"), F.lit(SALTS)))
    calls = resolved_types(large(files.select(*FILE, F.explode("asks").alias("ask")).select(*FILE, salt.alias("salt"), "ask.*")), known)
    calls = written(calls.where("type IS NOT NULL OR NOT here").withColumn("type", F.coalesce("type", F.lit(ANY))).drop("here", "types"))
    above = large(files.where("type IS NOT NULL").select("project", F.col("type").alias("low"), F.explode("parents").alias("types")))
    up = written(resolved_types(above, known).select("project", "low", F.col("type").alias("high")).where("low <> high").distinct())

    wanted = written(calls.select(*ASKED, "salt").distinct())
    declared = large(files.select(*FILE, "type", F.explode("declared").alias("d")).select("project", "type", "d.callee", "d.arity", F.concat_ws(":", "path", "d.src").alias("key")))
    declared = written(declared.join(large(wanted.select("project", "callee", "arity").distinct()), ["project", "callee", "arity"], "left_semi"))
    found, members = targets(wanted, declared, written(lineage(up)))

    met = large(calls).join(large(found), [*ASKED, "salt"]).select(*FILE, "callee", "dst_key", "edge_source", "srcs", "rival")
    met = written(met)
    one = met.where("rival").groupBy(*FILE, "callee", "dst_key", "edge_source").agg(F.array_distinct(F.flatten(F.collect_list("srcs"))).alias("srcs"))
    every = met.where("NOT rival").drop("rival").union(one.select(*FILE, "callee", "dst_key", "edge_source", "srcs"))
    edges = every.select("project", "path", F.explode("srcs").alias("src"), "dst_key", "callee", "edge_source").select("project", F.concat_ws(":", "path", "src").alias("src_key"), "dst_key", "callee", "edge_source")
    return large(edges.union(members).withColumnRenamed("callee", "dst_name"))


def file_edges(files: DataFrame) -> DataFrame:
    """The edges of files(project, path, text); see scoped_edges."""
    texts = files.select(*FILE, split_lines(F.col("text")).alias("texts"))
    return source_edges(texts.select(*FILE, F.transform("texts", lambda _, i: i + 1).alias("numbers"), "texts"))


def scoped_edges(lines: DataFrame) -> DataFrame:
    """(project, src_key, dst_key, dst_name, edge_source) from lines(project, path, line_no, text) of Java; keys are `path:line:name`. edge_source: resolved, implementation (from a row for many, or to it), ambiguous (likewise, of calls whose receiver is unknown)."""
    by_file = lines.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return source_edges(by_file.select(*FILE, F.col("l.line_no").alias("numbers"), F.col("l.text").alias("texts")))
