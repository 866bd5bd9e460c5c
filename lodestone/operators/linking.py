"""Imports to files: path keys, manifest facts, and the tiers that decide between candidates.

Symbols that stand for a file (``handle, path, name, qualified_name``) and targets are exploded into keys and met by equi-joins;
the best tier that has any candidate decides, and only a single one links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers in order: by path (with the named leaf first), by manifest fact, by qualified name, by name.
PATH, FACT, QUALIFIED, NAME = 0, 1, 2, 3


def normal(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"^\./", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def bare(path: Column) -> Column:
    """A path without its extension."""
    return F.regexp_replace(path, r"\.[^./]+$", "")


def joined(base: Column, rest: Column) -> Column:
    """``rest`` seen from the folder ``base``, with ``.`` and ``..`` taken out."""
    parts = F.filter(F.split(F.concat_ws("/", base, rest), "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.array_join(up, "/")


def file_keys(path: Column) -> Column:
    """Keys under which a file is found: its path, the path without extension, every folder, every end of the bare path."""
    p = normal(path)
    b = bare(p)
    parts = F.split(b, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tag = lambda t, values: F.transform(values, lambda v: F.concat(F.lit(t + ":"), v))
    return F.array_distinct(F.concat(tag("is", F.array(p, b)), tag("in", folders), tag("end", ends)))


def rust_module(target: Column) -> Column:
    """The module part of a Rust path, without ``crate``, ``self`` or ``super``; '' where there is none."""
    parts = F.split(target, "::")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rest = F.when(F.get(inner, F.lit(0)).isin("crate", "self", "super"), F.slice(inner, 2, F.size(inner))).otherwise(inner)
    return F.when(target.contains("::"), F.array_join(rest, "/")).otherwise(F.lit(""))


def python_module(importer: Column, target: Column) -> Column:
    """The path that a Python import means, from the importer's folder for leading dots; '' for other importers."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(target, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.split(folder(importer), "/")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    whole = F.when(dots > 0, joined(base, module)).otherwise(module)
    return F.when(F.lower(importer).rlike(r"\.pyi?$") & (module != ""), whole).otherwise(F.lit(""))


def target_keys(importer: Column, target: Column) -> Column:
    """Keys that a target means: the path itself, its end where it has no extension, seen from the importer, as Rust, as Python."""
    t = normal(target)
    tag = lambda name, value: F.concat(F.lit(name + ":"), value)
    here = joined(folder(normal(importer)), t)
    rust, python = rust_module(t), python_module(normal(importer), t)
    outer = folder(python)
    no_extension = ~t.rlike(r"\.[^./]+$")
    keys = F.array(
        tag("is", t), F.when(no_extension, tag("is", t)), F.when(no_extension, tag("end", F.concat(F.lit("/"), t))), tag("is", here), tag("in", here),
        F.when(rust != "", tag("end", F.concat(F.lit("/"), rust))), F.when(rust != "", tag("end", F.concat(F.lit("/"), rust, F.lit("/mod")))),
        F.when(python != "", tag("is", python)), F.when(python != "", tag("in", python)), F.when(outer != "", tag("is", outer)), F.when(outer != "", tag("in", outer)),
    )
    return F.array_distinct(F.array_compact(keys))


def leaf(target: Column) -> Column:
    """The symbol that a target names at its end: after ``::``, or a capitalised part after a dot; '' where there is none."""
    rust = F.element_at(F.split(target, "::"), -1)
    dot = F.regexp_extract(target, r"\.([A-Z][^.]*)$", 1)
    return F.when(target.contains("::"), rust).otherwise(dot)


def path_candidates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``import_id, to_handle, tier, sub``; ``sub`` is 0 for symbols that the target's leaf names, else 1."""
    asked = imports.select("import_id", "from_handle", "target", F.explode(target_keys(F.col("importer"), F.col("target"))).alias("key"))
    named = files.select(F.col("handle").alias("to_handle"), F.lower("name").alias("name"), F.lower("qualified_name").alias("qualified"), F.explode(file_keys(F.col("path"))).alias("key"))
    met = asked.join(named, "key").filter("to_handle <> from_handle")
    low = F.lower(leaf(F.col("target")))
    sub = F.when((low != "") & ((F.col("name") == low) | F.col("qualified").endswith(F.concat(F.lit("::"), low))), 0).otherwise(1)
    return met.select("import_id", "to_handle", F.lit(PATH).alias("tier"), sub.alias("sub")).distinct()


def fact_paths(imports: DataFrame, facts: DataFrame) -> DataFrame:
    """``import_id, expected``: paths that manifests map a target to; facts: ``source_path, kind, name, target, package``.

    Every target is cut into its beginnings at ``/`` (for modules, namespaces and alias prefixes), so that facts are met by an
    equi-join on the beginning that they stand for.
    """
    t = normal(F.col("target"))
    parts = F.split(t, "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = imports.select("import_id", t.alias("asked"), F.explode(F.array_distinct(heads)).alias("head"))
    base = folder(F.col("source_path"))
    name = F.regexp_replace(normal(F.col("name")), r"^/+|/+$", "")
    own = normal(F.col("fact_target"))
    f = facts.withColumnRenamed("target", "fact_target").withColumn("base", base)
    in_package = F.col("source_path").rlike(r"(^|/)package\.json$")
    modules = f.filter((F.col("kind") == "module") & ~in_package).select("base", F.regexp_replace(own, r"^/+|/+$", "").alias("key"), F.lit("module").alias("rule"), own.alias("to"), F.lit("").alias("tail"))
    spaces = f.filter(F.col("kind").isin("psr-4", "psr-0")).select("base", F.lower(name).alias("key"), F.lit("psr").alias("rule"), own.alias("to"), F.lit("").alias("tail"))
    star = F.instr(name, "*")
    aliases = f.filter("kind = 'path-alias'").select("base", F.when(star > 0, F.regexp_replace(F.split(name, r"\*")[0], "/$", "")).otherwise(name).alias("key"), F.when(star > 0, "alias").otherwise("exact").alias("rule"), own.alias("to"), F.when(star > 0, F.element_at(F.split(name, r"\*"), 2)).otherwise(F.lit("")).alias("tail"))
    entry = f.filter(F.col("kind").isin("main", "types", "export") | ((F.col("kind") == "module") & in_package)).filter("package is not null")
    suffix = F.regexp_replace(name, r"^\./?|^\.$", "")
    wanted = F.when((F.col("kind") == "export") & (suffix != ""), F.concat_ws("/", "package", suffix)).otherwise(F.col("package"))
    entries = entry.select("base", wanted.alias("key"), F.lit("exact").alias("rule"), own.alias("to"), F.lit("").alias("tail"))
    every = modules.unionByName(spaces).unionByName(aliases).unionByName(entries)
    # namespaces compare without case
    low = asked.join(every.filter("rule = 'psr'"), F.lower("head") == F.col("key"))
    met = low.unionByName(asked.join(every.filter("rule <> 'psr'"), F.col("head") == F.col("key")))
    rest = F.regexp_replace(F.substring(F.col("asked"), F.length("head") + 1, F.length("asked")), r"^/+", "")
    middle = F.when(F.col("tail") != "", F.substring(rest, F.lit(1), F.length(rest) - F.length("tail"))).otherwise(rest)
    whole = F.col("asked") == F.col("head")
    expected = (
        F.when(F.col("rule") == "module", joined(F.col("base"), rest))
        .when(F.col("rule") == "psr", joined(F.concat_ws("/", "base", "to"), F.replace(F.replace(rest, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))))
        .when((F.col("rule") == "alias") & rest.endswith(F.col("tail")) & (rest != ""), joined(F.col("base"), F.replace(F.col("to"), F.lit("*"), middle)))
        .when((F.col("rule") == "exact") & whole, joined(F.col("base"), F.col("to")))
    )
    return met.select("import_id", expected.alias("expected")).filter("expected is not null").distinct()


def fact_candidates(imports: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """``import_id, to_handle, tier, sub`` of the files at the paths that manifests map a target to, or below them."""
    p = normal(F.col("path"))
    parts = F.split(p, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keyed = files.select(F.col("handle").alias("to_handle"), F.explode(F.array_distinct(F.concat(F.array(p, bare(p)), folders))).alias("expected"))
    met = fact_paths(imports, facts).join(keyed, "expected").join(imports.select("import_id", "from_handle"), "import_id").filter("to_handle <> from_handle")
    return met.select("import_id", "to_handle", F.lit(FACT).alias("tier"), F.lit(0).alias("sub")).distinct()


def name_candidates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``import_id, to_handle, tier, sub`` of the symbols that the target names, qualified or plain."""
    own = files.select(F.col("handle").alias("to_handle"), F.explode(F.array(F.struct(F.lit(QUALIFIED).alias("tier"), F.col("qualified_name").alias("target")), F.struct(F.lit(NAME).alias("tier"), F.col("name").alias("target")))).alias("n"))
    met = imports.select("import_id", "from_handle", "target").join(own.select("to_handle", "n.tier", "n.target"), "target").filter("to_handle <> from_handle")
    return met.select("import_id", "to_handle", "tier", F.lit(0).alias("sub")).distinct()


def unique(candidates: DataFrame) -> DataFrame:
    """``import_id, to_handle, tier`` where the best tier, and in it the best part, holds one symbol only."""
    per = candidates.groupBy("import_id", "tier", "sub").agg(F.min("to_handle").alias("to_handle"), F.max("to_handle").alias("last"))
    best = per.groupBy("import_id").agg(F.min(F.struct("tier", "sub", "to_handle", "last")).alias("b"))
    return best.filter("b.to_handle = b.last").select("import_id", "b.to_handle", F.col("b.tier").cast("long").alias("tier"))


def link_imports(imports: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """``import_id, to_handle, tier``; imports: ``import_id, from_handle, importer, target``."""
    return unique(path_candidates(imports, files).unionByName(fact_candidates(imports, files, facts)).unionByName(name_candidates(imports, files)))


def module_owners(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates that all lie in one file come down to the symbol that owns it; files have ``handle, path, kind``."""
    own = candidates.join(files.select(F.col("handle").alias("to_handle"), "path", "kind"), "to_handle")
    one = own.groupBy("import_id").agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.bool_or(F.col("kind").isin("module", "package")).alias("owned")).filter("lo = hi and owned").select("import_id")
    kept = own.join(one, "import_id", "left_semi").filter(F.col("kind").isin("module", "package")).unionByName(own.join(one, "import_id", "left_anti"))
    return kept.select(*candidates.columns)
