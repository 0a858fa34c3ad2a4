"""Imports resolved to files, and what follows from them: file edges and symbol references.

Every strategy is an equi-join: of candidate paths with paths, of module names, of path suffixes and directories that
are exploded once per file. A specifier that doesn't start with a dot resolves alike wherever it stands, so different
ones are resolved once and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import paths as P
from quarrystone.session import discard, shuffled, staged

# What is tried after a path, in this order.
RESOLVED_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".groovy", ".cs", ".vb",
    ".php", ".rb", ".swift", ".lua", ".c", ".cc", ".cpp", ".cxx", ".h", ".hpp",
]
INDEX_NAMES = ["index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py", "mod.rs"]
ENDINGS = ["", *RESOLVED_EXTENSIONS, *["/" + n for n in INDEX_NAMES]]


def endings() -> Column:
    return F.array(*[F.lit(x) for x in ENDINGS])


def candidates(base: Column) -> Column:
    return F.transform(endings(), lambda e: F.concat(base, e))


def import_rows(imports: DataFrame) -> DataFrame:
    """Different imports with a specifier that isn't blank; ``spec`` is it without outer white space."""
    rows = imports.select("path", "ord", F.trim("specifier").alias("spec"), "imported_names", "is_type_only", "line")
    return rows.where("path is not null and length(spec) > 0").distinct()


def _relative(rows: DataFrame, known: DataFrame) -> DataFrame:
    asked = rows.where(F.col("spec").startswith(".")).select("path", "spec").distinct()
    base = P.normalized(F.concat(P.dirname(F.col("path")), F.lit("/"), F.col("spec")))
    tried = asked.select("path", "spec", F.posexplode(candidates(base)).alias("pos", "target"))
    return tried.join(shuffled(known), "target").groupBy("path", "spec").agg(F.min_by("target", "pos").alias("target"))


def _namespaces(specs: DataFrame, files: DataFrame) -> DataFrame:
    modules = files.where("length(module) > 0").select("module", F.col("path").alias("target"))
    direct = specs.join(shuffled(modules.withColumnRenamed("module", "spec")), "spec").select("spec", F.lit(1).alias("prio"), "target")
    split = specs.select("spec", F.regexp_extract("spec", r"^(.+)\.[^.]*$", 1).alias("module"), F.substring_index("spec", ".", -1).alias("leaf")).where("length(module) > 0")
    inside = split.join(shuffled(modules), "module").withColumn("same", (P.stem(F.col("target")) == F.col("leaf")).cast("int"))
    best = inside.withColumn("most", F.max("same").over(Window.partitionBy("spec"))).where("same = most")
    return direct.union(best.select("spec", F.lit(2).alias("prio"), "target"))


def _packages(specs: DataFrame, files: DataFrame) -> DataFrame:
    parts = F.filter(F.split(P.posix(F.col("spec")), "/"), lambda s: s != "")
    scoped = F.col("spec").startswith("@")
    first = F.when(scoped, 2).otherwise(1)
    asked = specs.select("spec", scoped.alias("scoped"), F.try_element_at(parts, first).alias("name"), F.array_join(F.slice(parts, first + 1, F.lit(1000)), "/").alias("sub")).where("name is not null")
    sub = F.when(F.length("sub") > 0, F.concat(F.lit("/"), F.col("sub"))).otherwise("")
    roots = F.array(F.lit(""), F.lit("/src"), F.lit("/lib"))
    tried = F.flatten(F.transform(roots, lambda r: F.transform(endings(), lambda e: F.concat(r, sub, e))))
    under = files.select("path", F.explode(P.ancestors(F.col("path"))).alias("dir"))
    directories = under.select("dir").distinct()
    places = under.select("dir", F.expr("substring(path, length(dir) + 1)").alias("rest"), F.col("path").alias("target"))
    ext = F.regexp_extract("path", "(" + "|".join(e.replace(".", r"\.") for e in RESOLVED_EXTENSIONS) + ")$", 1)
    beside = files.select("path", ext.alias("rest")).where("length(rest) > 0").select(F.expr("substring(path, 1, length(path) - length(rest))").alias("dir"), "rest", F.col("path").alias("target"))
    places = places.union(beside.join(shuffled(directories), "dir", "left_semi")).withColumn("name", P.basename(F.col("dir")))
    single = directories.select(P.basename(F.col("dir")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    asked = asked.join(shuffled(single), "name").where("scoped or n = 1").select("spec", "name", F.posexplode(tried).alias("pos", "rest"))
    hits = asked.join(shuffled(places), ["name", "rest"])
    depth = F.size(F.split("dir", "/"))
    return hits.groupBy("spec").agg(F.min_by("target", F.struct(depth, "dir", "pos")).alias("target")).select("spec", F.lit(3).alias("prio"), "target")


def _path_like(specs: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace(P.posix(F.col("spec")), "^@/", ""), "^/+", "")
    asked = specs.select("spec", plain.alias("want")).where("length(want) > 0")
    dotted = asked.where("want like '%.%' and want not like '%/%'").select("spec", F.replace("want", F.lit("."), F.lit("/")).alias("want"))
    tails = files.select(F.col("path").alias("target"), F.explode(P.suffixes(F.col("path"))).alias("want"))

    def tried(rows: DataFrame, prio: int) -> DataFrame:
        hits = rows.select("spec", F.posexplode(candidates(F.col("want"))).alias("pos", "target")).join(shuffled(known), "target")
        return hits.groupBy("spec").agg(F.min_by("target", "pos").alias("target")).select("spec", F.lit(prio).alias("prio"), "target")

    def ending(rows: DataFrame, prio: int) -> DataFrame:
        return rows.join(shuffled(tails), "want").groupBy("spec").agg(F.min("target").alias("target")).select("spec", F.lit(prio).alias("prio"), "target")

    return tried(asked, 4).union(ending(asked, 5)).union(tried(dotted, 6)).union(ending(dotted, 7))


def _directories(specs: DataFrame, files: DataFrame) -> DataFrame:
    plain = F.regexp_replace(P.posix(F.col("spec")), "^/+|/+$", "")
    asked = specs.select("spec", plain.alias("want")).where("want like '%/%'").select("spec", F.posexplode(P.suffixes(F.col("want"))).alias("start", "dir"))
    directories = files.select(P.dirname(F.col("path")).alias("dir"), F.col("path").alias("target")).where("dir <> '.'")
    reached = asked.join(shuffled(directories.select("dir").distinct()), "dir", "left_semi").groupBy("spec").agg(F.min_by("dir", "start").alias("dir"))
    return reached.join(shuffled(directories), "dir").select("spec", F.lit(8).alias("prio"), "target")


def _base_names(specs: DataFrame, files: DataFrame) -> DataFrame:
    parts = F.filter(F.split(F.regexp_replace("spec", "^@", ""), r"[.\\/:]"), lambda s: s != "")
    asked = specs.select("spec", F.try_element_at(parts, F.lit(-1)).alias("name")).where("name is not null")
    single = files.groupBy(P.stem(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1 and length(name) > 0")
    return asked.join(shuffled(single), "name").select("spec", F.lit(9).alias("prio"), "target")


def _found(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports, the file that each specifier with a dot in front reaches, ``(path, spec, target)``, and those that each
    other one reaches, ``(spec, target, prio)``; all are staged.

    A strategy is asked only for the specifiers that none before it has found: one plan of them all, again wherever edges
    are read, is more than a driver can hold.
    """
    files = staged(files.select("path", "module").where("path is not null").dropDuplicates(["path"]), "files")
    known = files.select(F.col("path").alias("target"))
    rows = staged(import_rows(imports), "imports")
    beside = staged(_relative(rows, known), "beside")
    strategies = [
        lambda specs: _namespaces(specs, files),
        lambda specs: _packages(specs, files),
        lambda specs: _path_like(specs, files, known),
        lambda specs: _directories(specs, files),
        lambda specs: _base_names(specs, files),
    ]
    specs, best = staged(rows.where(~F.col("spec").startswith(".")).select("spec").distinct(), "specs"), None
    for strategy in strategies:
        if best is not None:
            last, specs = specs, staged(specs.join(shuffled(found), "spec", "left_anti"), "specs")
            discard(last)
        found = strategy(specs).withColumn("least", F.min("prio").over(Window.partitionBy("spec"))).where("prio = least").select("spec", "target", "prio").distinct()
        found = staged(found, "found")
        best = found if best is None else best.union(found)
    return rows, beside, best


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, ord, spec, imported_names, line, target, prio)``: every import with each file that it resolves to.

    A specifier that starts with a dot is a path beside the file (prio 0). Another one is, in this order, a module (1)
    or the parent of a type in it (2), a workspace package (3), a path or the end of one (4, 5), a dotted path (6, 7),
    a directory of which all files count (8), or a base name that only one file has (9); the first that finds something
    wins. Among files that fit alike the smallest path wins. Imports without a path or specifier, and repeated rows,
    add nothing; an import may resolve to its own file.
    """
    rows, beside, best = _found(imports, files)
    near = rows.join(shuffled(beside), ["path", "spec"]).withColumn("prio", F.lit(0))
    columns = ["path", "ord", "spec", "imported_names", "line", "target", "prio"]
    return near.select(columns).union(rows.join(shuffled(best), "spec").select(columns))


def resolution_steps(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(prio, links, specifiers)``: rows of ``resolve_imports`` by strategy, and their different specifiers.

    A directory's files times the imports of it are many links, so they are multiplied for each specifier, not listed.
    """
    rows, beside, best = _found(imports, files)
    near = rows.join(shuffled(beside), ["path", "spec"]).groupBy("spec").agg(F.count("*").alias("links")).withColumn("prio", F.lit(0))
    reached = best.groupBy("spec", "prio").agg(F.count("*").alias("files"))
    far = rows.groupBy("spec").agg(F.count("*").alias("n")).join(shuffled(reached), "spec").withColumn("links", F.col("n") * F.col("files"))
    columns = ["prio", "spec", "links"]
    return near.select(columns).union(far.select(columns)).groupBy("prio").agg(F.sum("links").alias("links"), F.count("*").alias("specifiers"))


def file_edges(resolved: DataFrame) -> DataFrame:
    """Different ``(src, dst)`` with two different files."""
    return resolved.where("path <> target").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def count_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(edges)``, rows of which the sum is that of ``file_edges`` of ``resolve_imports``, without listing every link.

    Specifiers that reach all files of a module, those of it with a type's name, or a directory share one set of files.
    A file has one module and one directory, and the sets of types lie within those of modules; so what a file imports
    is the sum of its modules and types, and of its directories, less what each two of these share, and less itself.
    Files that are reached alone are listed, at most one for each import, and count unless such a set holds them.
    """
    rows, beside, best = _found(imports, files)
    module = F.regexp_extract("spec", r"^(.+)\.[^.]*$", 1)
    typed = (F.col("prio") == 2) & (P.stem(F.col("target")) == F.substring_index("spec", ".", -1))
    kind = F.when(typed, "type").when(F.col("prio") <= 2, "module").when(F.col("prio") == 8, "directory").otherwise("file")
    key = F.when(typed | (F.col("prio") == 1), F.col("spec")).when(F.col("prio") == 2, module).when(F.col("prio") == 8, P.dirname(F.col("target"))).otherwise(F.col("target"))
    sets = best.select("spec", kind.alias("kind"), key.alias("key"), "target")
    asked = rows.select("path", "spec").distinct().join(shuffled(sets.select("spec", "kind", "key").distinct()), "spec").select("path", "kind", "key").distinct()
    asked = staged(asked, "asked")
    alone = asked.where("kind = 'file'").select("path", F.col("key").alias("target")).union(rows.join(shuffled(beside), ["path", "spec"]).select("path", "target"))
    members = staged(sets.where("kind <> 'file'").select("kind", "key", "target").distinct(), "members")
    inside = F.when(F.col("kind") == "module", F.col("key")).when(F.col("kind") == "type", F.regexp_extract("key", r"^(.+)\.[^.]*$", 1))
    whole = F.max(F.col("kind") == "module").over(Window.partitionBy("path", "inside"))
    many = asked.where("kind <> 'file'").withColumn("inside", inside).withColumn("whole", whole).where("kind <> 'type' or not whole").select("path", "kind", "key")
    many = staged(many, "many")
    sizes = members.groupBy("kind", "key").agg(F.count("*").alias("n"))
    directories = F.col("kind") == "directory"
    shared = members.where(~directories).join(shuffled(members.where(directories).select("target", F.col("key").alias("dir"))), "target").groupBy("kind", "key", "dir").agg(F.count("*").alias("n"))
    pairs = many.where(~directories).join(shuffled(many.where(directories).select("path", F.col("key").alias("dir"))), "path")
    own = many.join(shuffled(members.withColumnRenamed("target", "path")), ["path", "kind", "key"]).select("path").distinct()
    held = alone.join(shuffled(members), "target").join(shuffled(many), ["path", "kind", "key"], "left_semi").select("path", "target")
    parts = [
        many.join(shuffled(sizes), ["kind", "key"]).agg(F.sum("n").alias("edges")),
        pairs.join(shuffled(shared), ["kind", "key", "dir"]).agg((-F.sum("n")).alias("edges")),
        own.agg((-F.count("*")).alias("edges")),
        alone.where("path <> target").distinct().join(shuffled(held.distinct()), ["path", "target"], "left_anti").agg(F.count("*").alias("edges")),
    ]
    made = None
    for part in parts:
        counted = staged(part, "part")
        made = counted if made is None else made.union(counted)
    discard(asked, members, many)
    return made


def _exports(symbols: DataFrame) -> DataFrame:
    return symbols.where("exported and name is not null").select(F.col("path").alias("target"), F.col("name").alias("symbol_name")).distinct()


def symbol_references(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(from_path, to_path, symbol_name, line)``: imported names that the file resolved to exports."""
    exported = _exports(symbols)
    named = resolved.where("path <> target").select("path", "ord", "line", "target", F.explode("imported_names").alias("symbol_name"))
    return named.join(shuffled(exported), ["target", "symbol_name"]).select(F.col("path").alias("from_path"), F.col("target").alias("to_path"), "symbol_name", "line", "ord")


def references(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol_references`` of ``resolve_imports``, without listing every link.

    Names that no file exports are dropped first, and different names of a specifier are held against its files' exports
    once; only what is found there is joined with the imports.
    """
    rows, beside, best = _found(imports, files)
    exported = staged(_exports(symbols), "exports")
    named = rows.select("path", "ord", "line", "spec", F.explode("imported_names").alias("symbol_name"))
    named = staged(named.join(shuffled(exported.select("symbol_name").distinct()), "symbol_name", "left_semi"), "named")
    near = named.join(shuffled(beside), ["path", "spec"]).join(shuffled(exported), ["target", "symbol_name"])
    hits = best.join(shuffled(named.select("spec", "symbol_name").distinct()), "spec").join(shuffled(exported), ["target", "symbol_name"])
    far = named.join(shuffled(hits), ["spec", "symbol_name"])
    columns = [F.col("path").alias("from_path"), F.col("target").alias("to_path"), "symbol_name", "line", "ord"]
    return near.where("path <> target").select(columns).union(far.where("path <> target").select(columns))


def usage_counts(references: DataFrame) -> DataFrame:
    """``(defined_in, symbol_name, referenced_by)``: files that use a symbol."""
    return references.groupBy(F.col("to_path").alias("defined_in"), "symbol_name").agg(F.count_distinct("from_path").alias("referenced_by"))
