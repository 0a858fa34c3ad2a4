"""Chunks of files for indexing, their hashes, and incremental refresh of a stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as T

CUT_MARK = "\n… (truncated)"


def header(path: Column, what: Column) -> Column:
    """The line that says where a chunk comes from."""
    return F.concat(F.lit("// "), F.concat_ws(" › ", path, what))


def cut_body(body: Column, most: int = 1500) -> Column:
    return F.when(F.length(body) <= most, body).otherwise(F.concat(F.substring(body, 1, most), F.lit(CUT_MARK)))


def line_windows(rows: DataFrame, key: str = "path", text: str = "text", size: int = 60, overlap: int = 10) -> DataFrame:
    """``(key, start_line, end_line, body)`` of windows of ``size`` lines that share ``overlap`` lines with the one before.

    Windows start every ``size - overlap`` lines (1 at least); the first one that reaches the end is the last. Blank
    windows and texts, and null texts, give none.
    """
    step = max(1, size - overlap)
    split = rows.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key), T.lines(F.col(text)).alias("__l")).withColumn("__n", F.size("__l"))
    starts = F.filter(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(step)), lambda s: (s == 0) | (s - step + size < F.col("__n")))
    spread = split.select(key, "__l", "__n", F.explode(starts).alias("__s"))
    body = F.array_join(F.slice("__l", F.col("__s") + 1, F.lit(size)), "\n")
    shaped = spread.select(key, (F.col("__s") + 1).alias("start_line"), F.least(F.col("__s") + size, F.col("__n")).alias("end_line"), body.alias("body"))
    return shaped.where(F.col("body").rlike(r"\S"))


def chunkable_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols without a parent, or whose parent isn't a symbol of the same file."""
    rows = symbols.dropDuplicates(["id"])
    owners = rows.select("path", F.col("name").alias("parent_name")).where("parent_name is not null").distinct()
    return rows.join(owners, ["path", "parent_name"], "left_anti")


def symbol_chunks(files: DataFrame, symbols: DataFrame, most_chars: int = 1500, per_file: int = 200) -> DataFrame:
    """``(id, path, kind, symbol, start_line, end_line, text, hash)`` of the first ``per_file`` symbols of each file."""
    rows = chunkable_symbols(symbols).where("path is not null")
    order = Window.partitionBy("path").orderBy("start_line", "id")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_file)
    lined = files.where("text is not null").select("path", T.lines(F.col("text")).alias("l"))
    joined = rows.join(lined, "path")
    size = F.size("l")
    first = F.least(F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1))), F.greatest(size, F.lit(1)))
    last = F.greatest(first, F.least(F.coalesce("end_line", F.lit(1)), size))
    name = F.concat_ws(".", "parent_name", "name")
    body = cut_body(F.array_join(F.slice("l", first, last - first + 1), "\n"), most_chars)
    text = F.concat(header(F.col("path"), F.concat_ws(" ", "type", name)), F.lit("\n"), body)
    ident = F.concat(F.col("path"), F.lit("#symbol:"), name, F.lit("@"), F.col("start_line").cast("string"))
    return joined.select(ident.alias("id"), "path", F.lit("symbol").alias("kind"), F.col("name").alias("symbol"), first.alias("start_line"), last.alias("end_line"), text.alias("text"), T.short_hash(text).alias("hash"))


def file_summaries(files: DataFrame, symbols: DataFrame, imports: DataFrame, most_symbols: int = 30, most_imports: int = 20) -> DataFrame:
    """``(path, doc, hash)``: path, module, decorators, the first symbols and the first imports of each file, as text.

    Only the rows that count are collected: ranks cut each file's symbols and imports first.
    """
    by_line = Window.partitionBy("path").orderBy("start_line", "id")
    top = symbols.dropDuplicates(["id"]).select("path", "id", "start_line", "type", "name").withColumn("n", F.row_number().over(by_line)).where(F.col("n") <= most_symbols)
    named = top.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(" ", "type", "name").alias("s")))), lambda x: x["s"]).alias("s"))
    by_ord = Window.partitionBy("path").orderBy("ord", "specifier")
    first = imports.where("specifier is not null").select("path", "ord", "specifier").distinct().withColumn("n", F.row_number().over(by_ord)).where(F.col("n") <= most_imports)
    taken = first.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "specifier"))), lambda x: x["specifier"]).alias("i"))
    joined = files.where("path is not null").select("path", "module", "decorators").join(named, "path", "left").join(taken, "path", "left")
    decorators = F.when(F.size("decorators") > 0, F.concat(F.lit("decorators: "), F.array_join("decorators", ", ")))
    doc = F.concat_ws("\n", F.concat(F.lit("file: "), F.col("path")), F.when(F.length("module") > 0, F.concat(F.lit("module: "), F.col("module"))), decorators, F.array_join("s", "\n"), F.when(F.size("i") > 0, F.concat(F.lit("imports: "), F.array_join("i", ", "))))
    return joined.select("path", doc.alias("doc"), T.short_hash(doc).alias("hash"))


def stale_chunks(chunks: DataFrame, stored: DataFrame, ident: str = "id", digest: str = "hash") -> DataFrame:
    """Chunks that aren't stored or are stored with another hash."""
    old = stored.select(F.col(ident), F.col(digest).alias("__h")).dropDuplicates([ident])
    return chunks.join(old, ident, "left").where(~F.col(digest).eqNullSafe(F.col("__h")) | F.col("__h").isNull()).drop("__h")


def upsert(stored: DataFrame, fresh: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """Stored rows without those whose key is fresh or removed, and the fresh rows."""
    gone = fresh.select(key) if removed is None else fresh.select(key).union(removed.select(key))
    return stored.join(gone.distinct(), key, "left_anti").unionByName(fresh)


def prune(stored: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is to be kept."""
    return stored.join(keep.select(key).distinct(), key, "left_semi")


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
