"""Scores of files and symbols for a task, and what moves them: hints, neighbours, fused rankings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import paths as P
from quarrystone.functions import text as T
from quarrystone.session import shuffled

# Words by which a task asks for tests.
TEST_WORDS = ["test", "tests", "spec", "fix", "bug", "broken", "failing", "failure"]


@dataclass(frozen=True)
class Hints:
    """What the user has at hand: the active file, open and changed ones, and files found by meaning with a similarity."""

    active: str | None = None
    opened: Sequence[str] = field(default_factory=tuple)
    changed: Sequence[str] = field(default_factory=tuple)
    similar: DataFrame | None = None

    def table(self, spark) -> DataFrame:
        """``(path, active, opened, changed, similarity)``, one row for each hinted path."""
        rows = [(p, p == self.active, p in set(self.opened), p in set(self.changed)) for p in dict.fromkeys([*([self.active] if self.active else []), *self.opened, *self.changed])]
        known = spark.createDataFrame(rows, "path string, active boolean, opened boolean, changed boolean")
        if self.similar is None:
            return known.withColumn("similarity", F.lit(None).cast("double"))
        similar = self.similar.groupBy("path").agg(F.max("similarity").alias("similarity"))
        return known.join(shuffled(similar), "path", "full").na.fill(False, ["active", "opened", "changed"])


def task_terms(task: Column) -> Column:
    return T.terms(task)


def wants_tests(terms: Column) -> Column:
    return F.arrays_overlap(terms, F.array(*[F.lit(x) for x in TEST_WORDS]))


def terms_of(spark, task: str) -> list[str]:
    """The terms of one task, for expressions that unroll over them."""
    return list(spark.range(1).select(T.terms(F.lit(task)).alias("t")).first()["t"])


def has(term: str):
    """A test of whether a text contains the term."""
    return lambda text: text.contains(term)


def score_files(files: DataFrame, imports: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """``(path, score)`` of every file: for each term 10 if its path has it, 4 if an import, 8 if a decorator, 6 if a
    symbol's name. Each side is reduced to one row of flags a file before it is joined, in one pass over its rows."""

    def flags(rows: DataFrame, key: str, value: Column, points: int, name: str) -> DataFrame:
        hit = [F.max(F.coalesce(value.contains(t), F.lit(False)).cast("int")).alias(f"h{i}") for i, t in enumerate(terms)]
        if not hit:
            return rows.select(F.col(key).alias("path"), F.lit(0).alias(name)).distinct()
        total = sum((F.col(f"h{i}") for i in range(len(terms))), F.lit(0)) * points
        return rows.groupBy(F.col(key).alias("path")).agg(*hit).select("path", total.alias(name))

    squashed = T.squash(F.col("path"))
    own = F.lit(0)
    decorators = F.coalesce(F.transform("decorators", F.lower), F.array().cast("array<string>"))
    for t in terms:
        own = own + F.when(squashed.contains(t), 10).otherwise(0) + F.when(F.exists(decorators, has(t)), 8).otherwise(0)
    base = files.where("path is not null").select("path", own.alias("own"))
    by_import = flags(imports, "path", F.lower("specifier"), 4, "imported")
    by_symbol = flags(symbols, "path", T.squash(F.col("name")), 6, "named")
    joined = base.join(shuffled(by_import), "path", "left").join(shuffled(by_symbol), "path", "left")
    return joined.select("path", (F.col("own") + F.coalesce("imported", F.lit(0)) + F.coalesce("named", F.lit(0))).cast("long").alias("score"))


def top_files(scores: DataFrame, top: int = 16) -> DataFrame:
    return scores.where("score > 0").orderBy(F.desc("score"), "path").limit(top)


def score_symbols(symbols: DataFrame, imports: DataFrame, file_scores: DataFrame, terms: list[str], squashed_task: str) -> DataFrame:
    """``(id, path, name, score)`` of every different symbol: a quarter of its file's score (8 at most), 25 if the task
    contains its name, and for each term 18 if it is the name or the parent's, else 9 if it is part of one; 6 if in the
    path, 8 in a decorator, 4 in a tag, 3 in what the file imports; 18 in a test file if the task asks for tests."""
    rows = symbols.select("id", "path", "name", "parent_name", "decorators", "tags").where("id is not null").dropDuplicates(["id"])
    words = F.lower(F.concat_ws(" ", F.array(F.col("specifier")), "imported_names"))
    hit = [F.max(F.coalesce(words.contains(t), F.lit(False)).cast("int")).alias(f"h{i}") for i, t in enumerate(terms)]
    context = imports.groupBy("path").agg(*hit) if hit else imports.select("path").distinct()
    joined = rows.join(shuffled(file_scores.select("path", "score")), "path", "left").join(shuffled(context), "path", "left")
    name, parent = T.squash(F.coalesce("name", F.lit(""))), T.squash(F.coalesce("parent_name", F.lit("")))
    path = T.squash(F.col("path"))
    decorators = F.coalesce(F.transform("decorators", F.lower), F.array().cast("array<string>"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    score = F.least(F.coalesce("score", F.lit(0)) / F.lit(4.0), F.lit(8.0)) + F.when((F.length(name) > 0) & F.lit(squashed_task).contains(name), 25.0).otherwise(0.0)
    for i, t in enumerate(terms):
        score = score + F.when((name == t) | (parent == t), 18.0).when(name.contains(t) | parent.contains(t), 9.0).otherwise(0.0)
        score = score + F.when(path.contains(t), 6.0).otherwise(0.0) + F.when(F.exists(decorators, has(t)), 8.0).otherwise(0.0)
        score = score + F.when(F.exists(tags, has(t)), 4.0).otherwise(0.0) + F.coalesce(F.col(f"h{i}"), F.lit(0)) * 3.0
    if set(terms) & set(TEST_WORDS):
        score = score + F.when(P.is_test(F.col("path")), 18.0).otherwise(0.0)
    return joined.select("id", "path", "name", score.alias("score"))


def hint_matches(files: DataFrame, hints: DataFrame) -> DataFrame:
    """``(path, score)``: 1 for every hinted file."""
    return files.select("path").distinct().join(shuffled(hints), "path", "left_semi").withColumn("score", F.lit(1).cast("long"))


def merge_scores(*scores: DataFrame) -> DataFrame:
    """``(path, score)``: the sum of a path's scores."""
    every = scores[0].select("path", "score")
    for more in scores[1:]:
        every = every.union(more.select("path", "score"))
    return every.groupBy("path").agg(F.sum("score").alias("score"))


def boost_by_hints(scores: DataFrame, hints: DataFrame) -> DataFrame:
    """25 for the active file, 12 for open and 30 for changed ones, and up to 40 by similarity."""
    joined = scores.join(shuffled(hints), "path", "left")
    extra = F.when(F.col("active"), 25).otherwise(0) + F.when(F.col("opened"), 12).otherwise(0) + F.when(F.col("changed"), 30).otherwise(0) + F.coalesce(T.half_up(F.col("similarity") * 40), F.lit(0))
    return joined.select("path", (F.col("score") + extra).alias("score"))


def boost_by_neighbours(scores: DataFrame, edges: DataFrame, matched: DataFrame, tests: bool) -> DataFrame:
    """7 for files that import a matched one, 7 for files that one imports, 45 for test files if the task wants tests."""
    importing = edges.join(shuffled(matched.select(F.col("path").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("path")).distinct().withColumn("i", F.lit(7))
    imported = edges.join(shuffled(matched.select(F.col("path").alias("src"))), "src", "left_semi").select(F.col("dst").alias("path")).distinct().withColumn("o", F.lit(7))
    joined = scores.join(shuffled(importing), "path", "left").join(shuffled(imported), "path", "left")
    extra = F.coalesce("i", F.lit(0)) + F.coalesce("o", F.lit(0)) + (F.when(P.is_test(F.col("path")), 45).otherwise(0) if tests else F.lit(0))
    return joined.select("path", (F.col("score") + extra).alias("score"))


def ranked(rows: DataFrame, order: Sequence[Column], item: str = "path", within: Sequence[str] = ()) -> DataFrame:
    """``item`` (and the columns of ``within``) with its rank from 1. A rank over a whole table has no other key to
    split by: it is computed by a range-partitioned sort and offsets of the partitions, not in one task."""
    if within:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).select(*within, item, "rank")
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(item, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    from quarrystone.session import staged

    spread = staged(spread, "ranked")  # positions stay as they are
    sizes = spread.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(offsets.select("__p", "first", "before")), "__p").select(item, (F.col("__i") - F.col("first") + F.col("before") + 1).alias("rank"))


def fuse(rankings: Sequence[DataFrame], item: str = "path", k: int = 60) -> DataFrame:
    """``(item, score)``: the sum of 1 / (k + rank) over the rankings that have the item."""
    every = rankings[0].select(item, "rank")
    for more in rankings[1:]:
        every = every.union(more.select(item, "rank"))
    return every.groupBy(item).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def scaled(rows: DataFrame, value: str) -> DataFrame:
    """The value as a share of the largest, which is one number and broadcast."""
    most = rows.agg(F.max(value).alias("__most"))
    return rows.crossJoin(F.broadcast(most)).withColumn(value, F.coalesce(F.try_divide(F.col(value), F.col("__most")), F.lit(0.0))).drop("__most")


def expand(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of a scored file, either way, get 3 less than it (1 at least) where that is more than they have."""
    both = edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    offered = scores.select(F.col("path").alias("src"), "score").join(shuffled(both), "src").groupBy(F.col("dst").alias("path")).agg(F.greatest(F.lit(1), F.max("score") - 3).alias("offer"))
    joined = scores.join(shuffled(offered), "path", "full")
    return joined.select("path", F.greatest("score", "offer").alias("score"))
