"""Measures of retrieval and of saved context, and plain baselines to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.session import shuffled

# Words that a baseline search leaves out.
STOP_WORDS = [
    "does", "after", "where", "when", "what", "with", "that", "this", "have", "from", "into", "works", "how", "before", "make", "sure",
    "even", "looks", "small", "enough", "running", "somewhere", "anything", "slightly",
]


def occurrences(text: Column, term: Column) -> Column:
    """How often a plain term occurs, without overlaps."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(0)


def grep_terms(query: str) -> list[str]:
    """Different words of more than three letters that aren't stop words."""
    import re

    return list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", query.lower()) if len(w) > 3 and w not in STOP_WORDS))


def grep_scores(rows: DataFrame, key: str, text: str, terms: list[str], most_hits: int = 10) -> DataFrame:
    """``(key, score)``: for every different term a text has, 10 and one for each hit up to ``most_hits``."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = F.lit(0).cast("long")
    for t in terms:
        n = occurrences(F.col("__t"), F.lit(t))
        score = score + F.when(n > 0, F.least(n, F.lit(most_hits)) + 10).otherwise(0)
    return rows.select(key, low.alias("__t")).select(key, score.alias("score")).where("score > 0")


def grep_matches(rows: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """``key`` of texts with at least two of the terms (all of them if there are fewer)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = sum((F.col("__t").contains(t).cast("int") for t in terms), F.lit(0))
    return rows.select(key, low.alias("__t")).where(hits >= min(2, len(terms))).select(key) if terms else rows.select(key).limit(0)


def first_hits(ranking: DataFrame, truth: DataFrame, query: str, item: str) -> DataFrame:
    """``(query, rank)``: of every query of ``truth`` the best rank of an expected item, null if none is ranked."""
    found = ranking.join(truth.select(query, item).distinct(), [query, item]).groupBy(query).agg(F.min("rank").alias("rank"))
    return truth.select(query).distinct().join(found, query, "left")


def retrieval_metrics(hits: DataFrame, kind: str | None = None) -> DataFrame:
    """Queries, share of first and of fifth ranks reached, and mean reciprocal rank (0 for a miss), with three digits;
    by ``kind`` as well, in one pass, where a null kind is the total."""
    measures = [
        F.count("*").alias("queries"),
        F.round(F.avg(F.when(F.col("rank") <= 1, 1.0).otherwise(0.0)), 3).alias("hit_at_1"),
        F.round(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), 3).alias("hit_at_5"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 3).alias("mrr"),
    ]
    return hits.agg(*measures) if kind is None else hits.rollup(kind).agg(*measures)


def savings(calls: DataFrame) -> DataFrame:
    """One row over ``(call_id, outcome, prompt_tokens, prompt_bytes, baseline_tokens, baseline_bytes)``.

    Calls that were sent and have a baseline count. Tokens that weren't measured are a quarter of the bytes, rounded up
    for each call. ``best_call`` is the earliest of those that saved most, if anything was saved.
    """
    sent = calls.where("outcome = 'sent' and (baseline_tokens is not null or baseline_bytes is not null)")
    actual = F.coalesce("prompt_tokens", T.byte_token_estimate(F.col("prompt_bytes")))
    baseline = F.coalesce("baseline_tokens", T.byte_token_estimate(F.col("baseline_bytes")))
    rows = sent.select("call_id", actual.cast("long").alias("actual"), baseline.cast("long").alias("baseline"), F.col("prompt_tokens").isNotNull().alias("measured")).withColumn("saved", F.col("baseline") - F.col("actual"))
    total = rows.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("actual"), F.lit(0)).alias("actual_tokens"),
        F.coalesce(F.sum("baseline"), F.lit(0)).alias("baseline_tokens"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.bool_or("measured"), F.lit(False)).alias("any_measured"),
        F.min_by(F.when(F.col("saved") > 0, F.col("call_id")), F.struct((-F.col("saved")).alias("s"), "call_id")).alias("best_call"),
        F.min_by("call_id", F.struct("saved", "call_id")).alias("worst_call"),
    )
    percent = T.share(F.col("saved_tokens"), F.col("baseline_tokens"))
    return total.withColumn("saved_percent", percent).withColumn("average_saved", F.coalesce(T.half_up(F.try_divide(F.col("saved_tokens").cast("double"), F.col("calls").cast("double"))), F.lit(0)))


def naive_baseline(calls: DataFrame, sizes: DataFrame, extra: int = 600) -> DataFrame:
    """``(call_id, bytes)``: the whole size of the files that a call included (0 for unknown ones), and ``extra``."""
    spread = calls.select("call_id", F.explode_outer("files").alias("path"))
    known = sizes.groupBy("path").agg(F.max("bytes").alias("bytes"))
    return spread.join(shuffled(known), "path", "left").groupBy("call_id").agg((F.coalesce(F.sum("bytes"), F.lit(0)) + extra).alias("bytes"))


def answers(answer: str, path: str, facts: str) -> tuple[Column, Column]:
    """Whether an answer has the expected path (true if none is expected), whatever its case and slashes, and whether all
    facts, which are patterns without regard to case, are found in it."""
    text = F.coalesce(F.col(answer), F.lit(""))
    place = F.replace(F.lower(text), F.lit("\\"), F.lit("/"))
    known = F.coalesce(F.col(facts), F.array().cast("array<string>"))
    return F.coalesce(F.contains(place, F.lower(F.col(path))), F.lit(True)), F.forall(known, lambda f: F.coalesce(F.regexp_like(text, F.concat(F.lit("(?i)"), f)), F.lit(False)))


def by_arm(results: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """Runs, correct ones, their share, and means of measures over those that have them, for each group."""
    means = [F.round(F.avg(m), 3).alias(f"mean_{m}") for m in measures]
    return results.groupBy(*group).agg(F.count("*").alias("runs"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("double")), 3).alias("share"), *means)


def token_totals(rows: DataFrame, used: str, others: list[str]) -> DataFrame:
    """One row: the tokens used, those of other ways, and the percentage saved against each (0 where they have none)."""
    sums = rows.agg(F.count("*").alias("tasks"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [used, *others]))
    return sums.select("*", *(T.share(F.col(c) - F.col(used), F.col(c)).alias(f"saved_{c}") for c in others))


def newest(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")
