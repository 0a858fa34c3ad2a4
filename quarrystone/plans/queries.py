"""The queries of the core over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions import paths as P
from quarrystone.functions import text as T
from quarrystone.operators import budget, chunks, classify, extract, graph, metrics, rank, report, resolve, retrieve, search, snapshots
from quarrystone.plans.sql import SQL as SQL
from quarrystone.plans.sql import TASK
from quarrystone.session import shuffled, staged
from quarrystone.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "symbols").distinct()


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.resolve_imports(table(spark, folder, "imports"), table(spark, folder, "files"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.file_edges(_resolved(spark, folder))


def _terms(spark: SparkSession) -> list[str]:
    return rank.terms_of(spark, TASK)


def _file_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rank.score_files(table(spark, folder, "files"), table(spark, folder, "imports"), table(spark, folder, "symbols"), _terms(spark))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, folder, "file_snapshots")).select("snapshot_no", "path", "change")


@query
def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = snapshots.snapshot_changes(table(spark, folder, "file_snapshots"))
    return found.groupBy("snapshot_no", "change").agg(F.count("*").alias("files"), F.count("old_hash").alias("old_hashes"), F.count("new_hash").alias("new_hashes"))


@query
def lexical_score(spark: SparkSession, folder: str) -> DataFrame:
    return _file_scores(spark, folder).where("score > 0")


@query
def lexical_top(spark: SparkSession, folder: str) -> DataFrame:
    return rank.top_files(_file_scores(spark, folder))


@query
def symbol_score(spark: SparkSession, folder: str) -> DataFrame:
    squashed = spark.range(1).select(T.squash(F.lit(TASK))).first()[0]
    scores = rank.score_symbols(_symbols(spark, folder), table(spark, folder, "imports"), _file_scores(spark, folder), _terms(spark), squashed)
    return scores.where("score > 0").select("id", "score")


@query
def path_flags(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("path")
    return table(spark, folder, "files").select(
        "path", P.extension(p).alias("ext"), P.is_supported(p).alias("supported"), P.is_generated(p).alias("generated"), P.is_test(p).alias("test"),
        P.is_script(p).alias("script"), P.top_segment(p).alias("top"), P.stem(p).alias("stem"), P.dirname(p).alias("dir"), P.test_stem(p).alias("test_stem"), F.size(P.ancestors(p)).alias("depth"),
    )


@query
def normal_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "file_snapshots").where("path is not null").select(snapshots.normal_path(F.col("path")).alias("path"), snapshots.normal_hash(F.col("content_hash")).alias("hash")).distinct()


def _references(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.references(table(spark, folder, "imports"), table(spark, folder, "files"), table(spark, folder, "symbols"))


@query
def file_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@query
def resolution_steps(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.resolution_steps(table(spark, folder, "imports"), table(spark, folder, "files"))


@query
def symbol_references(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.symbol_references(_resolved(spark, folder), table(spark, folder, "symbols")).drop("ord")


@query
def usage_counts(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.usage_counts(_references(spark, folder))


@query
def references_by_definition(spark: SparkSession, folder: str) -> DataFrame:
    refs = _references(spark, folder)
    return refs.groupBy("symbol_name").agg(F.count_distinct("to_path").alias("definitions"), F.count_distinct("from_path").alias("users"), F.min("from_path").alias("first_user"))


@query
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(table(spark, folder, "files"), _edges(spark, folder))


@query
def hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return graph.hotspots(table(spark, folder, "files"), _edges(spark, folder))


@query
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    return graph.orphans(table(spark, folder, "files"), _edges(spark, folder))


@query
def impact(spark: SparkSession, folder: str) -> DataFrame:
    seeds = table(spark, folder, "files").where("file_id % 50 = 0").select("path")
    return graph.impact_set(staged(_edges(spark, folder), "edges"), seeds, 3)


@query
def hop_counts(spark: SparkSession, folder: str) -> DataFrame:
    edges = staged(_edges(spark, folder), "edges")
    return graph.hop_counts(edges, edges.agg(F.min("src").alias("path")).where("path is not null")).select("path", "hops", "parent")


@query
def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    seeds = _file_scores(spark, folder).select("path", F.col("score").cast("double").alias("weight"))
    ranks = graph.pagerank(table(spark, folder, "files"), staged(_edges(spark, folder), "edges"), seeds)
    return ranks.select("path", F.round("rank", 9).alias("rank"))


@query
def communities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.communities(table(spark, folder, "files"), staged(_edges(spark, folder), "edges"))


@query
def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return graph.label_propagation(table(spark, folder, "files"), staged(_edges(spark, folder), "edges"))


@query
def repo_communities(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "files").select("path", F.col("repo").alias("community"))
    return report.community_sizes(labels, sample=3).select("community", "size", F.array_join("members", " ").alias("members"))


@query
def connected_parts(spark: SparkSession, folder: str) -> DataFrame:
    from quarrystone.operators.components import connected_components

    return connected_components(staged(_edges(spark, folder), "edges"))


@query
def merged_hints(spark: SparkSession, folder: str) -> DataFrame:
    hints = table(spark, folder, "documents").where("path is not null").select("path").distinct()
    files = table(spark, folder, "files")
    return rank.merge_scores(_file_scores(spark, folder), rank.hint_matches(files, hints)).where("score > 0")


@query
def hint_boosts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("path is not null")
    hints = docs.groupBy("path").agg(
        F.bool_or(F.col("source") == "issue").alias("active"), F.bool_or(F.col("source") == "chat").alias("opened"), F.bool_or(F.col("source") == "commit").alias("changed"),
        F.max(F.when(F.col("source") == "readme", F.length("text") % 100 / 100)).alias("similarity"),
    )
    return rank.boost_by_hints(_file_scores(spark, folder), hints)


@query
def neighbour_boosts(spark: SparkSession, folder: str) -> DataFrame:
    scores = staged(_file_scores(spark, folder), "scores")
    return rank.boost_by_neighbours(scores, staged(_edges(spark, folder), "edges"), scores.where("score >= 10"), True)


@query
def expand_one_hop(spark: SparkSession, folder: str) -> DataFrame:
    return rank.expand(staged(_file_scores(spark, folder).where("score > 0"), "scores"), _edges(spark, folder))


@query
def fused_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.length("text").alias("size"), F.size(T.terms(F.col("text"))).alias("words"))
    rankings = [rank.ranked(docs, [F.desc("size"), F.col("doc_id")], "doc_id"), rank.ranked(docs, [F.desc("words"), F.col("doc_id")], "doc_id")]
    return rank.scaled(rank.fuse(rankings, "doc_id"), "score").select("doc_id", F.round("score", 9).alias("score"))


@query
def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.line_windows(table(spark, folder, "files")).select("path", "start_line", "end_line", T.short_hash(F.col("body")).alias("hash"))


@query
def small_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = chunks.line_windows(table(spark, folder, "documents"), "doc_id", size=4, overlap=1)
    return made.select("doc_id", "start_line", "end_line", F.length("body").alias("size"))


@query
def symbol_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.symbol_chunks(table(spark, folder, "files"), table(spark, folder, "symbols")).select("id", "path", "symbol", "start_line", "end_line", "hash")


@query
def file_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.file_summaries(table(spark, folder, "files"), table(spark, folder, "symbols"), table(spark, folder, "imports")).select("path", "hash")


@query
def stale_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.stale_chunks(table(spark, folder, "code_chunks").select("id", "hash"), table(spark, folder, "chunks"))


@query
def upserted_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshots.listings(table(spark, folder, "file_snapshots"))
    old, new = (chunks.first_of_each(rows.where(F.col("snapshot_no") == n), ["path"], [F.desc("loaded_at"), F.desc_nulls_last("hash")]).select("path", "hash") for n in (1, 2))
    gone = chunks.first_of_each(rows.where("snapshot_no = 3"), ["path"], [F.desc("loaded_at")]).where("hash is null").select("path")
    return chunks.upsert(old, new, "path", gone)


@query
def pruned_index(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.prune(table(spark, folder, "chunks").select("id", "hash"), table(spark, folder, "code_chunks"), "id")


@query
def first_by_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("hash"))
    return chunks.first_of_each(docs, ["hash"], ["doc_id"])


def _top(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "vector")
    return search.top_k(queries, rows, "query", "vec_id", k=8, least=0.0)


@query
def vector_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder).select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


@query
def vector_pool(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    return search.pooled(_top(spark, folder).join(labels, "vec_id"), "label", ("query",)).select("query", "label", F.round("similarity", 6).alias("similarity"))


@query
def vector_stats(spark: SparkSession, folder: str) -> DataFrame:
    return search.vector_stats(table(spark, folder, "chunks"))


def _ranking(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    found = _top(spark, folder).where("query <> vec_id")
    ranking = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 6)), "vec_id")))
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    truth = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label").join(rows, "label").where("query <> vec_id")
    return ranking, truth


@query
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    ranking, truth = _ranking(spark, folder)
    hits = metrics.first_hits(ranking, truth, "query", "vec_id").withColumn("kind", F.when(F.col("query") % 100 == 0, "even").otherwise("odd"))
    return metrics.retrieval_metrics(hits, "kind")


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("repo is not null").select("repo", "doc_id", T.token_estimate(F.col("text")).alias("cost"))


@query
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return budget.admit_until_full(_costs(spark, folder), "cost", F.lit(6000), ["repo"], ["doc_id"])


@query
def budget_skip(spark: SparkSession, folder: str) -> DataFrame:
    return budget.admit_what_fits(_costs(spark, folder), "cost", 2000, "repo", ["doc_id"])


@query
def history_budget(spark: SparkSession, folder: str) -> DataFrame:
    return budget.admit_until_full(_costs(spark, folder), "cost", F.lit(4000), ["repo"], [F.desc("doc_id")])


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("baseline_tokens"), F.sum(F.col("l_extendedprice").cast("long")).alias("baseline_bytes"))
    rows = orders.select(
        F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderstatus") == "F", "sent").otherwise("blocked").alias("outcome"),
        F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_totalprice") / 1000)).alias("prompt_tokens"), F.floor(F.col("o_totalprice")).alias("prompt_bytes"),
    )
    return rows.join(lines, "call_id", "left").withColumn("baseline_tokens", F.when(F.col("call_id") % 2 == 0, F.col("baseline_tokens")))


@query
def savings(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.savings(_calls(spark, folder))


@query
def naive_baseline(spark: SparkSession, folder: str) -> DataFrame:
    calls = _edges(spark, folder).groupBy(F.col("src").alias("call_id")).agg(F.collect_list("dst").alias("files"))
    sizes = table(spark, folder, "files").select("path", F.octet_length("text").cast("long").alias("bytes"))
    return metrics.naive_baseline(calls, sizes)


@query
def grep_scores(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.grep_scores(table(spark, folder, "documents"), "doc_id", "text", metrics.grep_terms(TASK))


@query
def grep_matches(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.grep_matches(table(spark, folder, "documents"), "doc_id", "text", metrics.grep_terms(TASK))


@query
def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    replies = F.concat_ws(" ", "text", F.when(F.col("item_id") % 2 == 0, F.col("expected_path")), F.array_join("expected_facts", ", "))
    place, known = metrics.answers("answer", "expected_path", "expected_facts")
    return items.withColumn("answer", replies).select("item_id", place.alias("file_hit"), known.alias("fact_hit"))


@query
def task_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", classify.task_type(F.col("text")).alias("task_type"))


@query
def text_measures(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.size(T.terms(t)).alias("terms"), F.length(T.squash(t)).alias("squashed"), T.token_estimate(t).alias("tokens"), T.dominant_line_end(t).alias("line_end"), F.size(T.lines(t)).alias("lines"),
        T.line_at(t, F.lit(200)).alias("line_at_200"), F.length(T.shortened(t, 80)).alias("shortened"), T.query_hash(t).alias("query_hash"), T.budget_clamp(F.length(t), F.col("n_chars")).alias("clamped"),
    )


@query
def last_events(spark: SparkSession, folder: str) -> DataFrame:
    return changes.last_events(table(spark, folder, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def applied_changes(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshots.listings(table(spark, folder, "file_snapshots")).withColumnRenamed("hash", "content_hash")
    stored = chunks.first_of_each(rows.where("snapshot_no = 1"), ["path"], [F.desc("loaded_at"), F.desc_nulls_last("content_hash")]).select("path", "content_hash")
    order = F.struct(F.col("snapshot_no"), F.col("loaded_at"), F.coalesce("content_hash", F.lit("")))
    events = rows.where("snapshot_no > 1").select("path", "content_hash", F.lit("upsert").alias("op"), order.alias("seq"))
    return changes.apply_changes(stored, events)


@query
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = changes.windowed_counts(table(spark, folder, "events"), "ts")
    return made.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query
def modules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").select("path", extract.module_of(F.col("path"), F.col("text")).alias("module")).where("module is not null")


@query
def extracted_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return extract.symbols_of(extract.index_files(table(spark, folder, "files"))).select("id", "path", "name", "type", "start_line", "end_line", "exported", "parent_name")


@query
def extracted_imports(spark: SparkSession, folder: str) -> DataFrame:
    return extract.imports_of(extract.index_files(table(spark, folder, "files"))).select("path", "ord", "specifier", "is_type_only", "line")


@query
def extraction_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """By extension: stored symbols, extracted ones, and those with the same path, name and first line."""
    made = extracted_symbols(spark, folder).select("path", "name", F.col("start_line").alias("line")).distinct().withColumn("made", F.lit(1))
    kept = _symbols(spark, folder).select("path", "name", F.col("start_line").alias("line")).distinct().withColumn("kept", F.lit(1))
    both = made.join(kept, ["path", "name", "line"], "full").groupBy(P.extension(F.col("path")).alias("ext"))
    return both.agg(F.sum("kept").alias("stored"), F.sum("made").alias("extracted"), F.sum(F.col("kept") * F.col("made")).alias("same"))


@query
def surprising(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files")
    labels = files.select("path", F.concat_ws(":", "repo", P.extension(F.col("path"))).alias("label"))
    return report.surprising(table(spark, folder, "imports"), files, labels)


@query
def related_tests(spark: SparkSession, folder: str) -> DataFrame:
    return report.related_tests(table(spark, folder, "files"), table(spark, folder, "symbols"), rank.top_files(_file_scores(spark, folder)), _terms(spark))


@query
def dependency_flow(spark: SparkSession, folder: str) -> DataFrame:
    selected = staged(_file_scores(spark, folder).where("score > 0").select("path"), "selected")
    return report.dependency_flow(selected, _edges(spark, folder))


@query
def viewer_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes whose path contains a text, with their degree among themselves and their symbols."""
    nodes = table(spark, folder, "files").where(F.col("path").contains("session")).select("path")
    inside = report.dependency_flow(nodes, _edges(spark, folder))
    counted = _symbols(spark, folder).groupBy("path").agg(F.count_distinct("id").alias("symbols"))
    return graph.degrees(nodes, inside).join(shuffled(counted), "path", "left").na.fill(0, ["symbols"])


@query
def index_summary(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files").agg(F.count_distinct("path").alias("files"))
    symbols = table(spark, folder, "symbols").agg(F.count_distinct("id").alias("symbols"))
    edges = resolve.count_edges(table(spark, folder, "imports"), table(spark, folder, "files"))
    counts = files.unionByName(symbols, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True)
    return counts.agg(*[F.sum(c).alias(c) for c in ("files", "symbols", "edges")])


@query
def top_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("place", F.row_number().over(order)).where("place <= 3")


@query
def retrieved_files(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieve.Index(table(spark, folder, "files"), _symbols(spark, folder), table(spark, folder, "imports"), staged(_edges(spark, folder), "edges"))
    return retrieve.retrieve(index, TASK).files


@query
def retrieved_symbols(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieve.Index(table(spark, folder, "files"), _symbols(spark, folder), table(spark, folder, "imports"), staged(_edges(spark, folder), "edges"))
    return retrieve.retrieve(index, TASK).symbols
