"""A report on a repository's graph, and the joins that only it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import paths as P
from quarrystone.operators import graph
from quarrystone.session import shuffled, staged


def surprising(imports: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """``(src, dst, src_top, dst_top)``: a relative import that contains the stem of a file with another top-level
    directory and another label.

    Containment is an equality: the substrings of each different specifier are joined with the different stems.
    """
    rows = imports.where("specifier like '.%'").select(F.col("path").alias("src"), "specifier").distinct()
    n = F.length("specifier")
    starts = F.sequence(F.lit(1), n)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("specifier", i, k))))
    substrings = rows.select("specifier").distinct().select("specifier", F.explode(F.array_distinct(parts)).alias("stem"))
    named = files.where("path is not null").select(F.col("path").alias("dst"), P.stem(F.col("path")).alias("stem")).where("length(stem) > 0").distinct()
    hits = substrings.join(shuffled(named), "stem").select("specifier", "dst").distinct()
    pairs = rows.join(shuffled(hits), "specifier").where("src <> dst").select("src", "dst").distinct()
    tops = pairs.withColumn("src_top", P.top_segment(F.col("src"))).withColumn("dst_top", P.top_segment(F.col("dst"))).where("src_top <> dst_top")
    a, b = labels.select(F.col("path").alias("src"), F.col("label").alias("la")), labels.select(F.col("path").alias("dst"), F.col("label").alias("lb"))
    return tops.join(shuffled(a), "src").join(shuffled(b), "dst").where("la <> lb").select("src", "dst", "src_top", "dst_top")


def related_tests(files: DataFrame, symbols: DataFrame, selected: DataFrame, terms: list[str]) -> DataFrame:
    """``path`` of test files whose path has the stem of a selected file or a term, or a symbol of which has a term.

    Containment of a stem is an equality: the substrings of each test's path, of the lengths that stems have, are joined
    with the stems, however many there are.
    """
    from quarrystone.functions import text as T

    stems = selected.select(F.lower(P.test_stem(F.col("path"))).alias("stem")).where("length(stem) > 0").distinct()
    tests = files.where(P.is_test(F.col("path"))).select("path").distinct()
    low = F.lower("path")
    lengths = stems.agg(F.sort_array(F.collect_set(F.length("stem"))).alias("ns"))  # one row, an entry for each length
    cuts = F.flatten(F.transform("ns", lambda k: F.when(k <= F.length(low), F.transform(F.sequence(F.lit(1), F.length(low) - k + 1), lambda i: F.substring(low, i, k))).otherwise(F.array().cast("array<string>"))))
    by_stem = tests.crossJoin(F.broadcast(lengths)).select("path", F.explode(F.array_distinct(cuts)).alias("stem")).join(shuffled(stems), "stem", "left_semi").select("path")
    by_term, named = F.lit(False), F.lit(False)
    for t in terms:
        by_term = by_term | low.contains(t)
        named = named | T.squash(F.col("name")).contains(t)
    by_symbol = tests.join(shuffled(symbols.where(named).select("path")), "path", "left_semi")
    return by_stem.union(tests.where(by_term)).union(by_symbol).distinct()


def dependency_flow(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are selected."""
    return edges.join(shuffled(selected.select(F.col("path").alias("src"))), "src", "left_semi").join(shuffled(selected.select(F.col("path").alias("dst"))), "dst", "left_semi").select("src", "dst")


def community_sizes(labels: DataFrame, label: str = "community", sample: int = 12) -> DataFrame:
    """``(community, size, members)``: the first members by path; only these are collected."""
    from pyspark.sql import Window

    sizes = labels.groupBy(label).agg(F.count("*").alias("size"))
    first = labels.withColumn("n", F.row_number().over(Window.partitionBy(label).orderBy("path"))).where(F.col("n") <= sample)
    return sizes.join(shuffled(first.groupBy(label).agg(F.sort_array(F.collect_list("path")).alias("members"))), label)


def with_hubs(degree: DataFrame, top: int = 8) -> DataFrame:
    """Degrees with whether a node is among the ``top`` ones that have any."""
    degree = staged(degree, "degrees")
    first = degree.where("degree > 0").orderBy(F.desc("degree"), "path").limit(top).select("path", F.lit(True).alias("hub"))
    return degree.join(F.broadcast(first), "path", "left").na.fill(False, ["hub"])


def matching_nodes(nodes: DataFrame, edges: DataFrame, text: str = "", connected: bool = False, around: bool = False) -> DataFrame:
    """``path`` of nodes whose path contains a text; only those with an edge, or also what is one step away."""
    found = nodes.where(F.lower("path").contains(text.lower())).select("path").distinct()
    ends = edges.select(F.col("src").alias("path"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    if around:
        found = found.union(ends.join(shuffled(found), "path", "left_semi").select(F.col("other").alias("path"))).distinct()
    return found.join(shuffled(ends.select("path")), "path", "left_semi") if connected else found


def graph_json(degree: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(kind, json)``: a row for each node with degree, community and whether it is a hub, and for each edge."""
    nodes = with_hubs(degree).join(shuffled(labels.select("path", "community")), "path", "left")
    shown = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("path", "degree", "community", "hub")).alias("json"))
    return shown.union(edges.select(F.lit("edge"), F.to_json(F.struct("src", "dst"))))


def questions(hubs: list[str], tests: list[str], controllers: list[str], most: int = 6) -> list[str]:
    """What one might ask of a graph: about its first hubs, a test and a controller."""
    out = [q for h in hubs[:2] for q in (f"What does {h} do?", f"What breaks if {h} changes?")]
    out += [f"What does {t} cover?" for t in tests[:1]] + [f"How does a request reach {c}?" for c in controllers[:1]]
    return out[:most]


@dataclass
class Report:
    hubs: DataFrame
    orphans: DataFrame
    hot_symbols: DataFrame
    communities: DataFrame
    surprises: DataFrame
    totals: DataFrame
    tests: DataFrame
    controllers: DataFrame

    def markdown(self, rows: int = 10) -> str:
        """The short lists as text; each is cut to ``rows`` before it comes to the driver."""
        parts = ["# Graph report", ""]
        total = self.totals.first().asDict()
        parts += [", ".join(f"{v} {k}" for k, v in total.items()), ""]
        for title, frame in (("Hubs", self.hubs), ("Hot symbols", self.hot_symbols), ("Communities", self.communities), ("Surprising connections", self.surprises), ("Orphans", self.orphans)):
            parts += [f"## {title}", ""]
            parts += ["- " + ", ".join(str(v) for v in r) for r in frame.limit(rows).collect()] + [""]
        first = lambda frame, n: [r[0] for r in frame.limit(n).collect()]
        asked = questions(first(self.hubs, 2), first(self.tests, 1), first(self.controllers, 1))
        return "\n".join([*parts, "## Questions", "", *(f"- {q}" for q in asked), ""])


def build_report(files: DataFrame, symbols: DataFrame, imports: DataFrame, edges: DataFrame, usage: DataFrame) -> Report:
    nodes = files.select("path").where("path is not null")
    labels = graph.communities(nodes, edges)
    degree = graph.degrees(nodes, edges)
    sizes = community_sizes(labels).where("size > 1").orderBy(F.desc("size"), "community").limit(6)
    found = surprising(imports, files, labels.withColumnRenamed("community", "label")).orderBy("src", "dst").limit(10)
    totals = nodes.agg(F.count_distinct("path").alias("files")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(symbols.agg(F.count_distinct("id").alias("symbols")))
    return Report(degree.where("degree > 0").orderBy(F.desc("degree"), "path").limit(10), graph.orphans(nodes, edges).orderBy("path").limit(50), usage.orderBy(F.desc("referenced_by"), "symbol_name", "defined_in").limit(10), sizes, found, totals, nodes.where(P.is_test(F.col("path"))).orderBy("path"), symbols.where("type in ('controller', 'routeHandler')").select("name").orderBy("name"))
