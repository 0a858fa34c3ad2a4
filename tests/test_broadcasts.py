"""Joins of tables that grow aren't broadcast, however small they look, and plans stay small."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import graph, rank, report, resolve
from quarrystone.plans import queries


def ran(df):
    """The plan as it ran, after adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("src/a.ts", None), ("src/b.ts", None), ("lib/c.ts", None)], "path string, module string")


@pytest.fixture(scope="module")
def imports(spark):
    rows = [("src/a.ts", 0, "./b", ["B"], False, 1), ("src/b.ts", 0, "../lib/c", ["C"], False, 1), ("lib/c.ts", 0, "src/a", ["A"], False, 1)]
    return spark.createDataFrame(rows, "path string, ord int, specifier string, imported_names array<string>, is_type_only boolean, line int")


def test_surprising(files, imports):
    found = report.surprising(imports, files, files.select("path", F.col("path").alias("label")))
    assert "BroadcastHashJoin" not in ran(found)
    assert {tuple(r) for r in found.collect()} == {("src/a.ts", "src/b.ts", "a.ts", "b.ts"), ("src/b.ts", "lib/c.ts", "b.ts", "lib")}


def test_file_edges(files, imports):
    resolved = resolve.resolve_imports(imports, files)
    edges = resolve.file_edges(resolved)
    assert "BroadcastHashJoin" not in ran(edges)
    assert edges._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 10
    assert {tuple(r) for r in edges.collect()} == {("src/a.ts", "src/b.ts"), ("src/b.ts", "lib/c.ts"), ("lib/c.ts", "src/a.ts")}


def test_first_strategy_wins(spark):
    files = spark.createDataFrame([("app/x.cs", "Net.Http"), ("Net/Http.py", None), ("c/Http.go", None)], "path string, module string")
    imports = spark.createDataFrame([("app/x.cs", n, s) for n, s in enumerate(["Net.Http", "net/none", "z:Http", "Net/Http"])], "path string, ord int, specifier string")
    imports = imports.select("*", F.lit(None).cast("array<string>").alias("imported_names"), F.lit(False).alias("is_type_only"), F.lit(1).alias("line"))
    got = {(r["spec"], r["target"], r["prio"]) for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {("Net.Http", "app/x.cs", 1), ("Net/Http", "Net/Http.py", 3)}


def test_graphs_read_edges_once(spark, files):
    edges = spark.createDataFrame([("src/a.ts", "src/b.ts"), ("src/b.ts", "lib/c.ts")], "src string, dst string")
    nodes = files.select("path")
    scores = nodes.withColumn("score", F.lit(5))
    for made, leaves in ((graph.degrees(nodes, edges), 2), (graph.orphans(nodes, edges), 2), (rank.expand(scores, edges), 3)):
        assert "BroadcastHashJoin" not in ran(made)
        assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= leaves
    assert {tuple(r) for r in graph.degrees(nodes, edges).collect()} == {("src/a.ts", 0, 1, 1), ("src/b.ts", 1, 1, 2), ("lib/c.ts", 1, 0, 1)}


def test_hubs_count_degrees_once(spark, files):
    edges = spark.createDataFrame([("src/a.ts", "src/b.ts"), ("src/b.ts", "lib/c.ts")], "src string, dst string")
    made = report.with_hubs(graph.degrees(files.select("path"), edges), 1)
    assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert {(r["path"], r["hub"]) for r in made.collect()} == {("src/a.ts", False), ("src/b.ts", True), ("lib/c.ts", False)}


def most_rows(df):
    """The most rows that a node of the plan gave as it ran."""
    df.collect()

    def walk(node):
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []
        found = node.metrics().get("numOutputRows")
        return max([found.get().value() if found.isDefined() else 0, *(walk(x) for x in inner), *(walk(node.children().apply(i)) for i in range(node.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def fan_out(spark, tmp_path_factory):
    """A directory of 20 files that 30 files import, 600 links, of which one file exports what is asked for; and a file beside one."""
    folder = tmp_path_factory.mktemp("fan_out")
    paths = [f"lib/api/x{n}.go" for n in range(20)] + [f"app/y{n}.go" for n in range(30)]
    spark.createDataFrame([(p, None) for p in paths], "path string, module string").write.parquet(f"{folder}/files.parquet")
    rows = [(p, 0, "host/lib/api", ["Get", f"Own{n}"], False, 1) for n, p in enumerate(paths[20:])] + [("app/y0.go", 1, "./y1.go", ["Get"], False, 2)]
    spark.createDataFrame(rows * 2, "path string, ord int, specifier string, imported_names array<string>, is_type_only boolean, line int").write.parquet(f"{folder}/imports.parquet")
    made = [("1", "lib/api/x3.go", "Get", True), ("1", "lib/api/x3.go", "Get", True), ("2", "app/y1.go", "Get", True), ("3", "lib/api/x4.go", "Get", False), (None, "lib/api/x4.go", None, True)]
    spark.createDataFrame(made, "id string, path string, name string, exported boolean").write.parquet(f"{folder}/symbols.parquet")
    return str(folder)


def test_resolution_steps_list_no_links(spark, fan_out):
    made = queries.QUERIES["resolution_steps"](spark, fan_out)
    assert most_rows(made) < 100
    assert {tuple(r) for r in made.collect()} == {(8, 600, 1), (0, 1, 1)}


def test_usage_counts_list_no_links(spark, fan_out):
    made = queries.QUERIES["usage_counts"](spark, fan_out)
    assert most_rows(made) < 100
    assert {tuple(r) for r in made.collect()} == {("lib/api/x3.go", "Get", 30), ("app/y1.go", "Get", 1)}
    read = [spark.read.parquet(f"{fan_out}/{t}.parquet") for t in ("imports", "files", "symbols")]
    listed = resolve.symbol_references(resolve.resolve_imports(*read[:2]), read[2])
    assert sorted(map(tuple, resolve.references(*read).collect())) == sorted(map(tuple, listed.collect()))


def test_references_by_definition_list_no_links(spark, fan_out):
    made = queries.QUERIES["references_by_definition"](spark, fan_out)
    assert most_rows(made) < 100
    assert {tuple(r) for r in made.collect()} == {("Get", 2, 30, "app/y0.go")}


def test_index_summary_broadcasts_only_single_rows(spark, fan_out):
    made = queries.QUERIES["index_summary"](spark, fan_out)
    assert "BroadcastHashJoin" not in ran(made)
    assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 10
    assert [tuple(r) for r in made.collect()] == [(50, 3, 601)]


def test_index_summary_lists_no_links_and_broadcasts_nothing(spark, fan_out):
    made = queries.QUERIES["index_summary"](spark, fan_out)
    assert most_rows(made) < 100
    assert "Broadcast" not in ran(made)
    assert [tuple(r) for r in made.collect()] == [(50, 3, 601)]


def test_count_edges_of_sets_that_overlap(spark):
    """Modules across directories, types in them, directories and single files, asked together, also by their own members."""
    pick = random.Random(5)
    paths = [f"{d}/{s}{n}.{e}" for d in ("app", "lib/api", "lib/core") for n, (s, e) in enumerate([("Http", "cs"), ("Http", "go"), ("Pool", "cs"), ("Log", "py"), ("Log", "ts")])]
    paths += ["lib/api/Type.cs", "lib/core/Type.cs", "lib/api/Only.cs", "None.py"]
    files = [(p, pick.choice(["Net", "Net.Io", "Net", None, ""])) for p in paths] + [(None, "Net")]
    specs = ["Net", "Net.Io", "Net.Type", "Net.Other", "Net.Io.Type", "Net.Io.Only", "Net.Io.None", "host/lib/api", "x/lib/core", "host/app", "z:Only", "lib/api/Only", "app/Http0", "./Log3", "./Type", "../api/Only", "gone", " ", None]
    rows = [(p, n, pick.choice(specs)) for p in paths + [None, "away/x.cs"] for n in range(6)]
    files = spark.createDataFrame(files, "path string, module string")
    imports = spark.createDataFrame(rows * 2, "path string, ord int, specifier string")
    imports = imports.select("*", F.lit(None).cast("array<string>").alias("imported_names"), F.lit(False).alias("is_type_only"), F.lit(1).alias("line"))
    resolved = resolve.resolve_imports(imports, files)
    assert {1, 2, 8} < {r["prio"] for r in resolved.select("prio").distinct().collect()}
    assert resolve.count_edges(imports, files).agg(F.sum("edges")).first()[0] == resolve.file_edges(resolved).count()
    assert resolve.count_edges(imports.limit(0), files).agg(F.sum("edges")).first()[0] in (0, None)
