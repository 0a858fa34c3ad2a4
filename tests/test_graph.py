import os
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import graph
from quarrystone.operators.components import connected_components
from quarrystone.plans import queries


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "path string"), spark.createDataFrame(edges, "src string, dst string")


TWO = (["a1", "a2", "a3", "b1", "b2", "b3", "x"], [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1")])


def test_degrees_keep_zeros(spark):
    nodes, edges = frames(spark, *TWO)
    got = {r["path"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in graph.degrees(nodes, edges).collect()}
    assert got["x"] == (0, 0, 0) and got["a1"] == (1, 2, 3) and got["b1"] == (2, 1, 3)
    assert [r["path"] for r in graph.orphans(nodes, edges).collect()] == ["x"]
    assert [r["path"] for r in graph.hotspots(nodes, edges, 2).collect()] == ["a1", "b1"]


def test_impact_includes_a_seed_on_a_cycle_and_stops_at_depth(spark):
    _, edges = frames(spark, *TWO)
    seeds = spark.createDataFrame([("b1",), ("nowhere",)], "path string")
    got = {(r["path"], r["distance"]) for r in graph.impact_set(edges, seeds, 2).collect()}
    assert got == {("a1", 1), ("b3", 1), ("a3", 2), ("b2", 2)}
    assert "b1" in {r["path"] for r in graph.impact_set(edges, seeds, 3).collect()}


def test_shortest_path(spark):
    _, edges = frames(spark, *TWO)
    assert graph.shortest_path(edges, "a2", "b2") == ["a2", "a1", "b1", "b2"]
    assert graph.shortest_path(edges, "x", "x") == ["x"]
    assert graph.shortest_path(edges, "a1", "x") is None


def test_hops_go_on_to_the_end_of_a_long_chain(spark):
    _, edges = frames(spark, [], [(f"n{i:02}", f"n{i + 1:02}") for i in range(53)])
    got = {r["path"]: r["hops"] for r in graph.hop_counts(edges.coalesce(1), spark.createDataFrame([("n00",)], "path string")).collect()}
    assert got == {f"n{i:02}": i for i in range(54)}


@pytest.mark.parametrize("seeds", [None, [("a1", 5.0), ("b1", -3.0)]])
def test_pagerank_sums_to_one_and_seeds_pull(spark, seeds):
    nodes, edges = frames(spark, *TWO)
    table = None if seeds is None else spark.createDataFrame(seeds, "path string, weight double")
    got = {r["path"]: r["rank"] for r in graph.pagerank(nodes, edges, table).collect()}
    spread = {r["path"]: r["rank"] for r in graph.pagerank(nodes, edges, table, rounds=4, tolerance=0.0, small=0).collect()}
    at_once = {r["path"]: r["rank"] for r in graph.pagerank(nodes, edges, table, rounds=4, tolerance=0.0).collect()}
    assert spread.keys() == at_once.keys() and all(abs(spread[k] - at_once[k]) < 1e-12 for k in spread)
    assert abs(sum(got.values()) - 1) < 1e-9
    if seeds:
        assert max(got, key=got.get) == "a1" and got["x"] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pagerank_query_goes_on_until_ranks_settle(spark):
    folder = "/root/testdata/sf0.001"
    nodes = {r["path"] for r in queries.table(spark, folder, "files").collect()}
    edges = {(r["src"], r["dst"]) for r in queries._edges(spark, folder).collect()}
    scores = {r["path"]: max(0.0, float(r["score"])) for r in queries._file_scores(spark, folder).collect()}
    whole = sum(scores.values())
    tele = {v: scores.get(v, 0.0) / whole for v in nodes}
    steps = [(a, b, 1.0) for a, b in edges] + [(b, a, 0.5) for a, b in edges]
    out = dict.fromkeys(nodes, 0.0)
    for a, _, x in steps:
        out[a] += x
    rank, rounds = tele, 0
    for rounds in range(1, 31):
        got, loose = dict.fromkeys(nodes, 0.0), sum(rank[v] for v in nodes if not out[v])
        for a, b, x in steps:
            got[b] += rank[a] * x / out[a]
        fresh = {v: 0.85 * (got[v] + loose * tele[v]) + 0.15 * tele[v] for v in nodes}
        change, rank = sum(abs(fresh[v] - rank[v]) for v in nodes), fresh
        if change < 1e-6:
            break
    found = {r["path"]: r["rank"] for r in queries.pagerank(spark, folder).collect()}
    assert rounds > 5 and set(found) == nodes and all(abs(found[v] - rank[v]) < 2e-9 for v in nodes)


def test_communities_separate_clusters(spark):
    nodes, edges = frames(spark, *TWO)
    got = {r["path"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert len({got[n] for n in ("a1", "a2", "a3")}) == 1 and len({got[n] for n in ("b1", "b2", "b3")}) == 1
    assert got["a1"] != got["b1"] and got["x"] == "x" and set(got) == set(TWO[0])
    assert {r["number"] for r in graph.numbered(graph.communities(nodes, edges)).collect()} == {0, 1, 2}


def test_communities_without_edges_and_nodes(spark):
    nodes, edges = frames(spark, ["a", "b"], [])
    assert {(r["path"], r["community"]) for r in graph.communities(nodes, edges).collect()} == {("a", "a"), ("b", "b")}
    nodes, edges = frames(spark, [], [])
    assert graph.communities(nodes, edges).count() == 0 and graph.pagerank(nodes, edges).count() == 0 and graph.degrees(nodes, edges).count() == 0


def test_label_propagation_covers_all_nodes(spark):
    nodes, edges = frames(spark, *TWO)
    got = {r["path"]: r["label"] for r in graph.label_propagation(nodes, edges).collect()}
    assert set(got) == set(TWO[0]) and got["x"] == "x" and set(got.values()) <= set(TWO[0])


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (500, 500)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges + [(None, 3), edges[0]], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == {n: root(n) for n in parent}
    assert connected_components(frame.where(F.lit(False))).count() == 0
