import random

import numpy as np
import pytest

from quarrystone.llm import neighbours, peaks
from quarrystone.llm.pivots import PivotParams

SCHEMA = "id string, path string, vector array<float>, key string, n int"


def planted(seed, groups=14, size=25, noise=260, dim=64):
    """Clusters of several widths, links near the threshold, copies, scaled copies and unusable vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = rng.normal(size=dim)
        center /= np.linalg.norm(center)
        for i in range(1 + g * size // groups):
            rows.append(center + rng.normal(size=dim) * rng.choice([0.02, 0.04, 0.06]))
    rows += list(rng.normal(size=(noise, dim)))
    rows += [rows[3]] * 8 + [rows[5] * 2.5, rows[5] * 0.3]
    base = rows[-1] / np.linalg.norm(rows[-1])
    other = rng.normal(size=dim)
    other -= other @ base * base
    other /= np.linalg.norm(other)
    rows += [base * c + other * (1 - c * c) ** 0.5 for c in (0.79, 0.801)]
    rows = [(f"c{random.Random(i + seed).randrange(10**9)}", f"p{i % 7}", [float(x) for x in v], "k", 1) for i, v in enumerate(rows)]
    return rows + [("null", None, None, None, None), ("empty", "p", [], None, None), ("zero", "p", [0.0] * dim, None, None), ("short", "p", [1.0] * 32, None, None), (None, "p", [1.0] * dim, None, None), ("nan", "p", [float("nan")] * dim, None, None)]


def exact(rows, least=0.8, k=5):
    kept = [(i, np.array(np.float32(v), np.float64)) for i, _, v, *_ in rows if i and v and len(v) == 64 and any(v) and v[0] == v[0]]
    kept.sort(key=lambda r: r[0].encode())
    ids = [i for i, _ in kept]
    x = np.array([v / np.linalg.norm(v) for _, v in kept])
    near = np.round(x @ x.T, 6)
    np.fill_diagonal(near, -2)
    pairs, label = set(), np.arange(len(ids))
    for a in range(len(ids)):
        best = sorted(np.flatnonzero(near[a] >= least), key=lambda b: (-near[a, b], b))[:k]
        pairs |= {(ids[min(a, b)], ids[max(a, b)]) for b in best}
    changed = True
    while changed:
        fresh = np.array([min([label[a], *label[near[a] >= least]]) for a in range(len(ids))])
        changed, label = (fresh != label).any(), fresh
    return pairs, {(ids[label[a]], ids[a]) for a in range(len(ids)) if label[a] != a}


@pytest.mark.parametrize("hot", [20_000, 120])
def test_against_brute_force(spark, hot):
    rows = planted(1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pairs, members = exact(rows)
    near = neighbours.neighbour_pairs(frame, params=neighbours.NeighbourParams(pivots=PivotParams(prefix=5, least_pivots=40, hot=hot)))
    got = {tuple(r) for r in near.collect()}
    assert len(got & pairs) >= 0.97 * len(pairs) and len(got - pairs) <= 0.02 * len(pairs)
    found = peaks.clusters(frame, params=peaks.PeakParams(pivots=PivotParams(prefix=4, least_pivots=40, hot=hot)))
    rows_got = found.collect()
    assert {(r["first_id"], r["id"]) for r in rows_got if r["id"] != r["first_id"]} == members
    sizes = {r["first_id"]: r["size"] for r in rows_got}
    assert all(size == 1 + sum(f == first for f, _ in members) for first, size in sizes.items())


def test_typical_members_are_dense(spark):
    frame = spark.createDataFrame(planted(2), SCHEMA)
    rows = peaks.describe(peaks.clusters(frame), frame, typical=2).collect()
    assert rows and max(r["position"] for r in rows) == 2 and len({(r["first_id"], r["position"]) for r in rows}) == len(rows)
    assert all(r["path"].startswith("p") for r in rows)


def test_copies_only(spark):
    frame = spark.createDataFrame([(f"id{i:03}", "p", [1.0] + [0.0] * 63, "k", 1) for i in range(40)], SCHEMA)
    got = {tuple(r) for r in neighbours.nearest_neighbours(frame).select("id", "neighbour").collect()}
    assert got == {(f"id{i:03}", f"id{j:03}") for i in range(40) for j in [x for x in range(6) if x != i][:5]}
    assert {(r["first_id"], r["size"]) for r in peaks.clusters(frame).collect()} == {("id000", 40)}


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert neighbours.neighbour_pairs(frame).count() == 0
    assert peaks.clusters(frame).count() == 0


def test_groups_of_pivots_find_nearly_the_nearest():
    from quarrystone.llm.pivots import Pivots

    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 64))
    x = centers[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 64)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[:900].astype(np.float32)
    all_of_them = Pivots(PivotParams(prefix=5), pivots).prefixes(x)
    grouped = Pivots(PivotParams(prefix=5, direct=0), pivots)
    found = grouped.prefixes(x)
    assert grouped.middles is not None and len(grouped.groups) == 30 and sum(map(len, grouped.groups)) == 900
    assert found.dtype == all_of_them.dtype and (found[:, 0] == all_of_them[:, 0]).mean() > 0.97
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, all_of_them)]) > 4.7
    assert Pivots(PivotParams(), np.zeros((70_000, 64), np.float32), groups=[np.arange(1)], middles=pivots).width is np.uint32


def test_candidates_are_cut_by_footrule_distance():
    lists = np.array([[0, 1, 2], [0, 1, 2], [1, 0, 2], [2, 3, 0], [4, 0, 5]], np.uint16)
    rows = np.array([0])
    shared = neighbours.shared_weights(lists, rows, neighbours.by_pivot(lists, np.arange(5)))
    weight = lambda a, b: sum(min(3 - i, 3 - list(b).index(p)) for i, p in enumerate(a) if p in b)
    assert shared.tolist() == [[weight(lists[0], b) for b in lists]]
    assert neighbours.cut_at(shared, 2, 6).tolist() == [6] and neighbours.cut_at(shared, 3, 6).tolist() == [5] and neighbours.cut_at(shared, 9, 6).tolist() == [1]
