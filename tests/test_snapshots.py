import random
from datetime import datetime, timedelta

from quarrystone.operators.snapshots import SnapshotParams, snapshot_changes

SCHEMA = "snapshot_no int, loaded_at timestamp, repo string, path string, content_hash string"
T0 = datetime(2025, 1, 1)


def changes(spark, rows, **params):
    frame = spark.createDataFrame([(n, None if at is None else T0 + timedelta(hours=at), repo, path, h) for n, at, repo, path, h in rows], SCHEMA)
    return {(r["snapshot_no"], r["path"], r["change"]) for r in snapshot_changes(frame, SnapshotParams(**params)).collect()}


def test_kinds_of_change_and_spellings(spark):
    rows = [
        (1, 1, "r", "r/a", "AA"), (1, 1, "r", "r/b", "bb"), (1, 1, "r", "r/c", "cc"),
        (2, 2, "r", "./r//a", "sha256:aa"), (2, 2, "r", "r\\b", "b2"), (2, 2, "r", "r/d", "dd"), (2, 2, "r", None, "zz"),
    ]
    assert changes(spark, rows) == {(2, "r/b", "changed"), (2, "r/c", "removed"), (2, "r/d", "added")}


def test_last_loaded_row_counts_however_late(spark):
    rows = [(1, 1, "r", "r/a", "aa"), (2, 2, "r", "r/a", "bb"), (2, 99, "r", "r/a", "aa"), (2, None, "r", "r/a", "cc"), (2, 99, "r", "r/a", "aa")]
    assert changes(spark, rows) == set()


def test_missing_delivery_and_null_hash(spark):
    rows = [
        (1, 1, "r", "r/a", "aa"), (1, 1, "q", "q/a", "xx"), (1, 1, "q", "q/b", "yy"),
        (2, 2, "r", "r/a", None),
        (3, 3, "r", "r/a", "aa"), (3, 3, "q", "q/a", "x2"),
        (4, 4, "r", "r/a", "a4"), (4, 4, "n", "n/a", "nn"),
    ]
    assert changes(spark, rows) == {(3, "q/a", "changed"), (3, "q/b", "removed"), (4, "r/a", "changed")}


def test_empty_table_and_extra_columns(spark):
    assert changes(spark, []) == set()
    frame = spark.createDataFrame([(1, T0, "r", "r/a", "aa", "clash", "clash"), (2, T0, "r", "r/b", "bb", None, None)], SCHEMA + ", hash string, present string")
    assert {(r["path"], r["change"]) for r in snapshot_changes(frame).collect()} == {("r/a", "removed"), ("r/b", "added")}


def test_against_a_walk_through_the_snapshots(spark):
    rng, rows = random.Random(1), []
    for n in range(1, 6):
        for repo in "xyz":
            if n > 1 and rng.random() < 0.25:
                continue
            for i in range(12):
                for _ in range(rng.choice([0, 1, 1, 1, 2])):
                    rows.append((n, rng.randrange(50), repo, f"{repo}/{i}", rng.choice(["aa", "bb", None])))
    want, seen, last, before = set(), {}, {}, {}
    for n in range(1, 6):
        now, here = {}, set()
        for _, at, repo, path, h in sorted((r for r in rows if r[0] == n), key=lambda r: (r[1], r[4] is not None, r[4] or "")):
            now[path] = h
            here.add(repo)
        for repo in here:
            if repo in before:
                for path in {p for p in now if p[0] == repo} | seen[repo]:
                    if path not in now:
                        want.add((n, path, "removed"))
                    elif path not in seen[repo]:
                        want.add((n, path, "added"))
                    elif now[path] and last.get(path) and now[path] != last[path]:
                        want.add((n, path, "changed"))
            before[repo] = n
            seen[repo] = {p for p in now if p[0] == repo}
        last.update({p: h for p, h in now.items() if h})
    assert changes(spark, rows, buckets=3) == want
