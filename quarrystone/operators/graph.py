"""Analytics over the file graph: degrees, reach, paths, ranks and communities.

Graphs are tables of different ``(src, dst)`` edges and of ``(path)`` nodes. Iterations keep their state in staged
tables; nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import discard, shuffled, staged


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, in_degree, out_degree, degree)`` of every node, 0 where it has no edges."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(end).alias("path"), F.lit(o).alias("o"), F.lit(1 - o).alias("i")) for end, o in (("src", 1), ("dst", 0))])))
    counted = ends.groupBy("path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    joined = nodes.select("path").distinct().join(shuffled(counted), "path", "left").na.fill(0, ["in_degree", "out_degree"])
    return joined.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def hotspots(nodes: DataFrame, edges: DataFrame, top: int = 15) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "path").limit(top)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return nodes.select("path").distinct().join(shuffled(touched), "path", "left_anti")


def impact_set(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """``(seed, path, distance)``: what depends on each seed (column ``path``), directly or through at most ``depth``
    edges. A seed is in its own set if it lies on a cycle. Unknown seeds have empty sets."""
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("path"))
    frontier = seeds.select(F.col("path").alias("seed"), F.col("path").alias("at")).distinct()
    reached = None
    for step in range(1, depth + 1):
        found = frontier.join(shuffled(back), "at").select("seed", "path").distinct()
        if reached is not None:
            found = found.join(shuffled(reached), ["seed", "path"], "left_anti")
        found = staged(found.withColumn("distance", F.lit(step)), "frontier")
        reached = found if reached is None else reached.unionByName(found)
        if found.isEmpty():
            break
        frontier = found.select("seed", F.col("path").alias("at"))
    return reached


def hop_counts(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """``(path, hops, parent)`` of everything connected to the one node of ``start``, edges taken both ways.

    ``parent`` is the node before it on a shortest path: of several the smallest. The start has 0 hops and no parent.
    ``most`` hops are followed at most, all if it is None.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    reached = staged(start.select("path", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")), "hops")
    frontier, step = reached, 0
    while most is None or step < most:
        step += 1
        found = frontier.select(F.col("path").alias("src")).join(shuffled(both), "src").groupBy(F.col("dst").alias("path")).agg(F.min("src").alias("parent"))
        found = found.join(shuffled(reached), "path", "left_anti").select("path", F.lit(step).alias("hops"), "parent")
        frontier = staged(found, "hops")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if step % 20 == 0:
            reached = staged(reached, "hops")  # one table, so that the plan doesn't grow with the steps
    return reached


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> list[str] | None:
    """The nodes of a shortest path, both ends included; None if there is none. Equal ends are a path of one node."""
    if source == target:
        return [source]
    spark = edges.sparkSession
    tree = hop_counts(edges, spark.createDataFrame([(source,)], "path string"), most)
    path = [target]
    while path[-1] != source:
        row = tree.where(F.col("path") == path[-1]).select("parent").first()
        if row is None:
            return None
        path.append(row["parent"])
    return path[::-1]


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6, backward: float = 0.5, small: int = 300_000) -> DataFrame:
    """``(path, rank)``: personalised rank with edges followed forward at weight 1 and backward at ``backward``.

    ``seeds`` are ``(path, weight)``; negative weights are 0, weights are scaled to 1, and without a positive one all
    nodes are seeds. What nodes without edges have goes to the seeds. Stops early when ranks change by less than
    ``tolerance`` in total. Each round is one shuffle-reduced join over the edges; a hub's edges stay apart rows. A graph
    of at most ``small`` nodes and steps is ranked in the same way by one task, without a shuffle for each round.
    """
    every = nodes.select("path").distinct()
    total = every.count()
    if total == 0:
        return every.withColumn("rank", F.lit(0.0))
    if seeds is not None:
        weighted = every.join(shuffled(seeds.groupBy("path").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("w"))), "path", "left")
        whole = weighted.agg(F.sum("w")).first()[0] or 0.0
    else:
        weighted, whole = every.withColumn("w", F.lit(None).cast("double")), 0.0
    tele = F.coalesce("w", F.lit(0.0)) / whole if whole > 0 else F.lit(1.0 / total)
    steps = edges.select(F.col("src").alias("path"), F.col("dst").alias("to"), F.lit(1.0).alias("x")).union(edges.select("dst", "src", F.lit(backward)))
    steps = steps.join(shuffled(every), "path", "left_semi").join(shuffled(every.withColumnRenamed("path", "to")), "to", "left_semi")
    steps = staged(steps.groupBy("path", "to").agg(F.sum("x").alias("x")), "steps")
    if total <= small and steps.count() <= small:
        parts = weighted.select("path", tele.cast("double").alias("tele"), F.lit(None).cast("string").alias("to"), F.lit(None).cast("double").alias("x")).union(steps.select("path", F.lit(None).cast("double"), "to", F.col("x").cast("double")))
        return parts.repartition(1).mapInArrow(lambda batches: _ranked_at_once(batches, damping, rounds, tolerance), "path string, rank double")
    out = steps.groupBy("path").agg(F.sum("x").alias("out"))
    state = staged(weighted.withColumn("tele", tele).join(shuffled(out), "path", "left").select("path", "tele", "out", F.col("tele").alias("rank")), "ranks")
    last = state
    for _ in range(rounds):
        loose = state.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        moved = state.where("out is not null").join(shuffled(steps), "path").groupBy(F.col("to").alias("path")).agg(F.sum(F.col("rank") * F.col("x") / F.col("out")).alias("got"))
        fresh = (F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(loose) * F.col("tele")) + F.lit(1 - damping) * F.col("tele")).alias("rank")
        following = staged(state.join(shuffled(moved), "path", "left").select("path", "tele", "out", fresh, F.col("rank").alias("was")), "ranks")
        change = following.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        discard(last)
        last, state = following, following.drop("was")
        if change < tolerance:
            break
    return state.select("path", "rank")


def _ranked_at_once(batches: Iterator[pa.RecordBatch], damping: float, rounds: int, tolerance: float) -> Iterator[pa.RecordBatch]:
    """The ranks of a small graph, of nodes ``(path, tele)`` and steps ``(path, to, x)``."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("path", pa.string()), ("tele", pa.float64()), ("to", pa.string()), ("x", pa.float64())]))
    is_node = pc.is_null(rows["to"])
    nodes, steps = rows.filter(is_node), rows.filter(pc.invert(is_node))
    names = nodes["path"].combine_chunks()
    src, dst = (pc.index_in(steps[c], names).to_numpy(zero_copy_only=False) for c in ("path", "to"))
    tele, x, n = nodes["tele"].to_numpy(), steps["x"].to_numpy(), len(names)
    out = np.bincount(src, x, n)
    share, loose = x / out[src], out == 0
    rank = tele
    for _ in range(rounds):
        fresh = damping * (np.bincount(dst, rank[src] * share, n) + rank[loose].sum() * tele) + (1 - damping) * tele
        change, rank = np.abs(fresh - rank).sum(), fresh
        if change < tolerance:
            break
    yield pa.RecordBatch.from_arrays([names, pa.array(rank)], names=["path", "rank"])


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """``(path, label)``: every node takes the label most of its neighbours have, the smaller of equally common ones,
    unless its own is as common; labels start as the nodes themselves. Edges count both ways, mutual ones twice. In odd
    and even rounds different halves of the nodes move, so that pairs don't swap labels for ever."""
    both = staged(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    last = state = staged(nodes.select("path", F.col("path").alias("label")).distinct(), "labels")
    for step in range(rounds):
        votes = both.join(shuffled(state.select(F.col("path").alias("dst"), "label")), "dst").groupBy(F.col("src").alias("path"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
        own = votes.join(shuffled(state), ["path", "label"]).select("path", F.col("n").alias("own"))
        joined = state.join(shuffled(best), "path", "left").join(shuffled(own), "path", "left")
        moves = F.col("best").isNotNull() & (-F.col("best.n") > F.coalesce("own", F.lit(0))) & (F.pmod(F.xxhash64("path"), F.lit(2)) == step % 2)
        following = staged(joined.select("path", F.when(moves, F.col("best.label")).otherwise(F.col("label")).alias("label"), moves.alias("moved")), "labels")
        changed = following.where("moved").limit(1).count()
        discard(last)
        last, state = following, following.drop("moved")
        if not changed and step % 2:
            break
    return state


def communities(nodes: DataFrame, edges: DataFrame, levels: int = 5, sweeps: int = 8) -> DataFrame:
    """``(path, community)`` by modularity: nodes move to the neighbouring community with the largest gain, then each
    community becomes one node, and so on; the community is named by its smallest member.

    Edges count both ways, mutual ones twice. Moves of a sweep are made together, for nodes whose hash says so, which
    keeps two neighbours from swapping; a sweep that lowers modularity is undone and ends the level. A graph without
    edges has communities of one; an empty one has none. Only sums come to the driver.
    """
    names = staged(nodes.select("path", F.col("path").alias("community")).distinct(), "names")
    pairs = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weights = staged(pairs.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "weights")
    whole = weights.agg(F.sum("w")).first()[0]
    if not whole:
        return names
    for _ in range(levels):
        strength = staged(weights.groupBy("src").agg(F.sum("w").alias("k")), "strength")
        state = staged(strength.select("src", F.col("src").alias("c"), "k"), "state")
        before = _modularity(weights, state, whole)
        improved = False
        for sweep in range(sweeps):
            sums = state.groupBy("c").agg(F.sum("k").alias("total"))
            near = weights.where("src <> dst").join(shuffled(state.select(F.col("src").alias("dst"), F.col("c").alias("to"))), "dst").groupBy("src", "to").agg(F.sum("w").alias("shared"))
            joined = near.join(shuffled(state), "src").join(shuffled(sums.withColumnRenamed("c", "to")), "to")
            inside = F.col("to") == F.col("c")
            gain = F.col("shared") - F.col("k") * (F.col("total") - F.when(inside, F.col("k")).otherwise(0.0)) / whole
            best = joined.withColumn("gain", gain).groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("g"), "to")).alias("b"), F.max(F.when(inside, F.col("gain"))).alias("stay"))
            alone = sums.join(shuffled(state), "c").select("src", (-(F.col("k") * (F.col("total") - F.col("k"))) / whole).alias("lonely"))
            decided = state.join(shuffled(best), "src", "left").join(shuffled(alone), "src", "left")
            moves = F.col("b").isNotNull() & (-F.col("b.g") > F.coalesce("stay", "lonely") + 1e-12) & (F.pmod(F.xxhash64("src", F.lit(sweep)), F.lit(2)) == 0)
            following = staged(decided.select("src", F.when(moves, F.col("b.to")).otherwise(F.col("c")).alias("c"), "k"), "state")
            after = _modularity(weights, following, whole)
            if after <= before + 1e-9:
                discard(following)
                if sweep:
                    break
                continue
            discard(state)
            state, before, improved = following, after, True
        if not improved:
            break
        least = state.groupBy("c").agg(F.min("src").alias("name"))
        renamed = staged(state.join(shuffled(least), "c").select("src", "name"), "renamed")
        names = staged(names.join(shuffled(renamed.withColumnRenamed("src", "community")), "community", "left").select("path", F.coalesce("name", "community").alias("community")), "names")
        grouped = weights.join(shuffled(renamed.withColumnRenamed("name", "a")), "src").join(shuffled(renamed.select(F.col("src").alias("dst"), F.col("name").alias("b"))), "dst")
        old = weights
        weights = staged(grouped.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "weights")
        discard(old)
    return names


def _modularity(weights: DataFrame, state: DataFrame, whole: float) -> float:
    labelled = weights.join(shuffled(state.select("src", F.col("c").alias("a"))), "src").join(shuffled(state.select(F.col("src").alias("dst"), F.col("c").alias("b"))), "dst")
    inside = labelled.where("a = b").agg(F.sum("w")).first()[0] or 0.0
    square = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inside / whole - square / whole**2


def numbered(labels: DataFrame, label: str = "community") -> DataFrame:
    """Labels as numbers from 0, in the order of their smallest members; they are sorted by ranges, not in one task."""
    from quarrystone.operators.rank import ranked

    first = labels.groupBy(label).agg(F.min("path").alias("least"))
    return labels.join(shuffled(ranked(first, [F.col("least")], label)), label).select("path", (F.col("rank") - 1).cast("int").alias("number"))
