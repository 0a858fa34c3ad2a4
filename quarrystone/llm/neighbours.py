"""The most similar vectors of every vector, by a permutation index.

Each vector is represented by its ordered nearest pivots (its prefix) and posted in their inverted files. A vector
probes the files of its first pivots; the candidates there are ranked by the footrule distance of the prefixes, and only
the nearest of them are reranked by cosine.

With w(p) = prefix + 1 - position of pivot p (0 where absent), the footrule distance of two prefixes is
sum w(a) + sum w(b) - 2 * sum over shared pivots of min(w(a), w(b)), that is, a constant less twice the shared weight:
ranking by distance is ranking by shared weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.pivots import Block, PivotParams, each_block, exact_cosines, fit_pivots, members, postings

BAND = 5e-5  # beyond the error of a cosine of decoded codes


@dataclass(frozen=True)
class NeighbourParams:
    """k: neighbours of a vector. least: their lowest cosine. probes: inverted files that a vector searches.
    ranked: candidates of the least footrule distance that are reranked in each file (and those as near as the last).
    digits: to which cosines are rounded before ranking."""

    k: int = 5
    least: float = 0.8
    probes: int = 2
    ranked: int = 1500
    digits: int = 6
    pivots: PivotParams = PivotParams(prefix=5, rows_per_pivot=1500)


def by_pivot(lists: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """Where each pivot is in the lists of some rows, as row number * width + position."""
    width = lists.shape[1]
    flat = lists[rows].ravel()
    order = np.argsort(flat, kind="stable")
    pivots, starts = np.unique(flat[order], return_index=True)
    return {int(p): part for p, part in zip(pivots, np.split(order, starts[1:]))} if width else {}


def shared_weights(lists: np.ndarray, rows: np.ndarray, everywhere: dict[int, np.ndarray]) -> np.ndarray:
    """For ``rows`` against all: the sum of min(w) over shared pivots. everywhere: by_pivot of all rows."""
    width = lists.shape[1]
    weights = np.arange(width, 0, -1).astype(np.uint8)
    out = None
    for p, part in by_pivot(lists, rows).items():
        everyone = everywhere[p]
        if len(everyone) == len(lists) and len(part) == len(rows):  # the block's own pivot, which all have
            own, other = np.empty(len(rows), np.uint8), np.empty(len(lists), np.uint8)
            own[part // width], other[everyone // width] = weights[part % width], weights[everyone % width]
            out = np.minimum.outer(own, other)
    out = np.zeros((len(rows), len(lists)), np.uint8) if out is None else out
    for p, part in by_pivot(lists, rows).items():
        everyone = everywhere[p]
        if 1 < len(everyone) < len(lists) or (len(everyone) > 1 and len(part) < len(rows)):
            b, w = everyone // width, weights[everyone % width]
            for level in range(1, width + 1):  # min(w(a), w(b)) is the number of levels that both reach
                a = part[weights[part % width] == level] // width
                if len(a):
                    out[np.ix_(a, b)] += np.minimum(w, level)[None, :]
    return out


def cut_at(shared: np.ndarray, ranked: int, most: int) -> np.ndarray:
    """For each row the largest weight that at least ``ranked`` entries reach, 1 if there are fewer."""
    low, high = np.ones(len(shared), np.uint8), np.full(len(shared), most, np.uint8)
    while (low < high).any():
        middle = ((low.astype(np.int32) + high + 1) // 2).astype(np.uint8)
        enough = np.count_nonzero(shared >= middle[:, None], axis=1) >= ranked
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return low


def _top(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest entries above -1 of each row, with all that come within BAND of the k-th."""
    hits = (near > -1).sum(axis=1)
    few = np.flatnonzero((hits > 0) & (hits <= k))
    many = np.flatnonzero(hits > k)
    r, c = np.nonzero(near[few] > -1)
    rows, columns = [few[r]], [c]
    if len(many):
        part = near[many]
        limit = np.maximum(np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - BAND, -1)
        r, c = np.nonzero(part > limit[:, None])
        rows.append(many[r])
        columns.append(c)
    return np.concatenate(rows), np.concatenate(columns)


def block_neighbours(block: Block, params: NeighbourParams, tile: int = 256) -> dict[str, list] | None:
    n, t = block.lists.shape
    asks = (block.lists[:, : params.probes] == block.cell).any(axis=1)
    asking = np.flatnonzero(asks)
    asking = asking[np.lexsort(block.lists[asking, :2].T[::-1])]  # alike ones together: they have candidates in common
    everywhere = by_pivot(block.lists, np.arange(n))
    left, right = [], []
    for s in range(0, len(asking), tile):
        rows = asking[s : s + tile]
        shared = shared_weights(block.lists, rows, everywhere)
        shared[np.arange(len(rows)), rows] = 0
        if block.side is not None:
            shared[block.side[rows][:, None] == block.side[None, :]] = 0
        dropped = shared < cut_at(shared, params.ranked, t * (t + 1) // 2)[:, None]
        columns = np.flatnonzero(~dropped.all(axis=0))
        near = block.unit[rows] @ block.unit[columns].T
        out = near < params.least - BAND
        out |= np.take(dropped, columns, axis=1)
        np.copyto(near, np.float32(-2), where=out)
        live = np.flatnonzero(~out.all(axis=1))
        if not len(live):
            continue
        rows, near = rows[live], near[live]
        homes = block.lists[rows, 0]
        for home in np.unique(homes[homes != block.cell]):  # what these meet in their nearest pivot's file, they meet there
            near[np.ix_(homes == home, (block.lists[columns] == home).any(axis=1))] = -2
        r, c = _top(near, params.k)
        left.append(rows[r])
        right.append(columns[c])
        others = np.flatnonzero(~asks[columns] & (near > -1).any(axis=0))  # those that don't probe this file learn from those that do
        r, c = _top(np.ascontiguousarray(near[:, others].T), params.k)
        left.append(columns[others[r]])
        right.append(rows[c])
    if not left:
        return None
    a, b = np.concatenate(left), np.concatenate(right)
    cosines = exact_cosines(block.codes, a, b)
    order = np.lexsort((-cosines, a))
    a, b, cosines = a[order], b[order], cosines[order]
    start = np.searchsorted(a, np.arange(n))  # across tiles: again the k largest of each, and what is near the k-th
    last = np.minimum(start[a] + params.k - 1, np.searchsorted(a, a, side="right") - 1)
    keep = (cosines >= cosines[last] - BAND) & (cosines >= params.least - BAND)
    a, b, cosines = a[keep], b[keep], cosines[keep]
    return {"key": [bytes(x) for x in block.keys[a]], "nbr": [bytes(x) for x in block.keys[b]], "cos": cosines}


FOUND = pa.schema([("key", pa.binary()), ("nbr", pa.binary()), ("cos", pa.float64())])


def key_neighbours(df: DataFrame, ident: str = "id", vector: str = "vector", params: NeighbourParams = NeighbourParams()) -> DataFrame:
    """``(key, nbrs array<struct<r double, nbr binary>>)`` of every distinct direction with a neighbour: the k of the
    highest rounded cosine and those that tie with the k-th, most similar first."""
    pivots = fit_pivots(df, ident, vector, params.pivots)
    found = each_block(postings(df, vector, pivots), pivots, lambda b: block_neighbours(b, params), "key binary, nbr binary, cos double", FOUND)
    rounded = found.select("key", F.struct((-F.round("cos", params.digits)).alias("r"), "nbr").alias("x")).where(-F.col("x.r") >= params.least)
    lists = rounded.groupBy("key").agg(F.sort_array(F.collect_set("x")).alias("x"))
    cut = F.element_at("x", F.least(F.lit(params.k), F.size("x")))["r"]
    return lists.select("key", F.transform(F.filter("x", lambda y: y["r"] <= cut), lambda y: F.struct((-y["r"]).alias("r"), y["nbr"].alias("nbr"))).alias("nbrs"))


def nearest_neighbours(df: DataFrame, ident: str = "id", vector: str = "vector", params: NeighbourParams = NeighbourParams()) -> DataFrame:
    """``(id, neighbour, cosine)``: for every id, its k most similar others with a cosine of at least ``least``.

    Rows whose vector is null, of another size, not finite, or all zero have and are no neighbours, and so have rows
    with a null id; an empty table gives no rows. Of equal rounded cosines the smaller id goes first. Vectors of one
    direction, however many, are one entry of the index, of which at most k + 1 ids can be anyone's neighbours; no
    group of copies is gathered in a task. Other columns are not read, whatever their names.
    """
    k = params.k
    # one shuffle by key serves both the first ids of each key and the last join; a limit pushed below it would undo that
    every = members(df, ident, vector, params.pivots.dim).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    first = every.where(F.col("n") + F.lit(0) <= k + 1)
    heads = first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = key_neighbours(df, ident, vector, params)
    pairs = lists.select("key", F.explode("nbrs").alias("x")).select(F.col("x.nbr").alias("nbr"), "key", F.col("x.r").alias("r"))
    others = pairs.join(heads.select(F.col("key").alias("nbr"), F.slice("ids", 1, k).alias("ids")), "nbr").select("key", "r", "ids")
    # copies of one direction are each other's neighbours, with a cosine of 1
    own = heads.where(F.size("ids") > 1).select("key", F.lit(1.0).alias("r"), "ids")
    candidates = others.union(own).groupBy("key").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("r")).alias("r"), i.alias("id"))))).alias("x"))
    best = candidates.select("key", F.slice(F.sort_array("x"), 1, k + 1).alias("x"))
    return (
        every.join(best, "key")
        .select("id", F.posexplode(F.slice(F.filter("x", lambda y: y["id"] != F.col("id")), 1, k)).alias("pos", "x"))
        .select("id", F.col("x.id").alias("neighbour"), (-F.col("x.r")).alias("cosine"))
    )


def neighbour_pairs(df: DataFrame, ident: str = "id", vector: str = "vector", params: NeighbourParams = NeighbourParams()) -> DataFrame:
    """``(id_a, id_b)``, once for each pair of which one is a neighbour of the other, the smaller id first."""
    near = nearest_neighbours(df, ident, vector, params)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
