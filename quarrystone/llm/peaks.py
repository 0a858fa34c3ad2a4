"""Clusters of similar vectors by density peaks.

The density of a vector is the number of vectors within the cutoff, counted in the file of its nearest pivot, its home.
Its pointer goes to the nearest denser vector at home there within the cutoff; a vector without one is a peak. Pointers
are followed to the peak, whose key is the label of all vectors on the way. Then vectors of different labels meet in the
files of more pivots, and labels between which there is a link are joined by connected components, so that the groups
are exactly the parts connected by links. Cosines near the cutoff are computed again from the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.pivots import Block, PivotParams, coded, each_block, encode, fit_pivots, key_bytes, measure_blocks, members, post_labelled, postings, unit_rows
from quarrystone.operators.components import connected_components
from quarrystone.session import staged


@dataclass(frozen=True)
class PeakParams:
    """cutoff: the least cosine of a link, after rounding to 6 decimals. slack: error of cosines of the first pass's short
    codes: no vector that may have a link is left out of the second pass, and no pointer is less than a link. band: error
    of cosines of the second pass's codes, within which the vectors themselves decide. prefix: blocks a vector is posted
    to in the second pass (in the first: pivots.prefix). small: pairs up to which those to be decided are broadcast."""

    cutoff: float = 0.8
    slack: float = 0.012
    band: float = 4e-5
    prefix: int = 7
    small: int = 1_000_000
    pivots: PivotParams = PivotParams(prefix=4, least_pivots=128, rows_per_pivot=1500)


def block_peaks(block: Block, params: PeakParams, tile: int = 1024) -> dict[str, list] | None:
    """Of the entries that may have a link: how many they have (0 unless at home here), and for those at home the label,
    the peak that their pointers lead to."""
    n = len(block.keys)
    home = block.lists[:, 0] == block.cell
    density, linked = np.zeros(n, np.int64), np.zeros(n, bool)
    for s in range(0, n, tile):
        near = block.unit[s : s + tile] @ block.unit.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -2
        if block.side is not None:
            near[block.side[s : s + tile][:, None] == block.side[None, :]] = -2
        linked[s : s + tile] = (near >= params.cutoff - params.slack).any(axis=1)
        density[s : s + tile] = (near >= params.cutoff) @ block.counts
    density += block.counts - 1 if block.first else 0
    label = np.full(n, -1)
    if block.first and home.any():
        rows = np.flatnonzero(home)
        rows = rows[np.argsort(-density[rows], kind="stable")]  # densest first; keys are in order, so ties go by key
        pointer, unit = np.arange(len(rows)), block.unit[rows]
        for s in range(0, len(rows), tile):
            near = unit[s : s + tile] @ unit[: s + tile].T
            near[np.arange(near.shape[1])[None, :] >= np.arange(s, s + len(near))[:, None]] = -2
            best = near.argmax(axis=1)
            pointer[s : s + tile] = np.where(near[np.arange(len(near)), best] >= params.cutoff + params.slack, best, pointer[s : s + tile])
        while (pointer != pointer[pointer]).any():
            pointer = pointer[pointer]
        label[rows] = rows[pointer]
    where = np.flatnonzero(linked)
    if not len(where):
        return None
    names = [bytes(x) for x in block.keys]
    return {"key": [names[i] for i in where], "n": np.where(home, density, 0)[where], "label": [names[label[i]] if label[i] >= 0 else None for i in where]}


PEAKS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("label", pa.binary())])


def block_links(block: Block, params: PeakParams, tile: int = 1024) -> dict[str, list] | None:
    """Links between labels, no more than connect those that are connected in the block, and pairs of entries whose cosine
    is too near the cutoff to tell, if nothing else connects their labels."""
    labels, first, label = np.unique(block.keys, return_index=True, return_inverse=True)
    n, count = len(block.keys), len(labels)
    if count < 2:
        return None
    group = np.arange(count)  # of labels that are connected so far

    def top(g: int) -> int:
        while group[g] != g:
            group[g] = group[group[g]]
            g = group[g]
        return int(g)

    links, near_pairs = [], []
    for s in range(0, n, tile):
        near = block.unit[s : s + tile] @ block.unit[: s + tile].T  # entries are in the order of their labels
        if block.side is not None:
            near[block.side[s : s + tile][:, None] == block.side[None, : s + tile]] = -2
        mine, low = label[s : s + tile], params.cutoff - params.band
        ahead = first[first < near.shape[1]]
        best = np.maximum.reduceat(near, ahead, axis=1)  # of each entry to each label so far
        best[np.arange(len(near)), mine] = -2
        rows, others = np.nonzero(best >= params.cutoff + params.band)
        for a, b in (divmod(int(pair), count) for pair in np.unique(mine[rows] * count + others)):
            if (x := top(a)) != (y := top(b)):
                group[max(x, y)] = min(x, y)
                links.append((a, b))
        doubtful = (best >= low) & (best < params.cutoff + params.band)
        if doubtful.any():
            r, c = np.nonzero((near >= low) & doubtful[:, label[: near.shape[1]]])
            near_pairs.append(np.stack([r + s, c]))
    kind, src, dst = [0] * len(links), [bytes(labels[a]) for a, _ in links], [bytes(labels[b]) for _, b in links]
    if near_pairs:
        a, b = np.concatenate(near_pairs, axis=1)
        tops = np.array([top(g) for g in range(count)])
        open_ = tops[label[a]] != tops[label[b]]
        a, b = a[open_], b[open_]
        if len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = [bytes(k) for k in key_bytes(block.codes[used])]
            for i, j in zip(place[: len(a)], place[len(a) :]):
                kind.append(1)
                src.append(keys[i])
                dst.append(keys[j])
    return {"kind": kind, "src": src, "dst": dst}


LINKS = pa.schema([("kind", pa.int32()), ("src", pa.binary()), ("dst", pa.binary())])


def decided(pairs: DataFrame, df: DataFrame, vector: str, params: PeakParams) -> DataFrame:
    """Those of the ``(src, dst)`` pairs of keys whose vectors have a cosine, in double precision and rounded, that makes a
    link. Only the vectors of these keys are looked at; the table isn't shuffled where the pairs are few."""
    dim = params.pivots.dim

    def exact(batches):
        for batch in batches:
            where, x = unit_rows(batch.column(0), dim)
            keys = key_bytes(encode(x)[0]) if len(x) else []
            yield pa.RecordBatch.from_pydict({"key": pa.array([bytes(k) for k in keys], pa.binary()), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    def cosines(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float64).reshape(-1, dim) for i in (2, 3))
            keep = pa.array(np.round(np.einsum("ij,ij->i", a, b), 6) >= params.cutoff)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["src", "dst"])

    keys = pairs.select(F.col("src").alias("key")).union(pairs.select("dst")).distinct()
    few = pairs.count() <= params.small
    wanted = df.select(vector).mapInArrow(exact, "key binary, x binary").join(F.broadcast(keys) if few else keys, "key", "left_semi").groupBy("key").agg(F.min("x").alias("x"))
    both = pairs.join(wanted.select(F.col("key").alias("src"), F.col("x").alias("a")), "src").join(wanted.select(F.col("key").alias("dst"), F.col("x").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(cosines, "src binary, dst binary")


def key_groups(df: DataFrame, ident: str, vector: str, params: PeakParams) -> DataFrame:
    """``(key, component, density)`` of every direction that may be linked to another one."""
    pivots = fit_pivots(df, ident, vector, params.pivots)
    found = each_block(postings(df, vector, pivots, short=True), pivots, lambda b: block_peaks(b, params), "key binary, n long, label binary", PEAKS)
    labels = staged(found.groupBy("key").agg(F.sum("n").alias("density"), F.max("label").alias("label")).withColumn("label", F.coalesce("label", "key")), "labels")
    wide = measure_blocks(df, ident, vector, replace(pivots, params=replace(params.pivots, prefix=params.prefix), splits={}), df.count())
    labelled = coded(df, vector, params.pivots.dim).join(labels.select("key", "label"), "key")
    links = staged(each_block(post_labelled(labelled, "label", wide), wide, lambda b: block_links(b, params), "kind int, src binary, dst binary", LINKS, labelled=True), "links")
    sure = links.where("kind = 0").select("src", "dst")
    near = staged(decided(links.where("kind = 1").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), df, vector, params), "decided")
    of = labels.select("key", "label")
    more = near.join(of.select(F.col("key").alias("src"), F.col("label").alias("a")), "src").join(of.select(F.col("key").alias("dst"), F.col("label").alias("b")), "dst")
    joined = connected_components(sure.union(more.select("a", "b")).where("src <> dst"))
    return labels.join(joined.withColumnRenamed("node", "label"), "label", "left").select("key", F.coalesce("component", "label").alias("component"), "density")


def clusters(df: DataFrame, ident: str = "id", vector: str = "vector", params: PeakParams = PeakParams()) -> DataFrame:
    """``(id, first_id, size, density)`` of every id in a cluster of two or more; ``first_id`` is the cluster's smallest.

    Rows whose vector is null, of another size, not finite, or all zero, and rows with a null id, are in no cluster; an
    empty table gives no rows. Vectors of one direction are one entry, however many, so that copies are never paired;
    density counts them all. Other columns are not read, whatever their names.
    """
    every = members(df, ident, vector, params.pivots.dim)
    keys = every.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = staged(keys.join(key_groups(df, ident, vector, params), "key", "left").withColumn("component", F.coalesce("component", "key")), "named")
    totals = named.groupBy("component").agg(F.min("least").alias("first_id"), F.sum("n").alias("size")).where("size > 1")
    by_key = named.join(totals, "component").select("key", "first_id", "size", F.greatest(F.coalesce("density", F.lit(0)), F.col("n") - 1).alias("density"))
    return every.join(by_key, "key").select("id", "first_id", "size", "density")


def describe(clustered: DataFrame, rows: DataFrame, typical: int = 3, ident: str = "id", path: str = "path") -> DataFrame:
    """``(first_id, size, position, id, path)``: each cluster's ``typical`` densest members, ties by id."""
    top = clustered.withColumn("position", F.row_number().over(Window.partitionBy("first_id").orderBy(F.desc("density"), "id"))).where(F.col("position") <= typical)
    return top.join(rows.select(F.col(ident).alias("id"), F.col(path).alias("path")), "id").select("first_id", "size", "position", "id", "path")
