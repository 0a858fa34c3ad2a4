"""Blocks of nearby vectors: every vector is posted to its nearest pivots, and vectors meet in the blocks they share.

A vector is kept as 64 (``dim``) 16-bit codes of its direction and one scale, a quarter of the bytes of doubles; dot
products of codes are exact integers, so a pair gets the same cosine in whatever block it meets, within about 1e-5 of
the cosine in double precision. Vectors of one direction (copies, and copies of another length) have equal codes and
are one entry with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = 12  # bytes of an entry's identity, a hash of its codes
STEPS = 1024  # scales are multiples of 1 / STEPS
FULL = 32767
POSTING = "block long, part int, keys binary, codes binary, scales binary, lists binary, counts binary"
CODED = "key binary, codes binary, scale int, n int"


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors (``dim`` finite entries, not all zero) and their directions in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    where = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(where)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        peak = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
        good = np.isfinite(peak) & (peak > 0)
        where, x = where[good], x[good] / peak[good, None]  # so that the squares neither vanish nor overflow
        return where, x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (int16) and scales (in steps, uint16) of unit rows."""
    steps = np.minimum(np.ceil(np.abs(x).max(axis=1) * STEPS + 1e-9), STEPS).astype(np.uint16) if len(x) else np.zeros(0, np.uint16)
    return np.rint(x / (steps[:, None] / STEPS) * FULL).clip(-FULL, FULL).astype(np.int16), steps


def decode(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32) * (steps.astype(np.float32) / (STEPS * FULL))[:, None]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def key_bytes(codes: np.ndarray) -> np.ndarray:
    """Identities of directions, as fixed-width byte strings."""
    width = codes.shape[1] * 2
    raw = np.ascontiguousarray(codes).tobytes()
    return np.array([hashlib.blake2b(raw[i : i + width], digest_size=KEY).digest() for i in range(0, len(raw), width)], dtype=f"V{KEY}")


def exact_cosines(codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows from whole-number dot products: the same in every block."""
    a, b = codes[left].astype(np.float64), codes[right].astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


@dataclass(frozen=True)
class PivotParams:
    """dim: entries of a vector. prefix: blocks a vector is posted to. rows_per_pivot, least_pivots, most_pivots: the
    pivots' sample has one row for so many rows within these bounds. apart: two pivots have a lower cosine than this.
    direct: pivots up to which a vector is compared with all; beyond, with those of its ``branches`` nearest groups of
    pivots. hot: entries from which a block is split into salted sub-blocks, of which every two meet; what is hot is
    told from a sample of about ``measured`` rows."""

    dim: int = 64
    prefix: int = 6
    rows_per_pivot: int = 1000
    least_pivots: int = 128
    most_pivots: int = 131_072
    apart: float = 0.8
    direct: int = 2048
    branches: int = 12
    hot: int = 20_000
    measured: int = 400_000


def _nearest(near: np.ndarray, names: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The t largest of each row, largest first, and what they are called."""
    top = np.argpartition(-near, t - 1, axis=1)[:, :t] if near.shape[1] > t else np.broadcast_to(np.arange(near.shape[1]), near.shape)
    value = np.take_along_axis(near, top, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(value, order, axis=1), np.take_along_axis(np.take_along_axis(names, top, axis=1), order, axis=1)


@dataclass
class Pivots:
    """groups: of pivots, with the middle of each, where there are too many to look at all."""

    params: PivotParams
    vectors: np.ndarray
    splits: dict[int, int] = field(default_factory=dict)
    groups: list[np.ndarray] = field(default_factory=list)
    middles: np.ndarray | None = None

    def __post_init__(self) -> None:
        n = len(self.vectors)
        if n <= self.params.direct or self.groups:
            return
        self.middles = self.vectors[: int(np.ceil(n**0.5))]
        for _ in range(3):
            home = np.concatenate([(self.vectors[s : s + 8192] @ self.middles.T).argmax(axis=1) for s in range(0, n, 8192)])
            sums = np.zeros_like(self.middles)
            np.add.at(sums, home, self.vectors)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            self.middles = np.where(size > 0, sums / np.maximum(size, 1e-9), self.middles)
        self.groups = [np.flatnonzero(home == g) for g in range(len(self.middles))]

    @property
    def width(self) -> type:
        return np.uint16 if len(self.vectors) < 65_536 else np.uint32

    def prefixes(self, x: np.ndarray) -> np.ndarray:
        """The ordered nearest pivots of each row."""
        t = min(self.params.prefix, len(self.vectors))
        out = np.empty((len(x), t), self.width)
        for s in range(0, len(x), 4096):
            rows = x[s : s + 4096].astype(np.float32)
            if self.middles is None:
                near = -(rows @ self.vectors.T)
                top = np.argpartition(near, t - 1, axis=1)[:, :t]
                out[s : s + 4096] = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
                continue
            near = rows @ self.middles.T
            probed = np.argpartition(-near, min(self.params.branches, near.shape[1]) - 1, axis=1)[:, : self.params.branches]
            best, names = np.full((len(rows), t), -2, np.float32), np.zeros((len(rows), t), np.int64)
            flat, asks = probed.ravel(), np.repeat(np.arange(len(rows)), probed.shape[1])
            order = np.argsort(flat, kind="stable")
            groups, starts = np.unique(flat[order], return_index=True)
            for g, who in zip(groups, np.split(asks[order], starts[1:])):
                mine = self.groups[g]
                if len(mine):
                    value = np.concatenate([best[who], rows[who] @ self.vectors[mine].T], axis=1)
                    named = np.concatenate([names[who], np.broadcast_to(mine, (len(who), len(mine)))], axis=1)
                    best[who], names[who] = _nearest(value, named, t)
            out[s : s + 4096] = names
        return out


def fit_pivots(df: DataFrame, ident: str, vector: str, params: PivotParams) -> Pivots:
    """Pivots from a bounded sample (at most ``most_pivots`` rows, those with the lowest hash), each far from the others."""
    rows = df.count()
    size = min(max(params.least_pivots, rows // params.rows_per_pivot), params.most_pivots)
    sample = df.select(vector, F.xxhash64(ident).alias("__h")).where(F.size(vector) == params.dim)
    if rows > 4 * size:
        share = min(1.0, 3 * size / rows)
        sample = sample.where(F.col("__h") < int(-(2**63) + share * 2**64))
    table = sample.orderBy("__h", vector).limit(size).select(vector).toArrow()
    _, x = unit_rows(table.column(0), params.dim)
    x = x.astype(np.float32)
    kept = np.zeros((0, params.dim), np.float32)
    for s in range(0, len(x), 1024):
        tile = x[s : s + 1024]
        if len(kept):
            tile = tile[(tile @ kept.T).max(axis=1) < params.apart]
        near, chosen = tile @ tile.T, []
        for i in range(len(tile)):
            if not chosen or near[i, chosen].max() < params.apart:
                chosen.append(i)
        kept = np.concatenate([kept, tile[chosen]])
    return measure_blocks(df, ident, vector, Pivots(params, kept), rows)


def measure_blocks(df: DataFrame, ident: str, vector: str, pivots: Pivots, rows: int) -> Pivots:
    """Estimates the different entries of each pivot's file and sets how many sub-blocks each hot one is split into."""
    p = pivots.params
    if not len(pivots.vectors):
        return pivots
    share = min(1.0, p.measured / max(rows, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots.vectors), np.int64)
        for batch in batches:
            _, x = unit_rows(batch.column(0), p.dim)
            if len(x):
                codes, _ = encode(x)
                _, first = np.unique(codes.view(f"V{codes.shape[1] * 2}").ravel(), return_index=True)
                total += np.bincount(pivots.prefixes(x[first]).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    if rows * p.prefix <= p.hot:
        return pivots  # no file can be hot
    part = df.where(F.xxhash64(ident, F.lit(1)) < int(-(2**63) + share * 2**64)) if share < 1 else df
    sizes = part.select(vector).mapInArrow(count, "cell int, n long").groupBy("cell").agg((F.sum("n") / share).alias("n"))
    hot = sizes.where(F.col("n") > p.hot).collect()  # at most a row for each pivot
    return replace(pivots, splits={r["cell"]: -int(-r["n"] // p.hot) for r in hot})


def sub_blocks(keys: np.ndarray, parts: int) -> np.ndarray:
    return keys.view(np.uint8).reshape(len(keys), KEY)[:, :4].copy().view(np.uint32).ravel() % parts


def block_number(cell: int, low: int, high: int) -> int:
    return (cell << 40) | (low << 20) | high


def _files(pivots: Pivots, cells: np.ndarray, salt: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Packed rows of ``POSTING`` for some entries. cells: the pivots that each is posted to; salt: what tells its sub-block."""
    names = ("keys", "codes", "scales", "lists", "counts")
    out: dict[str, list] = {k: [] for k in ("block", "part", *names)}

    def emit(block: int, part: int, rows: np.ndarray) -> None:
        out["block"].append(block)
        out["part"].append(part)
        for name in names:
            out[name].append(columns[name][rows].tobytes() if name in columns else b"")

    flat = cells.ravel()
    order = np.argsort(flat, kind="stable")
    found, starts = np.unique(flat[order], return_index=True)
    for cell, rows in zip(found.tolist(), np.split(order // cells.shape[1], starts[1:])):
        parts = pivots.splits.get(cell, 1)
        if parts == 1:
            emit(block_number(cell, 0, 0), 0, rows)
            continue
        own = sub_blocks(salt[rows], parts)
        for part in range(parts):
            mine = rows[own == part]
            if len(mine):
                for other in range(parts):
                    emit(block_number(cell, min(part, other), max(part, other)), part, mine)
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((k, pa.binary()) for k in names)])
    return pa.RecordBatch.from_pydict(out, schema=schema)


def postings(df: DataFrame, vector: str, pivots: Pivots, short: bool = False) -> DataFrame:
    """The inverted files: packed rows of ``POSTING``, one for each pivot (and pair of sub-blocks) in a batch.

    Copies within a batch are merged before the shuffle. short: only the high bytes of the codes (cosines within about
    0.006), for steps that need no more.
    """
    p = pivots.params

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = unit_rows(batch.column(0), p.dim)
            if not len(x) or not len(pivots.vectors):
                continue
            codes, steps = encode(x)
            _, first, counts = np.unique(codes.view(f"V{p.dim * 2}").ravel(), return_index=True, return_counts=True)
            codes, steps = codes[first], steps[first]
            keys, lists = key_bytes(codes), pivots.prefixes(decode(codes, steps))
            if short:
                codes = ((codes.astype(np.int32) + 128) >> 8).clip(-127, 127).astype(np.int8)
            yield _files(pivots, lists, keys, keys=keys, codes=codes, scales=steps, lists=lists, counts=counts.astype(np.uint32))

    return df.select(vector).mapInArrow(post, POSTING)


def coded(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """``CODED`` rows of the usable vectors; copies within a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = unit_rows(batch.column(0), dim)
            if not len(x):
                continue
            codes, steps = encode(x)
            _, first, counts = np.unique(codes.view(f"V{dim * 2}").ravel(), return_index=True, return_counts=True)
            codes, steps = codes[first], steps[first]
            yield pa.RecordBatch.from_pydict({"key": pa.array([bytes(k) for k in key_bytes(codes)], pa.binary()), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "scale": pa.array(steps.astype(np.int32)), "n": pa.array(counts.astype(np.int32))})

    return df.select(vector).mapInArrow(run, CODED)


def post_labelled(rows: DataFrame, label: str, pivots: Pivots) -> DataFrame:
    """The inverted files of ``CODED`` rows with a ``label`` of KEY bytes, which takes the place of the keys."""
    p = pivots.params

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, labels = (np.frombuffer(b"".join(batch.column(i).to_pylist()), f"V{KEY}") for i in (0, 3))
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16).reshape(-1, p.dim)
            steps = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint16)
            yield _files(pivots, pivots.prefixes(decode(codes, steps)), keys, keys=labels, codes=codes, scales=steps)

    return rows.select("key", "codes", "scale", label).mapInArrow(post, POSTING)


@dataclass
class Block:
    """Entries that share a pivot, in the order of their keys (or labels). side: which of the two sub-blocks each entry is
    in where the block joins two, else None. first: whether it doesn't join two different ones. lists, counts: empty
    where they weren't posted."""

    number: int
    cell: int
    keys: np.ndarray
    codes: np.ndarray
    unit: np.ndarray
    lists: np.ndarray
    counts: np.ndarray
    side: np.ndarray | None
    first: bool


def _block(number: int, parts: list[tuple], pivots: Pivots, labelled: bool) -> Block:
    p, t = pivots.params, min(pivots.params.prefix, len(pivots.vectors))
    part, *columns = zip(*parts)
    joined = [b"".join(x) for x in columns]
    keys = np.frombuffer(joined[0], f"V{KEY}")
    codes = np.frombuffer(joined[1], np.int16 if len(joined[1]) == 2 * p.dim * len(keys) else np.int8).reshape(-1, p.dim)
    steps, lists = np.frombuffer(joined[2], np.uint16), np.frombuffer(joined[3], pivots.width).reshape(-1, t)
    counts, place = np.frombuffer(joined[4], np.uint32), np.repeat(part, [len(x) // KEY for x in columns[0]])
    if labelled:
        first = np.argsort(keys, kind="stable")
        keys = keys[first]
    else:
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
    cell, low, high = number >> 40, (number >> 20) & 0xFFFFF, number & 0xFFFFF
    side = place[first] == low if low != high else None
    return Block(number, cell, keys, codes[first], decode(codes[first], steps[first]), lists[first] if len(lists) else lists, counts, side, low == high)


def each_block(rows: DataFrame, pivots: Pivots, work: Callable[[Block], dict[str, list] | None], schema: str, arrow: pa.Schema, labelled: bool = False) -> DataFrame:
    """Runs ``work`` on every block, one block in memory at a time; rows of a block are adjacent after one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            result = work(_block(current, parts, pivots, labelled)) if parts else None
            if result and len(next(iter(result.values()))):
                yield pa.RecordBatch.from_pydict(result, schema=arrow)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for number, *values in zip(*columns):
                if number != current:
                    yield from done()
                    current, parts = number, []
                parts.append(tuple(values))
        yield from done()

    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * int(spark.sparkContext.defaultParallelism), 2 * len(pivots.vectors) + 1))
    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def members(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """``(id, key)`` of every usable vector with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, x = unit_rows(batch.column(1), dim)
            keys = key_bytes(encode(x)[0]) if len(x) else []
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(where, pa.int64())).cast(pa.string()), "key": pa.array([bytes(k) for k in keys], pa.binary())})

    return df.select(ident, vector).where(F.col(ident).isNotNull()).mapInArrow(run, "id string, key binary")
