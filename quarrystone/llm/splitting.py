"""Pieces of oversized chunks, cut at content-defined places that are moved to natural boundaries.

A rolling hash over the text marks landmarks. From the start of a piece, the first landmark between the least and the
greatest size is taken and moved to the nearest natural boundary there: the end of a line, preferably before a blank or
less indented one; only within a line that is itself too long, the end of a word or a punctuation mark. As landmarks
depend only on the characters before them, an edit alters the pieces around it, and further ones stay as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitParams:
    """least: smallest size of a piece before the last, as a share of the greatest. mean: characters between landmarks,
    as a share of the greatest size. span: characters that the rolling hash sees."""

    least: float = 0.35
    mean: float = 0.25
    span: int = 24


LINE = re.compile(r"\r\n|\r|\n")
INLINE = re.compile(r"[;,})\]>|.!?:]+\s*|\s+")
FACTOR = 0x9E3779B1


def landmarks(text: str, every: int, span: int) -> np.ndarray:
    """Positions after which the hash of the last ``span`` characters is 0 modulo ``every``."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h, factor = np.zeros(len(x), np.uint64), np.uint64(1)
    for i in range(min(span, len(x))):
        h[i:] += x[: len(x) - i] * factor
        factor = np.uint64((int(factor) * FACTOR) % 2**64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return np.flatnonzero(h % np.uint64(max(every, 1)) == 0) + 1


def line_ends(text: str) -> tuple[list[int], list[int]]:
    """Positions after each line end, and how natural a cut there is (2: before a blank or less indented line)."""
    ends = [m.end() for m in LINE.finditer(text)]
    starts = [0, *ends]
    indents = []
    for a, b in zip(starts, [*ends, len(text)]):
        line = text[a:b].rstrip("\r\n")
        stripped = line.lstrip()
        indents.append(-1 if not stripped else len(line) - len(stripped))
    ranks = []
    for i in range(len(ends)):
        before, after = indents[i], indents[i + 1]
        ranks.append(3 if before == -1 and after >= 0 else 2 if after == -1 or (before >= 0 and after < before) else 1)
    return ends, ranks


def cut(text: str, most: int, overlap: int, params: SplitParams = SplitParams()) -> list[tuple[int, int, int]]:
    """``(start, core, end)`` of each piece: characters start to end, of which start to core repeat the last lines of
    the piece before. A text within the limit is one piece.

    ``overlap`` whole lines are repeated, fewer where they would take more than half of the limit; after a cut within a
    line none are, as both pieces have that line's number.
    """
    n, most = len(text), max(1, most)
    if n <= most:
        return [(0, 0, n)]
    marks = landmarks(text, max(2, int(most * params.mean)), params.span)
    ends, ranks = line_ends(text)
    places, values = np.array(ends, np.int64), np.array(ranks, np.float64)
    pieces, core, start = [], 0, 0
    while n - start > most:
        low, high = max(core + max(1, int(most * params.least) // 2), start + max(1, int(most * params.least))), start + most
        i, j = np.searchsorted(marks, [low, high + 1])
        target = int(marks[i]) if i < j else None
        at = None
        i, j = np.searchsorted(places, [low, high + 1])
        if i == j:  # at least one line end, if it must be an early one
            i = np.searchsorted(places, core + 1)
        if i < j:
            near = places[i:j]
            goal = high if target is None else target
            at = int(near[np.argmin((np.abs(near - goal) + most * 0.02) / values[i:j])])
        else:
            spots = [low - 1 + m.end() for m in INLINE.finditer(text[low - 1 : high + 1]) if low <= low - 1 + m.end() <= high]
            goal = high if target is None else target
            if spots:
                at = min(spots, key=lambda p: abs(p - goal))
        if at is None:
            at = high if target is None else target
            if at < n and text[at - 1] == "\r" and text[at] == "\n" and at - 1 > core:
                at -= 1
        pieces.append((start, core, at))
        core = start = at
        i = int(np.searchsorted(places, at))
        if overlap > 0 and i < len(places) and places[i] == at:
            for back in range(overlap, 0, -1):
                first = int(places[i - back]) if i - back >= 0 else 0
                if at - first <= most // 2 and first >= pieces[-1][0]:
                    start = first
                    break
    pieces.append((start, core, n))
    return pieces


def _split(params: SplitParams):
    names = ["id", "piece", "start_line", "end_line", "overlap_lines", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for ident, body, first, last, summary, most, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                breaks = [m.end() for m in LINE.finditer(body)]
                at = np.array(breaks, np.int64)
                for k, (start, core, end) in enumerate(cut(body, most, overlap, params)):
                    line = (first or 1) + int(np.searchsorted(at, start, side="right"))
                    final = (first or 1) + int(np.searchsorted(at, end - 1, side="right"))
                    if summary:
                        line, final = first, last
                    rows.append((ident, k, line, final, int(np.searchsorted(at, core, side="right") - np.searchsorted(at, start, side="right")), body[start:end]))
                if len(rows) >= 2000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def body_of(kind: Column, text: Column) -> Column:
    """What is after the header line of a symbol or window; of any other kind, everything."""
    cut_at = F.instr(text, "\n")
    rest = F.when(cut_at > 0, F.substring(text, cut_at + 1, F.length(text))).otherwise("")
    return F.when(kind.isin("symbol", "window"), rest).otherwise(text)


def limits(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(options_id, most, overlap)`` with the values of options_id 0 in place of nulls; and the one row of 0."""
    base = options.where("options_id = 0").agg(F.max("max_chunk_chars").alias("most0"), F.max("window_overlap").alias("overlap0"))
    each = options.where("options_id is not null").groupBy("options_id").agg(F.max("max_chunk_chars").alias("most"), F.max("window_overlap").alias("overlap"))
    return each, base


def pieces(chunks: DataFrame, options: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """``(id, piece, start_line, end_line, overlap_lines, text)`` of every chunk whose body is longer than the limit.

    ``piece`` counts from 0; ``overlap_lines`` lines at its start are also the last ones of the piece before. Lines are
    those of the file; a file summary has no lines of its own there, so its pieces keep the lines of the whole. A null
    text has no body; a null ``options_id`` or value, or an id that is not among the options, stands for the values of
    options_id 0, and without these nothing is oversized. A null start line is taken as 1. Repeated rows give their
    pieces once for each row. Only oversized bodies leave the JVM; other columns are not read.
    """
    each, base = limits(options)
    body = body_of(F.col("kind"), F.col("text"))
    rows = chunks.select("id", "options_id", "start_line", "end_line", (F.col("kind") == "file-summary").alias("summary"), body.alias("body"))
    known = rows.join(F.broadcast(each), "options_id", "left").crossJoin(F.broadcast(base)) if _few(each) else rows.join(each, "options_id", "left").crossJoin(F.broadcast(base))
    known = known.withColumn("most", F.coalesce("most", "most0")).withColumn("overlap", F.coalesce("overlap", "overlap0", F.lit(0)))
    over = known.where(F.length("body") > F.col("most")).select("id", "body", "start_line", "end_line", F.coalesce("summary", F.lit(False)).alias("summary"), "most", "overlap")
    return over.mapInArrow(_split(params), "id string, piece int, start_line int, end_line int, overlap_lines int, text string")


def _few(options: DataFrame, bound: int = 100_000) -> bool:
    return options.limit(bound + 1).count() <= bound


def oversized(chunks: DataFrame, options: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """``id`` of every chunk that has more than one piece."""
    return pieces(chunks, options, params).where("piece = 1").select("id").distinct()
