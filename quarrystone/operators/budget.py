"""Selections under a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admit_until_full(rows: DataFrame, cost: str, budget: Column, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of each group in order up to the first that doesn't fit; ``spent`` is the sum so far. Costs are positive."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(window)).where(F.col("spent") <= budget)


def admit_what_fits(rows: DataFrame, cost: str, budget: int, group: str, order: Sequence[str]) -> DataFrame:
    """Rows of each group in order, passing over those that don't fit; ``spent`` is the sum so far.

    Each step needs the one before, so a group is walked in order: its rows are adjacent and sorted in one partition
    and stream through with only the sum in memory, whatever the group's size.
    """
    names = rows.columns
    at = names.index(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spent, started = None, 0, False
        for batch in batches:
            groups, costs = batch.column(names.index(group)).to_pylist(), batch.column(at).to_pylist()
            keep, sums = [], []
            for i, (g, c) in enumerate(zip(groups, costs)):
                if not started or g != current:
                    current, spent, started = g, 0, True
                if c is not None and spent + c <= budget:
                    spent += c
                    keep.append(i)
                    sums.append(spent)
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(sums, pa.int64())], names=[*names, "spent"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", spent long"
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
