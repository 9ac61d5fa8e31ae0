"""Places in a sorted order, worked out by range partitions and never in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The id that Spark gives a row holds the partition above this many bits and the row's place in it below them.
_BITS = 33


def sorted_parts(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df, dealt out by ranges of `order` and sorted in each, as a written table with two more columns: part (ascends
    with the order) and row (from 0 in its part). Equal keys lie in one part, so `order` should end in an id."""
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    return cut(placed.select(*df.columns, F.shiftright("at", _BITS).alias("part"), F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("row")), label)


def part_counts(parts: DataFrame) -> list[tuple[int, int, int]]:
    """(part, rows before it, rows in it) of a table of sorted_parts; as many as the shuffle has partitions."""
    out, before = [], 0
    for r in parts.groupBy("part").count().orderBy("part").collect():
        out.append((r["part"], before, r["count"]))
        before += r["count"]
    return out
