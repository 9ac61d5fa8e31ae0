"""Places of rows in the order of their group, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlens.session import scratch

#: The id that Spark gives a row holds the partition above this many bits and the row's place in it below them.
_BITS = 33


def ranges(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df, dealt out by ranges of (group, order) and sorted in each, as a written table with _part (ascends with the
    order) and _row (from 0 in its part). A group of any size lies in as many parts as its rows need."""
    at = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("_at", F.monotonically_increasing_id())
    folder = scratch(df.sparkSession, "places")
    mask = F.lit((1 << _BITS) - 1)
    at.select(*df.columns, F.shiftright("_at", _BITS).alias("_part"), F.col("_at").bitwiseAND(mask).alias("_row")).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def placed(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """The 1-based place of each row in its group by `order`, which ends in an id so that no two rows tie.

    First the rows of a group in each range are counted (at most groups + ranges numbers), then a row's place is that
    of its range and its place inside. Rows without a group are a group of their own; an empty table gives none."""
    parts = ranges(df, group, order)
    counts = parts.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_group", "_in", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = parts.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias(name))
