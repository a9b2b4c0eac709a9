"""Running numbers in order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

PART, PLACE, FIRST, ROWS = "__part", "__place", "__first", "__rows"


def running_index(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "index") -> DataFrame:
    """df with each row's number (long, from 0) in its group by order; no groups: in the table (WIN2).

    Rows are range-sorted by group and order and written once. A row's number is its place in
    its stretch (the group's rows of one partition) and the rows of the group's stretches in
    partitions before. Only the stretches, a row for each group and partition that holds some of
    it, are summed in order, so a group of any size is spread over tasks. Rows that tie in
    groups and order stay in one partition, in any order: an order that names each row makes
    the numbers repeatable. Null is a group of its own, and first in order; an empty table gives
    no rows; a column that is called name is replaced.
    """
    kept = df.drop(name)
    part = kept.orderBy(*groups, *order).withColumn(PART, F.spark_partition_id()).withColumn(PLACE, F.monotonically_increasing_id())
    part = stage(part, "running-index")
    stretch = part.groupBy(PART, *groups).agg(F.min(PLACE).alias(FIRST), F.count("*").alias(ROWS))
    ahead = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1) if not groups else Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.withColumn(ROWS, F.coalesce(F.sum(ROWS).over(ahead), F.lit(0)))
    stretch = stretch.select(FIRST, ROWS, F.col(PART).alias("__p"), *(F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)))
    same = reduce(lambda a, b: a & b, (F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)), F.col(PART) == F.col("__p"))
    return part.join(stretch, same).select(*(F.col(f"`{c}`") for c in kept.columns), (F.col(PLACE) - F.col(FIRST) + F.col(ROWS)).alias(name))
