"""Are cost, level, main and second value possible together? What can't be is flagged, a level that only fits otherwise is corrected.

The value ranges are dimension tables: (cost, key, rarity, start, end) for main values, and the
same with one key a cost for second ones. Both are counted before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import all_flags, consistent_level, f32, max_level, scaled_value
from .resolve import small

#: How far a main and a second value may lie from what their level gives; the rarity whose second range serves the lowest one.
MAIN_TOLERANCE, SECOND_TOLERANCE, LOWEST_RANGE = 0.051, 0.51, 2


def _at(level: Column, start: Column, end: Column, rarity: Column, flat: Column) -> Column:
    return f32(F.when(start.isNotNull() & level.isNotNull(), scaled_value(start, end, level, max_level(rarity), flat)))


def primary_value(df: DataFrame, ranges: DataFrame, cost: str = "cost", key: str = "main_key", rarity: str = "rarity", level: str = "level") -> DataFrame:
    """df with range_start, range_end, allowed (the cost may have the key) and primary (the value at the level; null if illegal) (CS1, CS4)."""
    r = small(ranges.select(F.col("cost").alias("_c"), F.col("key").alias("_k"), F.col("rarity").alias("_r"), F.col("start").alias("range_start"), F.col("end").alias("range_end")))
    legal = small(ranges.select(F.col("cost").alias("_lc"), F.col("key").alias("_lk")).distinct())
    out = df.join(r, (F.col(cost) == F.col("_c")) & (F.col(key) == F.col("_k")) & (F.col(rarity) == F.col("_r")), "left").drop("_c", "_k", "_r")
    out = out.join(legal, (F.col(cost) == F.col("_lc")) & (F.col(key) == F.col("_lk")), "left").withColumn("allowed", F.col("_lc").isNotNull()).drop("_lc", "_lk")
    return out.withColumn("primary", _at(F.col(level), F.col("range_start"), F.col("range_end"), F.col(rarity), F.lit(False)))


def secondary_value(df: DataFrame, ranges: DataFrame, cost: str = "cost", rarity: str = "rarity", level: str = "level") -> DataFrame:
    """df with second_wanted (the cost's only second key) and secondary (its whole value at the level) (CS5)."""
    r = ranges.select(F.col("cost").alias("_c"), F.col("key").alias("second_wanted"), F.col("rarity").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    place = F.when(F.col(rarity) == 1, F.lit(LOWEST_RANGE)).otherwise(F.col(rarity))
    out = df.join(small(r), (F.col(cost) == F.col("_c")) & (place == F.col("_r")), "left")
    return out.withColumn("secondary", _at(F.col(level), F.col("_s"), F.col("_e"), F.col(rarity), F.lit(True))).drop("_c", "_r", "_s", "_e")


def solve(df: DataFrame, mains: DataFrame, seconds: DataFrame) -> DataFrame:
    """df (cost, rarity, level, main_key, main_value, second_key, second_value) with level corrected and consistency columns (CS7).

    Added: level_read, primary and secondary (at the level after correction), second_off (a
    second value that differs, for information), consistency (the flags, in order). Without
    cost or level nothing can be said. The level is corrected before the second value is
    looked at, and before any later rule counts entries by level.
    """
    out = primary_value(df, mains)
    known = F.col("cost").isNotNull() & F.col("level").isNotNull()
    has_main, has_second = F.col("main_key").isNotNull(), F.col("second_key").isNotNull()
    apart = f32(F.abs(f32(F.col("main_value")) - F.col("primary"))) > f32(MAIN_TOLERANCE)
    only = consistent_level(F.col("main_value"), F.col("range_start"), F.col("range_end"), max_level(F.col("rarity")), F.lit(False), MAIN_TOLERANCE)
    out = out.withColumn("_wrong", known & has_main & F.col("allowed") & F.coalesce(apart, F.lit(False)))
    out = out.withColumn("_only", F.when(F.col("_wrong"), only)).withColumn("_fixed", F.coalesce(F.col("_wrong") & (F.col("_only") != F.col("level")), F.lit(False)))
    out = out.withColumn("_bad", known & has_main & ~F.col("allowed")).withColumn("level_read", F.col("level"))
    out = out.withColumn("level", F.when(F.col("_fixed"), F.col("_only")).otherwise(F.col("level")).cast("int"))
    out = out.withColumn("primary", _at(F.col("level"), F.col("range_start"), F.col("range_end"), F.col("rarity"), F.lit(False)))
    out = secondary_value(out, seconds)
    other = known & has_second & ~F.col("second_key").eqNullSafe(F.col("second_wanted"))
    off = known & has_second & ~other & (f32(F.abs(f32(F.col("second_value")) - F.col("secondary"))) > f32(SECOND_TOLERANCE))
    flags = all_flags(MainStatInvalidForCost=F.col("_bad"), LevelCorrectedByStats=F.col("_fixed"), MainValueImpossible=F.col("_wrong") & F.col("_only").isNull(), SecondMainStatInvalid=other)
    out = out.withColumn("second_off", F.coalesce(off, F.lit(False))).withColumn("consistency", flags)
    return out.drop("_wrong", "_only", "_fixed", "_bad", "range_start", "range_end", "allowed", "second_wanted")
