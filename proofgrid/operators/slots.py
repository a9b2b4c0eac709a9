"""Assigning positioned lines to slots, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repair_artifacts, value_line


def nearest_slot(y: Column, centres: Sequence[float]) -> Column:
    """struct(slot, distance) of the nearest centre, the first among equals; (-1, infinite) without any (SL1)."""
    if not centres:
        return F.struct(F.lit(-1).alias("slot"), F.lit(float("inf")).alias("distance"))
    near = F.array_min(F.array(*(F.struct(F.abs(y - float(c)).alias("distance"), F.lit(i).alias("slot")) for i, c in enumerate(centres))))
    return F.struct(near["slot"].alias("slot"), near["distance"].alias("distance"))


def reach(centres: Sequence[float], share: float = 0.6) -> float:
    """Farthest distance that still counts: a share of the upper median pitch, infinite under two centres (SL2)."""
    gaps = sorted(b - a for a, b in zip(centres, centres[1:]))
    return share * gaps[len(gaps) // 2] if gaps else float("inf")


def slot_centres(regions: Sequence[tuple[float, float]], height: float) -> list[float]:
    """Centres of (top, height) regions scaled to a crop (SL3)."""
    return [(y + h / 2) * height for y, h in regions]


def assign(lines: DataFrame, group: str, order: str, y: str, centres: Sequence[float]) -> DataFrame:
    """lines with slot (null for orphans), distance, and status first, collision or orphan (SL4, SL6, WIN4)."""
    near = nearest_slot(F.col(y), centres)
    rows = lines.withColumn("distance", near["distance"]).withColumn("slot", F.when(near["distance"] <= reach(centres), near["slot"]))
    k = F.row_number().over(Window.partitionBy(group, "slot").orderBy(order))
    return rows.withColumn("status", F.when(F.col("slot").isNull(), "orphan").when(k == 1, "first").otherwise("collision"))


def fill(lines: DataFrame, group: str, order: str, y: str, text: str, centres: Sequence[float], parse: Callable[[Column], Column], headers: Column, resolved: Callable[[Column], Column]) -> DataFrame:
    """lines with slot, role and parsed (SL4): what each line of a group does for its slot.

    lines have attempt (1, or 2 for a retry pass). parse reads a whole line; resolved says
    whether what it read is a legal value; headers, which lines are headings. Roles: header;
    orphan (too far from all slots); row (the slot's whole line: the first of the first pass,
    or, if that isn't resolved, the first resolved one of the retry pass); value and label
    (the last one of each, where no whole line came before); collision (whole lines that
    lose, and parts behind a whole line).
    """
    near = nearest_slot(F.col(y), centres)
    rows = lines.withColumn("distance", near["distance"]).withColumn("slot", F.when(near["distance"] <= reach(centres), near["slot"])).withColumn("parsed", parse(F.col(text)))
    head = F.coalesce(headers, F.lit(False))
    out = F.when(head, "header").when(F.col("slot").isNull(), "orphan")
    rows = rows.withColumn("_out", out).withColumn("_slot", F.when(F.col("_out").isNull(), F.col("slot")))
    whole = F.col("_out").isNull() & F.col("parsed").isNotNull()
    rows = rows.withColumn("_whole", whole).withColumn("_good", whole & F.coalesce(resolved(F.col("parsed")), F.lit(False)))
    slot = Window.partitionBy(group, "_slot")
    at = F.struct("attempt", order)
    rows = rows.withColumn("_first", F.min(F.when(F.col("_whole"), at)).over(slot))
    # of the first pass only the first whole line counts
    counts = F.col("_whole") & ((F.col("attempt") > 1) | (at == F.col("_first")))
    rows = rows.withColumn("_best", F.min(F.when(counts, F.struct((~F.col("_good")).cast("int").alias("bad"), F.col("attempt").alias("a"), F.col(order).alias("o")))).over(slot))
    wins = counts & (F.col("_best.a") == F.col("attempt")) & (F.col("_best.o") == F.col(order))
    part = F.when(value_line(repair_artifacts(F.col(text))).isNotNull(), "value").otherwise("label")
    rows = rows.withColumn("_part", F.when(F.col("_out").isNull() & ~F.col("_whole") & F.coalesce(at < F.col("_first"), F.lit(True)), part))
    last = F.row_number().over(Window.partitionBy(group, "_slot", "_part").orderBy(F.desc("attempt"), F.desc(order)))
    role = F.coalesce(F.col("_out"), F.when(wins, "row"), F.when(F.col("_part").isNotNull() & (last == 1), F.col("_part")), F.when(F.col("_part").isNotNull(), F.lit("overwritten")), F.lit("collision"))
    return rows.withColumn("role", role).drop("_out", "_slot", "_whole", "_good", "_first", "_best", "_part")


def accepted(df: DataFrame, group: str, key: str, order: str, legal: Sequence[str]) -> DataFrame:
    """df with flag: InvalidSubstatKey for keys without a table, SubstatDuplicate for all but the first of a key, else null (SL8)."""
    valid = F.coalesce(F.col(key).isin(list(legal)), F.lit(False))
    k = F.row_number().over(Window.partitionBy(group, key).orderBy(order))
    return df.withColumn("flag", F.when(~valid, "InvalidSubstatKey").when(k > 1, "SubstatDuplicate"))


def accept_retries(first: DataFrame, second: DataFrame, group: str, legal: Sequence[str], main: Column, usable: Column, expected: Column, cap: float = 0.80) -> DataFrame:
    """Rows of second attempts that fill a slot (SL9), with confidence cut to cap.

    first and second have slot and key; second has confidence too. A retry counts only for an
    unfilled slot below expected, with a legal key that the group doesn't have, that isn't
    the main value again (main) and whose value is legal (usable); of one key the first slot.
    """
    ok = F.coalesce(F.col("key").isin(list(legal)) & ~F.coalesce(main, F.lit(False)) & usable & (F.col("slot") < expected), F.lit(False))
    open_ = second.where(ok).join(first.select(group, "slot"), [group, "slot"], "left_anti").join(first.select(group, "key"), [group, "key"], "left_anti")
    return first_of_key(open_, group, "key", "slot").withColumn("confidence", F.least(F.col("confidence"), F.lit(cap).cast("float")))


def purge(entries: Column, expected: Column, legal: Sequence[str]) -> Column:
    """Entries without those of unknown keys and repeats, where they are more than expected (SL10, SET4)."""
    known = F.filter(entries, lambda e: F.coalesce(e["key"].isin(list(legal)), F.lit(False)))
    keys = F.transform(known, lambda e: F.lower(e["key"]))
    single = F.filter(known, lambda e, i: F.array_position(keys, F.lower(e["key"])) == i + 1)
    return F.when(F.size(entries) > expected, single).otherwise(entries)


def gaps(df: DataFrame, group: str, y: str) -> DataFrame:
    """(group, pitch): the upper median of the differences between neighbouring places (WIN6)."""
    rows = df.withColumn("_gap", F.col(y) - F.lag(y).over(Window.partitionBy(group).orderBy(y)))
    sizes = F.array_sort(F.collect_list("_gap"))  # nulls are left out
    return rows.groupBy(group).agg(sizes.alias("_g")).select(group, F.get("_g", F.floor(F.size("_g") / 2).cast("int")).alias("pitch"))


def recombine(label: Column, value: Column) -> Column:
    """A split label and value as one line, or null if one is missing (SL5)."""
    return F.when(label.isNotNull() & value.isNotNull(), F.concat_ws(" ", label, value))


def duplicates_main(main_key: Column, main_value: Column, key: Column, value: Column, tolerance: float = 0.05) -> Column:
    """The entry repeats the main one (SL7)."""
    return F.coalesce((main_key == key) & (F.abs(main_value - value) < tolerance), F.lit(False))


def first_of_key(df: DataFrame, group: str, key: str, order: str, cap: int | None = None) -> DataFrame:
    """The first row of each key in a group, in order, at most cap of them (SL8, WIN3, WIN8)."""
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(group, key).orderBy(order))).where("_k = 1")
    if cap is not None:
        first = first.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= cap)
    return first.drop("_k")


def fill_retries(first: DataFrame, second: DataFrame, group: str, slot: str, key: str) -> DataFrame:
    """Second attempts for slots not yet filled whose key the group doesn't have (SL9)."""
    open_ = second.join(first.select(group, slot), [group, slot], "left_anti").join(first.select(group, key), [group, key], "left_anti")
    return first.withColumn("attempt", F.lit(1)).unionByName(first_of_key(open_, group, key, slot).withColumn("attempt", F.lit(2)))
