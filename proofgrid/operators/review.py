"""Overlaying edits and overrides, relinking files, and what is missing or new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by order (J2: a later duplicate wins)."""
    w = Window.partitionBy(F.lower(F.col(key).cast("string"))).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def overlay(base: DataFrame, edits: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """base with the columns of its latest edit where that has a value; keys ignore case."""
    e = latest(edits, key, order).select(F.lower(F.col(key).cast("string")).alias("_key"), *(F.col(c).alias(f"_e_{c}") for c in columns))
    out = base.join(e, F.lower(base[key].cast("string")) == F.col("_key"), "left")
    merged = [F.coalesce(F.col(f"_e_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return out.select(*merged, F.col("_key").isNotNull().alias("edited"))


def override_merge(base: DataFrame, override: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All keys of both sides, ignoring case, with the override's row where it has one."""
    a = base.select(F.lower(key).alias("_k"), F.col(key).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    b = override.select(F.lower(key).alias("_k"), F.col(key).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    out = a.join(b, "_k", "full_outer")
    pick = lambda c: F.when(F.col("_b").isNotNull(), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c)
    return out.select(F.coalesce("_b", "_a").alias(key), *(pick(c) for c in columns), F.col("_b").isNotNull().alias("overridden"))


def relink(rows: DataFrame, files: DataFrame, path: str, file_path: str) -> DataFrame:
    """rows with linked (the path if it exists, else a file of the same base name) and status kept, relinked or missing (SRC11, J12)."""
    base = lambda c: F.element_at(F.split(c, r"[/\\]"), -1)
    known = files.select(F.col(file_path).alias("_same")).distinct()
    named = files.groupBy(base(F.col(file_path)).alias("_name")).agg(F.min(file_path).alias("_other"))
    out = rows.join(known, rows[path] == F.col("_same"), "left").join(named, base(rows[path]) == F.col("_name"), "left")
    status = F.when(F.col("_same").isNotNull(), "kept").when(F.col("_other").isNotNull(), "relinked").otherwise("missing")
    return out.select(*(rows[c] for c in rows.columns), F.coalesce("_same", "_other").alias("linked"), status.alias("status"))


def missing_names(expected: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """Expected names that the catalog lacks, ignoring case (J9, SET3)."""
    return expected.select(name).distinct().join(catalog.select(F.lower(name).alias("_k")).distinct(), F.lower(F.col(name)) == F.col("_k"), "left_anti")


def repeated_keys(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, n) of keys that a group has more than once (AGG6)."""
    return df.groupBy(group, key).agg(F.count("*").alias("n")).where("n > 1")


def padded(df: DataFrame, column: str, size: int) -> DataFrame:
    """An array column padded with nulls to size and cut there."""
    kind = df.schema[column].dataType.elementType
    return df.withColumn(column, F.slice(F.concat(F.col(column), F.array_repeat(F.lit(None).cast(kind), size)), 1, size))


def overlay_array(base: DataFrame, edits: DataFrame, key: str, column: str, order: Sequence[str], size: int = 5) -> DataFrame:
    """base with an array column replaced whole by its latest edit's, padded to size."""
    return padded(overlay(base, edits, key, [column], order), column, size)
