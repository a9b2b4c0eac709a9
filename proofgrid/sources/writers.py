"""Sinks: JSON documents, cached tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import to_wire


def write_json(df: DataFrame, column: str, path: str) -> None:
    """One text file set with a document a line (SNK1-SNK6)."""
    df.select(column).write.mode("overwrite").text(path)


def write_document_lines(lines: DataFrame, group: str, path: str, parts: int | None = None) -> None:
    """Write document_lines to path, a folder document=... for each group.

    A group's files, in order of their names, make its document with a line end after each line,
    which JSON ignores. Lines are range-sorted over parts tasks (the session's number of shuffle
    partitions if None), so a large group has several files and no task holds more than its
    range; rows are written as they come off the sort, and lost tasks are written again by
    Spark's commit protocol. parts=1 gives each group one file. Folders are called g_ and the
    group's value, or null.
    """
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # never null: the writer then keeps this order instead of sorting by folder again
    named = lines.select(F.coalesce(F.concat(F.lit("g_"), F.col(f"`{group}`").cast("string")), F.lit("null")).alias("document"), "line", "text")
    out = named.repartitionByRange(n, "document", "line").sortWithinPartitions("document", "line")
    out.select("document", "text").write.mode("overwrite").partitionBy("document").text(path)


def template_documents(templates: DataFrame, version: str) -> DataFrame:
    """One JSON document of templates by name in wire form (SNK7); templates are a dimension."""
    rows = F.array_sort(F.collect_list(F.struct("name", to_wire(F.col("signature")).alias("signature"))))
    return templates.agg(F.to_json(F.struct(F.lit(version).alias("version"), rows.alias("signatures"))).alias("json"))


def region_document(regions: DataFrame) -> DataFrame:
    """One JSON object of all regions, cut to 0..1 (SNK8)."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double"))).alias(c)
    entries = F.array_sort(F.collect_list(F.struct(F.col("name"), F.struct(*(clamp(c) for c in "xywh")).alias("r"))))
    return regions.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def cache_catalog(catalog: DataFrame, path: str) -> DataFrame:
    """Write a catalog and read the written one (SNK10, SRC5)."""
    catalog.write.mode("overwrite").parquet(path)
    return catalog.sparkSession.read.schema(catalog.schema).parquet(path)


def collision_report(pairs: DataFrame) -> str:
    """A Markdown table of colliding names, a dimension's worth (SNK9)."""
    rows = pairs.orderBy("inner", "outer").collect()
    return "\n".join(["| name | contained in |", "|---|---|", *(f"| {r['inner']} | {r['outer']} |" for r in rows)])
