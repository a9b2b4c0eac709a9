"""JSON documents of any size, as sorted lines that make one text."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_index

HEAD, TAIL = -1, (1 << 63) - 1


def document_lines(
    items: DataFrame, group: str, order: str, item: Column, array: str, before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None, kept: Column | None = None
) -> DataFrame:
    """(group, line long, text): each group's document as a head, a line for each kept item in order, and a tail (SNK2-SNK4, SNK6).

    The texts of a group in the order of line make {before, array: [items], after}, byte for
    byte what to_json makes of the same struct. before and after are aggregates of the group's
    rows or literals; a null field is left out. Items that are not kept count
    in the aggregates only; a group of none has an empty array. Lines are HEAD, the items'
    numbers from 0, and TAIL; order should name each item, ties come in any order. Null is a
    group of its own; an empty table gives no rows.
    """
    kept = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    key = F.col(f"`{group}`")
    body = items.where(kept).select(key.alias("__group"), F.col(f"`{order}`").alias("__order"), F.coalesce(F.to_json(item), F.lit("null")).alias("__text"))
    body = running_index(body, ["__group"], ["__order", "__text"], "line")
    comma = F.when(F.col("line") > 0, F.lit(",")).otherwise(F.lit(""))
    body = body.select(F.col("__group").alias(group), "line", F.concat(comma, "__text").alias("text"))

    before, after = dict(before or {}), dict(after or {})
    # each aggregate goes by a name of its own, as both sides may call a field alike
    named = [(f"__{side}{i}", name, c) for side, cs in (("b", before), ("a", after)) for i, (name, c) in enumerate(cs.items())]
    ends = items.groupBy(key.alias("__group")).agg(F.count("*").alias("__n"), *(c.alias(a) for a, _, c in named))
    fields = lambda side: [F.col(a).alias(name) for a, name, _ in named if a.startswith(f"__{side}")]
    text = lambda cs: F.to_json(F.struct(*cs)) if cs else F.lit("{}")
    head, tail = text(fields("b")), text(fields("a"))
    opened = F.when(head == "{}", F.lit("{")).otherwise(F.concat(F.expr("substr(h, 1, length(h) - 1)"), F.lit(",")))
    closed = F.when(tail == "{}", F.lit("]}")).otherwise(F.concat(F.lit("],"), F.expr("substr(t, 2)")))
    ends = ends.withColumns({"h": head, "t": tail})
    ends = ends.select(F.col("__group").alias(group), F.inline(F.array(
        F.struct(F.lit(HEAD).cast("long").alias("line"), F.concat(opened, F.lit(json.dumps(array, ensure_ascii=False) + ":[")).alias("text")),
        F.struct(F.lit(TAIL).cast("long").alias("line"), closed.alias("text")),
    )))
    return body.unionByName(ends)
