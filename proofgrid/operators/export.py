"""Export policy: refuse with reasons, quarantine, validate the payload, account for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import expected_count
from ..functions.text import camel_key, sanitize_key
from .documents import document_lines
from .ordering import running_index

STRICT, PARTIAL = "Strict", "IncludePartial"
UNKNOWN = "UNKNOWN"


def reasons(**checks: Column) -> Column:
    """Messages of the checks that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in checks.items())))


def fatal_reasons(name: Column, cost: Column, level: Column, group: Column, main_key: Column, main_value: Column, costs: Sequence[int] = (1, 3, 4), levels: tuple[int, int] = (0, 25)) -> Column:
    """What no policy lets through (EXP1)."""
    missing = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return reasons(
        **{
            "name missing": missing(name) | (name == UNKNOWN),
            "cost invalid": ~F.coalesce(cost.isin(list(costs)), F.lit(False)),
            "level invalid": ~F.coalesce(level.between(*levels), F.lit(False)),
            "set missing": missing(group),
            "main stat missing": missing(main_key) | (main_key == "Unknown"),
            "main value invalid": ~F.coalesce(main_value > 0, F.lit(False)),
        }
    )


def degradations(substats: Column, level: Column) -> Column:
    """What only strict export refuses: keyed entries without an accepted value, and too few entries (EXP1).

    substats is an array of struct(key, value, snapped).
    """
    keyed = F.filter(substats, lambda s: s["key"].isNotNull() & (s["key"] != "Unknown"))
    unresolved = F.transform(F.filter(keyed, lambda s: s["snapped"].isNull()), lambda s: F.concat(F.lit("unresolved value for "), s["key"]))
    accepted = F.size(F.filter(keyed, lambda s: s["snapped"].isNotNull()))
    few = F.when(accepted < expected_count(level), F.array(F.lit("count below the level rule"))).otherwise(F.array().cast("array<string>"))
    return F.concat(unresolved, few)


def decide(df: DataFrame, fatal: Column, degraded: Column, policy: str = STRICT) -> DataFrame:
    """df with reasons and exported (EXP1, EXP2)."""
    blocking = F.concat(fatal, degraded) if policy == STRICT else fatal
    return df.withColumn("reasons", F.coalesce(blocking, F.array().cast("array<string>"))).withColumn("exported", F.size("reasons") == 0)


def exported_substats(substats: Column, cap: int = 5, dedupe: bool = True, places: int | None = 2) -> Column:
    """Accepted entries as struct(key in camel case, value), first of each key, at most cap (EXP3, EXP4)."""
    ok = F.filter(substats, lambda s: s["snapped"].isNotNull() & s["key"].isNotNull())
    if dedupe:
        keys = F.transform(ok, lambda s: s["key"])
        ok = F.filter(ok, lambda s, i: F.array_position(keys, s["key"]) == i + 1)
    value = lambda s: F.bround(s["snapped"].cast("double"), places) if places is not None else s["snapped"].cast("double")
    return F.transform(F.slice(ok, 1, cap), lambda s: F.struct(camel_key(s["key"]).alias("key"), value(s).alias("value")))


def with_export_ids(df: DataFrame, group: str | None, order: Sequence[str], name: Column, millis: int, prefix: str = "item") -> DataFrame:
    """Running index of the kept rows, the id made of it, and createdAt (WIN2, EXP3).

    The index runs within group, or over the whole table where group is None; no task holds a
    whole group (ordering.py).
    """
    out = running_index(df, [] if group is None else [group], order)
    number = F.lpad(F.col("index").cast("string"), 3, "0")
    number = F.when(F.col("index") >= 1000, F.col("index").cast("string")).otherwise(number)
    return out.withColumn("export_id", F.concat_ws("_", F.lit(prefix), F.lit(str(millis)), number, sanitize_key(name))).withColumn("created_at", F.lit(millis).cast("long") + F.col("index"))


def quarantine(rejected: DataFrame, key: str) -> DataFrame:
    """(key, reasons), one row for each key, the first reasons given (SNK4, J11)."""
    first = Window.partitionBy(key).orderBy(F.col("reasons").cast("string"))
    return rejected.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(key, "reasons")


def quarantine_documents(rejected: DataFrame, group: str, key: str) -> DataFrame:
    """(group, json): the number of quarantined keys and their reasons, one document a group (SNK4)."""
    rows = rejected.groupBy(group, key).agg(F.min_by("reasons", F.col("reasons").cast("string")).alias("reasons"))
    packed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("image"), "reasons"))).alias("entries"))
    return packed.select(group, F.to_json(F.struct(F.size("entries").alias("count"), F.col("entries"))).alias("json"))


def quarantine_lines(rejected: DataFrame, group: str, key: str) -> DataFrame:
    """The documents of quarantine_documents as lines, for groups of any size (SNK4)."""
    rows = rejected.groupBy(group, key).agg(F.min_by("reasons", F.col("reasons").cast("string")).alias("reasons"))
    return document_lines(rows, group, key, F.struct(F.col(key).alias("image"), "reasons"), "entries", {"count": F.count("*")})


def edit_documents(df: DataFrame, group: str, order: str, fields: Sequence[str], exported_at: str) -> DataFrame:
    """(group, json): reviewed rows with how many are verified and edited (SNK6); df has verified and edited."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields, "verified", "edited").alias("row"))))
    packed = df.groupBy(group).agg(rows.alias("rows"), F.count("*").alias("total"), F.count_if("verified").alias("v"), F.count_if("edited").alias("e"))
    head = F.struct(F.lit(exported_at).alias("ExportedAt"), F.col("total").alias("TotalEchoes"), F.col("v").alias("VerifiedCount"), F.col("e").alias("EditedCount"), F.transform("rows", lambda r: r["row"]).alias("Echoes"))
    return packed.select(group, F.to_json(head).alias("json"))


def edit_lines(df: DataFrame, group: str, order: str, fields: Sequence[str], exported_at: str) -> DataFrame:
    """The documents of edit_documents as lines, for groups of any size (SNK6)."""
    head = {"ExportedAt": F.lit(exported_at), "TotalEchoes": F.count("*"), "VerifiedCount": F.count_if("verified"), "EditedCount": F.count_if("edited")}
    return document_lines(df, group, order, F.struct(*fields, "verified", "edited"), "Echoes", head)


def raw_values(df: DataFrame, main_key: str = "main_key", substats: str = "substats") -> DataFrame:
    """Rows with a main key, entries with the values as read, past the export policy (EXP9; never the default)."""
    plain = F.transform(substats, lambda s: F.struct(s["key"].alias("key"), s["value"].alias("value")))
    return df.where(F.coalesce(F.trim(main_key) != "", F.lit(False))).withColumn(substats, plain)


def accounting(df: DataFrame, exported: Column, quarantined: Column) -> DataFrame:
    """One row: total, exported, quarantined, skipped, balanced (AGG17)."""
    c = df.agg(F.count("*").alias("total"), F.count_if(exported).alias("exported"), F.count_if(quarantined & ~exported).alias("quarantined"), F.count_if(~exported & ~quarantined).alias("skipped"))
    return c.withColumn("balanced", F.col("exported") + F.col("quarantined") + F.col("skipped") == F.col("total"))


def validate(df: DataFrame, key: str, json_col: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """(key, problem): each rule over the parsed document ``doc`` that holds, and documents that don't parse (EXP5-EXP7).

    An absent optional field passes; one that is present and null is for a rule to find in the
    text, as the parsed document can't tell.
    """
    doc = df.select(key, F.col(json_col).alias("_raw"), F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE"}).alias("doc"))
    broken = F.col("_raw").isNull() | F.try_parse_json(F.col("_raw")).isNull()
    found = [F.when(broken, F.lit("document: not JSON"))] + [F.when(~broken & F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in rules.items()]
    return doc.select(key, F.explode(F.array_compact(F.array(*found))).alias("problem"))


def require_valid(problems: DataFrame) -> None:
    """Raise if there is any problem, before anything is written (EXP8)."""
    some = problems.limit(5).collect()
    if some:
        raise ValueError("invalid payload: " + "; ".join(str(r["problem"]) for r in some))


def documents(df: DataFrame, group: str, order: str, fields: Sequence[str], header: dict[str, Column]) -> DataFrame:
    """(group, json): header fields and the group's rows in order as one JSON document (SNK1-SNK6).

    Null fields are left out, as JSON writers do.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("row"))))
    packed = df.groupBy(group).agg(F.transform(rows, lambda r: r["row"]).alias("rows"))
    return packed.select(group, F.to_json(F.struct(*(c.alias(n) for n, c in header.items()), F.size("rows").alias("count"), "rows")).alias("json"))
