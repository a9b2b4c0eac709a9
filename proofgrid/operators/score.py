"""Scoring against truth: fields, multisets, calibration, precision and recall, confusions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_text


def field_scores(df: DataFrame, key: str, fields: Mapping[str, tuple[str, str, bool]], optional: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, expected, actual, match), a row for each field (AC1).

    fields maps a name to its expected and actual column and whether case is ignored;
    optional fields are scored only where something is expected.
    """
    rows = [F.struct(F.lit(f).alias("field"), F.col(e).cast("string").alias("expected"), F.col(a).cast("string").alias("actual"), same_text(F.col(e).cast("string"), F.col(a).cast("string"), ci).alias("match")) for f, (e, a, ci) in fields.items()]
    out = df.select(key, F.inline(F.array(*rows)))
    return out.where(~F.col("field").isin(list(optional)) | F.col("expected").isNotNull()) if optional else out


def multiset_match(expected: Column, actual: Column, tolerance: float = 0.051) -> Column:
    """struct(matched, missed, extra) of arrays of struct(key, value) (AC2, J8).

    Each expected entry in turn takes the first actual one left with its key, ignoring case,
    and a value within tolerance; a fold over the array carries what is left.
    """
    empty = actual.isNull()
    left = F.when(empty, F.filter(expected, lambda x: F.lit(False))).otherwise(actual)
    start = F.struct(left.alias("left"), F.lit(0).alias("matched"), F.lit(0).alias("missed"))

    def step(acc: Column, e: Column) -> Column:
        hit = lambda a: (F.lower(a["key"]) == F.lower(e["key"])) & (F.abs((a["value"] - e["value"]).cast("float")) <= F.lit(tolerance).cast("float"))
        at = F.coalesce(F.array_position(F.transform(acc["left"], lambda a: F.coalesce(hit(a), F.lit(False))), True), F.lit(0))
        rest = F.filter(acc["left"], lambda a, i: i != (at - 1).cast("int"))
        return F.struct(F.when(at > 0, rest).otherwise(acc["left"]).alias("left"), (acc["matched"] + F.when(at > 0, 1).otherwise(0)).alias("matched"), (acc["missed"] + F.when(at > 0, 0).otherwise(1)).alias("missed"))

    return F.aggregate(F.coalesce(expected, F.filter(actual, lambda x: F.lit(False))), start, step, lambda acc: F.struct(acc["matched"].alias("matched"), acc["missed"].alias("missed"), F.size(acc["left"]).alias("extra")))


def calibration(df: DataFrame, confidence: str, hit: str, buckets: int = 10) -> DataFrame:
    """(bucket, lower, upper, count, matched, rate) for every bucket, empty ones too (AC5, AGG9).

    Buckets are closed below and open above, the last closed; null confidences and those
    outside 0..1 fall out. The rate of an empty bucket is 0.
    """
    c = F.col(confidence).cast("double")
    at = F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("int")
    at = F.when(c < at / buckets, at - 1).when((c >= (at + 1) / buckets) & (at < buckets - 1), at + 1).otherwise(at)
    found = df.where(c.between(0, 1)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("m"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    n, m = (F.coalesce(F.col(x), F.lit(0)) for x in ("n", "m"))
    return every.join(found, "bucket", "left").select("bucket", (F.col("bucket") / buckets).alias("lower"), ((F.col("bucket") + 1) / buckets).alias("upper"), n.alias("count"), m.alias("matched"), F.coalesce(F.try_divide(m, n), F.lit(0.0)).alias("rate"))


def rates(df: DataFrame, matched: Column, expected: Column, actual: Column) -> DataFrame:
    """One row: matched, expected, actual, recall and precision (1 when there is nothing to find) (AC4, AGG10)."""
    s = df.agg(F.coalesce(F.sum(matched), F.lit(0)).alias("matched"), F.coalesce(F.sum(expected), F.lit(0)).alias("expected"), F.coalesce(F.sum(actual), F.lit(0)).alias("actual"))
    part = lambda d: F.coalesce(F.try_divide(F.col("matched"), F.col(d)), F.lit(1.0))
    return s.withColumn("recall", part("expected")).withColumn("precision", part("actual"))


def substat_counts(scores: DataFrame, key: str, prefix: str = "substat", extra: str = "substat-extra") -> DataFrame:
    """(key, matched, expected, extra) of the entry fields among a key's scored fields (AGG11)."""
    is_extra = F.col("field").startswith(extra)
    mine = F.col("field").startswith(prefix) & ~is_extra
    return scores.groupBy(key).agg(F.count_if(mine & F.col("match")).alias("matched"), F.count_if(mine).alias("expected"), F.count_if(is_extra).alias("extra"))


def substat_fields(expected: Column, actual: Column, tolerance: float = 0.051) -> Column:
    """array of struct(field, expected, actual, match): substatN for each expected entry, substat-extraN for what is left over (AC2).

    Entries are struct(key, value); each expected one takes the first left with its key and value.
    """
    entry = "array<struct<key:string,value:float>>"
    none = F.array().cast(entry)
    show = lambda e: F.when(e.isNotNull(), F.concat_ws("=", e["key"], e["value"].cast("string")))
    start = F.struct(F.coalesce(actual.cast(entry), none).alias("left"), F.array().cast("array<struct<field:string,expected:string,actual:string,match:boolean>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        hit = lambda a: F.coalesce((F.lower(a["key"]) == F.lower(e["key"])) & (F.abs((a["value"] - e["value"]).cast("float")) <= F.lit(tolerance).cast("float")), F.lit(False))
        at = F.coalesce(F.array_position(F.transform(acc["left"], hit), True), F.lit(0)).cast("int")
        got = F.when(at > 0, F.get(acc["left"], at - 1))
        row = F.struct(F.concat(F.lit("substat"), (F.size(acc["out"]) + 1).cast("string")).alias("field"), show(e).alias("expected"), show(got).alias("actual"), (at > 0).alias("match"))
        return F.struct(F.filter(acc["left"], lambda a, i: i != at - 1).alias("left"), F.concat(acc["out"], F.array(row)).alias("out"))

    def rest(acc: Column) -> Column:
        more = F.transform(acc["left"], lambda a, i: F.struct(F.concat(F.lit("substat-extra"), (i + 1).cast("string")).alias("field"), F.lit(None).cast("string").alias("expected"), show(a).alias("actual"), F.lit(False).alias("match")))
        return F.concat(acc["out"], more)

    return F.aggregate(F.coalesce(expected.cast(entry), none), start, step, rest)


def with_evidence(scores: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """scores with raw, confidence and provenance of each field (AC3).

    evidence has key, field, raw, confidence, provenance, one row a field, the first recorded; a
    field without any is not-recorded. substatN takes the confidence of the N-th entry read,
    wherever it was matched; what is left over has none.
    """
    found = scores.join(evidence, [key, "field"], "left")
    confidence = F.when(~F.col("field").startswith("substat-extra"), F.col("confidence"))
    return found.withColumn("confidence", confidence).withColumn("provenance", F.coalesce("provenance", F.lit("not-recorded")))


def retry_totals(df: DataFrame, key: str, retries: str, recovered: str) -> DataFrame:
    """One row: keys with retries, retries and recovered in all (AC7)."""
    return df.agg(F.count_if(F.col(retries) > 0).alias("retried"), F.coalesce(F.sum(retries), F.lit(0)).alias("retries"), F.coalesce(F.sum(recovered), F.lit(0)).alias("recovered"))


def accuracy_report(entries: DataFrame, key: str, note: str, retries: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of an accuracy report (SNK5): head (one JSON row with totals and calibration), failed and fields (rows).

    entries are scored fields with evidence; retries has key, retries, recovered. Failed and
    scored fields stay tables, as they grow with the data; only sums go into the head.
    """
    c = calibration(entries, "confidence", "match")
    buckets = c.agg(F.array_sort(F.collect_list(F.struct("bucket", "lower", "upper", "count", "matched", "rate"))).alias("calibration"))
    total = entries.agg(F.count("*").alias("total_fields"), F.count_if(~F.col("match")).alias("failed_fields"))
    again = retry_totals(retries, key, "retries", "recovered") if retries is not None else entries.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(n) for n in ("retried", "retries", "recovered")))
    head = total.join(buckets).join(again)
    head = head.select(F.to_json(F.struct(F.lit(note).alias("note"), "total_fields", "failed_fields", F.transform("calibration", lambda b: b.dropFields("bucket")).alias("calibration"), "retried", "retries", "recovered")).alias("json"))
    return {"head": head, "failed": entries.where(~F.col("match")), "fields": entries}


def exact_matches(scores: DataFrame, key: str) -> DataFrame:
    """(key, exact): all of a key's fields match (AGG12)."""
    return scores.groupBy(key).agg(F.bool_and("match").alias("exact"))


def top_confusions(df: DataFrame, expected: str, actual: str, k: int = 5) -> DataFrame:
    """The k most frequent mismatches with both sides present; ties in binary order (AC6, TOP1)."""
    wrong = df.where(F.col(expected).isNotNull() & F.col(actual).isNotNull() & (F.col(expected) != F.col(actual)))
    return wrong.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "actual").limit(k)


def drift(scores: DataFrame, verified: str, hit: str) -> DataFrame:
    """Mismatches split by whether the truth is verified: failures and reports (AC8)."""
    return scores.groupBy(F.when(F.col(verified), "failure").otherwise("report").alias("kind")).agg(F.count_if(~F.col(hit)).alias("mismatches"), F.count("*").alias("fields"))
