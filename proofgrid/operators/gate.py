"""Quality gates, confidence composition, provenance, and choosing between engines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needs_review(errors: Column, required: list[Column], flags: Column, count: Column, expected: Column, confidences: list[Column], line_confidences: Column, least: float = 0.80) -> Column:
    """Errors, a missing required value, any flag, a wrong count, or a present confidence below least (QG1, FLT8)."""
    low = lambda c: F.coalesce(c.cast("float") < F.lit(least).cast("float"), F.lit(False))
    out = (F.coalesce(F.size(errors), F.lit(0)) > 0) | (F.coalesce(F.size(flags), F.lit(0)) > 0) | ~count.eqNullSafe(expected)
    for r in required:
        out = out | r.isNull()
    for c in confidences:
        out = out | low(c)
    return out | F.coalesce(F.exists(line_confidences, low), F.lit(False))


def line_confidence(line: Column, state: Column, cap: Column | float = 1.0) -> Column:
    """The least of the line's own confidence (0.5 if unknown), its value's, and a cap (QG2)."""
    value = F.when(state == "Exact", 1.0).when(state == "Corrected", 0.70).otherwise(0.0)
    return F.least(F.coalesce(line.cast("double"), F.lit(0.5)), value, cap if isinstance(cap, Column) else F.lit(cap)).cast("float")


def provenance(engine: Column, mode: Column, preprocess: Column, attempt: Column) -> Column:
    """engine/mode/preprocess/attemptN with ? for what is missing, not-recorded without any (QG4)."""
    part = lambda c: F.coalesce(c, F.lit("?"))
    none = engine.isNull() & mode.isNull() & preprocess.isNull() & attempt.isNull()
    return F.when(none, F.lit("not-recorded")).otherwise(F.concat_ws("/", part(engine), part(mode), part(preprocess), F.concat(F.lit("attempt"), part(attempt.cast("string")))))


def choose_read(primary: Column, secondary: Column, accept: Column, accept_secondary: Column, shortest: int = 2) -> Column:
    """Primary if long enough and accepted; else the one that is accepted, secondary before primary (QG5)."""
    good = F.coalesce((F.length(primary) >= shortest) & accept, F.lit(False))
    good2 = F.coalesce((F.length(secondary) >= shortest) & accept_secondary, F.lit(False))
    return F.when(good, primary).when(good2, secondary).when(F.coalesce(F.length(secondary) >= shortest, F.lit(False)), secondary).otherwise(primary)


def usable_lines(lines: DataFrame, group: list[str], text: str) -> DataFrame:
    """Groups with a non-blank line and a line with a digit (QG6)."""
    ok = F.bool_or(F.trim(text) != "") & F.bool_or(F.col(text).rlike(r"\d"))
    return lines.groupBy(*group).agg(F.coalesce(ok, F.lit(False)).alias("usable"))


def display_status(verified: Column, edited: Column, failed: Column, complete: Column) -> Column:
    """verified, edited, error, complete or partial, the first that holds (FLT7)."""
    t = lambda c: F.coalesce(c, F.lit(False))
    return F.when(t(verified), "verified").when(t(edited), "edited").when(t(failed), "error").when(t(complete), "complete").otherwise("partial")


def run_status(errors: Column, review: Column) -> Column:
    """FAIL, REVIEW or OK (FLT9)."""
    return F.when(F.coalesce(F.size(errors), F.lit(0)) > 0, "FAIL").when(review, "REVIEW").otherwise("OK")


def review_filter(df: DataFrame, text: str | None, columns: list[str], mode: str, modes: Mapping[str, Column]) -> DataFrame:
    """Rows whose columns contain text, ignoring case, and for which the mode's condition holds (FLT5)."""
    out = df if mode == "all" else df.where(modes[mode])
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
        out = out.where(hit)
    return out


def session_summary(df: DataFrame, **parts: Column) -> DataFrame:
    """One row of aggregates over a session (AGG16)."""
    return df.agg(*(c.alias(n) for n, c in parts.items()))
