"""Column expressions for legal values and closed-form rules; the rule tables are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, plain_number

EXACT, CORRECTED, AMBIGUOUS, ILLEGAL = "Exact", "Corrected", "Ambiguous", "NotARoll"


def f32(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def table_of(key: Column, legal: Mapping[str, Sequence[float]]) -> Column:
    """The legal values of a key as array<float>, or null if it has no table (LV1, LV7)."""
    out = F.lit(None).cast("array<float>")
    for name, values in legal.items():
        out = F.when(key == name, F.array(*(f32(v) for v in sorted(values)))).otherwise(out)
    return out


def exact_value(value: Column, table: Column, tolerance: float = 0.001) -> Column:
    """The first legal value within tolerance, or null (LV2)."""
    return F.get(F.filter(table, lambda x: f32(F.abs(f32(x - f32(value)))) < f32(tolerance)), F.lit(0))


def closest_value(value: Column, table: Column, tolerance: Column) -> Column:
    """The nearest legal value within tolerance; ties go to the smaller (LV3)."""
    near = F.array_min(F.transform(table, lambda x: F.struct(F.abs(x - f32(value)).alias("d"), x.alias("v"))))
    return F.when(near["d"] <= tolerance, near["v"])


def confusion_candidates(value: Column, table: Column, pairs: Sequence[tuple[str, str]], percent: Column, shift: bool = True) -> Column:
    """Legal values that one misread character, or for percents a shifted point, explains (LV5).

    pairs are read both ways; result ascending without repeats. Without shift a point is never
    taken as shifted, as the confusion document says (SRC8).
    """
    both = sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})
    text = plain_number(value)

    def swapped(t: Column, a: str, b: str) -> Column:
        swap = lambda i: F.when(F.substr(t, i, F.lit(1)) == a, F.concat(F.substr(t, F.lit(1), i - 1), F.lit(b), F.substr(t, i + 1, F.length(t))))
        return F.transform(F.sequence(F.lit(1), F.length(t)), swap)

    texts = let(text, lambda t: F.concat(*(swapped(t, a, b) for a, b in both))) if both else F.array().cast("array<string>")
    numbers = F.transform(texts, lambda t: t.try_cast("float"))
    shifted = F.when(percent & F.lit(shift), F.array(f32(f32(value) * f32(10)), f32(f32(value) / f32(10)))).otherwise(F.array().cast("array<float>"))
    legal = F.transform(F.concat(numbers, shifted), lambda v: exact_value(v, table))
    return F.array_sort(F.array_distinct(F.array_compact(legal)))


def resolve_value(key: Column, value: Column, legal: Mapping[str, Sequence[float]], pairs: Sequence[tuple[str, str]], percent: Column, shift: bool = True) -> Column:
    """struct(state, value, candidates): exact, uniquely correctable, ambiguous or illegal (LV4)."""
    table = table_of(key, legal)
    exact = exact_value(value, table)
    candidates = F.coalesce(confusion_candidates(value, table, pairs, percent, shift), F.array().cast("array<float>"))
    n = F.size(candidates)
    state = F.when(table.isNull() | value.isNull(), ILLEGAL).when(exact.isNotNull(), EXACT).when(n == 1, CORRECTED).when(n > 1, AMBIGUOUS).otherwise(ILLEGAL)
    resolved = F.when(exact.isNotNull(), exact).when(n == 1, F.get(candidates, F.lit(0)))
    return F.struct(state.alias("state"), resolved.alias("value"), F.when(exact.isNull() & table.isNotNull(), candidates).otherwise(F.array().cast("array<float>")).alias("candidates"))


def graded_confidence(state: Column, exact: float = 0.92, corrected: float = 0.85, other: float = 0.5) -> Column:
    """The confidence that a resolution's state stands for (LV6, QG2)."""
    return F.when(state == EXACT, f32(exact)).when(state == CORRECTED, f32(corrected)).otherwise(f32(other))


def review_grade(value: Column, table: Column, snap: Column) -> Column:
    """How a review shows a value: valid, snap or non-standard (LV8)."""
    return F.when(exact_value(value, table).isNotNull(), "valid").when(snap.isNotNull(), "snap").otherwise("non-standard")


def expected_count(level: Column, every: int = 5, most: int = 5) -> Column:
    """Entries that a level unlocks (SL10)."""
    return F.least(F.expr(f"cast(1 as int)") * F.floor(level / every), F.lit(most)).cast("int")


def max_level(rarity: Column) -> Column:
    """The top level of a rarity (CS2)."""
    return F.when(rarity.between(1, 4), rarity * 5).otherwise(25).cast("int")


def main_allowed(cost: Column, key: Column, legal: Mapping[int, Sequence[str]]) -> Column:
    """Whether a cost may have the key as its main value (CS1); legal lists the keys of each cost."""
    fits = F.lit(False)
    for c, keys in legal.items():
        fits = fits | ((cost == c) & key.isin(list(keys)))
    return F.coalesce(fits, F.lit(False))


def scaled_value(start: Column, end: Column, level: Column, most: Column, flat: Column) -> Column:
    """A value that grows linearly with level, cut down to a tenth, or to a whole number if flat (CS3)."""
    at = F.greatest(F.lit(0), F.least(level, most))
    raw = start.cast("double") + (end.cast("double") - start.cast("double")) * at / most
    return F.when(flat, F.floor(raw + 1e-9).cast("double")).otherwise(F.floor(raw * 10 + 1e-9) / 10)


def consistent_level(value: Column, start: Column, end: Column, most: Column, flat: Column, tolerance: float = 0.051, levels: int = 25) -> Column:
    """The only level from 0 to ``levels`` that gives the value within tolerance, or null (CS6)."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda lv: f32(F.abs(f32(f32(scaled_value(start, end, lv, most, flat)) - f32(value)))) <= f32(tolerance))
    return F.when(F.size(fits) == 1, F.get(fits, F.lit(0)))


def all_flags(**flags: Column) -> Column:
    """The names of the conditions that hold, in the order given (QG3)."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items())))
