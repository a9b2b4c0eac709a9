"""Column expressions that read noisy text: normalising, similarity, label/value lines, small grammars.

All are built-in functions, so they stay in whole-stage code generation. Rule tables
(aliases, header patterns) are parameters. Parsing never raises: what cannot be read is null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# The grammars that reads are held against.
LEADING_JUNK = r"^[\(\[\{<\|+*~✦\-•\s]+"
TRAILING_JUNK = r"[^0-9a-zA-Z%\.\s]+$"
BROKEN_PERCENT = r"(\d+)\s*(?:0/0|/0|o/o|O/O)"
STAT_LINE = r"^(.+?)\s+([\d,]+\.?\d*)\s*(%?)$"
VALUE_LINE = r"^[-+]?\s*(\d+(?:[.,]\d+)?)\s*(%)?$"
OWNER_LINE = r"(?i)Equipped\s+by\s+(.+)"
CAPTURE_NAME = r"_p(\d+)_r(\d+)_c(\d+)_idx(\d+)\.png$"
PERCENT_TOP = 50.0


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") == "", F.lit(True))


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_identity(c: Column) -> Column:
    """Lower-case, then only a-z and 0-9 (ER1)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def boundary_aligned(a: Column, b: Column) -> Column:
    """One is a prefix or a suffix of the other (ER4)."""
    return a.startswith(b) | a.endswith(b) | b.startswith(a) | b.endswith(a)


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two normalised texts as a float (ER2).

    Empty: 0; equal: 1; one contains the other and the shorter has five characters or more:
    0.9 at a boundary, else 0.9 * short / long; otherwise 1 - distance / longer. Every step is
    single precision, since thresholds are compared in it.
    """
    f = lambda c: c.cast("float")
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (short >= 5) & (a.contains(b) | b.contains(a))
    ratio = f(f(short) / f(long_))
    far = f(f(F.levenshtein(a, b)) / f(long_))
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), f(F.lit(0)))
        .when(a == b, f(F.lit(1)))
        .when(inside & boundary_aligned(a, b), f(F.lit(0.9)))
        .when(inside, f(f(F.lit(0.9)) * ratio))
        .otherwise(f(f(F.lit(1)) - far))
    )


def repair_artifacts(c: Column) -> Column:
    """Blank to empty; leading bullets and brackets and trailing symbols go; a percent sign read as 0/0 comes back (TX1)."""
    s = F.regexp_replace(c, LEADING_JUNK, "")
    s = F.regexp_replace(s, TRAILING_JUNK, "")
    s = F.regexp_replace(s, BROKEN_PERCENT, "$1%")
    return F.when(blank(c), F.lit("")).otherwise(F.trim(s))


def match_label(c: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """The key of the first alias (key, pattern), in order, whose pattern is found in the repaired label, ignoring case (TX2)."""
    if not aliases:
        return F.lit(None).cast("string")
    return let(repair_artifacts(c), lambda label: F.coalesce(*(F.when(label.rlike(f"(?i){pattern}"), F.lit(key)) for key, pattern in aliases)))


def recover_percent(v: Column, most: float = PERCENT_TOP) -> Column:
    """Percent values that lost their decimal point: divided by ten, in single precision, until they are not above most."""

    def scaled(x: Column) -> Column:
        steps = F.coalesce(F.ceil(F.least(F.log10(x.cast("double") / most), F.lit(40.0))), F.lit(0)) + 1
        ladder = F.sequence(F.lit(1), F.greatest(steps, F.lit(1)).cast("int"))
        return F.when(x > most, F.aggregate(ladder, x, lambda a, _: F.when(a > most, (a / F.lit(10)).cast("float")).otherwise(a))).otherwise(x)

    return let(v, scaled)


def parse_line(c: Column, aliases: Sequence[tuple[str, str]], percent_of: dict[str, str], percent_keys: Sequence[str]) -> Column:
    """A label/value line as struct(key, value float, raw_label, raw_value), or null (TX3).

    aliases as in match_label; up to two trailing tokens of the label are dropped until one
    matches. percent_of maps a flat key to its percent twin, taken when the value has a
    percent sign; values with a percent sign above 50 are scaled down by tens. raw_label is the
    label that matched. Keys that are percents by themselves (percent_keys) need nothing else.
    """
    pattern = STAT_LINE
    drop = lambda t: F.regexp_replace(t, r"\s+\S+$", "")

    def keyed(line: Column) -> Column:
        whole = F.trim(F.regexp_extract(line, pattern, 1))
        tried = F.transform(F.array_distinct(F.array(whole, drop(whole), drop(drop(whole)))), lambda t: F.struct(match_label(t, aliases).alias("key"), t.alias("label")))
        hit = F.get(F.filter(tried, lambda t: t["key"].isNotNull()), F.lit(0))
        label, key = hit["label"], hit["key"]
        value = F.regexp_replace(F.regexp_extract(line, pattern, 2), ",", "").try_cast("float")
        return F.struct(label.alias("label"), key.alias("key"), value.alias("value"), F.regexp_extract(line, pattern, 2).alias("raw"), F.regexp_extract(line, pattern, 3).alias("sign"), line.rlike(pattern).alias("ok"))

    def finished(p: Column) -> Column:
        twin = F.coalesce(*(F.when(p["key"] == a, F.lit(b)) for a, b in percent_of.items()), p["key"])
        return let(F.when(p["sign"] == "%", twin).otherwise(p["key"]), lambda key: valued(p, key))

    def valued(p: Column, key: Column) -> Column:
        scaled = let(p["value"], lambda v: recover_percent(v))
        value = F.when(p["sign"] == "%", scaled).otherwise(p["value"])
        ok = p["ok"] & key.isNotNull() & p["value"].isNotNull()
        return F.when(ok, F.struct(key.alias("key"), value.cast("float").alias("value"), p["label"].alias("raw_label"), F.concat(p["raw"], p["sign"]).alias("raw_value")))

    return let(repair_artifacts(c), lambda line: let(keyed(line), finished))


def parse_columns(labels: Column, values: Column, aliases: Sequence[tuple[str, str]], skip: str = "echo skill") -> Column:
    """Labels and values of two columns of lines paired by place; header labels are skipped first (TX4)."""
    kept = F.filter(labels, lambda x: ~F.lower(x).contains(skip) & ~blank(x))
    pairs = F.arrays_zip(kept.alias("label"), F.filter(values, lambda x: ~blank(x)).alias("value"))
    read = F.transform(pairs, lambda p: F.struct(match_label(p["label"], aliases).alias("key"), F.regexp_replace(F.regexp_extract(p["value"], r"([\d,]+\.?\d*)", 1), ",", "").try_cast("float").alias("value")))
    return F.filter(read, lambda r: r["key"].isNotNull() & r["value"].isNotNull())


def parse_level(c: Column, most: int = 25) -> Column:
    """A level alone on its line, with or without Lv, Level or +, from 0 to most (TX6)."""
    s = F.regexp_replace(F.trim(c), r"(?i)^(?:Lv\.?|Level)\s*", "")
    v = nullif_empty(F.regexp_extract(s, r"^\+?\s*(\d{1,2})$", 1)).try_cast("int")
    return F.when(v.between(0, most), v)


def parse_cost(c: Column, legal: str = "134") -> Column:
    """A digit of legal behind the word cost, anywhere (TX7)."""
    return nullif_empty(F.regexp_extract(c, rf"(?i)Cost\s*([{legal}])", 1)).try_cast("int")


def clean_text(c: Column) -> Column:
    """Everything but word characters, white space, %, . and - becomes a blank (TX8)."""
    return F.trim(F.regexp_replace(c, r"(?U)[^\w\s%\.\-]", " "))


def value_line(c: Column) -> Column:
    """A line that holds only a value: struct(value float, percent boolean), or null (TX9)."""
    pattern = VALUE_LINE
    line = F.trim(c)
    value = F.replace(F.regexp_extract(line, pattern, 1), F.lit(","), F.lit(".")).try_cast("float")
    return F.when(line.rlike(pattern), F.struct(value.alias("value"), (F.regexp_extract(line, pattern, 2) == "%").alias("percent")))


def sanitize_key(c: Column) -> Column:
    """Only letters and digits, of any script (TX10)."""
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "")


def camel_key(c: Column) -> Column:
    """The first letter lower-cased (TX11)."""
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def capture_name(page: Column, row: Column, col: Column, index: Column, prefix: str = "echo") -> Column:
    """The file name of a capture; page, row and column count from 0 (TX12)."""
    return F.format_string(f"{prefix}_p%02d_r%02d_c%02d_idx%03d.png", page + 1, row + 1, col + 1, index)


def parse_capture_name(c: Column) -> Column:
    """page, row, col, index (as written) of a capture's file name or path, or null."""
    pattern = CAPTURE_NAME
    part = lambda k: F.regexp_extract(c, pattern, k).try_cast("int")
    return F.when(c.rlike(pattern), F.struct(part(1).alias("page"), part(2).alias("row"), part(3).alias("col"), part(4).alias("index")))


def lines_of(c: Column) -> Column:
    """The non-blank lines, trimmed (TX13)."""
    # F.trim itself would be given a line's place as the characters to trim
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def header_index(lines: Column, *words: str) -> Column:
    """The place (from 1) of the first line with all words, or 0 (TX20)."""
    hit = F.transform(lines, lambda x: F.forall(F.array(*(F.lit(w) for w in words)), lambda w: x.contains(w)))
    return F.array_position(hit, True)


def line_windows(lines: Column) -> Column:
    """Each two neighbouring lines joined by a blank (WIN5)."""
    return F.when(F.size(lines) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(lines, i - 1), F.get(lines, i)))).otherwise(F.array().cast("array<string>"))


def is_header(c: Column, patterns: Sequence[str]) -> Column:
    """The lower-cased line contains one of the patterns (FLT10)."""
    return F.coalesce(F.exists(F.array(*(F.lit(p) for p in patterns)), lambda p: F.lower(c).contains(p)), F.lit(False))


def extract_owner(c: Column) -> Column:
    """What follows the words equipped by (ER14)."""
    return nullif_empty(F.trim(F.regexp_extract(c, OWNER_LINE, 1)))


def strip_variant(c: Column, word: str = "phantom") -> Column:
    """struct(variant boolean, name): a leading variant word taken off (ER8)."""
    pattern = rf"(?i)^\s*{word}\b[:\s]*"
    return F.struct(c.rlike(pattern).alias("variant"), F.regexp_replace(c, pattern, "").alias("name"))


def to_number(c: Column, kind: str, default: float | int | None = None) -> Column:
    """Any text or number as kind, or default where it isn't one (TX16, TX17)."""
    return F.coalesce(c.cast("string").try_cast(kind), F.lit(default).cast(kind))


def plain_number(c: Column, places: int = 5) -> Column:
    """A number with up to places decimals and no trailing zeros (TX18)."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "#" * places))


def two_places(c: Column) -> Column:
    """A number with at least one decimal and two at most (TX18)."""
    return F.call_function("format_number", c.cast("double"), F.lit("0.0#"))


def fixed_places(c: Column, places: int = 2) -> Column:
    """A number with exactly so many decimals (TX18)."""
    return F.format_string(f"%.{places}f", c.cast("double"))


def as_percent(c: Column, places: int = 1) -> Column:
    """A share as a percentage (TX18)."""
    return F.concat(fixed_places(c.cast("double") * 100, places), F.lit("%"))


def padded_number(c: Column, digits: int = 2) -> Column:
    """A whole number with leading zeros (TX18)."""
    return F.format_string(f"%0{digits}d", c.cast("long"))


def to_display(c: Column, names: Mapping[str, str]) -> Column:
    """The display name of a key, or the key itself (TX19)."""
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in names.items()), c)


def from_display(c: Column, names: Mapping[str, str]) -> Column:
    """The key of a display name or of a key, ignoring case, the first that fits; else null (TX19, J13)."""
    fits = [F.when((F.lower(c) == v.lower()) | (F.lower(c) == k.lower()), F.lit(k)) for k, v in names.items()]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def same_text(a: Column, b: Column, ignore_case: bool = False) -> Column:
    """Null-safe equality in which empty and null are one (AC1)."""
    a, b = (nullif_empty(x) for x in (a, b))
    return F.lower(a).eqNullSafe(F.lower(b)) if ignore_case else a.eqNullSafe(b)
