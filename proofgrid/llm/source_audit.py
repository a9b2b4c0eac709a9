"""Source divergence audit by wide term vectors.

The texts of each language are cut into terms; terms in enough documents are kept. Each
kept term becomes one wide row: an array of its counts in all sources of the language, in
a fixed order. Higher-order functions turn the array into smoothed shares p and emit, for
each two sources, the term's contribution to their divergence; contributions are summed
map-side, so what is shuffled grows with tasks and pairs of sources only. All steps run
inside the JVM, and all arithmetic is on integers:

    p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)),  f(p, q) = floor((p - q)^2 / (p + q))

with N the source's count over kept terms and V the kept terms of the language. A source's
divergence from another one is the sum of f over all kept terms; the terms that mark a
source most are those whose share in it is above the whole language's, by f.

Defined results: null text, language and source count as the empty string. Each row is a
document, repeated ids and repeated rows included. A source without terms has count 0 for
all kept terms; a language without kept terms has divergence 0 everywhere and no marking
terms. Texts of any length are read whole. Equal values are ranked by the item's UTF-8
bytes. No row gives no row; columns of docs other than the three named are not read. The
result has one row for each ordered pair of a language's sources, so wide rows, whose size
is the number of its sources, are never larger than a source's own part of the result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_frequent, stage

#: What stands between terms, maximal runs of ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, in one pass over the texts."""
    ascii_ = F.octet_length("text") == F.char_length("text")  # there, lower() changes A-Z only and is faster
    plain = F.when(ascii_, F.lower("text")).otherwise(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    rows = docs.select("lang", "source", F.sort_array(F.split(plain, BETWEEN)).alias("w"))
    # in sorted order a term's first place in its document is where it differs from the one before
    firsts = F.transform("w", lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & (F.get("w", i - 1) == t), 0).otherwise(1).alias("first")))
    each = rows.select("lang", "source", F.inline(firsts)).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def share(count: Column, mass: Column, kept: Column) -> Column:
    """p of a count among mass occurrences of kept terms, exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * (count + 2), (mass + 2 * kept).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """f, exactly: both are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def wide_vectors(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The kept terms and their language's shape.

    (lang, term, total, counts map by source), and one row for each language: its sources in
    order, with their masses, the number V of kept terms and their occurrences N.
    """
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = stage(by_term.where(F.col("docs") >= least).drop("docs"), "kept terms")
    mass = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("mass"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
    sources = docs.select("lang", "source").distinct().join(mass, ["lang", "source"], "left").select("lang", "source", F.coalesce("mass", F.lit(0)).alias("mass"))
    shape = sources.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "mass"))).alias("sources"))
    shape = shape.join(size, "lang", "left").select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))
    return kept, stage(shape, "languages")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair``, all other sources, and ``term``, the top marking terms."""
    plain = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    kept, shape = wide_vectors(plain, least)
    # a language may hold most terms: its row goes to as many tasks as its terms need
    wide = join_frequent(kept, shape, "lang", "term", shape.select("lang", F.col("v").alias("n")).where("n > 0"))
    found = F.transform("sources", lambda s: F.coalesce(F.try_element_at("counts", s["source"]), F.lit(0)))
    wide = wide.select("lang", "term", "sources", "v", "n", "total", found.alias("c"))
    wide = wide.select("lang", "term", "sources", "c", F.zip_with("c", "sources", lambda c, s: share(c, s["mass"], F.col("v"))).alias("p"), share(F.col("total"), F.col("n"), F.col("v")).alias("q"))

    return _pairs(wide, shape).unionByName(_terms(wide, top))


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top) if top else out


def _pairs(wide: DataFrame, shape: DataFrame) -> DataFrame:
    each = wide.select("lang", "p", F.posexplode("p").alias("i", "a"))
    later = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda b, k: F.struct((F.col("i") + 1 + k).alias("j"), distance(F.col("a"), b).alias("f")))
    parts = each.select("lang", "i", F.explode(later).alias("x"))
    sums = parts.groupBy("lang", "i", F.col("x.j").alias("j")).agg(F.sum("x.f").alias("value"))
    ends = shape.select("lang", F.posexplode("sources.source").alias("a", "source"), F.col("sources.source").alias("others"))
    ends = ends.select("lang", "source", "a", F.posexplode("others").alias("b", "item")).where("a <> b").select("lang", "source", "item", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    rows = ends.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return _ranked(rows)


def _terms(wide: DataFrame, top: int) -> DataFrame:
    each = F.zip_with("p", F.zip_with("c", "sources", lambda c, s: F.struct(c.alias("c"), s["source"].alias("source"))), lambda p, s: F.struct(s["source"].alias("source"), s["c"].alias("c"), p.alias("p")))
    above = F.filter(each, lambda x: (x["c"] > 0) & (x["p"] > F.col("q")))
    rows = wide.select("lang", "term", "q", F.explode(above).alias("x"))
    rows = rows.select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("x.p"), F.col("q")).alias("value"))
    return _ranked(rows, top)
