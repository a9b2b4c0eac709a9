"""Column expressions over vectors: standardising, template distance, template building, wire form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def standardize(v: Column, most: float = 2.0) -> Column:
    """Zero mean, unit population deviation (1 where it is 0), clipped to +-most (VS1)."""
    spread = lambda v, m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v))
    clip = lambda z: F.greatest(F.lit(-most), F.least(F.lit(most), z))
    scaled = lambda v, m, sd: F.transform(v, lambda x: clip((x - m) / F.when(sd == 0, 1.0).otherwise(sd)))
    return let(v.cast("array<double>"), lambda v: let(mean(v), lambda m: let(spread(v, m), lambda sd: scaled(v, m, sd))))


def luma_signature(pixels: Column, opaque: int = 40) -> Column:
    """The standardised luma of struct(r, g, b, a) pixels; those under the opacity count as black (VS1)."""
    luma = lambda p: F.when(p["a"] < opaque, F.lit(0.0)).otherwise((p["r"] * 0.2126 + p["g"] * 0.7152 + p["b"] * 0.0722) / 255.0)
    return standardize(F.transform(pixels, luma))


def mean_colour(pixels: Column, opaque: int = 40) -> Column:
    """struct(r, g, b): the mean of the opaque pixels, null without any (VS9)."""
    seen = F.filter(pixels, lambda p: p["a"] >= opaque)
    part = lambda c: F.try_divide(F.aggregate(seen, F.lit(0.0), lambda s, p: s + p[c]), F.size(seen))
    return F.when(F.size(seen) > 0, F.struct(part("r").alias("r"), part("g").alias("g"), part("b").alias("b")))


def mean_of_slice(samples: Column, first: int = 60, last: int = 74) -> Column:
    """The element-wise mean of the samples from first to last (from 0), those of one scale (AGG8); null without any."""
    part = F.slice(samples, first + 1, last - first + 1)
    total = F.aggregate(part, F.transform(F.get(part, F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(part))


def l1_score(a: Column, b: Column) -> Column:
    """1 - L1 / (4 n): 1 for equal vectors (VS3)."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / (4 * F.size(a))


def to_wire(v: Column, scale: int = 32, most: float = 2.0) -> Column:
    """Vectors as small integers, rounded half to even (SNK7)."""
    return F.transform(v, lambda x: F.bround(F.greatest(F.lit(-most), F.least(F.lit(most), x)) * scale).cast("int"))


def from_wire(v: Column, scale: int = 32) -> Column:
    return F.transform(v, lambda x: x / F.lit(float(scale)))


def mean_vectors(df: DataFrame, key: str, vector: str, least: int = 3) -> DataFrame:
    """(key, n, vector): the element-wise mean of each key with at least ``least`` rows (AGG7, VS7).

    Elements are summed map-side by key and place, so a key of any share is no hot group.
    """
    cells = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    packed = means.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("cells"))
    return packed.select(key, "n", F.transform("cells", lambda c: c["m"]).alias("vector"))
