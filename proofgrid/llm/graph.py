"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, stage


def _forest(batches: Iterator[pa.RecordBatch]):
    """A partition's edges as stars (vertex, smallest vertex that the partition joins it to)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = np.array([(v, r) for v in parent if (r := root(v)) != v], dtype=np.int64).reshape(-1, 2)
    for lo in range(0, len(pairs), 100_000):
        yield {"v": pa.array(pairs[lo : lo + 100_000, 0]), "u": pa.array(pairs[lo : lo + 100_000, 1])}


#: Edges, thinned, that one task may finish by itself.
LOCAL_EDGES = 500_000


def connected_components(edges: DataFrame, a: str, b: str, local: int = LOCAL_EDGES) -> DataFrame:
    """(v, component) for every vertex that some edge joins to a smaller one; component is the smallest vertex reached.

    Alternates large-star and small-star steps (each vertex's neighbours are joined to the
    smallest among them) on edges first thinned to a forest within each partition, until a
    step changes nothing. Each step is a combinable minimum and one join, so a hub with a
    third of all edges is summed map-side. Tables are written between steps. When the thinned
    edges number at most ``local``, a single task (of bounded size, therefore) unites them.
    """
    e = edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).where("v is not null and u is not null and v <> u")
    thin = lambda df: map_arrow(df, _forest, "v long, u long")
    stars = stage(thin(e), "stars")
    if stars.count() <= local:
        whole = stage(thin(stars.coalesce(1)), "components")
        discard(stars)
        return whole.select("v", F.col("u").alias("component"))
    while True:
        # large star: every larger neighbour of v goes to the smallest of v and its neighbours
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: every smaller neighbour and v itself go to the smallest neighbour
        down = large.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).where("v <> u")
        least = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = stage(thin(small.unionByName(least.select("v", F.col("m").alias("u")))).distinct(), "stars")
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.countDistinct("v")).first() for d in (stars.distinct(), new)]
        discard(stars)
        stars = new
        if sums[0][:2] == sums[1][:2] and sums[1][2] == sums[1][0]:
            return stars.select("v", F.col("u").alias("component"))
