"""Mixing sources to target weights by pivotal dependent rounding.

Targets: each source's share of the mix by weight, stopped at a multiple of its own size,
the excess reshared by weight until no source is above. Every document of a source starts
with the same number of copies, target / size; the whole part is taken, the fraction is a
probability. Two fractional documents meet: word mass moves from one to the other, in a
random direction with odds that keep both expectations, until one becomes integral. The
sum of words never changes, so a source's taken words miss their target by at most half a
document, the last one left fractional, which is rounded to the nearer side (by its
probability it would miss by up to a whole document instead of half of one).

Leaves are hashed groups of a source's documents of bounded expected size, met in order of
falling size, so that the last one left is small; what each leaves over meets again in a
reduction tree of fixed fan-in. Groups, order and randomness depend only on ids and the
seed, so reruns agree under any partitioning.

Defined results: null texts and texts without words have size 0 and take 0; a null source
is a source of its own, sorted last; repeated rows and ids are documents of their own; an
empty table gives an empty result; texts are read whole; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, stage

#: Expected documents of a leaf, and leftovers that meet at once in the tree.
LEAF, FAN = 512, 64
#: Fractions this near to a whole number are whole.
EPS = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """sizes (source, source_size, n) with ``target``; one aggregate over sources a round."""
    # a source's place is its place within its range of sources and the number of those in ranges before
    order = F.col("source").asc_nulls_last()
    ranged = stage(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    first, before = [], 0
    for r in sorted(ranged.groupBy("part").count().collect()):
        first += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    place = place + F.create_map(*first)[F.col("part")] if first else place
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int"))
    rows = stage(ranged.select("source", "source_size", "n", w.alias("w")), "mix-sources")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # level is the words a unit of weight; it only rises, as sources stop
        stopped = ceiling * F.col("source_size") <= level * F.col("w")
        r = rows.agg(F.sum(F.when(stopped, ceiling * F.col("source_size")).otherwise(0.0)).alias("full"), F.sum(F.when(~stopped, F.col("w"))).alias("open")).first()
        if not r["open"] or (new := (total - r["full"]) / r["open"]) <= level * (1 + 1e-12):
            break
        level = new
    return rows.withColumn("target", F.least(ceiling * F.col("source_size").cast("double"), level * F.col("w")))


def settle(ids: np.ndarray, size: np.ndarray, p: np.ndarray, seed: int) -> int:
    """Round p in place by meetings in the order given; the index left fractional, or -1.

    Mass moves in words: size * p is kept. Draws are hashed from the two ids, so equal
    inputs meet alike.
    """
    held = -1
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        sa, sb = float(size[a]), float(size[b])
        up = min((1 - p[a]) * sa, p[b] * sb)  # words that may move from b to a
        down = min(p[a] * sa, (1 - p[b]) * sb)
        draw = xxhash.xxh3_64_intdigest(f"{ids[a]}|{ids[b]}|{i}", seed) / 2.0**64
        move = up if draw * (up + down) < down else -down
        p[a] += move / sa
        p[b] -= move / sb
        held = -1
        for k in (a, b):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = round(p[k])
            else:
                held = k
    return held


def _round_groups(groups: DataFrame, seed: int, last: bool) -> DataFrame:
    """Settle each (source key, grp); the p of the one left over stays fractional unless last."""

    def run(key, table):
        table = table.sort_by([("size", "descending"), ("id", "ascending"), *((c, "ascending") for c in table.column_names if c.startswith("__"))])
        ids, size = table["id"].to_pylist(), table["size"].to_numpy()
        p = table["p"].to_numpy().copy()
        held = settle(ids, size, p, seed)
        if last and held >= 0:
            p[held] = float(p[held] >= 0.5)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return groups.groupBy("skey", "grp").applyInArrow(run, groups.schema)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """id_col, size, source_size, target, taken, then copies and source, for every row of docs.

    row_col, a column that tells rows of one id apart, comes last if it is given.
    """
    carried = [F.col(f"`{row_col}`").alias("__row")] * (row_col is not None)
    names = ["__row"] * len(carried)
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    base = stage(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), words.alias("size"), *carried), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = stage(targets(sizes, weights, share, ceiling), "mix-targets")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF)).alias("leaves"), F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).alias("skey"))
    joined = base.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = joined.withColumn("whole", F.floor(rate + EPS).cast("long")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("leaves")))
    rows = stage(rows.select("skey", "grp", "leaves", "id", "source", "size", "source_size", "target", "whole", "p", *names), "mix-rates")

    fractional = F.col("p") > EPS
    left, finished = rows.where(fractional), [stage(rows.where(~fractional).withColumn("p", F.lit(0.0)), "mix-whole")]
    leaves, final = int(plan.agg(F.max("leaves")).first()[0] or 1), False
    while not final:
        # the last round has every source in one group; before, FAN groups' leftovers meet in one
        final = leaves == 1
        met = stage(_round_groups(left, seed + leaves, final), "mix-round")
        finished.append(met.where("p = 0 or p = 1"))
        left = met.where("p > 0 and p < 1").withColumn("grp", F.floor(F.col("grp") / FAN))
        leaves = -(-leaves // FAN)
    discard(rows, base)
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part)
    copies = (F.col("whole") + F.col("p")).cast("long")
    taken = (copies * F.col("size")).alias("taken")
    return whole.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, copies.alias("copies"), "source", *(F.col(n).alias(row_col) for n in names))


def repeat(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, **options) -> DataFrame:
    """docs, each row as often as the mix takes it.

    Rows are told apart by a hash of all their columns, so ids may repeat; rows that are alike
    in all columns share their copies.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__print", F.xxhash64(*columns))
    mixed = mix(rows, weights, share, ceiling, row_col="__print", **options)
    taken = stage(mixed.groupBy("__print").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__alike")).where("__copies > 0"), "mix-taken")
    again = lambda df: df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)
    alike = taken.where("__alike > 1")
    if alike.isEmpty():
        return again(rows.join(taken, "__print"))
    single = rows.join(alike.select("__print"), "__print", "left_semi").dropDuplicates(["__print"])
    return again(rows.join(taken.where("__alike = 1"), "__print")).unionByName(again(single.join(alike, "__print")))
