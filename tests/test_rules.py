"""Legal values, closed-form rules, slots and raster steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.functions import raster, rules
from proofgrid.operators import slots

LEGAL = {"CritRate": [6.3, 6.9, 7.5, 8.1, 8.7, 9.3, 9.9, 10.5], "AtkPercent": [6.4, 7.1, 7.9, 8.6, 9.4, 10.1, 10.9, 11.6]}
PAIRS = [("1", "7"), ("3", "8")]


def resolve(spark, rows):
    df = spark.createDataFrame([(i, k, float(v) if v is not None else None) for i, (k, v) in enumerate(rows)], "i int, k string, v float")
    return [r["r"] for r in df.select("i", rules.resolve_value(F.col("k"), F.col("v"), LEGAL, PAIRS, F.lit(True)).alias("r")).orderBy("i").collect()]


def test_legal_values(spark):
    got = resolve(spark, [("CritRate", 6.3), ("CritRate", 1.5), ("CritRate", 50), ("AtkPercent", 79), ("SpectroDamage", 30), ("CritRate", None)])
    assert [r["state"] for r in got] == ["Exact", "Corrected", "NotARoll", "Corrected", "NotARoll", "NotARoll"]
    assert got[1]["value"] == pytest.approx(7.5) and got[3]["value"] == pytest.approx(7.9) and got[2]["value"] is None


def test_every_legal_value_is_exact_and_no_midpoint_is(spark):
    rows = [(k, v) for k, vs in LEGAL.items() for v in vs]
    assert {r["state"] for r in resolve(spark, rows)} == {"Exact"}
    middle = [(k, (a + b) / 2) for k, vs in LEGAL.items() for a, b in zip(vs, vs[1:])]
    assert "Exact" not in {r["state"] for r in resolve(spark, middle)}


def test_counts_and_scaling(spark):
    df = spark.createDataFrame([(x,) for x in (0, 4, 5, 9, 10, 19, 20, 24, 25, 30)], "l int")
    assert [r["n"] for r in df.select(rules.expected_count(F.col("l")).alias("n")).collect()] == [0, 0, 1, 1, 2, 3, 4, 4, 5, 5]
    v = lambda s, e, lv, flat: spark.range(1).select(rules.scaled_value(F.lit(s), F.lit(e), F.lit(lv), F.lit(25), F.lit(flat)).alias("v")).first()["v"]
    assert [v(4.4, 22.0, 25, False), v(4.4, 22.0, 0, False), v(8.8, 44.0, 25, False), v(456.0, 2280.0, 25, True)] == [22.0, 4.4, 44.0, 2280.0]
    lv = lambda x: spark.range(1).select(rules.consistent_level(F.lit(x), F.lit(4.4), F.lit(22.0), F.lit(25), F.lit(False)).alias("l")).first()["l"]
    assert [lv(22.0), lv(4.4), lv(99.0)] == [25, 0, None]


def test_slots(spark):
    centres = [50.0, 150.0, 250.0, 350.0, 450.0]
    assert slots.reach(centres) == 60.0 and slots.reach([1.0]) == float("inf")
    df = spark.createDataFrame([(1, 1, 255.0), (1, 2, 1000.0), (1, 3, 251.0)], "g int, o int, y double")
    got = {r["o"]: (r["slot"], r["distance"], r["status"]) for r in slots.assign(df, "g", "o", "y", centres).collect()}
    assert got == {1: (2, 5.0, "first"), 2: (None, 550.0, "orphan"), 3: (2, 1.0, "collision")}


def test_components_match_a_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(40):
        ink = rng.random((7, 9)) < 0.5
        want, k = np.zeros(ink.shape, int), 0
        for y, x in np.ndindex(ink.shape):
            if ink[y, x] and not want[y, x]:
                k += 1
                todo = [(y, x)]
                want[y, x] = k
                while todo:
                    i, j = todo.pop()
                    for p, q in ((i, j + 1), (i + 1, j), (i, j - 1), (i - 1, j)):
                        if 0 <= p < 7 and 0 <= q < 9 and ink[p, q] and not want[p, q]:
                            want[p, q] = k
                            todo.append((p, q))
        assert (raster.components(ink) == want).all()


def test_raster_steps():
    a = np.full((12, 20), 255)
    a[1, 2:18] = 0  # a highlight stroke near the top
    a[5, 3:6] = a[8, 3:6] = a[11, 3:6] = 0
    assert (raster.drop_highlight_rows(a)[1] == 255).all()
    assert raster.ink_bands(a) == [(1, 1), (5, 5), (8, 8), (11, 11)]
    assert (raster.trim_footer(a)[11] == 255).all() and raster.quiet_border(a, 2).shape == (16, 24)
    assert raster.word_width(raster.drop_highlight_rows(a)) == 3 and len(raster.sample_windows()) == 75
    assert raster.longest_run(a == 0)[1] == 16


#: Pixels for which the variances at 120 and 122 are the same number but for the last bits of a double.
TIED = [91, 209, 108, 125, 137, 113, 135, 151, 92, 130, 119, 93, 113, 85, 92, 77, 158, 109, 146, 161, 168, 154, 143, 110, 91, 53, 136, 138, 175, 124, 150, 86, 161, 68, 90, 137, 154, 63, 96, 122, 140, 175, 120, 135, 154, 136, 134, 125, 119, 105, 85, 122, 93, 112, 118, 94, 158, 106, 74, 73, 167, 157, 110, 133]


def test_thresholds_of_equal_variance(spark):
    """Variances are compared as they are, or rounded; one value, one pixel and no pixel are cases, too."""
    df = spark.createDataFrame([(0, TIED), (1, [7, 7, 7]), (2, [3, 9]), (3, [5]), (4, []), (5, None)], "i int, px array<int>")
    got = {r["i"]: (r["raw"], r["rounded"]) for r in df.select("i", raster.otsu(F.col("px")).alias("raw"), raster.otsu(F.col("px"), 3).alias("rounded")).collect()}
    assert got == {0: (122, 120), 1: (7, 7), 2: (3, 3), 3: (5, 5), 4: (None, None), 5: (None, None)}


def test_a_threshold_is_computed_once_for_all_pixels(spark):
    """A random threshold is the same for all pixels of a raster."""
    t = F.floor(F.rand(7) * 2).cast("int")
    rows = spark.range(20).select(F.array_repeat(F.lit(1), 64).alias("px")).select(F.size(F.array_distinct(raster.threshold(F.col("px"), t))).alias("n")).collect()
    assert {r["n"] for r in rows} == {1}


def test_component_tables_of_mixed_rasters(spark):
    """Stacks give each raster's own components; null, empty and blank rasters give none."""
    rng = np.random.default_rng(1)
    shapes = [(8, 8), (3, 5), (1, 1), (8, 8), (5, 3), (3, 5), (16, 16)] * 6
    inks = {i: rng.random(s) < 0.55 for i, s in enumerate(shapes)}
    rows = [(i, np.where(a, 0, 255).ravel().tolist(), a.shape[1], a.shape[0]) for i, a in inks.items()]
    rows += [(100, None, 8, 8), (101, [0], None, 1), (102, [], 0, 0), (103, [255] * 4, 2, 2)]
    df = spark.createDataFrame(rows, "k long, px array<int>, w int, h int").repartition(2)
    got = sorted(tuple(r) for r in raster.component_table(df, "k").collect())
    want = [(i, b["id"], b["pixels"], b["min_x"], b["max_x"], b["min_y"], b["max_y"]) for i, a in inks.items() for b in raster.boxes(raster.components(a))]
    assert got == sorted(want)
