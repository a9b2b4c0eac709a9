"""Golden rows of the text grammars."""

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import text

ALIASES = [
    ("CritRate", r"crit\.?\s*rate"), ("CritDamage", r"crit\.?\s*(dmg|damage)"), ("EnergyRegen", r"energy\s*regen"),
    ("Hp", "^hp$"), ("Atk", "^atk$"), ("Def", "^def$"),
]
TWINS = {"Hp": "HpPercent", "Atk": "AtkPercent", "Def": "DefPercent"}
PERCENT = ["CritRate", "CritDamage", "EnergyRegen", *TWINS.values()]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_levels(spark):
    good = {"25": 25, "+25": 25, " 0 ": 0, "Lv.15": 15, "Lv 15": 15, "Level 3": 3, "+0": 0}
    bad = ["", " ", None, "abc", "2 5", "25+7", "Lv.15 (+3)", "0-99", "99", "26"]
    assert column(spark, list(good), text.parse_level) == list(good.values())
    assert column(spark, bad, text.parse_level) == [None] * len(bad)


def test_lines(spark):
    rows = {
        "ATK 79%": ("AtkPercent", 7.9), "HP 79%": ("HpPercent", 7.9), "DEF 79%": ("DefPercent", 7.9), "Energy Regen 840%": ("EnergyRegen", 8.4),
        "ATK 150": ("Atk", 150), "Crit. Rate 22.0%": ("CritRate", 22), "ATK j 100": ("Atk", 100), "DEF Co 12.8%": ("DefPercent", 12.8), "blah blup 100": None, "j 100": None, "": None, None: None,
    }
    got = column(spark, list(rows), lambda c: text.parse_line(c, ALIASES, TWINS, PERCENT))
    for want, r in zip(rows.values(), got):
        assert (r is None) == (want is None)
        if want:
            assert r["key"] == want[0] and r["value"] == pytest.approx(want[1], abs=1e-4)


def test_lines_lose_blanks_and_nothing_else(spark):
    """Digits that equal a line's place stay, blanks at both ends go."""
    texts = ["0 a 0\n1 b 1\n2 c 2\n", " x \n  \n y1", None, ""]
    assert column(spark, texts, text.lines_of) == [["0 a 0", "1 b 1", "2 c 2"], ["x", "y1"], None, []]
    assert column(spark, texts[:2], lambda c: text.line_windows(text.lines_of(c))) == [["0 a 0 1 b 1", "1 b 1 2 c 2"], ["x y1"]]


def test_headers_owner_variant(spark):
    marks = ["echo skill", "sonata effect", "equipped by"]
    assert column(spark, ["Echo Skill", "Sonata Effect", "Equipped by Ann", "echo skill text", "Crit. Rate", "HP", None], lambda c: text.is_header(c, marks)) == [True] * 4 + [False] * 3
    assert column(spark, ["x Equipped by  Ann Lee", "none"], text.extract_owner) == ["Ann Lee", None]
    assert [tuple(r) for r in column(spark, ["Phantom: Rook", "Phantomrook"], text.strip_variant)] == [(True, "Rook"), (False, "Phantomrook")]


def test_capture_names(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (11, 4, 2, 1485), (99, 3, 0, 1495), (0, 1, 1, 999)], "p long, r long, c long, i long")
    names = df.select(text.capture_name(*(F.col(x) for x in "prci")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["echo_p01_r01_c01_idx001.png", "echo_p12_r05_c03_idx1485.png", "echo_p100_r04_c01_idx1495.png", "echo_p01_r02_c02_idx999.png"]
    assert [r["x"]["index"] for r in names.select(text.parse_capture_name(F.col("n")).alias("x")).collect()] == [1, 1485, 1495, 999]


def test_similarity_is_single_precision(spark):
    pairs = [("", "a"), ("abc", "abc"), ("abcde", "abcdefg"), ("bcdef", "abcdefg"), ("a" * 17 + "b" * 8, "a" * 17 + "c" * 8)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in df.select("i", text.similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got[:3] == [0.0, 1.0, pytest.approx(0.9)] and got[3] == pytest.approx(0.9 * 5 / 7)
    ok = df.where("i = 4").select((text.similarity(F.col("a"), F.col("b")) >= F.lit(0.68).cast("float")).alias("ok")).first()["ok"]
    assert ok  # 1 - 8/25 passes in single precision
