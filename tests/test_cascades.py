"""The name cascade and slot filling against plain loops; consistency flags and options on small cases."""

import random

from pyspark.sql import functions as F

from proofgrid.functions import text
from proofgrid.operators import resolve, review, score, slots
from proofgrid.sources import readers

CENTRES = [50.0, 150.0, 250.0]


def test_slots_fill_like_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for g in range(40):
        for o in range(rng.randint(1, 9)):
            kind = rng.choice(["A 5", "A 7", "B 5", "5.5", "label", "head"])
            rows.append((g, o, 1 if o < 5 else 2, float(rng.choice([50, 55, 150, 250, 900])), kind))
    df = spark.createDataFrame(rows, "g int, o int, attempt int, y double, t string")
    parse = lambda c: text.parse_line(c, [("A", "^A$"), ("B", "^B$")], {}, [])
    got = {(r["g"], r["o"]): r["role"] for r in slots.fill(df, "g", "o", "y", "t", CENTRES, parse, F.col("t") == "head", lambda p: p["value"] == 5).collect()}
    for g in range(40):
        chosen, first, parts = {}, {}, {}
        want = {}
        for _, o, attempt, y, t in (r for r in rows if r[0] == g):
            if t == "head":
                want[o] = "header"
            elif y == 900:
                want[o] = "orphan"
            elif t[0] in "AB":
                s, good = int(y > 100) + int(y > 200), t.endswith("5")
                if s not in chosen:
                    chosen[s] = (o, good)
                elif attempt == 2 and good and not chosen[s][1]:
                    chosen[s] = (o, True)
                first.setdefault(s, o)
                want[o] = ("row?", s)
            else:
                s = int(y > 100) + int(y > 200)
                if s in first:
                    want[o] = "collision"
                else:
                    part = "value" if t == "5.5" else "label"
                    parts[s, part] = o
                    want[o] = ("part?", s, part)
        for o, w in want.items():
            if isinstance(w, tuple) and w[0] == "row?":
                w = "row" if chosen[w[1]][0] == o else "collision"
            elif isinstance(w, tuple):
                w = w[2] if parts[w[1:]] == o else "overwritten"
            assert got[g, o] == w, (g, o)


def test_the_cascade_widens_and_rescues(spark):
    catalog = spark.createDataFrame([("granite hound", 1), ("copper falcon", 3), ("silver serpent", 4)], "name string, cost int")
    rows = [(1, "granite hound", None, 1), (2, "zzz\ngranite\nhound\nqqqqqq", None, 1), (3, "", "noise noise noise\ncopper falcan", 3), (4, "silver serpent", None, 3), (5, None, None, 1)]
    df = spark.createDataFrame(rows, "id int, t string, alt string, cost int")
    plain = {r["id"]: (r["entry"], r["stage"]) for r in resolve.name_cascade(df, catalog, "id", "t", "name", "alt").collect()}
    assert plain == {1: ("granite hound", 0), 2: ("granite hound", 1), 3: ("copper falcon", 3), 4: ("silver serpent", 0), 5: (None, None)}
    pool = F.col("q_cost") == F.col("c_cost")
    got = {r["id"]: (r["entry"], r["contradicts"]) for r in resolve.name_in_pool(df, catalog, "id", "t", "name", pool, "alt").collect()}
    assert got == {1: ("granite hound", False), 2: ("granite hound", False), 3: ("copper falcon", False), 4: ("silver serpent", True), 5: (None, True)}


def test_large_catalogs_are_matched_in_blocks(spark):
    catalog = spark.createDataFrame([(f"entry number {i}",) for i in range(60)], "name string")
    q = spark.createDataFrame([(i, f"entry nxmber {i}") for i in range(10, 40)], "id int, t string")
    a, b = (sorted(map(tuple, resolve.match(q, catalog, "id", "t", "name", few=m).collect())) for m in (7, 1000))
    assert a == b and len(a) == 30


def test_reports_and_retries(spark):
    entry = "array<struct<key:string,value:float>>"
    df = spark.createDataFrame([(1, [("A", 1.0), ("B", 2.0)], [("b", 2.01), ("C", 3.0)])], f"k int, e {entry}, a {entry}")
    fields = df.select("k", F.inline(score.substat_fields(F.col("e"), F.col("a"))))
    assert [(r["field"], r["match"]) for r in fields.collect()] == [("substat1", False), ("substat2", True), ("substat-extra1", False)]
    assert tuple(score.substat_counts(fields, "k").first()) == (1, 1, 2, 1)
    evidence = spark.createDataFrame([(1, "substat2", "raw", 0.95, "e/m/p/attempt1")], "k int, field string, raw string, confidence double, provenance string")
    entries = score.with_evidence(fields, evidence, "k")
    report = score.accuracy_report(entries, "k", "note")
    assert '"failed_fields":2' in report["head"].first()["json"] and report["failed"].count() == 2
    assert {r["provenance"] for r in entries.collect()} == {"e/m/p/attempt1", "not-recorded"}


def test_truth_keys_in_any_case_and_options(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"NAME":"x","Cost":3,"mainstat":{"KEY":"k","value":1.5}}')
    (tmp_path / "b.json").write_text("not json")
    r = readers.truth(spark, str(tmp_path)).collect()
    assert [(x["name"], x["cost"], x["mainStat"]["key"]) for x in r] == [("x", 3, "k")]
    assert readers.Options.read(spark, {"PROOFGRID_ICON_MARGIN": "0.5", "PROOFGRID_ENGINE_FALLBACK": "no", "PROOFGRID_ACCEPT_SCORE": "x"}) == readers.Options(icon_margin=0.5, engine_fallback=False)
    padded = review.padded(spark.createDataFrame([([(1, "a")],)], "a array<struct<x:int,y:string>>"), "a", 3).first()["a"]
    assert len(padded) == 3 and padded[0]["y"] == "a" and padded[1] is None
