"""Matching, scoring, export and review on small tables; order independence; sessions."""

import json

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import export, resolve, review, score
from proofgrid.plans import session
from proofgrid.sources import readers


def test_near_tie_is_ambiguous_and_order_does_not_matter(spark):
    names = ["testab", "testac", "other name", "another name long"]
    q = spark.createDataFrame([(1, "testad"), (2, "other name"), (3, "oth"), (4, ""), (5, None)], "id int, t string")
    runs = [{r["id"]: tuple(r) for r in resolve.match(q, spark.createDataFrame([(n,) for n in ns], "name string").repartition(3), "id", "t", "name", threshold=0.6).collect()} for ns in (names, names[::-1])]
    assert runs[0] == runs[1]
    r = runs[0]
    assert r[1][1] == "testab" and r[1][3] and r[1][4] == "testac"
    assert r[2][1] == "other name" and r[2][2] == 1.0 and not r[2][3]
    assert r[3][1] is None and r[3][2] > 0 and r[4][1] is None and r[5][2] == 0.0


def test_corrupted_names_resolve(spark):
    names = [f"{a}{b}" for a in ("granite", "marble", "copper", "silver") for b in ("hound", "falcon", "serpent")]
    q = spark.createDataFrame([(i * 100 + j, n[:j] + "x" + n[j + 1 :], n) for i, n in enumerate(names) for j in range(len(n))], "id int, t string, want string")
    got = resolve.match(q, spark.createDataFrame([(n,) for n in names], "name string"), "id", "t", "name").join(q, "id").collect()
    assert sum(r["entry"] == r["want"] for r in got) >= 0.95 * len(got)


def test_widening(spark):
    q = spark.createDataFrame([(1, "alpha one", 1), (2, "alpha one", 9)], "id int, t string, cost int")
    c = spark.createDataFrame([("alpha one", 1), ("beta two", 3)], "name string, cost int")
    got = {r["id"]: (r["entry"], r["widened"]) for r in resolve.match_constrained(q, c, "id", "t", "name", F.col("q_cost") == F.col("c_cost")).collect()}
    assert got == {1: ("alpha one", False), 2: ("alpha one", True)}


def test_big_catalogs_are_refused(spark):
    with pytest.raises(ValueError):
        resolve.small(spark.range(11), most=10)


ENTRY = "array<struct<key:string,value:float>>"


def test_multisets(spark):
    cases = [
        ([("A", 1.0), ("B", 2.0)], [("b", 2.04), ("a", 1.0)], (2, 0, 0)), ([("A", 1.0)], [], (0, 1, 0)), ([], [("A", 1.0)], (0, 0, 1)),
        ([("A", 1.0), ("A", 1.0)], [("A", 1.0)], (1, 1, 0)), ([("A", 22.0)], [("A", 22.0001)], (1, 0, 0)), (None, None, (0, 0, 0)), ([("A", 1.0)], None, (0, 1, 0)),
    ]
    df = spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(cases)], f"i int, e {ENTRY}, a {ENTRY}")
    got = df.select("i", score.multiset_match(F.col("e"), F.col("a")).alias("s")).orderBy("i").collect()
    assert [tuple(-1 if x is None else x for x in r["s"]) if r["s"] else (0, 0, 0) for r in got][:5] == [c[2] for c in cases[:5]]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.7, True), (1.0, True), (0.0, False), (None, True), (1.5, True)], "c double, h boolean").select(F.col("c").cast("float").alias("c"), "h")
    got = {r["bucket"]: (r["count"], r["matched"]) for r in score.calibration(df, "c", "h").collect()}
    assert len(got) == 10 and got[9] == (1, 1) and got[0] == (1, 0) and got[6] == (1, 1) and sum(n for n, _ in got.values()) == 3


def test_export_policies_and_accounting(spark):
    subs = [{"key": "CritRate", "value": 8.7, "snapped": 8.7}, {"key": "AtkPercent", "value": 7.1, "snapped": None}]
    df = spark.createDataFrame([("a", "Name", 4, 10, "Set", "CritRate", 22.0, subs), ("b", None, 2, 99, " ", None, 0.0, [])], "f string, n string, c int, l int, s string, mk string, mv double, subs array<struct<key:string,value:float,snapped:float>>")
    fatal, soft = export.fatal_reasons(*(F.col(x) for x in ("n", "c", "l", "s", "mk", "mv"))), export.degradations(F.col("subs"), F.col("l"))
    strict = {r["f"]: r for r in export.decide(df, fatal, soft).collect()}
    assert not strict["a"]["exported"] and any("AtkPercent" in x for x in strict["a"]["reasons"]) and len(strict["b"]["reasons"]) == 7
    loose = export.decide(df, fatal, soft, export.PARTIAL)
    assert {r["f"]: r["exported"] for r in loose.collect()} == {"a": True, "b": False}
    kept = loose.where("exported").select(export.exported_substats(F.col("subs")).alias("x")).first()["x"]
    assert [(k["key"], round(k["value"], 2)) for k in kept] == [("critRate", 8.7)]
    total = export.accounting(loose, F.col("exported"), ~F.col("exported")).first()
    assert total["balanced"] and total["total"] == 2
    with pytest.raises(ValueError):
        export.require_valid(spark.createDataFrame([("x: bad",)], "problem string"))
    export.require_valid(spark.createDataFrame([], "problem string"))


def test_overlay_and_relink(spark):
    base = spark.createDataFrame([("A.png", 1), ("b.png", 2)], "f string, v int")
    edits = spark.createDataFrame([("a.PNG", 5, 0), ("a.png", 7, 1)], "f string, v int, o int")
    assert {r["f"]: (r["v"], r["edited"]) for r in review.overlay(base, edits, "f", ["v"], ["o"]).collect()} == {"A.png": (7, True), "b.png": (2, False)}
    rows = spark.createDataFrame([("/x/a.png",), ("/y/c.png",), ("/z/d.png",)], "p string")
    files = spark.createDataFrame([("/x/a.png",), ("/new/c.png",)], "f string")
    assert {r["p"]: r["status"] for r in review.relink(rows, files, "p", "f").collect()} == {"/x/a.png": "kept", "/y/c.png": "relinked", "/z/d.png": "missing"}


def test_readers(spark):
    raw = json.dumps({"1": {"en": "Rook", "code": "R", "rank": [5], "group": [1, 99], "intensity": 1}, "2": {"en": " ", "code": "", "rank": [], "group": [], "intensity": 0}})
    ready = json.dumps([{"Name": "Alba", "Cost": 4, "Rarities": [5], "Sonatas": ["S"]}])
    got = readers.catalog(spark.createDataFrame([(raw,), (ready,), ("{broken",)], "text string"), {1: "Frost"}).collect()
    assert [(r["name"], r["cost"], r["sets"]) for r in got] == [("Alba", 4, ["S"]), ("Rook", 3, ["Frost"])]
    sig = json.dumps({"version": "v1", "signatures": [{"name": "a", "signature": [32, -16]}, {"name": "b", "signature": [1]}]})
    one = readers.signatures(spark.createDataFrame([(sig,)], "text string"), length=2).collect()
    assert [(r["version"], r["name"], r["signature"]) for r in one] == [("v1", "a", [1.0, -0.5])]
    assert readers.confusions(spark.createDataFrame([("{}",)], "text string"), [("1", "7")]).count() == 2


def test_session(spark):
    r = session.Rules(aliases=[("Crit", "crit"), ("Atk", "^atk$")], percent_of={"Atk": "AtkPercent"}, percent_keys=["Crit", "AtkPercent"], legal={"Crit": [6.3, 7.5], "AtkPercent": [7.9]}, confusions=[("1", "7")], centres=[50.0, 150.0], headers=["skill"])
    reads = spark.createDataFrame(
        [("i1", "name", "e", "p", "x", 1, "Grey Falcon", 0.9), ("i1", "cost", "e", "p", "x", 1, "Cost 3", 0.9), ("i1", "level", "e", "p", "x", 1, "Lv.10", 0.9), ("i1", "main", "e", "p", "x", 1, "Atk 7.9%", 0.9), ("i2", "name", "e", "p", "x", 1, "??", 0.1)],
        "image_file string, region string, engine string, psm string, preprocess string, attempt int, text string, confidence double",
    )
    lines = spark.createDataFrame([("i1", 1, "Crit 1.5%", 48.0, 0.95), ("i1", 2, "Atk 7.9%", 152.0, 0.95), ("i1", 3, "Echo Skill", 300.0, 0.9)], "image_file string, line_no int, text string, y double, confidence double")
    catalog = spark.createDataFrame([("Grey Falcon", 3), ("Red Falcon", 1)], "name string, cost int")
    got = {x["image_file"]: x for x in session.recognise(reads, lines, catalog, r).collect()}
    assert got["i1"]["name"] == "Grey Falcon" and got["i1"]["level"] == 10 and [s["state"] for s in got["i1"]["substats"]] == ["Corrected", "Exact"] and got["i1"]["flags"] == []
    assert got["i1"]["needs_review"]  # the corrected entry's confidence is below 0.80
    assert got["i2"]["name"] is None and "LevelUnparsed" in got["i2"]["flags"] and got["i2"]["needs_review"]
