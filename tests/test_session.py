"""Sessions from a folder to documents: cut off, resumed and replayed; all flags; options; the shifted point."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import rules as rules_
from proofgrid.plans import session
from proofgrid.sources.readers import Options

RULES = session.Rules(
    aliases=[("Crit", "crit"), ("AtkPercent", "^atkp$"), ("Atk", "^atk$"), ("Hp", "^hp$"), ("Odd", "^odd$")], percent_of={}, percent_keys=["Crit", "AtkPercent"],
    legal={"Crit": [6.3, 7.5], "AtkPercent": [7.9, 9.4], "Atk": [30, 40, 50], "Hp": [320, 360]}, confusions=[("1", "7"), ("3", "8")], centres=[50.0, 150.0, 250.0, 350.0, 450.0], headers=["skill"],
    sets=["Frost Song", "Ember Hall", "Void Choir"], set_headers=("echo set",), drop_main_copies=True,
)
CATALOG = [("Grey Falcon", 3, ["Frost Song"]), ("Red Falcon", 1, ["Ember Hall", "Void Choir"]), ("Stone Warden", 4, ["Void Choir"]), ("Twin Name", 1, ["Frost Song"]), ("Twin Name", 3, ["Ember Hall"])]
MAINS = [(3, "AtkPercent", 5, 6.0, 30.0), (1, "Hp", 5, 100.0, 2280.0), (4, "Crit", 5, 4.4, 22.0)]
SECONDS = [(3, "Atk", 5, 20.0, 100.0), (1, "Hp", 5, 228.0, 2280.0), (4, "Atk", 5, 30.0, 150.0)]


def ranges(spark, rows):
    return spark.createDataFrame(rows, "cost int, key string, rarity int, start double, end double")


def image(file, shown, /, **regions):
    read = lambda region, t, c=0.95, attempt=1, engine="windows": {"region": region, "engine": engine, "psm": "6", "preprocess": "none", "attempt": attempt, "text": t, "confidence": c}
    lines = [{"line_no": i, "attempt": 1, "y": 50.0 + 100 * y, "text": t, "confidence": 0.95} for i, (y, t) in enumerate(shown)]
    again = [{"slot": s, "text": t, "confidence": 0.99} for s, t in regions.pop("again", [])]
    more = regions.pop("more", [])
    return {"image_file": file, "rarity": 5, "equipped_by": "someone", "reads": [read(k, v) for k, v in regions.items()] + [read(**m) for m in more], "lines": lines, "retries": again}


def scanned(spark, images, options=None, solver=True, rules=RULES):
    df = spark.read.schema(session.IMAGES).json(spark.sparkContext.parallelize([json.dumps(i) for i in images]))
    nested = lambda c: df.select("image_file", F.inline(c))
    catalog = spark.createDataFrame(CATALOG, "name string, cost int, sets array<string>")
    more = (ranges(spark, MAINS), ranges(spark, SECONDS)) if solver else (None, None)
    got = session.recognise(nested("reads"), nested("lines"), catalog, rules, nested("retries"), *more, df.select("image_file", "rarity"), options).collect()
    assert len(got) == len({r["image_file"] for r in got}) == len(images)
    return {r["image_file"]: r for r in got}


GOOD = {"name": "Grey Falcon", "cost": "Cost 3", "level": "Lv.10", "main": "atkp 15.6%", "second": "atk 52", "icon": "Frost Song", "set": "x"}
TWO = [(0, "crit 6.3%"), (1, "atk 40")]


def test_flags_sets_retries_ladders_and_options(spark):
    images = [
        image("good", TWO, **GOOD), image("contradicts", TWO, **GOOD | {"name": "Stone Warden"}), image("unparsed", TWO, **GOOD | {"level": "??"}), image("wrongmain", TWO, **GOOD | {"main": "hp 900"}),
        image("corrected", [(0, "crit 6.3%"), (1, "atk 40"), (2, "hp 320")], **GOOD | {"main": "atkp 20.4%"}), image("impossible", TWO, **GOOD | {"main": "atkp 15.7%"}), image("second", TWO, **GOOD | {"second": "hp 52"}),
        image("collision", [*TWO, (1, "hp 320")], **GOOD), image("badkey", [*TWO, (2, "odd 5")], **GOOD), image("duplicate", [*TWO, (2, "crit 7.5%")], **GOOD),
        image("ambiguous", [(0, "crit 6.3%"), (1, "atk 80")], **GOOD), image("noroll", [(0, "crit 6.3%"), (1, "atk 99")], **GOOD), image("short", TWO[:1], **GOOD), image("excess", [*TWO, (2, "hp 320")], **GOOD),
        image("copy", [*TWO, (2, "atkp 15.6%")], **GOOD), image("twin", TWO, **GOOD | {"name": "Twin Name"}), image("nothing", []),
    ]
    images += [
        image("text", TWO, **GOOD | {"name": "Red Falcon", "cost": "Cost 1", "icon": "Frost Song", "set": "Ember Hall", "main": "hp 972", "second": "hp 1048"}),
        image("heading", TWO, **{k: v for k, v in GOOD.items() if k != "icon"} | {"set": "Echo Set\nFrust Sung"}), image("default", TWO, **{k: v for k, v in GOOD.items() if k not in ("icon", "set")}),
        image("again", TWO[:1], again=[(0, "hp 320"), (1, "crit 7.5%"), (1, "atk 40"), (4, "hp 320")], **GOOD), image("split", [(0, "crit 6.3%"), (1, "atk"), (1, "40")], **GOOD),
        image("inferred", TWO, **GOOD | {"cost": "none"}),
    ]
    reread = {"region": "name", "t": "Grey Falcon", "attempt": 2, "engine": "other"}
    optional = [image("fallback", TWO, more=[reread], **GOOD | {"name": "x"}), image("near", TWO, **GOOD | {"name": "Grey Falkan"}), image("low", TWO, more=[{"region": "level", "t": "Lv.10", "c": 0.82}], **{k: v for k, v in GOOD.items() if k != "level"})]
    got = scanned(spark, images + optional, Options())
    flags = {k: r["flags"] for k, r in got.items()}
    assert flags["good"] == [] and not got["good"]["needs_review"] and flags["copy"] == [] and flags["twin"] == []
    assert "NameContradictsEvidence" in flags["contradicts"] and "CostNameMismatch" in flags["contradicts"] and got["contradicts"]["cost"] == 3
    assert "LevelUnparsed" in flags["unparsed"] and flags["wrongmain"] == ["MainStatInvalidForCost"]
    assert flags["corrected"] == ["LevelCorrectedByStats"] and (got["corrected"]["level_read"], got["corrected"]["level"]) == (10, 15)
    assert flags["impossible"] == ["MainValueImpossible"] and flags["second"] == ["SecondMainStatInvalid"] and flags["collision"] == ["SlotCollision"]
    assert flags["badkey"] == ["InvalidSubstatKey"] and flags["duplicate"] == ["SubstatDuplicate"]
    assert flags["noroll"] == ["NotARoll"] and flags["short"] == ["SubstatShort"] and flags["excess"] == ["SubstatExcess"]
    assert flags["ambiguous"] in (["AmbiguousRoll"], []) and got["ambiguous"]["needs_review"]
    assert got["nothing"]["name"] is None and got["nothing"]["needs_review"]
    # QG7: roll flags stand for unresolved rows, and nothing else
    for r in got.values():
        states = {s["state"] for s in r["substats"]}
        assert ("NotARoll" in r["flags"]) == ("NotARoll" in states) and ("AmbiguousRoll" in r["flags"]) == ("Ambiguous" in states)
        assert all((s["snapped"] is None) == (s["state"] in ("NotARoll", "Ambiguous")) for s in r["substats"])
    assert (got["text"]["sonata"], got["text"]["sonata_source"]) == ("Ember Hall", "text")
    assert got["heading"]["sonata"] == "Frost Song" and got["default"]["sonata"] == "Frost Song" and round(got["default"]["sonata_confidence"], 2) == 0.5 and got["default"]["sonata_source"] == "catalog"
    assert [(s["slot"], s["key"], s["snapped"]) for s in got["again"]["substats"]] == [(0, "Crit", pytest.approx(6.3)), (1, "Atk", 40.0)] and got["again"]["recovered"] == 1
    assert got["again"]["substats"][1]["confidence"] == pytest.approx(0.8) and got["split"]["substats"][1]["confidence"] == pytest.approx(0.88)
    assert (got["inferred"]["cost"], got["inferred"]["cost_confidence"]) == (3, 0.5) and got["inferred"]["needs_review"]
    assert got["fallback"]["name"] == got["near"]["name"] == "Grey Falcon" and not got["low"]["needs_review"]
    strict = scanned(spark, optional, Options(engine_fallback=False, name_threshold=0.95, review_confidence=0.9))
    assert strict["fallback"]["name"] is None and strict["near"]["name"] is None and strict["low"]["needs_review"]


def test_the_point_shifts_only_where_it_may(spark):
    df = spark.createDataFrame([(0.75,), (63.0,), (7.5,)], "v float")
    for shift, want in ((True, [7.5, pytest.approx(6.3), 7.5]), (False, [None, None, 7.5])):
        got = df.select(rules_.resolve_value(F.lit("Crit"), F.col("v"), {"Crit": [6.3, 7.5]}, [], F.lit(True), shift)["value"].alias("x")).collect()
        assert [r["x"] for r in got] == want


def folder(path, n=24, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        names = {"name": rng.choice([c[0] for c in CATALOG]), "cost": f"Cost {rng.choice([1, 3, 4])}", "level": rng.choice(["Lv.10", "Lv.5", "?"])}
        docs = [image(f"i{i:03}_{k}", TWO[: rng.randint(0, 2)], **GOOD | names) for k in range(2)] + [image("again", TWO, **GOOD)] * (i == 0)
        (path / f"{i:03}.json").write_text("\n".join(map(json.dumps, docs)))
        os.utime(path / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def light(reads, lines, catalog, r, retries=None, mains=None, seconds=None, rarity=None, options=None):
    """Stands for recognise where only the session's mechanics count."""
    named = reads.where("region = 'name'").groupBy("image_file").agg(F.max("text").alias("name"))
    level = reads.where("region = 'level'").groupBy("image_file").agg(F.max("text").alias("t")).select("image_file", F.regexp_extract("t", r"(\d+)", 1).try_cast("int").alias("level"))
    rows = rarity.distinct().join(named, "image_file", "left").join(level, "image_file", "left")
    entry = F.struct(F.lit(0).alias("slot"), F.lit("Crit").alias("key"), F.lit(6.3).cast("float").alias("value"), F.lit(6.3).cast("float").alias("snapped"), F.lit(1.0).cast("float").alias("confidence"), F.lit("Exact").alias("state"))
    return rows.select("image_file", "name", F.lit(3).alias("cost"), "rarity", "level", F.struct(F.lit("Hp").alias("key"), F.lit(320.0).alias("value")).alias("main"), F.lit("Frost Song").alias("sonata"), F.array(entry, entry).alias("substats"))


def test_a_session_that_is_cut_off_and_resumed(spark, tmp_path, monkeypatch):
    source = tmp_path / "reads"
    source.mkdir()
    monkeypatch.setattr(session, "recognise", light)
    folder(source, 5)
    catalog = spark.createDataFrame(CATALOG, "name string, cost int, sets array<string>")
    edits = spark.createDataFrame([("i001_0", "Red Falcon", 10, 1), ("I001_0", "Stone Warden", 15, 2)], "image_file string, name string, level int, at int")

    def run(out, files, **more):
        return session.run_session(spark, f"file://{source}", f"file://{tmp_path / out}", catalog, RULES, 1_000, "2020", ranges(spark, MAINS), ranges(spark, SECONDS), edits, files=files, **more)

    rows = lambda r: (sorted(map(str, r["scans"].drop("batch").collect())), [x[0] for x in r["backup"].collect()], [x[0] for x in r["quarantine"].collect()], r["accounts"].first())
    whole = rows(run("whole", 100))
    assert len(whole[0]) == 11 and whole[3]["balanced"] and 0 < whole[3]["exported"] < 11 and json.loads(whole[1][0])["echoes"] and any("Stone Warden" in x for x in whole[0])

    asked = []
    assert run("cut", 2, stop=lambda: bool(asked.append(1)) or len(asked) > 1) is None  # one batch runs, the second doesn't begin
    assert len(os.listdir(tmp_path / "cut/ledger")) == 1 and len(os.listdir(tmp_path / "cut/scans")) == 1

    class Killed(Exception):
        pass

    def dies(*_):
        raise Killed

    # killed between writing the next batch and entering it in the ledger
    with monkeypatch.context() as m:
        m.setattr(session, "enter", dies)
        with pytest.raises(Exception, match="Killed"):
            run("cut", 2)
    assert len(os.listdir(tmp_path / "cut/ledger")) == 1 and len(os.listdir(tmp_path / "cut/scans")) == 2
    seen = session.committed(spark, f"file://{tmp_path}/cut").select("batch").distinct().collect()
    assert [r["batch"] for r in seen] == [0]
    assert rows(run("cut", 2)) == whole
    assert rows(run("cut", 2)) == whole  # nothing is left to do
    folder(source, 6)
    assert len(run("cut", 2)["scans"].collect()) == 13


def test_evaluation_with_evidence(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "y")], "image_file string, t_name string")
    scans = spark.createDataFrame([("a", "x"), ("b", "z")], "image_file string, name string")
    evidence = spark.createDataFrame([("a", "name", "X", 0.9, "e/6/none/attempt1")], "image_file string, field string, raw string, confidence double, provenance string")
    retries = spark.createDataFrame([("a", 2, 1)], "image_file string, retries int, recovered int")
    got = session.evaluate(truth, scans, "image_file", {"name": ("t_name", "name", False)}, evidence, retries, "n")
    assert set(got) == {"scores", "exact", "confusions", "report", "failed"}
    head = json.loads(got["report"].first()[0])
    assert (head["total_fields"], head["failed_fields"], head["recovered"], head["note"]) == (2, 1, 1, "n") and [r["image_file"] for r in got["failed"].collect()] == ["b"]


def test_a_whole_session(spark, tmp_path):
    source = tmp_path / "reads"
    source.mkdir()
    folder(source, 2)
    catalog = spark.createDataFrame(CATALOG, "name string, cost int, sets array<string>")
    got = session.run_session(spark, f"file://{source}", f"file://{tmp_path}/out", catalog, RULES, 1_000, "2020", ranges(spark, MAINS), ranges(spark, SECONDS))
    rows = {r["image_file"]: r for r in got["scans"].collect()}
    assert len(rows) == 5 and rows["again"]["exported"] and rows["again"]["flags"] == []
    items = json.loads(got["backup"].first()[0])["echoes"]
    assert len(items) == sum(r["exported"] for r in rows.values()) and {"Grey Falcon"} <= {i["name"] for i in items}
    assert json.loads(got["quarantine"].first()[0])["count"] == 5 - len(items) if len(items) < 5 else True
