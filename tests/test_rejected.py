"""What the readers leave out: folders of good, broken, empty and foreign files give exact rows and reasons."""

import json
import os

import pytest

from proofgrid.sources import readers

GOOD = [{"Name": "Grey", "Cost": 3, "Rarities": [5], "Sonatas": ["Frost"]}, {"Name": " ", "Cost": 1}, {"Cost": 4}, {"Name": "Red", "Cost": 1}]
RAW = {"a": {"en": "Raw", "intensity": 1, "rank": [5], "group": [1]}, "b": {"en": "", "intensity": 0}}


def folder(spark, tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return readers.documents(spark, f"file://{tmp_path}/*.json", empty=True)


def reasons(df):
    return {(os.path.basename(r["path"]), r["entry"], r["reason"]) for r in df.collect()}


BROKEN = {"empty.json": "  \n", "zero.json": "", "cut.json": '[{"Name":"x"', "text.json": "plain words", "number.json": "7", "none.json": "null"}
WHY = {"empty.json": "empty", "zero.json": "empty", "cut.json": "not JSON", "text.json": "not JSON"}


def whole(kind):
    return {(f, None, WHY.get(f, f"not a document of kind {kind}")) for f in BROKEN}


def test_catalogs(spark, tmp_path):
    texts = folder(spark, tmp_path, BROKEN | {"good.json": GOOD, "raw.json": RAW, "no.json": [], "bom.json": "﻿" + json.dumps(GOOD[:1])})
    got = readers.catalog(texts, {1: "Frost"}).collect()
    assert sorted(r["name"] for r in got) == ["Grey", "Grey", "Raw", "Red"]
    bad = reasons(readers.rejected(texts, "catalog"))
    assert bad == whole("catalog") | {("good.json", 1, "no name"), ("good.json", 2, "no name"), ("raw.json", 1, "no name"), ("no.json", None, "no entries")}
    assert len(got) + sum(e is not None for _, e, _ in bad) == 4 + 2 + 1  # each entry is here or there


def test_signatures(spark, tmp_path):
    one = {"name": "a", "signature": [1, 2, 3, 4]}
    bad = [{"name": "b", "signature": [1]}, {"name": "c"}, {"name": "d", "signature": "x"}, {"name": " ", "signature": [1, 2, 3, 4]}]
    texts = folder(spark, tmp_path, BROKEN | {"versioned.json": {"version": "1", "signatures": [one, *bad]}, "bare.json": [bad[0], one], "foreign.json": {"rows": []}})
    got = readers.signatures(texts, 4).collect()
    assert [r["name"] for r in got] == ["a", "a"]
    assert reasons(readers.rejected(texts, "signatures", 4)) == whole("signatures") | {
        ("versioned.json", 1, "signature of 1"), ("versioned.json", 2, "no signature"), ("versioned.json", 3, "no signature"), ("versioned.json", 4, "no name"), ("bare.json", 0, "signature of 1"), ("foreign.json", None, "not a document of kind signatures"),
    }


def test_truths(spark, tmp_path):
    files = {"named.json": {"Name": "x", "cost": 3}, "image.json": {"sourceImage": "y.png"}, "foreign.json": {"rows": []}, "list.json": [{"name": "x"}]}
    texts = folder(spark, tmp_path, BROKEN | files)
    got = readers.truth(spark, f"file://{tmp_path}/*.json").select("path").collect()
    assert sorted(os.path.basename(r["path"]) for r in got) == ["image.json", "named.json"]
    assert reasons(readers.rejected(texts, "truth")) == whole("truth") | {(f, None, "not a document of kind truth") for f in ("foreign.json", "list.json")}


def test_nothing_and_unknown_kinds(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert readers.rejected(none, "catalog").count() == 0 and readers.rejected(none, "truth").schema.names == ["path", "entry", "reason"]
    with pytest.raises(ValueError, match="no reader"):
        readers.rejected(none, "other")
