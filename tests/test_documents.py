"""Running numbers and documents of hot groups: equal to the small ways, and spread over tasks."""

import glob
import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.operators import export, payload
from proofgrid.operators.documents import document_lines
from proofgrid.operators.ordering import running_index
from proofgrid.sources.writers import write_document_lines

ODD = ["a", "b/c=d e", "", None, "null", "g_"]


def hot(spark, n):
    """n rows, two thirds of them in one group, the rest in groups with odd names."""
    return spark.range(n, numPartitions=7).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.element_at(F.array(*map(F.lit, ODD)), (F.col("id") / 3 % len(ODD) + 1).cast("int"))).alias("grp"),
        F.xxhash64("id").alias("at"), F.col("id"), F.concat(F.lit('"\n\\é'), F.col("id")).alias("image"), (F.col("id") % 5 == 0).alias("verified"), (F.col("id") % 7 == 0).alias("edited"),
    )


@pytest.mark.parametrize("groups", [["grp"], [], ["grp", "verified"]])
def test_running_index_is_row_number(spark, groups):
    df = hot(spark, 20_000)
    over = Window.partitionBy(*groups).orderBy("at") if groups else Window.orderBy("at")
    want = df.withColumn("index", (F.row_number().over(over) - 1).cast("long"))
    got = running_index(df.withColumn("index", F.lit("clash")), groups, ["at"])
    assert got.columns == want.columns and got.schema["index"].dataType == want.schema["index"].dataType
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert running_index(df.limit(0), groups, ["at"]).count() == 0


def test_ties_get_each_number_once(spark):
    df = hot(spark, 500).withColumn("at", F.lit(None).cast("long"))
    got = running_index(df, ["grp"], ["at"]).groupBy("grp").agg(F.array_sort(F.collect_list("index")).alias("i")).collect()
    assert all(r["i"] == list(range(len(r["i"]))) for r in got)


def joined(lines, group):
    out = {}
    for r in lines.orderBy("line").collect():
        out[r[group]] = out.get(r[group], "") + r["text"]
    return out


def test_lines_make_the_documents(spark):
    df = hot(spark, 600).withColumn("reasons", F.array(F.lit("cost invalid"), F.col("image")))
    whole = lambda d, g="grp": {r[g]: r["json"] for r in d.collect()}
    twice = df.unionByName(df.where("id < 40").withColumn("reasons", F.array(F.lit("a"))))
    assert joined(export.quarantine_lines(twice, "grp", "image"), "grp") == whole(export.quarantine_documents(twice, "grp", "image"))
    assert joined(export.edit_lines(df, "grp", "at", ["image"], "2020"), "grp") == whole(export.edit_documents(df, "grp", "at", ["image"], "2020"))


def items(spark, n):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))
    return hot(spark, n).select(
        "grp", "id", F.concat(F.lit("Name "), F.col("id")).alias("name"), (F.col("id") % 5).cast("int").alias("cost"), F.lit(5).alias("rarity"), F.lit(10).alias("level"), F.when(F.col("grp") != "a", "Set").alias("sonata"),
        F.lit("Atk").alias("main_key"), (F.col("id") / 7).alias("main_value"), F.array(entry("Atk", F.col("id") / 3), entry("Hp", F.lit(1))).alias("substats"), F.when(F.col("id") % 2 == 0, "who").alias("equipped_by"),
    )


def test_lines_of_both_layouts_and_groups_without_items(spark):
    whole = lambda d: {r["grp"]: r["json"] for r in d.collect()}
    kept = payload.backup_items(items(spark, 400), ["Atk", "Hp"], 1000, ["id"], "grp").persist()
    got = joined(payload.backup_lines(kept, "grp", "2020", "1"), "grp")
    assert got == whole(payload.backup_documents(kept, "grp", "2020", "1")) and json.loads(got["a"])["echoes"] == [] and len(got) == 7
    kept = payload.artifact_items(items(spark, 400)).persist()
    assert joined(payload.artifact_lines(kept, "grp", "id", "here"), "grp") == whole(payload.artifact_documents(kept, "grp", "id", "here"))


def test_heads_and_tails_may_be_empty_or_alike(spark):
    df = hot(spark, 30)
    item, none, n = F.struct("id"), F.lit(None).cast("int"), F.count("*")
    for before, after, want in (({}, {}, '{"it\\"s":[@]}'), ({"n": n}, {"n": n}, '{"n":20,"it\\"s":[@],"n":20}'), ({"n": none}, {"n": none}, '{"it\\"s":[@]}')):
        got = joined(document_lines(df, "grp", "id", item, 'it"s', before, after), "grp")["hot"]
        assert got == want.replace("@", ",".join('{"id":%d}' % i for i in range(30) if i % 3))
    assert joined(document_lines(df.where("id = 1"), "grp", "id", F.when(F.col("id") > 5, item), "x"), "grp") == {"hot": '{"x":[null]}'}
    assert document_lines(df.limit(0), "grp", "at", item, "x").count() == 0


def folder_text(path, document):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{glob.escape(os.path.join(path, document))}/part-*"))).replace("\n", "")


def test_written_parts_in_order_of_name(spark, tmp_path):
    df = hot(spark, 30_000)
    lines = document_lines(df, "grp", "at", F.struct("id", "image"), "rows", {"n": F.count("*")})
    want = joined(lines, "grp")
    for parts in (9, 1):
        path = str(tmp_path / str(parts))
        write_document_lines(lines, "grp", f"file://{path}", parts)
        folders = [f for f in os.listdir(path) if f.startswith("document=")]
        assert len(folders) == len(want) == 7
        files = len(glob.glob(f"{path}/document=g_hot/part-*"))
        assert files == 1 if parts == 1 else files >= 5  # the hot group isn't one task's
        assert folder_text(path, "document=g_hot") == want["hot"] and json.loads(want["hot"])["n"] == 20_000
        assert folder_text(path, "document=null") == want[None] and folder_text(path, "document=g_null") == want["null"]
        assert folder_text(path, "document=g_") == want[""] and folder_text(path, "document=g_b%2Fc%3Dd e") == want["b/c=d e"]
