"""Readers of semi-structured sources, each giving a typed DataFrame; malformed parts become nulls or are skipped."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_capture_name
from ..functions.vectors import from_wire

CATALOG = "array<struct<Name:string,Cost:int,Rarities:array<int>,Sonatas:array<string>>>"
RAW_CATALOG = "map<string,struct<en:string,code:string,rank:array<int>,`group`:array<int>,intensity:int>>"
SIGNATURES = "struct<version:string,scannerSignatureVersion:string,signatures:array<struct<name:string,signature:array<int>>>>"
LEGACY_SIGNATURES = "array<struct<name:string,signature:array<int>>>"
TRUTH = (
    "fixtureVersion int, layout string, resolution map<string,int>, uiScale int, panelRect map<string,double>, fieldRects map<string,map<string,double>>,"
    " sourceImage string, sourceFullImage string, verified boolean, name string, cost int, rarity int, level int, sonata string,"
    " mainStat struct<key:string,value:float>, secondMainStat struct<key:string,value:float>, subStats array<struct<key:string,value:float>>"
)
EDITS = (
    "ExportedAt timestamp, TotalEchoes int, VerifiedCount int, EditedCount int, Echoes array<struct<ImageFileName:string,EchoName:string,Cost:int,Rarity:int,Level:int,Sonata:string,"
    "MainStat:struct<Key:string,Display:string,Value:float>,SecondMainStat:struct<Key:string,Display:string,Value:float>,"
    "Substats:array<struct<Key:string,Display:string,Value:float,SnappedValue:float>>,IsVerified:boolean,IsEdited:boolean>>"
)


def documents(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """(path, text) of whole text files, a byte order mark taken off.

    Spark's sources pass over files without a byte; with empty these come, too, with an empty
    text, for which the driver takes the list of names that it has made anyway.
    """
    raw = spark.read.text(path, wholetext=True)
    read = raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    if not empty:
        return read
    listed = spark.createDataFrame([(f,) for f in raw.inputFiles()], "path string")
    listed = listed.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))  # as _metadata spells it
    return read.unionByName(listed.join(read, "path", "left_anti").withColumn("text", F.lit("")))


def captures(spark: SparkSession, folder: str, limit: int = 0, pattern: str = "echo_*.png") -> DataFrame:
    """(path, length, page, row, col, index) of a folder's captures by place, the first limit if positive (SRC1-SRC3)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    named = files.select("path", "length", parse_capture_name(F.col("path")).alias("n")).select("path", "length", "n.*").orderBy(F.col("index").asc_nulls_last(), "path")
    return named.limit(limit) if limit > 0 else named


def catalog(texts: DataFrame, groups: Mapping[int, str]) -> DataFrame:
    """(name, cost, rarities, sets) from catalog documents in either form, by name (SRC4-SRC6).

    In the raw form intensity 0 costs 1, 1 costs 3 and all else 4; unknown groups are dropped
    in place; blank names are dropped. Documents in neither form give no rows.
    """
    lookup = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv)) if groups else F.create_map().cast("map<int,string>")
    ready = texts.select(F.inline_outer(F.from_json("text", CATALOG)).alias("name", "cost", "rarities", "sets"))
    raw = texts.where(F.trim("text").startswith("{")).select(F.explode(F.map_values(F.from_json("text", RAW_CATALOG))).alias("e"))
    cost = F.when(F.col("e.intensity") == 0, 1).when(F.col("e.intensity") == 1, 3).otherwise(4)
    raw = raw.select(F.col("e.en").alias("name"), cost.alias("cost"), F.col("e.rank").alias("rarities"), F.filter(F.transform("e.group", lambda g: F.try_element_at(lookup, g)), lambda g: g.isNotNull()).alias("sets"))
    return ready.unionByName(raw).where("trim(name) <> ''").orderBy("name")


def signatures(texts: DataFrame, length: int = 256) -> DataFrame:
    """(version, name, signature) from versioned or bare documents; elements of other lengths are skipped (SRC7)."""
    full = F.from_json("text", SIGNATURES)
    bare = F.from_json("text", LEGACY_SIGNATURES)
    rows = texts.select(F.coalesce(full["version"], full["scannerSignatureVersion"]).alias("version"), F.explode(F.when(F.trim("text").startswith("["), bare).otherwise(full["signatures"])).alias("s"))
    return rows.where((F.trim("s.name") != "") & (F.size("s.signature") == length)).select("version", F.col("s.name").alias("name"), from_wire(F.col("s.signature")).alias("signature"))


def check_version(rows: DataFrame, expected: str) -> bool:
    """Whether every signature is of the expected version or a local one (VS8)."""
    bad = rows.where(F.col("version").isNull() | ~(F.col("version").contains(expected) | F.col("version").startswith("local")))
    return bad.isEmpty()


def confusions(texts: DataFrame, fallback: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(from_ch, to_ch), each pair both ways; the fallback's if there is none (SRC8)."""
    doc = F.from_json("text", "struct<decimalShift:boolean,digitPairs:array<struct<`from`:string,`to`:string,observations:int>>>")
    read = texts.select(F.inline(doc["digitPairs"])).select(F.col("from").alias("from_ch"), F.col("to").alias("to_ch")).where("length(from_ch) = 1 and length(to_ch) = 1")
    spare = texts.sparkSession.createDataFrame(list(fallback), "from_ch string, to_ch string")
    read = read.unionByName(spare) if read.isEmpty() else read
    return read.unionByName(read.select(F.col("to_ch").alias("from_ch"), F.col("from_ch").alias("to_ch"))).distinct()


def decimal_shift(texts: DataFrame) -> bool:
    """Whether confusion documents let a decimal point shift; they do where none says no (SRC8)."""
    doc = F.from_json("text", "struct<decimalShift:boolean>")
    return texts.where(~F.coalesce(doc["decimalShift"], F.lit(True))).isEmpty()


def cached_catalog(spark: SparkSession, cache: str, source: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The catalog from its cache, or from source, which then is written there (SRC5).

    A cache that is missing, empty or broken counts as none. What was read stays in memory for
    the session under the cache's path, so that later calls share it.
    """
    key = (spark.sparkContext.applicationId, cache)
    if not refresh and key in _CATALOGS:
        return _CATALOGS[key]
    rows = None
    if not refresh:
        try:
            rows = spark.read.schema(CATALOG_ROWS).json(cache)
            rows = None if rows.isEmpty() else rows
        except AnalysisException:
            rows = None
    if rows is None:
        source().write.mode("overwrite").json(cache)
        rows = spark.read.schema(CATALOG_ROWS).json(cache)
    _CATALOGS[key] = rows
    return rows


CATALOG_ROWS = "name string, cost int, rarities array<int>, sets array<string>"
_CATALOGS: dict[tuple[str, str], DataFrame] = {}


@dataclass(frozen=True)
class Options:
    """Knobs of a session (SRC15)."""

    name_engine: str = "windows"
    engine_fallback: bool = True
    name_threshold: float = 0.68
    accept_score: float = 0.75
    rescue_score: float = 0.90
    set_threshold: float = 0.70
    icon_margin: float = 0.003
    review_confidence: float = 0.80

    @classmethod
    def read(cls, spark: SparkSession, environment: Mapping[str, str] = {}, prefix: str = "proofgrid.") -> Options:
        """Defaults, overridden by the session's settings, overridden by environment variables (PROOFGRID_...); what can't be read is left out."""
        found = {}
        for f in fields(cls):
            for text in (spark.conf.get(prefix + f.name, None), environment.get((prefix + f.name).upper().replace(".", "_"))):
                if text is None:
                    continue
                kind = type(f.default)
                try:
                    found[f.name] = text.strip().lower() in ("1", "true", "yes") if kind is bool else kind(text)
                except ValueError:
                    continue
        return cls(**found)


def region_overrides(texts: DataFrame, known: DataFrame) -> DataFrame:
    """known (name, x, y, w, h) with the rectangles of a document that are whole and inside 0..1 (SRC9, J3)."""
    rects = texts.select(F.explode(F.from_json("text", "map<string,struct<x:float,y:float,w:float,h:float>>")).alias("name", "r")).select("name", "r.*")
    rects = rects.where("x >= 0 and y >= 0 and w > 0 and h > 0 and x + w <= 1.0001 and y + h <= 1.0001").toDF("name", "ox", "oy", "ow", "oh")
    out = known.join(rects, "name", "left")
    return out.select("name", *(F.coalesce(f"o{c}", c).alias(c) for c in "xywh"), F.col("ox").isNotNull().alias("overridden"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Hand-truth sidecars, keys in any case; files that aren't JSON are left out (SRC10)."""
    rows = documents(spark, path).select("path", F.from_json(any_case("text", _names(TRUTH)), f"struct<{_struct(TRUTH)}>", {"mode": "PERMISSIVE"}).alias("d"))
    return rows.where("d.name is not null or d.sourceImage is not null").select("path", "d.*")


def rejected(texts: DataFrame, kind: str, length: int = 256) -> DataFrame:
    """(path, entry, reason): what the reader of a kind leaves out of documents (path, text) (SRC4, SRC7, SRC10).

    kind is catalog, signatures or truth. A document that gives nothing has one row with a null
    entry: it is empty, not JSON, JSON of another kind, or without entries. An entry that is
    left out has a row with its place (in the raw catalog, by key order; from 0). So every entry
    of a document is a row of the reader or one here. Entries of the wrong type in a document of
    the right kind are named, too. An empty table gives no rows.
    """
    v = F.col("_v")
    part = lambda path, type_: F.try_variant_get(v, path, type_)
    array, fields_ = part("$", "array<variant>"), part("$", "map<string,variant>")
    entry = lambda e, name, type_="string": F.try_variant_get(e, f"$.{name}", type_)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    if kind == "catalog":
        found = F.coalesce(array, F.map_values(fields_))
        wrong = lambda e: F.when(blank(F.when(array.isNotNull(), entry(e, "Name")).otherwise(entry(e, "en"))), "no name")
    elif kind == "signatures":
        found = F.coalesce(array, part("$.signatures", "array<variant>"))
        size = lambda e: F.size(entry(e, "signature", "array<variant>"))
        wrong = lambda e: F.when(entry(e, "signature", "array<variant>").isNull(), "no signature").when(size(e) != length, F.concat(F.lit("signature of "), size(e).cast("string"))).when(blank(entry(e, "name")), "no name")
    elif kind == "truth":
        known = F.filter(F.map_keys(fields_), lambda k: F.lower(k).isin("name", "sourceimage"))
        found = F.when(F.size(known) > 0, F.array(v))
        wrong = lambda e: F.lit(None).cast("string")
    else:
        raise ValueError(f"no reader of {kind}")
    whole = F.when(F.coalesce(F.col("text").rlike(r"^\s*$"), F.lit(True)), "empty").when(v.isNull(), "not JSON").when(found.isNull(), f"not a document of kind {kind}").when(F.size(found) == 0, "no entries")
    entries = F.filter(F.transform(found, lambda e, i: F.struct(i.alias("entry"), wrong(e).alias("reason"))), lambda r: r["reason"].isNotNull())
    rows = texts.select("path", "text", F.try_parse_json("text").alias("_v")).select("path", whole.alias("_whole"), entries.alias("_entries"))
    none = F.array(F.struct(F.lit(None).cast("int").alias("entry"), F.col("_whole").alias("reason")))
    return rows.select("path", F.inline(F.when(F.col("_whole").isNotNull(), none).otherwise(F.col("_entries"))))


def any_case(text: str, names: Sequence[str]) -> Column:
    """A JSON text whose keys are written as in names, whatever their case was."""
    out = F.col(text)
    for n in names:
        out = F.regexp_replace(out, rf'(?i)"{n}"(\s*:)', rf'"{n}"$1')
    return out


def with_images(rows: DataFrame, files: DataFrame, image: str = "sourceImage", file_path: str = "path") -> DataFrame:
    """rows whose image is among files, by base name (SRC10, J12)."""
    base = lambda c: F.lower(F.element_at(F.split(c, r"[/\\\\]"), -1))
    known = files.select(base(F.col(file_path)).alias("_file")).distinct()
    return rows.join(known, base(rows[image]) == F.col("_file"), "left_semi")


def edits(texts: DataFrame) -> DataFrame:
    """One row for each edited entry of verified-edit documents, with its place (SRC13)."""
    doc = F.from_json("text", f"struct<{_struct(EDITS)}>")
    return texts.select(doc["ExportedAt"].alias("exported_at"), F.posexplode(doc["Echoes"]).alias("pos", "e")).select("exported_at", "pos", "e.*")


def newest(files: DataFrame, path: str, *patterns: str) -> DataFrame:
    """The greatest path by name that matches one of the SQL patterns (SRC12, SRT4)."""
    hit = F.lit(not patterns)
    for p in patterns:
        hit = hit | F.col(path).like(p)
    return files.where(hit).agg(F.max(path).alias(path))


def json_value(text: Column, path: str, kind: str) -> Column:
    """A value inside a JSON text as kind, or null (SRC14)."""
    return F.get_json_object(text, path).try_cast(kind)


def _names(ddl: str) -> list[str]:
    """All field names of a schema."""
    return list(dict.fromkeys(re.findall(r"(\w+)[ :](?:int|string|boolean|float|double|map|struct|array|timestamp)", ddl)))


def _struct(ddl: str) -> str:
    depth, out, at_name = 0, [], True
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == " " and at_name and depth == 0 and out and out[-1] not in (",", " "):
            out.append(":")
            at_name = False
            continue
        if ch == "," and depth == 0:
            at_name = True
        out.append(ch)
    return "".join(out).replace(", ", ",")
