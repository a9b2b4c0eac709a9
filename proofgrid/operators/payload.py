"""Export documents and the rules that they have to satisfy.

Two layouts: a backup, whose items have an id, a set and up to five distinct entries, and an
artifact document of the open GOOD format, version 3. Items that a layout can't hold are
skipped and counted, never mended. The rules look at the JSON text as it is (through
variants), so that a missing field, a null and a value of a wrong kind are told apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import camel_key, sanitize_key
from .documents import document_lines
from .export import with_export_ids

# Fixed values of the two layouts.
COSTS, RARITIES, LEVELS = (1, 3, 4), (1, 5), (0, 25)
BACKUP_SCHEMA, MOST_ENTRIES, MOST_ARTIFACT_ENTRIES, ARTIFACT_LEVEL = 7, 5, 9, 20
COLLECTIONS = "characters weapons builds teams equippedLoadouts theorycraftBuilds optimizerProfiles optimizerRuns".split()
ORIGINS = ("scan", "screenshot", "manual", "import")
BACKGROUNDS, GENDERS = ("signal", "tacet", "plain"), ("male", "female")
INTERVAL, MOST_WEIGHT, MOST_MINIMUM = (250, 10_000), 4, 500
SETTINGS = (
    '{"displayName":"Resonator","uid":"","privacyMode":false,"background":"signal","scanIntervalMs":900,"roverGender":"male","liveCharacterArt":true,'
    '"scoreWeights":{},"characterSubstatWeights":{},"characterEnergyRegenMinimums":{}}'
)
ARTIFACT_KEYS = {
    "Hp": "hp", "HpPercent": "hp_", "Atk": "atk", "AtkPercent": "atk_", "Def": "def", "DefPercent": "def_", "CritRate": "cr", "CritDamage": "cd", "EnergyRegen": "enerRech", "HealingBonus": "heal_",
    "ElectroDamage": "electro_dmg_", "FusionDamage": "pyro_dmg_", "GlacioDamage": "cryo_dmg_", "AeroDamage": "anemo_dmg_", "SpectroDamage": "geo_dmg_", "HavocDamage": "physical_dmg_",
    "BasicDamage": "physical_dmg_", "HeavyDamage": "physical_dmg_", "SkillDamage": "physical_dmg_", "LiberationDamage": "physical_dmg_",
}
OTHER_KEY, OTHER_SET, SLOTS = "eleMas", "UnknownSet", {1: "flower", 3: "sands", 4: "circlet"}


def artifact_key(key: Column) -> Column:
    """A key in the artifact format's words (EXP10)."""
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in ARTIFACT_KEYS.items()), F.lit(OTHER_KEY))


def artifact_slot(cost: Column) -> Column:
    """The artifact format's slot of a cost (EXP10)."""
    return F.coalesce(*(F.when(cost == c, F.lit(s)) for c, s in SLOTS.items()), F.lit(SLOTS[1]))


def artifact_set(name: Column) -> Column:
    """A set's name as a key (EXP10)."""
    flat = sanitize_key(F.coalesce(name, F.lit("")))
    return F.when(flat == "", F.lit(OTHER_SET)).otherwise(flat)


def _in_range() -> Column:
    ok = F.col("cost").isin(list(COSTS)) & F.col("rarity").between(*RARITIES) & F.col("level").between(*LEVELS) & (F.trim("sonata") != "")
    return F.coalesce(ok, F.lit(False))


def _two_places(c: Column) -> Column:
    return F.bround(c.cast("double") * 100) / 100


def _blank_or_unknown(c: Column) -> Column:
    return F.coalesce((F.trim(c) == "") | (F.lower(c) == "unknown"), F.lit(True))


def backup_items(df: DataFrame, keys: Sequence[str], millis: int, order: Sequence[str], group: str | None = None, prefix: str = "item") -> DataFrame:
    """df (name, cost, rarity, level, sonata, main_key, main_value, substats, equipped_by) with skipped, index, item (EXP3).

    substats are (key, value). An item is skipped if the layout can't hold it; of its entries
    the first of each known key counts, five at most; values are rounded to two places, half
    to even. The index and createdAt run over kept items only.
    """
    known = F.filter("substats", lambda s: F.coalesce(s["key"].isin(list(keys)), F.lit(False)))
    names = F.transform(known, lambda s: s["key"])
    single = F.slice(F.filter(known, lambda s, i: F.array_position(names, s["key"]) == i + 1), 1, MOST_ENTRIES)
    entries = F.transform(single, lambda s: F.struct(camel_key(s["key"]).alias("key"), _two_places(s["value"]).alias("value")))
    ok = _in_range() & F.coalesce(F.col("main_key").isin(list(keys)), F.lit(False)) & (sanitize_key(F.coalesce("name", F.lit(""))) != "")
    rows = df.withColumn("skipped", ~ok).withColumn("_entries", F.coalesce(entries, F.array().cast("array<struct<key:string,value:double>>")))
    kept = with_export_ids(rows.where(~F.col("skipped")), group, order, F.col("name"), millis, prefix)
    who = F.trim("equipped_by")
    item = F.struct(
        F.col("export_id").alias("id"), "name", "cost", "rarity", "level", "sonata", F.struct(camel_key(F.col("main_key")).alias("key"), _two_places(F.col("main_value")).alias("value")).alias("mainStat"),
        F.col("_entries").alias("subStats"), F.lit(False).alias("locked"), F.lit(False).alias("excluded"), F.when(who != "", who).alias("equippedByName"), F.col("created_at").alias("createdAt"), F.lit("scan").alias("source"),
    )
    kept = kept.withColumn("item", item).drop("export_id", "created_at", "_entries")
    return kept.unionByName(rows.where("skipped").drop("_entries"), allowMissingColumns=True)


def artifact_items(df: DataFrame) -> DataFrame:
    """df (name, cost, rarity, level, sonata, main_key, main_value, substats, equipped_by) with skipped and item (EXP4).

    Entries keep repeats, nine at most, and their values unrounded; levels stop at the
    format's top and the true one goes along.
    """
    some = F.slice(F.filter("substats", lambda s: ~_blank_or_unknown(s["key"])), 1, MOST_ARTIFACT_ENTRIES)
    entries = F.transform(some, lambda s: F.struct(artifact_key(s["key"]).alias("key"), s["value"].cast("double").alias("value"), s["key"].alias("wuwaKey")))
    ok = _in_range() & ~_blank_or_unknown(F.col("main_key"))
    item = F.struct(
        artifact_set(F.col("sonata")).alias("setKey"), artifact_slot(F.col("cost")).alias("slotKey"), F.least("level", F.lit(ARTIFACT_LEVEL)).alias("level"), "rarity", artifact_key(F.col("main_key")).alias("mainStatKey"),
        F.coalesce("equipped_by", F.lit("")).alias("location"), F.lit(False).alias("lock"), F.coalesce(entries, F.array().cast("array<struct<key:string,value:double,wuwaKey:string>>")).alias("substats"),
        F.col("name").alias("wuwaName"), F.col("sonata").alias("wuwaSonata"), F.col("cost").alias("wuwaCost"), F.col("level").alias("wuwaLevel"), F.col("main_key").alias("wuwaMainStatKey"),
    )
    return df.withColumn("skipped", ~ok).withColumn("item", F.when(ok, item))


def _gathered(items: DataFrame, group: str, order: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.when(~F.col("skipped"), F.struct(F.col(order).alias("_o"), F.col("item")))))
    return items.groupBy(group).agg(F.transform(rows, lambda r: r["item"]).alias("_rows"), F.count_if("skipped").alias("skipped"))


def backup_documents(items: DataFrame, group: str, exported_at: str, data_version: str) -> DataFrame:
    """(group, skipped, json): a backup of each group's kept items, in index order (SNK2)."""
    empty = [F.array().cast("array<string>").alias(c) for c in COLLECTIONS]
    head = F.struct(F.lit(BACKUP_SCHEMA).alias("schemaVersion"), F.lit(data_version).alias("gameDataVersion"), F.lit(exported_at).alias("exportedAt"), F.col("_rows").alias("echoes"), *empty, F.from_json(F.lit(SETTINGS), _settings_type()).alias("settings"))
    return _gathered(items, group, "index").select(group, "skipped", F.to_json(head).alias("json"))


def backup_lines(items: DataFrame, group: str, exported_at: str, data_version: str) -> DataFrame:
    """The documents of backup_documents as lines, for groups of any size (SNK2)."""
    before = {"schemaVersion": F.lit(BACKUP_SCHEMA), "gameDataVersion": F.lit(data_version), "exportedAt": F.lit(exported_at)}
    after = {c: F.array().cast("array<string>") for c in COLLECTIONS} | {"settings": F.from_json(F.lit(SETTINGS), _settings_type())}
    return document_lines(items, group, "index", F.col("item"), "echoes", before, after, ~F.col("skipped"))


def _settings_type() -> str:
    weights = "map<string,map<string,double>>"
    return f"displayName string, uid string, privacyMode boolean, background string, scanIntervalMs int, roverGender string, liveCharacterArt boolean, scoreWeights {weights}, characterSubstatWeights {weights}, characterEnergyRegenMinimums map<string,double>"


def artifact_documents(items: DataFrame, group: str, order: str, origin: str) -> DataFrame:
    """(group, skipped, json): an artifact document of each group's kept items (SNK3)."""
    none = F.array().cast("array<string>")
    head = F.struct(F.lit("GOOD").alias("format"), F.lit(origin).alias("source"), F.lit(3).alias("version"), none.alias("characters"), F.col("_rows").alias("artifacts"), none.alias("weapons"))
    return _gathered(items, group, order).select(group, "skipped", F.to_json(head).alias("json"))


def artifact_lines(items: DataFrame, group: str, order: str, origin: str) -> DataFrame:
    """The documents of artifact_documents as lines, for groups of any size (SNK3)."""
    none = F.array().cast("array<string>")
    before = {"format": F.lit("GOOD"), "source": F.lit(origin), "version": F.lit(3), "characters": none}
    return document_lines(items, group, order, F.col("item"), "artifacts", before, {"weapons": none}, ~F.col("skipped"))


# Rules. A kind is the JSON type of a field: null if it is missing, VOID if it is null.
def kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _is(k: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | k.startswith(h)
    return F.coalesce(out, F.lit(False))


def is_number(k: Column) -> Column:
    return _is(k, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _value(v: Column, field: str, type_: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", type_)


def no_text(v: Column, field: str) -> Column:
    """Not a string with something in it (EXP7)."""
    return ~(_is(kind(v, field), "STRING") & F.coalesce(F.trim(_value(v, field, "string")) != "", F.lit(False)))


def no_boolean(v: Column, field: str) -> Column:
    return ~_is(kind(v, field), "BOOLEAN")


def no_number(v: Column, field: str, low: float | None = None, high: float | None = None) -> Column:
    """Not a finite number, or outside low to high."""
    x = _value(v, field, "double")
    ok = is_number(kind(v, field)) & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = ok & (x >= low) if low is not None else ok
    ok = ok & (x <= high) if high is not None else ok
    return ~F.coalesce(ok, F.lit(False))


def _no_cost(v: Column) -> Column:
    return ~(is_number(kind(v, "cost")) & F.coalesce(_value(v, "cost", "double").isin([float(c) for c in COSTS]), F.lit(False)))


def _not(v: Column, field: str, head: str) -> Column:
    return ~_is(kind(v, field), head)


def _said(where: Column, checks: Mapping[str, Column]) -> list[Column]:
    return [F.when(c, F.concat(where, F.lit(": " + m))) for m, c in checks.items()]


def _text_rule(v: Column, *fields: str) -> dict[str, Column]:
    return {f"{f} must be a non-empty string": no_text(v, f) for f in fields}


def _bool_rule(v: Column, *fields: str) -> dict[str, Column]:
    return {f"{f} must be a boolean": no_boolean(v, f) for f in fields}


def _line_rule(v: Column) -> dict[str, Column]:
    """A key and a finite value (EXP7)."""
    return _text_rule(v, "key") | {"value must be a finite number": no_number(v, "value")}


def _array(v: Column, field: str) -> Column:
    return F.coalesce(_value(v, field, "array<variant>"), F.array().cast("array<variant>"))


def _each(v: Column, field: str, where: Column, rules) -> Column:
    """Problems of each element of an array field."""
    return F.flatten(F.transform(_array(v, field), lambda s, i: F.array_compact(F.array(*_said(F.concat(where, F.lit(f"{field}["), i.cast("string"), F.lit("]")), rules(s))))))


def _weights(doc: Column, field: str, most: float | None, keys: Sequence[str]) -> Column:
    """Problems of a map of maps of weights."""
    outer = F.map_entries(F.coalesce(_value(doc, f"settings.{field}", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    inner = lambda e: F.map_entries(F.coalesce(F.try_variant_get(e["value"], "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))

    def bad(w: Column) -> Column:
        x = F.try_variant_get(w["value"], "$", "double")
        ok = w["key"].isin(list(keys)) & is_number(F.schema_of_variant(w["value"])) & (x >= 0)
        return ~F.coalesce(ok & (x <= most) if most is not None else ok, F.lit(False))

    def problems(e: Column) -> Column:
        name = F.concat(F.lit(f"settings: {field}."), e["key"])
        wrong = F.transform(F.filter(inner(e), bad), lambda w: F.concat(name, F.lit("."), w["key"], F.lit(" must be a known stat key with a numeric weight")))
        return F.when(_is(F.schema_of_variant(e["value"]), "OBJECT"), wrong).otherwise(F.array(F.concat(name, F.lit(" must be an object"))))

    k = kind(doc, f"settings.{field}")
    shape = F.array(F.lit(f"settings: {field} must be an object"))
    return F.when(k.isNull(), F.array().cast("array<string>")).when(_is(k, "OBJECT"), F.flatten(F.transform(outer, problems))).otherwise(shape)


def _minimums(doc: Column) -> Column:
    field = "characterEnergyRegenMinimums"
    entries = F.map_entries(F.coalesce(_value(doc, f"settings.{field}", "map<string,variant>"), F.create_map().cast("map<string,variant>")))

    def bad(e: Column) -> Column:
        return ~F.coalesce(is_number(F.schema_of_variant(e["value"])) & F.try_variant_get(e["value"], "$", "double").between(0, MOST_MINIMUM), F.lit(False))

    k = kind(doc, f"settings.{field}")
    wrong = F.transform(F.filter(entries, bad), lambda e: F.concat(F.lit(f"settings: {field}."), e["key"], F.lit(f" must be 0..{MOST_MINIMUM}")))
    return F.when(k.isNull(), F.array().cast("array<string>")).when(_is(k, "OBJECT"), wrong).otherwise(F.array(F.lit(f"settings: {field} must be an object")))


def _settings(doc: Column, keys: Sequence[str]) -> Column:
    s = lambda f: f"settings.{f}"
    has = lambda f: kind(doc, s(f)).isNotNull()
    text_if_any = lambda f: has(f) & _not(doc, s(f), "STRING")
    one_of = lambda f, some: F.coalesce(_value(doc, s(f), "string").isin(list(some)), F.lit(False)) & _is(kind(doc, s(f)), "STRING")
    checks = {
        "displayName must be a non-empty string": no_text(doc, s("displayName")), "privacyMode must be a boolean": no_boolean(doc, s("privacyMode")), "uid must be a string when present": text_if_any("uid"),
        "background must be signal/tacet/plain": ~one_of("background", BACKGROUNDS), "roverGender must be a string when present": text_if_any("roverGender"),
        "roverGender must be male or female": _is(kind(doc, s("roverGender")), "STRING") & ~one_of("roverGender", GENDERS), f"scanIntervalMs must be a number {INTERVAL[0]}..{INTERVAL[1]}": no_number(doc, s("scanIntervalMs"), *INTERVAL),
    }
    found = F.concat(F.array_compact(F.array(*_said(F.lit("settings"), checks))), _weights(doc, "scoreWeights", None, keys), _weights(doc, "characterSubstatWeights", MOST_WEIGHT, keys), _minimums(doc))
    return F.when(_is(kind(doc, "settings"), "OBJECT"), found).otherwise(F.array(F.lit("envelope: settings must be an object")))


def _backup_item(e: Column, where: Column) -> Column:
    level = _value(e, "level", "int")
    fine = ~no_number(e, "level", *LEVELS) & (_value(e, "level", "double") == level)
    most = F.when(fine, F.greatest(F.lit(0), F.least(F.lit(MOST_ENTRIES), F.floor(level / 5)))).otherwise(MOST_ENTRIES)
    n = F.size(_array(e, "subStats"))
    main = F.try_variant_get(e, "$.mainStat", "variant")
    optional = {f"{f} must be a string when present": kind(e, f).isNotNull() & _not(e, f, "STRING") for f in ("equippedBy", "equippedByName")}
    checks = _text_rule(e, "id", "name") | {"cost must be 1, 3 or 4": _no_cost(e), "rarity must be 1..5": no_number(e, "rarity", *RARITIES), "level must be 0..25": ~F.coalesce(fine, F.lit(False))} | _text_rule(e, "sonata")
    checks |= {"mainStat must be an object": _not(e, "mainStat", "OBJECT")} | {m: _is(kind(e, "mainStat"), "OBJECT") & c for m, c in _line_rule(main).items()}
    checks |= {"subStats must be an array": _not(e, "subStats", "ARRAY"), "subStats exceed what the level allows": n > most} | _bool_rule(e, "locked", "excluded")
    checks |= {"createdAt must be a number": ~is_number(kind(e, "createdAt")), f"source must be one of {'/'.join(ORIGINS)}": ~(_is(kind(e, "source"), "STRING") & F.coalesce(_value(e, "source", "string").isin(list(ORIGINS)), F.lit(False)))} | optional
    found = F.concat(F.array_compact(F.array(*_said(where, checks))), _each(e, "subStats", F.concat(where, F.lit(".")), _line_rule))
    return F.when(_is(F.schema_of_variant(e), "OBJECT"), found).otherwise(F.array(F.concat(where, F.lit(": not an object"))))


def _artifact_item(a: Column, where: Column) -> Column:
    checks = _text_rule(a, "setKey", "slotKey", "mainStatKey") | {"level must be 0..25": no_number(a, "level", *LEVELS), "rarity must be 1..5": no_number(a, "rarity", *RARITIES)} | _bool_rule(a, "lock") | {"substats must be an array": _not(a, "substats", "ARRAY")}
    found = F.concat(F.array_compact(F.array(*_said(where, checks))), _each(a, "substats", F.concat(where, F.lit(".")), _line_rule))
    return F.when(_is(F.schema_of_variant(a), "OBJECT"), found).otherwise(F.array(F.concat(where, F.lit(": not an object"))))


def _problems(df: DataFrame, key: str, json_col: str, head, items: str, rule) -> DataFrame:
    """(key, problem) of documents by rules over the envelope and over each item; an item is a row of its own."""
    doc = df.select(F.col(key), F.try_parse_json(json_col).alias("doc"))
    broken = F.col("doc").isNull()
    shape = F.when(broken, F.array(F.lit("envelope: not valid JSON"))).when(~_is(F.schema_of_variant("doc"), "OBJECT"), F.array(F.lit("envelope: root is not an object")))
    top = doc.select(key, F.explode(F.coalesce(shape, head(F.col("doc")))).alias("problem"))
    each = doc.where(_is(kind(F.col("doc"), items), "ARRAY")).select(key, F.posexplode(_array(F.col("doc"), items)).alias("_i", "_e"))
    where = F.concat(F.lit(f"{items}["), F.col("_i").cast("string"), F.lit("]"))
    return top.unionByName(each.select(key, F.explode(rule(F.col("_e"), where)).alias("problem")))


def backup_problems(df: DataFrame, key: str, json_col: str, keys: Sequence[str]) -> DataFrame:
    """(key, problem) of backups; none for valid ones (EXP5). keys are the known keys in camel case."""

    def head(d: Column) -> Column:
        version = no_number(d, "schemaVersion", 1, BACKUP_SCHEMA)
        checks = {f"schemaVersion must be 1..{BACKUP_SCHEMA}": version} | _text_rule(d, "gameDataVersion", "exportedAt") | {f"{c} must be an array": _not(d, c, "ARRAY") for c in (*COLLECTIONS, "echoes")}
        return F.concat(F.array_compact(F.array(*_said(F.lit("envelope"), checks))), _settings(d, keys))

    return _problems(df, key, json_col, head, "echoes", _backup_item)


def artifact_problems(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, problem) of artifact documents; none for valid ones (EXP6)."""

    def head(d: Column) -> Column:
        checks = _text_rule(d, "format", "source") | {"version must be 3": no_number(d, "version", 3, 3), "artifacts must be an array": _not(d, "artifacts", "ARRAY")}
        return F.array_compact(F.array(*_said(F.lit("envelope"), checks)))

    return _problems(df, key, json_col, head, "artifacts", _artifact_item)
