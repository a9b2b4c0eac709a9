"""Whole sessions: from engine reads to reviewed, exported and scored rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import consistency, export, gate, payload, resolve, review, score, slots
from ..sources.readers import Options
from ..storage import exists, stage
from ..streaming.folder import drain_folder

REGIONS = ["name", "cost", "level", "main", "second", "set", "icon"]
#: What a value put together from a label and a number, and one read again, are worth at most; the least score of a set's own line.
SPLIT_CAP, RETRY_CAP, SET_LINE = 0.88, 0.80, 0.55
ENTRIES = "array<struct<slot:int,key:string,value:float,snapped:float,confidence:float,state:string>>"
#: An image's reads, lines and lines read again, one JSON object a line.
READ = "region:string,engine:string,psm:string,preprocess:string,attempt:int,text:string,confidence:double"
LINE = "line_no:int,attempt:int,y:double,text:string,confidence:double"
AGAIN = "slot:int,text:string,confidence:double"
IMAGES = f"image_file string, rarity int, equipped_by string, reads array<struct<{READ}>>, lines array<struct<{LINE}>>, retries array<struct<{AGAIN}>>"


@dataclass(frozen=True)
class Rules:
    """The tables a session needs; all are small and come from the caller."""

    aliases: Sequence[tuple[str, str]]
    percent_of: Mapping[str, str]
    percent_keys: Sequence[str]
    legal: Mapping[str, Sequence[float]]
    confusions: Sequence[tuple[str, str]]
    centres: Sequence[float]
    headers: Sequence[str] = ()
    sets: Sequence[str] = field(default_factory=list)
    set_headers: Sequence[str] = ("set",)
    decimal_shift: bool = True
    #: Whether an entry that is the main value once more goes (SL7).
    drop_main_copies: bool = False

    def parse(self, c: Column) -> Column:
        return text.parse_line(c, self.aliases, dict(self.percent_of), self.percent_keys)

    def resolve(self, key: Column, value: Column) -> Column:
        return rules.resolve_value(key, value, self.legal, self.confusions, key.isin(list(self.percent_keys)), self.decimal_shift)


def best_reads(reads: DataFrame, options: Options | None = None) -> DataFrame:
    """(image_file, region, text, confidence, origin): the first attempt with a text of each region, by attempt and engine (QG4, QG5).

    With options, names are read by their preferred engine first; without its fallback no
    second attempt counts.
    """
    short = (F.length(F.trim(F.coalesce("text", F.lit("")))) < 2).cast("int")
    order = [short, F.col("attempt"), F.desc_nulls_last("confidence"), F.col("engine")]
    if options is not None:
        reads = reads if options.engine_fallback else reads.where("attempt <= 1")
        order.insert(1, F.coalesce((F.col("region") == "name") & (F.lower("engine") != options.name_engine.lower()), F.lit(False)).cast("int"))
    first = reads.withColumn("_k", F.row_number().over(Window.partitionBy("image_file", "region").orderBy(*order))).where("_k = 1")
    return first.select("image_file", "region", "text", "confidence", gate.provenance(F.col("engine"), F.col("psm"), F.col("preprocess"), F.col("attempt")).alias("origin"))


def _names(base: DataFrame, catalog: DataFrame, o: Options) -> DataFrame:
    """(image_file, name, name_score, ambiguous, contradicts, entry_cost, legal_sets): the name cascade within the cost's pool (ER7, ER10, J7)."""
    pool = F.col("q_cost").isNull() | (F.col("q_cost") == F.col("c_cost"))
    found = resolve.name_in_pool(base.select("image_file", "query", "cost"), catalog.select("name", "cost"), "image_file", "query", "name", pool, accept=o.accept_score, stop=o.rescue_score, threshold=o.name_threshold)
    direct = resolve.match(base.select("image_file", "query"), catalog.select("name"), "image_file", "query", "name", o.name_threshold).select("image_file", "ambiguous")
    # a name may have several costs; it is one image all the same
    sets = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))) if "sets" in catalog.columns else F.first(F.lit(None).cast("array<string>"))
    one = catalog.groupBy(F.col("name").alias("_name")).agg(F.array_sort(F.collect_set("cost")).alias("_costs"), sets.alias("legal_sets"))
    out = base.select("image_file", "cost").join(found, "image_file").join(direct, "image_file").join(one, F.col("entry") == F.col("_name"), "left")
    entry_cost = F.when(F.array_contains("_costs", F.coalesce("cost", F.lit(-1))), F.col("cost")).otherwise(F.get("_costs", F.lit(0)))
    out = out.withColumn("entry_cost", entry_cost)
    return out.select("image_file", F.col("entry").alias("name"), resolve.contradicted(F.col("score"), F.col("cost"), F.col("entry_cost")).alias("name_score"), "ambiguous", (F.col("contradicts") & F.col("cost").isNotNull()).alias("contradicts"), "entry_cost", "legal_sets")


def _entries(lines: DataFrame, again: DataFrame | None, base: DataFrame, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Entries by slot, and (image_file, collided, entry_flags): filling, parts put together, acceptance, retries (SL4-SL9)."""
    lines = lines if "attempt" in lines.columns else lines.withColumn("attempt", F.lit(1))
    placed = slots.fill(lines, "image_file", "line_no", "y", "text", r.centres, r.parse, text.is_header(F.col("text"), list(r.headers)), lambda p: r.resolve(p["key"], p["value"])["value"].isNotNull())
    part = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    slot = placed.where("role in ('row', 'label', 'value')").groupBy("image_file", "slot").agg(part("row", "text").alias("row"), part("row", "confidence").alias("c"), slots.recombine(part("label", "text"), part("value", "text")).alias("split"), F.least(part("value", "confidence"), F.lit(SPLIT_CAP)).alias("split_c"))
    slot = slot.withColumn("p", r.parse(F.coalesce("row", "split"))).where("p is not null")
    rows = slot.select("image_file", F.col("slot").cast("int").alias("slot"), F.col("p.key").alias("key"), F.col("p.value").alias("value"), F.when(F.col("row").isNotNull(), F.col("c")).otherwise(F.col("split_c")).alias("confidence"))
    rows = rows.join(base.select("image_file", "main"), "image_file")
    copy = slots.duplicates_main(F.col("main.key"), F.col("main.value"), F.col("key"), F.col("value")) & F.lit(r.drop_main_copies)
    rows = rows.where(~copy).drop("main")
    checked = slots.accepted(rows, "image_file", "key", "slot", list(r.legal))
    kept = checked.where("flag is null").drop("flag")
    retried = kept.limit(0)
    if again is not None:
        second = again.withColumn("p", r.parse(F.col("text"))).where("p is not null").join(base.select("image_file", "main", "wanted"), "image_file")
        second = second.select("image_file", "slot", F.col("p.key").alias("key"), F.col("p.value").alias("value"), "confidence", "main", "wanted")
        ok = r.resolve(F.col("key"), F.col("value"))["value"].isNotNull()
        main = slots.duplicates_main(F.col("main.key"), F.col("main.value"), F.col("key"), F.col("value"))
        retried = slots.accept_retries(kept, second, "image_file", list(r.legal), main, ok, F.col("wanted"), RETRY_CAP).select(*kept.columns)
    every = kept.withColumn("cap", F.lit(1.0)).unionByName(retried.withColumn("cap", F.lit(RETRY_CAP)))
    every = every.withColumn("res", r.resolve(F.col("key"), F.col("value")))
    entry = F.struct("slot", "key", "value", F.col("res.value").alias("snapped"), gate.line_confidence(F.col("confidence"), F.col("res.state"), F.col("cap")).alias("confidence"), F.col("res.state").alias("state"))
    entries = every.groupBy("image_file").agg(F.array_sort(F.collect_list(entry)).alias("substats"), F.count_if(F.col("cap") < 1).alias("recovered"))
    trouble = placed.groupBy("image_file").agg(F.bool_or(F.col("role") == "collision").alias("collided"))
    flagged = checked.where("flag is not null").groupBy("image_file").agg(F.array_sort(F.collect_set("flag")).alias("entry_flags"))
    return entries, trouble.join(flagged, "image_file", "left")


def _set(base: DataFrame, named: DataFrame, r: Rules, o: Options) -> DataFrame:
    """(image_file, sonata, sonata_confidence, sonata_source, settles): icon, text zone, heading's line, catalog (ER11-ER13)."""
    spark = base.sparkSession
    sets = spark.createDataFrame([(s,) for s in r.sets], "name string")
    zone = resolve.zone_set(base.select("image_file", "set_text"), "image_file", "set_text", sets, "name", o.set_threshold).select("image_file", F.col("value").alias("zone"), F.col("confidence").alias("zone_c"))
    lines = text.lines_of(F.coalesce("set_text", F.lit("")))
    rows = base.select("image_file", "icon_text", "icon_confidence", text.header_index(F.transform(lines, F.lower), *(w.lower() for w in r.set_headers)).alias("at"), F.coalesce(resolve.after_header(lines, *r.set_headers), F.lit("")).alias("line"))
    near = resolve.match(rows.select("image_file", "line"), sets, "image_file", "line", "name", SET_LINE).select("image_file", F.col("entry").alias("matched"), F.col("score").alias("line_c"))
    rows = rows.join(zone, "image_file", "left").join(near, "image_file").join(named.select("image_file", "legal_sets"), "image_file")
    legal = F.col("legal_sets")
    choice = F.coalesce(
        resolve.arbitrate(F.col("icon_text"), F.col("icon_confidence"), F.col("zone"), F.col("zone_c"), legal),
        F.when(F.col("zone").isNotNull(), F.struct(F.col("zone").alias("value"), F.col("zone_c").cast("float").alias("confidence"), F.lit("text").alias("source"), F.lit(False).alias("settles"))),
        resolve.without_icon(F.col("at"), F.col("line"), F.col("matched"), F.col("line_c"), legal),
    )
    out = rows.withColumn("_s", choice)
    return out.select("image_file", F.col("_s.value").alias("sonata"), F.col("_s.confidence").alias("sonata_confidence"), F.col("_s.source").alias("sonata_source"), F.coalesce("_s.settles", F.lit(False)).alias("settles"))


def recognise(reads: DataFrame, lines: DataFrame, catalog: DataFrame, r: Rules, retries: DataFrame | None = None, mains: DataFrame | None = None, seconds: DataFrame | None = None, rarity: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """One row for each image_file: what was resolved, with confidences, entries, all flags and needs_review.

    reads, lines and retries (lines read again for a slot) are engine output; catalog has
    name, cost and, where sets count, sets. mains and seconds are the value ranges of the
    consistency solver, which without them says nothing; rarity has image_file and rarity (5
    where unknown) of all images. An image that nothing can be read from stays, with nulls and flags.
    """
    o = options or Options()
    spark = reads.sparkSession
    first = stage(best_reads(reads, options), "best reads")
    wide = first.groupBy("image_file").pivot("region", REGIONS).agg(F.first("text").alias("text"), F.first("confidence").alias("confidence"))
    variant = text.strip_variant(text.clean_text(F.col("name_text")))
    base = wide.select(
        "image_file", variant["variant"].alias("variant"), variant["name"].alias("query"), text.parse_cost(F.col("cost_text")).alias("cost"), "cost_confidence", text.parse_level(F.col("level_text")).alias("level"), "level_confidence",
        r.parse(F.col("main_text")).alias("main"), "main_confidence", r.parse(F.col("second_text")).alias("second"), "set_text", "icon_text", "icon_confidence",
    )
    ranks = (rarity if rarity is not None else spark.createDataFrame([], "image_file string, rarity int")).groupBy("image_file").agg(F.max("rarity").alias("rarity"))
    base = base.join(ranks, "image_file", "left" if rarity is None else "full").withColumns({"rarity": F.coalesce("rarity", F.lit(5)), "query": F.coalesce("query", F.lit("")), "variant": F.coalesce("variant", F.lit(False))})
    base = stage(base, "reads")
    named = stage(_names(base, catalog, o), "names")
    base = base.join(named.select("image_file", "entry_cost"), "image_file").withColumn("read_cost", F.col("cost")).withColumn("cost", F.coalesce("cost", "entry_cost"))
    for column, source in (("main_key", "main.key"), ("main_value", "main.value"), ("second_key", "second.key"), ("second_value", "second.value")):
        base = base.withColumn(column, F.col(source))
    if mains is not None and seconds is not None:
        base = consistency.solve(base, mains, seconds)
    else:
        base = base.withColumns({"level_read": F.col("level"), "second_off": F.lit(False), "consistency": F.array().cast("array<string>")})
    base = stage(base.withColumn("wanted", rules.expected_count(F.col("level"))), "resolved reads")

    entries, trouble = _entries(lines, retries, base, r)
    out = base.drop("entry_cost").join(named, "image_file").join(entries, "image_file", "left").join(trouble, "image_file", "left").join(_set(base, named, r, o), "image_file")
    out = out.withColumn("substats", slots.purge(F.coalesce("substats", F.array().cast(ENTRIES)), F.coalesce("wanted", F.lit(0)), list(r.legal)))
    count, state = F.size("substats"), lambda s: F.exists("substats", lambda x: x["state"] == s)
    solver, mine = (lambda f: F.array_contains("consistency", f)), lambda f: F.array_contains("entry_flags", f)
    flags = rules.all_flags(
        NameContradictsEvidence=F.col("contradicts") & ~F.col("settles"), LevelUnparsed=F.col("level").isNull(), CostNameMismatch=F.col("read_cost") != F.col("entry_cost"), MainStatInvalidForCost=solver("MainStatInvalidForCost"),
        LevelCorrectedByStats=solver("LevelCorrectedByStats"), MainValueImpossible=solver("MainValueImpossible"), SecondMainStatInvalid=solver("SecondMainStatInvalid"), SlotCollision=F.col("collided"),
        InvalidSubstatKey=mine("InvalidSubstatKey"), SubstatDuplicate=mine("SubstatDuplicate"), AmbiguousRoll=state("Ambiguous"), NotARoll=state("NotARoll"), SubstatShort=count < F.col("wanted"), SubstatExcess=count > F.col("wanted"),
    )
    cost_confidence = F.when(F.col("read_cost").isNotNull(), F.coalesce("cost_confidence", F.lit(0.5))).when(F.col("entry_cost").isNotNull(), 0.5).otherwise(0.0)
    shown = F.when(F.col("variant") & F.col("name").isNotNull(), F.concat(F.lit("Phantom: "), "name")).otherwise(F.col("name"))
    out = out.withColumns({"flags": flags, "cost_confidence": cost_confidence, "name": shown, "recovered": F.coalesce("recovered", F.lit(0))})
    required = [F.col("name"), F.col("main"), *([F.col("sonata")] if r.sets else [])]
    doubt = gate.needs_review(F.array().cast("array<string>"), required, F.col("flags"), count, F.col("wanted"), [F.col("name_score"), F.col("level_confidence"), F.col("cost_confidence")], F.transform("substats", lambda s: s["confidence"]), o.review_confidence)
    return out.select(
        "image_file", "variant", "name", "name_score", "ambiguous", "cost", "cost_confidence", "rarity", "level", "level_read", "level_confidence", "main", "main_confidence", "second", "second_off",
        "sonata", "sonata_confidence", "sonata_source", "substats", "recovered", "flags", doubt.alias("needs_review"),
    )


def evaluate(truth: DataFrame, scans: DataFrame, key: str, fields: Mapping[str, tuple[str, str, bool]], evidence: DataFrame | None = None, retries: DataFrame | None = None, note: str = "") -> dict[str, DataFrame]:
    """Scores of all fields, exact matches, and confusions of scans against truth; with evidence the parts of a report too (AC1-AC7, SNK5)."""
    scores = score.field_scores(truth.join(scans, key, "left"), key, fields)
    out = {"scores": scores, "exact": score.exact_matches(scores, key), "confusions": score.top_confusions(scores, "expected", "actual")}
    if evidence is not None:
        out["report"], out["failed"], _ = score.accuracy_report(score.with_evidence(scores, evidence, key), key, note, retries).values()
    return out


def export_session(scans: DataFrame, policy: str = export.STRICT) -> DataFrame:
    """scans with reasons and exported."""
    fatal = export.fatal_reasons(F.col("name"), F.col("cost"), F.col("level"), F.col("sonata"), F.col("main.key"), F.col("main.value"))
    return export.decide(scans, fatal, export.degradations(F.col("substats"), F.col("level")), policy)


class Stopped(Exception):
    """Asked to stop before a batch."""


def enter(spark: SparkSession, out: str, number: int) -> None:
    """Put a batch into the ledger."""
    spark.range(1).select(F.lit(number).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").json(f"{out}/ledger/{number}")


def committed(spark: SparkSession, out: str) -> DataFrame:
    """Scans of all batches that the ledger holds; of an image read in several batches those of the last one."""
    rows = spark.read.option("basePath", f"{out}/scans").parquet(f"{out}/scans/batch=*").join(spark.read.json(f"{out}/ledger/*", schema="batch long"), "batch", "left_semi")
    last = rows.groupBy("image_file").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["image_file", "batch"], "left_semi")


def scan_folder(spark: SparkSession, source: str, out: str, catalog: DataFrame, r: Rules, mains: DataFrame | None = None, seconds: DataFrame | None = None, options: Options | None = None, files: int = 100, stop: Callable[[], bool] = lambda: False) -> bool:
    """Recognise what a folder of image documents (``IMAGES``) holds and hasn't been recognised; False if asked to stop before the end.

    Each batch of files is written to a folder named by the batch's number, then entered in
    the ledger. A batch that was cut off is read again under the same number and takes the
    place of what was left of it; one that is in the ledger is not written twice. stop is
    asked before a batch begins, so a batch that runs is finished first. An image is whole
    within its document.
    """

    def each(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        if exists(s, f"{out}/ledger/{number}/_SUCCESS"):
            return
        if stop():
            raise Stopped
        images = stage(batch, "images")
        nested = lambda c: images.select("image_file", F.inline(c))
        scans = recognise(nested("reads"), nested("lines"), catalog, r, nested("retries"), mains, seconds, images.select("image_file", "rarity"), options)
        who = images.groupBy("image_file").agg(F.max("equipped_by").alias("equipped_by"))
        scans.join(who, "image_file").write.mode("overwrite").parquet(f"{out}/scans/batch={number}")
        enter(s, out, number)

    query = drain_folder(spark, source, IMAGES, each, f"{out}/checkpoint", "json", files)
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if Stopped.__name__ not in str(e):
            raise
        return False
    return True


def run_session(spark: SparkSession, source: str, out: str, catalog: DataFrame, r: Rules, millis: int, exported_at: str, mains: DataFrame | None = None, seconds: DataFrame | None = None, edits: DataFrame | None = None, policy: str = export.STRICT, options: Options | None = None, files: int = 100, stop: Callable[[], bool] = lambda: False) -> dict[str, DataFrame] | None:
    """From a folder of reads to scans, export documents, quarantine and accounts; None if stopped, to go on when called again.

    edits have image_file, name, level and at, the time of the edit. Written below out: scans,
    backup, quarantine (a document a line). The same input gives the same rows and documents,
    however its files arrive and however often the run was cut off.
    """
    if not scan_folder(spark, source, out, catalog, r, mains, seconds, options, files, stop):
        return None
    scans = committed(spark, out).drop("batch")
    if edits is not None:
        scans = review.overlay(scans, edits, "image_file", ["name", "level"], ["at"])
    decided = stage(export_session(scans, policy), "decided")
    items = decided.where("exported").select(
        "image_file", F.regexp_replace("name", "^Phantom: ", "").alias("name"), "cost", "rarity", "level", "sonata", F.col("main.key").alias("main_key"), F.col("main.value").alias("main_value"), "equipped_by",
        F.transform(F.filter("substats", lambda s: s["snapped"].isNotNull()), lambda s: F.struct(s["key"].alias("key"), s["snapped"].alias("value"))).alias("substats"), F.lit(1).alias("session"),
    )
    backup = payload.backup_documents(payload.backup_items(items, list(r.legal), millis, ["image_file"]), "session", exported_at, "1")
    held = export.quarantine_documents(decided.where(~F.col("exported")).withColumn("session", F.lit(1)), "session", "image_file")
    for name, docs in (("backup", backup), ("quarantine", held)):
        docs.select("json").write.mode("overwrite").text(f"{out}/{name}")
    return {"scans": decided, "backup": spark.read.text(f"{out}/backup"), "quarantine": spark.read.text(f"{out}/quarantine"), "accounts": export.accounting(decided, F.col("exported"), ~F.col("exported"))}
